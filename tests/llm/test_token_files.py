"""Token files against the library, read back from what is written."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quernlight.llm.queries import op13_token_files
from quernlight.llm.token_files import _LATIN, _OTHER, Encoder, positions, read_parts, read_tokens, token_digests, token_range, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(PATH))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def expected(library, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(library, text)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["", None, "a", " \n\t  x  ", "don't we'll  'S 'ss", "<|endoftext|> and <|endoftext|>", "½²³ 12 ª_º", "naïve — “quoted” €5…", "日本語 текст", "\x85\xa0 \x1c\x1f", "a" * 5000 + " b" * 5000, "x y​z퟿"]


def test_words_are_those_of_the_library(library):
    safe = [chr(c) for c in range(0x20AD) if not _OTHER.match(chr(c))]
    for c in safe:
        s = f"a{c}1{c}!{c}{c}a {c}b"
        assert _LATIN.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)], hex(ord(c))


def test_encoder_equals_library(library):
    rng = np.random.default_rng(4)
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    alphabet = list("ab'sd tlvreRE  \n\t019!?_-<|>éß½²—“€日́\U0001f600\x85\xa0\x1c")
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<i4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_texts_are_looked_up_together(library, monkeypatch):
    """The words of many texts that aren't known are asked for once, in one text of the model's."""
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    texts = [t for t in ODD if t is not None] + [f"word{i} ünd “{i}”" for i in range(200)]
    asked = []
    plain = Encoder._unknown
    monkeypatch.setattr(Encoder, "_unknown", lambda self, words: asked.append(len(words)) or plain(self, words))
    for _ in range(2):
        got = [np.frombuffer(i, "<i4").tolist() for i in encoder.encode_all(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked[0] > 200 and sum(asked[1:]) <= 2  # words beyond 64 characters aren't remembered


@pytest.mark.parametrize("delta", [False, True])
def test_files(spark, library, delta):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, "same id"), (7, "same id")]
    rows += [(1000 + i, f"document {i} " + "word " * (i % 50)) for i in range(500)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, part string, first int, ids int")
    folder = write_tokens(df.repartition(5), str(PATH), delta=delta, row_group_bytes=4096, page_bytes=512)
    got = sorted(map(tuple, token_digests(spark, folder).collect()), key=lambda r: r[1])
    want = expected(library, rows)
    # Rows of a null id come in the order of the table: compare them as a set of sizes.
    assert [r[1:] for r in got[2:]] == [r[1:] for r in want[2:]] and [r[0] for r in got] == [r[0] for r in want]
    assert sorted(r[2:] for r in got[:2]) == sorted(r[2:] for r in want[:2])
    groups, tokens = 0, 0
    for name in glob.glob(f"{folder.removeprefix('file:')}/rows/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = columns["ids.list.element"]
            assert ids.has_offset_index and columns["doc_id"].has_column_index
            assert ("DELTA_BINARY_PACKED" in ids.encodings) if delta else ("RLE_DICTIONARY" in ids.encodings)
            assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            tokens += meta.row_group(g).num_rows
    assert tokens == len(rows) and groups > len(glob.glob(f"{folder.removeprefix('file:')}/rows/*.parquet"))


def test_selective_reads(spark, library):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(300)]
    folder = write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), str(PATH))
    plan = positions(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens" in plan and "ids" not in plan.split("ReadSchema")[1].split(">")[0]
    flat = [x for r in sorted(rows) for x in ids_of(library, r[1])]
    parts = read_parts(spark, folder).orderBy("part").collect()
    assert sum(p["tokens"] for p in parts) == len(flat) and parts[-1]["base"] + parts[-1]["tokens"] == len(flat)
    for start, stop in [(0, 1), (100, 101), (333, 2500), (len(flat) - 3, len(flat) + 50), (0, len(flat)), (len(flat), len(flat) + 9)]:
        cut = sorted(token_range(spark, folder, start, stop).collect(), key=lambda r: r["start"])
        assert [x for r in cut for x in r["ids"]] == flat[start:stop]
    assert read_tokens(spark, folder).where("doc_id = 17").count() == 1


def test_empty_table(spark):
    folder = write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), str(PATH))
    assert token_digests(spark, folder).count() == 0 and token_range(spark, folder, 0, 10).count() == 0


def test_query_equals_library(spark, sf_dir, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, op13_token_files(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected(library, rows)
