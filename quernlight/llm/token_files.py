"""Token-id output: Parquet files of list columns for training.

Documents are range-sorted by doc_id, encoded in that order (the sort key alone is
sampled, each text is encoded once) and written by Spark's Parquet writer, so that a
lost task is simply run again and a file is there whole or not at all. A row is

    part   the file's place in the order of files
    doc_id
    first  ids of the file that stand before this document's
    n_tokens
    ids    list<int>: the document's ids and the end id

in the second page version, with the ids dictionary-encoded or delta-encoded (to
choose), the counts delta-encoded, row groups and pages of given size, and column
and offset indexes, which the writer always makes. So counts are read without the
ids, a range of doc_id without the other pages, and a range of token positions
from few files, row groups and pages. A small table beside it, `parts`, holds
for each file the ids that stand before it.

A word's ids are made by the tokenizers library once and remembered by the worker; a
text that holds a special token's string is encoded by the library whole.

Defined cases: a null text counts as empty, and an empty text has just the end id; a
null doc_id comes first; rows of one doc_id stay in the order in which Spark reads
the table, and all of them are rows of the files (a hot id is dealt to many files); an empty table gives a folder without documents; other columns
are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .bpe import byte_symbols
from .shared import ensure_checkpoint_dir, kept

ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
#: Words that a worker remembers twice over: those met lately, and those met before them.
WORD_MEMORY = 300_000
ROWS = 256  # rows of a batch that goes back to Spark

#: The library's classes are taken from here below U+0250 and for common punctuation only.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞€]")


def _words(letters: str, numbers: str, spaces: str) -> re.Pattern:
    """The library's pattern for byte-level words, over the given character classes. Letters come
    first: no other part but numbers and the rest may begin with a space, and none of them with a letter."""
    return re.compile(
        f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{letters}{numbers}{spaces}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


_ASCII = _words("A-Za-z", "0-9", r"\t\n\x0b\x0c\r ")
_LATIN = _words("A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\x0b\x0c\r \x85\xa0")


class Encoder:
    """A byte-level tokenizer of the library with a memory of words; ids as 32-bit numbers (of the machine's order, little-endian here)."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.model = Tokenizer.from_str(source), Tokenizer.from_str(source)
        for t in (self.library, self.model):
            t.no_truncation()
            t.no_padding()
        self.model.pre_tokenizer = pre_tokenizers.Sequence([])  # takes words as they are, in characters that stand for bytes
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.symbols = str.maketrans({b: c for c, b in byte_symbols().items()})
        self.bytes_of = np.zeros(self.library.get_vocab_size(with_added_tokens=True), np.int64)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes_of[k] = len(token)
        self.lately: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _ASCII.findall(text)
        if not _OTHER.search(text):
            return _LATIN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _unknown(self, words: list[str]) -> list[bytes]:
        """Words go to the library's model together; the bytes of its tokens tell whose they are."""
        if self.library.normalizer is None:
            asked = b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words]).decode("latin-1").translate(self.symbols).split("\xff")
            (found,) = self.model.encode_batch_fast([asked], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<i4")
            ends, stops = np.cumsum(self.bytes_of[ids]), np.cumsum(list(map(len, asked)))
            cuts = np.searchsorted(ends, stops) + 1
            if len(ends) and cuts[-1] == len(ids) and (ends[cuts - 1] == stops).all():
                data, cuts = ids.tobytes(), [0, *(4 * cuts).tolist()]
                return [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return self._library(words)  # not each byte has a token

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Words of all texts are looked up together, and the unknown ones asked for together."""
        words: list[str] = []
        ends, whole = [], {}
        for k, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                whole[k] = self._library([text])[0]
            else:
                words += self.words(text)
            ends.append(len(words))
        ids = list(map(self.lately.get, words))
        if None in ids:
            missing, at = [], -1
            with suppress(ValueError):  # none is left
                while True:
                    missing.append(at := ids.index(None, at + 1))
            new = {words[k] for k in missing}
            found = {w: known for w in new if (known := self.before.get(w)) is not None} if self.before else {}
            unknown = [w for w in new if w not in found] if found else list(new)
            if unknown:
                found.update(zip(unknown, self._unknown(unknown)))
            for k in missing:
                ids[k] = found[words[k]]
            if len(self.lately) >= WORD_MEMORY:
                self.before, self.lately = self.lately, {}
            self.lately.update(found if max(map(len, found)) <= 64 else {w: i for w, i in found.items() if len(w) <= 64})
        return [whole[k] if k in whole else b"".join(ids[s:e]) for k, (s, e) in enumerate(zip([0, *ends], ends))]


def write_tokens(
    documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, delta: bool = False,
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the ids of all documents, in ascending order of id_col; returns the folder
    (a new one in the shared checkpoint folder, if none is named)."""
    spark = documents.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/quernlight-tokens-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Equal ids may be many: their rows deal them to more than one file.
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    fields = T.StructType([
        T.StructField("part", T.IntegerType()), rows.schema["doc_id"], T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    arrow, end = to_arrow_schema(fields), np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = source.value
        encoder = kept(("tokens", hash(text)), lambda: Encoder(text))
        part, first = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [i + end for i in encoder.encode_all(batch.column(1).to_pylist())]
                ends = np.cumsum([0] + [len(i) // 4 for i in ids])
                counts = np.diff(ends)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(first + ends[:-1]), pa.array(counts), lists], schema=arrow
                )
                first += int(ends[-1])

    encoded = rows.select("doc_id", "text").mapInArrow(run, fields)
    writer = encoded.write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#part", "true")
    if not delta:
        writer = writer.option("parquet.enable.dictionary#ids.list.element", "true")
    writer.parquet(f"{folder}/rows")
    parts = read_tokens(spark, folder).groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; Spark reads only the columns, row groups and pages that a query needs."""
    return spark.read.parquet(f"{folder}/rows")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """part, rows, tokens, base: one row for each file."""
    return spark.read.parquet(f"{folder}/parts")


def positions(spark: SparkSession, folder: str, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the named columns; without `ids` among them, no ids are read."""
    rows, parts = read_tokens(spark, folder), read_parts(spark, folder).select(F.col("part").alias("p"), "base")
    start = (F.col("base") + F.col("first")).alias("start")
    return rows.join(parts, F.col("part") == F.col("p")).select("doc_id", start, "n_tokens", *more)


def token_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """doc_id, start, ids of the documents that hold token positions start to stop (exclusive),
    ids cut to that range. Files outside it are skipped by their statistics, and if the range
    lies in one file, so are its pages."""
    parts = read_parts(spark, folder).where((F.col("base") < stop) & (F.col("base") + F.col("tokens") > start))
    low, high, base = parts.agg(F.min("part"), F.max("part"), F.min("base")).first()  # three numbers
    rows = read_tokens(spark, folder).where(F.col("part").between(low, high))
    if low is not None and low == high:
        rows = rows.where(F.col("first") < stop - base)
    begin = F.col("base") + F.col("first")
    rows = rows.join(parts.select(F.col("part").alias("p"), "base"), F.col("part") == F.col("p"))
    rows = rows.where((begin < stop) & (begin + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - begin, F.lit(0)).cast("int")
    keep = (F.least(F.lit(stop) - begin, F.col("n_tokens")).cast("int") - skip).alias("keep")
    return rows.select("doc_id", (begin + skip).alias("start"), F.slice("ids", skip + 1, keep).alias("ids"))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), as the files have them."""
    rows = positions(spark, folder, ("ids",))
    fields = T.StructType([*rows.schema.fields[:3], T.StructField("ids_crc32", T.LongType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(lists.flatten().to_numpy().astype("<u4").tobytes())
            ends = 4 * np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = pa.array(np.diff(ends) // 4, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts, pa.array(crc, pa.int64())], schema=arrow)

    return rows.mapInArrow(run, fields)
