import hashlib
import re

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernlight.llm.bpe import bpe_encode
from quernlight.llm.queries import tokenizer_path


def sets_of(text):
    """Word 5-grams, by the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[ \t\n\v\f\r]+", low) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_of_each_group(docs):
    """Every pair of documents compared; the smallest id of each component."""
    sets = [(r.doc_id, sets_of(r.text)) for r in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return {i for i in up if root(i) == i}


def with_live_secrets(docs):
    """Ids of documents that hold a value which looks alive and which less than four
    owners (repositories, of few owners, too) have."""
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    opaque = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
    texts, sources = {}, {}
    for r in docs:
        t = r.text or ""
        found = {m[1] for m in assign.finditer(t) if len(m[1]) >= 12}
        texts[t] = found | {m[0] for m in opaque.finditer(t) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])}
        sources.setdefault(t, set()).add(r.source)
    owners, repos = {}, {}
    for t, values in texts.items():
        for v in values:
            owners.setdefault(v, set()).update(s.split("/")[0] for s in sources[t])
            repos.setdefault(v, set()).update(sources[t])
    odd = ("example", "changeme", "placeholder", "xxxx", "0123456789", "your")
    alive = {v for v in owners if len(set(v)) >= 8 and not any(p in v.lower() for p in odd) and not (len(owners[v]) >= 4 and len(repos[v]) >= 4)}
    return {r.doc_id for r in docs if texts[r.text or ""] & alive}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    planted = [(10_000_000 + k, f"the token = '{v}' is here, number {k}", "en", f"src{k}/r", 50) for k, v in enumerate(["Zk83LmQp92XwRt56Yb", *["Qw93ErTy74UiOp15As"] * 4])]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(docs.schema[c].dataType) for c in docs.columns)))
    before, columns = docs.collect(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        after_df = stage(spark, docs, sf_dir)
        after = after_df.collect()
        assert after_df.columns == columns
        ids, had = [r.doc_id for r in after], {r.doc_id: r for r in before}
        assert all(had[r.doc_id].text == r.text for r in after)
        if name == "language":
            assert set(ids) == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
            assert all(r.lang == had[r.doc_id].lang for r in after if had[r.doc_id].lang is not None) and all(r.lang for r in after)
        elif name == "near duplicates":
            assert sorted(ids) == sorted(kept_of_each_group(before)) and len(ids) < len(before)
        elif name == "secrets":
            assert set(had) - set(ids) == with_live_secrets(before) and len(ids) == len(set(ids))
            assert 10_000_000 not in ids and {10_000_001, 10_000_004} <= set(ids)
        else:
            words = {s: sum(len(r.text.split()) for r in before if r.source == s) for s in {r.source for r in before}}
            total = sum(words.values())
            assert abs(sum(len(r.text.split()) for r in after) - total) < 0.1 * total
            assert max(ids.count(i) for i in set(ids)) <= 3
        docs, before = spark.createDataFrame(after, docs.schema), after
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = library.encode(r.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir)
    assert sorted(map(tuple, encoded.collect())) == sorted(want)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (None, "the cat sat on the mat", "en", None, 3, "x"), (None, "der Hund und die Katze", "de", "s", 3, "x"),
            (2, "the dog and the house of the man", "en", "s", None, "x"), (2, "the dog and the house of the man", "en", "s", None, "x"), (3, "", "en", "t", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[:3] == ["doc_id", "text", "lang"] and len(docs.columns) == 6
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.collect() == []


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)


def test_texts_of_one_id(spark):
    """One id may name several texts: a near duplicate goes alone, and clean texts all stay."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [(1, text("a")), (5, text("a") + " end"), (5, text("b")), (5, text("c")), (5, text("c")), (6, text("c") + " end"), (7, text("d")), (7, text("d") + " end"), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.text[0], r.doc_id or 0) for r in out.collect())
    assert [c for c, _ in got] == ["a", "b", "c", "d", "e"]
    assert got[0] == ("a", 1) and got[1] == ("b", 5) and got[3:] == [("d", 7), ("e", 0)]


def test_encoding_decodes(spark):
    rows = [(1, "the cat sat", "en", "s"), (2, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.encode(spark, docs, "").collect()
    want = bpe_encode(docs, tokenizer_path("word_bpe_49k.json"), emit=("decoded",)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {r.doc_id: hashlib.sha256(r.decoded.encode()).hexdigest() for r in want}
