import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quernlight.llm import queries as q
from quernlight.llm.language import UNKNOWN, Scorer, identify, learning_rows, letter_pieces, train, words_of
from quernlight.llm.mixing import mix

ODD = [
    (1, "the cat and the dog 123", "en", "b", "x"), (1, "the cat and the dog 123", "en", "b", "x"), (2, None, "en", None, "x"), (None, "der Hund und die Katze", "de", "a", None),
    (3, "", None, "a", "y"), (4, "12 34 !!", None, "ß", "y"), (5, "word " * 40000, "en", "b", "y"), (6, "ein Haus und der Baum", "de", None, "y"), (7, "the house and the tree", "en", "c", "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string"


@pytest.fixture(scope="module")
def pieces():
    return letter_pieces(q.tokenizer_path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations():
    rnd = random.Random(1)
    for _ in range(50):
        p = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))): rnd.random() for _ in range(5)} | {"a": 0.1, "b": 0.2}
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8))) for _ in range(6)]
        scorer = Scorer({"x": p, "y": {k: v / 2 for k, v in p.items()}})
        together = scorer.words(words)
        for k, word in enumerate(words):
            totals = [0.0, 0.0]
            for cuts in itertools.product([0, 1], repeat=len(word) - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
                for of, share in enumerate((1, 2)):
                    totals[of] += math.prod(UNKNOWN if word[a:b] == "c" else p.get(word[a:b], 0.0) / share for a, b in itertools.pairwise(at))
            assert list(together[k]) == pytest.approx([math.log(t) for t in totals])
            assert list(scorer.word(word)) == pytest.approx([math.log(t) for t in totals])


def test_runs_of_any_length():
    """No underflow and no cut: the sum of a long run equals one in logs."""
    p = {"a": 0.01, "ab": 0.02, "ba": 0.003, "bab": 0.004, "b": 0.05}
    word = "".join(random.Random(2).choice("abc") for _ in range(3000))
    logs = [0.0]
    for end in range(1, len(word) + 1):
        ways = [logs[end - k] + math.log(p[x]) for k in (1, 2, 3) if end >= k and (x := word[end - k : end]) in p]
        ways += [logs[end - 1] + math.log(UNKNOWN)] if word[end - 1] == "c" else []
        logs.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
    scorer = Scorer({"x": p})
    assert scorer.words([word, word[:30]])[:, 0] == pytest.approx([logs[-1], logs[30]])
    assert scorer.predict([word, word[:30] + " " + word, None])[2] == ("und", 0.0)


def test_spans_end_between_words(monkeypatch):
    text = "ab cde f" * 50 + "²_x"
    whole = [w for part in words_of(text) for w in part]
    monkeypatch.setattr("quernlight.llm.language.SPAN", 7)
    assert [w for part in words_of(text) for w in part] == whole and whole[-2:] == ["f", "x"]


def test_repeats_lose_no_language(spark, pieces):
    """One text of each language, thousands of times: all languages are learned, from one text each."""
    texts = {"en": "the house of the man", "de": "das Haus und der Mann", "fr": "la maison et les hommes", "es": "el hombre y la casa", "it": "gli uomini della casa", "nl": "het huis van de man"}
    docs = spark.createDataFrame([(i, t, lang) for lang, t in texts.items() for i in range(1, 4001)], "doc_id long, text string, lang string")
    model = train(learning_rows(docs), pieces)
    assert sorted(model) == sorted(texts)
    scorer = Scorer(model)
    assert [lang for lang, _ in scorer.predict(list(texts.values()))] == list(texts)
    once = train(spark.createDataFrame([(t, lang) for lang, t in texts.items()], "text string, lang string"), pieces)
    assert model["de"] == pytest.approx(once["de"])


def test_language_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op7_language_id(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, pieces):
    rows = identify(spark.createDataFrame(ODD, SCHEMA), pieces).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].lang_pred == by[3].lang_pred == by[4].lang_pred == "und" and by[2].score == 0
    assert by[None].held_out is False
    assert identify(spark.createDataFrame([], SCHEMA), pieces).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None, "a", "")], SCHEMA)
    assert [r.lang_pred for r in identify(unlabelled, pieces).collect()] == ["und"]


def fill(sizes, weights=(1, 2, 3)):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, total = dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    free = set(names)
    while free and total > 1e-9:
        share = {s: total * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] + share[s] > 3 * sizes[s]}
        for s in free:
            add = min(share[s], 3 * sizes[s] - target[s])
            target[s] += add
            total -= add
        if not over:
            break
        free -= over
    return target


@pytest.mark.parametrize("case", ["table", "odd", "skew"])
def test_mixing(spark, sf_dir, case):
    if case == "table":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    elif case == "odd":
        docs = spark.createDataFrame(ODD, SCHEMA)
    else:
        rnd = random.Random(4)
        docs = spark.createDataFrame([(i, "w " * rnd.randint(0, 50), rnd.choice("aaaaaaaab") if i else "z") for i in range(3000)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = fill(sizes)
    for s, n in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == n and r.target == pytest.approx(targets[s]) for r in own)
        assert abs(sum(r.taken for r in own) - targets[s]) <= 1.5
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        whole = [r for r in own if r.size and r.taken % r.size]
        assert len({r.doc_id for r in whole}) <= 2  # all but the last document (and its repeats) are whole
    again = mix(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(rows, key=key) == sorted(again, key=key)


@pytest.mark.parametrize("groups", [
    {("a", 1, "x"): 1000, ("b", 2, "y"): 1000, ("c", 3, "z"): 1000},
    {("a", 1, "x y"): 700, ("a", 2, "x"): 600, ("b", 3, "u v w"): 500, ("c", 4, "k"): 13},
    {("a", 1, "w " * 7): 9001, ("b", 2, "w " * 5): 3, ("b", None, "w"): 5000, ("b", None, ""): 20_000},
    {("a", 1, "w " * 997): 1, ("b", 2, "w " * 3): 1},
])
def test_mixing_many_repeats(spark, groups):
    """Totals of repeated rows come within a word of the target, whatever the number of repeats."""
    rows = [(i, t, s) for (s, i, t), n in groups.items() for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(docs).collect()
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    assert len(got) == len(rows)
    for s, target in fill(sizes).items():
        own = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target) for r in own) and abs(sum(r.taken for r in own) - target) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        most = max(r.size for r in own)
        assert abs(sum(r.copies * r.size for r in own) - target) <= most
    key = lambda r: (r.source, r.doc_id or 0, r.size, r.taken, r.copies)
    assert sorted(got, key=key) == sorted(mix(docs).collect(), key=key)


def test_a_million_equal_rows(spark):
    docs = spark.range(1_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("hot").alias("source"))
    docs = docs.union(spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string"))
    out = mix(docs)
    assert out.groupBy("source").agg(F.count("*"), F.sum("taken")).sort("source").collect() == [("hot", 1_000_000, 0), ("s", 1, 3)]


def test_mixing_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
