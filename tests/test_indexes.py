"""The text index against plain Python, the vector index against the exact search."""

import glob
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlight.operators.search import bm25, vector_search
from quernlight.operators.text_index import TextIndex, parse_match
from quernlight.operators.vector_index import VectorIndex, recall
from quernlight.plans.search_queries import QUERIES

WORDS = ["alpha", "beta", "gamma", "delta", "alphabet", "gam", "été"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    return {i: " ".join(rng.choice(WORDS, rng.integers(0, 14), p=[0.2, 0.2, 0.2, 0.2, 0.1, 0.05, 0.05])) for i in range(120)} | {500: None, 501: "", 502: "a b of"}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id bigint, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    index = TextIndex(spark, str(tmp_path_factory.mktemp("text")))
    index.add(frame(spark, {i: "beta old words" if i % 3 == 0 else t for i, t in texts.items()}), "id", "text")
    index.add(frame(spark, {i: t for i, t in texts.items() if i % 3 == 0} | {900: "alpha beta gone"}), "id", "text")
    index.remove(spark.createDataFrame([(900,), (901,)], "key bigint"))
    return index


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if len(t.encode()) > 2]


def spots(t, phrase):
    n = len(phrase)
    fits = lambda w, p: w.startswith(p[:-1]) if p.endswith("*") else w == p
    return [k for k in range(len(t) - n + 1) if all(fits(w, p) for w, p in zip(t[k : k + n], phrase))]


def near(t, a, b, n):
    return any((y - x - len(a) if x <= y else x - y - len(b)) <= n for x in spots(t, a) for y in spots(t, b))


CASES = {
    "alpha": lambda t: "alpha" in t,
    "alpha gamma": lambda t: "alpha" in t and "gamma" in t,
    '"alpha beta"': lambda t: spots(t, ["alpha", "beta"]),
    "alpha + beta + gam*": lambda t: spots(t, ["alpha", "beta", "gam*"]),
    "alpha*": lambda t: spots(t, ["alpha*"]),
    "alpha OR beta AND gamma": lambda t: "alpha" in t or ("beta" in t and "gamma" in t),
    "(alpha OR beta) AND gamma": lambda t: ("alpha" in t or "beta" in t) and "gamma" in t,
    "alpha NOT beta": lambda t: "alpha" in t and "beta" not in t,
    'alpha AND gamma NOT "beta gamma"': lambda t: "alpha" in t and "gamma" in t and not spots(t, ["beta", "gamma"]),
    "alpha beta NOT gamma OR été": lambda t: ("alpha" in t and "beta" in t and "gamma" not in t) or "été" in t,
    "NEAR(alpha beta, 0)": lambda t: near(t, ["alpha"], ["beta"], 0),
    'NEAR("alpha beta" delta, 2)': lambda t: near(t, ["alpha", "beta"], ["delta"], 2),
    "NEAR(alpha alpha)": lambda t: "alpha" in t,
    "ALPHA of": lambda t: "alpha" in t,  # a word without terms counts for nothing
    '"alpha alpha"': lambda t: spots(t, ["alpha", "alpha"]),
    "missing OR beta": lambda t: "beta" in t,
}


@pytest.mark.parametrize("match", CASES)
def test_match(index, texts, match):
    got = index.search(match).collect()
    assert sorted(r["key"] for r in got) == sorted(i for i, t in texts.items() if CASES[match](tokens(t))) and all(r["rank"] <= 0 for r in got)


@pytest.mark.parametrize("match", ['"alpha beta"', "NEAR(alpha beta, 1)"])
def test_long_documents_take_linear_time(spark, tmp_path, match):
    """A term of a long text has as many places as the text has words."""
    index = TextIndex(spark, str(tmp_path))
    index.add(frame(spark, {1: "alpha gamma delta beta gamma delta " * 60000, 2: "alpha beta"}), "id", "text")
    began = time.time()
    assert [r["key"] for r in index.search(match).collect()] == [2] and time.time() - began < 15


def test_documents_of_one_split_are_dealt(spark, tmp_path):
    """As many files as cores, though all texts come in one split; the documents stand in each file's first rows."""
    rows = spark.range(0, 8000, 1, 1).selectExpr("id", "concat('alpha beta', id) AS text")
    TextIndex(spark, str(tmp_path)).add(rows, "id", "text")
    assert len(glob.glob(f"{tmp_path}/postings/*/*.parquet")) > 1
    held = spark.read.parquet(f"{tmp_path}/postings").where("term = ''")
    assert held.count() == held.select("key").distinct().count() == 8000 and held.where("dl <> 2").isEmpty()


def test_scores_are_those_of_bm25(spark, index, texts):
    want = {r["id"]: round(r["bm25"], 9) for r in bm25(frame(spark, texts), "id", "text", "alpha gamma delta").collect()}
    got = {r["key"]: round(-r["rank"], 9) for r in index.search("alpha OR gamma OR delta").collect()}
    assert got == want and index.statistics()[0] == len(texts)


def test_only_the_terms_postings_are_read(index):
    plan = index.postings([("alpha", False), ("gam", True)])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,gam)" in plan and "EqualTo(term,alpha)" in plan


def test_compact_and_nothing_to_find(spark, index, tmp_path):
    small = index.compact(str(tmp_path / "small"))
    assert sorted(map(tuple, small.search("alpha* OR beta").collect())) == sorted(map(tuple, index.search("alpha* OR beta").collect()))
    assert len(small._generations()[0]) == 1 and small.statistics() == index.statistics()
    assert index.search("of").count() == 0 and index.search("  ").count() == 0
    empty = TextIndex(spark, str(tmp_path / "empty"))
    assert empty.search("alpha").count() == 0
    empty.add(frame(spark, {}).limit(0), "id", "text")
    assert empty.search("alpha").count() == 0


def test_uncommitted_generations_are_not_seen(spark, index, texts, tmp_path):
    other = TextIndex(spark, str(tmp_path / "half"))
    other.add(frame(spark, {1: "alpha"}), "id", "text")
    other._table("postings").drop("gen").write.parquet(f"{other.path}/postings/gen=lost")
    assert other.search("alpha").count() == 1


@pytest.mark.parametrize("bad", ["alpha AND", "(alpha", "alpha)", "NEAR(alpha beta", "* alpha", "AND"])
def test_broken_matches_are_refused(bad):
    with pytest.raises(ValueError):
        parse_match(bad)


# --- vectors -----------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 12)) * 4
    rows = [(i, (centres[i % 30] + rng.standard_normal(12)).tolist()) for i in range(3000)]
    rows += [(5000, None), (5001, [1.0] * 5), (5002, [0.0] * 12), (5003, [float("nan")] + [1.0] * 11), (5004, [None] + [1.0] * 11), (7, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_pruning_and_inserts(spark, vectors, metric, tmp_path):
    index = VectorIndex.build(vectors.where("vec_id < 2500"), str(tmp_path / "v"), metric)
    index.insert(vectors.where("vec_id >= 2500"))
    queries = vectors.where("vec_id % 20 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    good = vectors.where("vec_id < 3000")
    exact = vector_search(good, queries, 10, metric)
    assert index.probes < len(index.centroids) // 2  # clustered vectors need few lists
    share = recall(index.search(queries, 10), exact).first()
    assert share["found"] >= 0.9 * share["wanted"] > 0
    every = index.search(queries, 10, probes=len(index.centroids), refine=20)
    plain = lambda df, key: sorted((r["query"], r["rank"], r[key], round(r["score"], 6), round(r["distance"], 6)) for r in df.collect())
    assert plain(every, "key") == plain(exact, "vec_id")
    zero = 0 if metric == "cosine" else 1  # a zero vector has no direction
    assert index.read().count() == 3001 + zero
    folders = glob.glob(f"{tmp_path}/v/rows/list=*")
    assert 1 < len(folders) <= len(index.centroids)


def test_index_without_queries_or_vectors(spark, vectors, tmp_path):
    index = VectorIndex.build(vectors.where("vec_id < 100"), str(tmp_path / "v"), lists=4)
    assert index.search(spark.createDataFrame([], "query bigint, q array<double>"), 5).count() == 0
    none = spark.createDataFrame([(1, None), (2, [0.0] * 12)], "query bigint, q array<double>")
    assert index.search(none, 5).count() == 0
    with pytest.raises(ValueError):
        VectorIndex.build(vectors.limit(0), str(tmp_path / "none"))


def test_shared_terms_are_counted_where_the_document_is(spark, sf_dir):
    """Items times documents are never shuffled: documents are dealt once, then only the best of each task."""
    plan = QUERIES["golden_queries"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert not re.search(r"hashpartitioning\((item_id#\d+L?, doc_id#\d+L?|doc_id#\d+L?, item_id#\d+L?), ", plan)
