"""Ranking queries over documents and embeddings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import dealt, shared_folder
from ..functions import scalar as S
from ..operators import search as R
from ..operators import text_index as X
from ..operators import vector_index as V
from .registry import Registry, table

query = Registry()
TERMS = ["the", "from", "this"]
TEXT = "the from this"
TASK_DOCS = 4096  # documents of one task that holds counts for each item
#: Tokens and BM25 in SQL, shared by several queries.
TOK = r"tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: strlen(t) > 2) AS t FROM documents)"
BM25 = f"""{TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
q AS (SELECT unnest(['the', 'from', 'this']) AS term),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
       FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id)"""
QV = "qv AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _bm25(spark, d) -> DataFrame:
    return R.bm25(_docs(spark, d), "doc_id", "text", TEXT, TERMS)


def _query_vectors(spark, d) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query(f"WITH {TOK} SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM tok")
def tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", S.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"WITH {TOK}, x AS (SELECT doc_id, unnest(list_distinct(t)) AS term FROM tok) SELECT term, count(*) AS df FROM x GROUP BY term")
def bm25_document_frequencies(spark, d):
    return R.bm25_stats(_docs(spark, d), "doc_id", "text")[0]


@query(f"WITH {TOK} SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM tok")
def bm25_corpus_stats(spark, d):
    corpus = R.bm25_stats(_docs(spark, d), "doc_id", "text")[1]
    return corpus.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY round(bm25, 9) DESC, doc_id LIMIT 20")
def bm25_search(spark, d):
    best = _bm25(spark, d).withColumn("s", F.round("bm25", 9))
    return R.top_k(best, 20, "s", "doc_id").select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {BM25}, w AS (SELECT doc_id FROM tok WHERE list_contains(t, 'the') AND list_contains(t, 'from') AND list_contains(t, 'this'))
SELECT doc_id, round(-bm25, 6) AS rank FROM bm JOIN w USING (doc_id) ORDER BY round(-bm25, 9), doc_id LIMIT 50""")
def full_text_query(spark, d):
    found = R.full_text(_docs(spark, d), "doc_id", "text", TEXT, "doc_id", 50)
    return found.select("doc_id", F.round("rank", 6).alias("rank"))


@query("SELECT doc_id, 0.0::DOUBLE AS rank FROM documents ORDER BY doc_id DESC LIMIT 1000")
def full_text_blank_query(spark, d):
    return R.full_text(_docs(spark, d), "doc_id", "text", "  ", "doc_id", 1000)


def _vector_sql(score: str, distance: str) -> str:
    return f"""WITH {QV}, p AS (SELECT query, vec_id, {score} AS score, {distance} AS distance FROM embeddings, qv),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p)
    SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def _vectors(spark, d, metric):
    hits = R.vector_search(table(spark, d, "embeddings"), _query_vectors(spark, d), 5, metric)
    return hits.select("query", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_vector_sql("list_cosine_similarity(embedding::DOUBLE[], q)", "1 - list_cosine_similarity(embedding::DOUBLE[], q)"))
def vector_search_cosine(spark, d):
    return _vectors(spark, d, "cosine")


@query(_vector_sql("list_dot_product(embedding::DOUBLE[], q)", "0"))
def vector_search_dot(spark, d):
    return _vectors(spark, d, "dot")


@query(_vector_sql("1 / (1 + list_distance(embedding::DOUBLE[], q))", "0"))
def vector_search_l2(spark, d):
    return _vectors(spark, d, "l2")


@query(f"""WITH {QV}, p AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, qv WHERE label IN (1, 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p)
SELECT query, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_search_in_collections(spark, d):
    """The filter comes before the ranking: nothing is fetched in excess."""
    e = table(spark, d, "embeddings").where(F.col("label").isin(1, 3))
    return R.vector_search(e, _query_vectors(spark, d), 5).select("query", "vec_id", F.round("score", 6).alias("score"))


#: A document's vector is the one with its number; the query's is the first.
SEMANTIC = """q1 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
se AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q1 WHERE vec_id IN (SELECT doc_id FROM documents))"""


def _semantic(spark, d) -> DataFrame:
    """Cosine of every document's vector with the query's."""
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.lit(0).alias("query"), F.col("embedding").alias("q")).first()["q"]
    v = e.select(F.col("vec_id").alias("doc_id"), R.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])).alias("score"))
    return v.join(_docs(spark, d).select("doc_id"), "doc_id", "left_semi")


@query(f"""WITH {BM25}, {SEMANTIC} SELECT doc_id, round(0.4 * CASE WHEN coalesce(bm25, 0) > 0 THEN 1 / (1 + exp(-bm25)) ELSE 0 END + 0.6 * score, 6) AS score
FROM se LEFT JOIN bm USING (doc_id) ORDER BY 2 DESC, doc_id LIMIT 20""")
def hybrid_search(spark, d):
    fused = R.hybrid(_semantic(spark, d), _bm25(spark, d), "doc_id").withColumn("score", F.round("score", 6))
    return R.top_k(fused, 20, "score", "doc_id")


@query(f"""WITH {BM25}, {SEMANTIC},
a AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30),
b AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM se QUALIFY rank <= 30)
SELECT doc_id, round(least(1, sum(1.0::DOUBLE / (60 + rank)) / (2.0::DOUBLE / 61)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id
ORDER BY score DESC, doc_id LIMIT 10""")
def rank_fusion(spark, d):
    lexical = R.ranked(_bm25(spark, d).withColumn("s", F.round("bm25", 9)), "s", "doc_id", 30)
    vector = R.ranked(_semantic(spark, d).withColumn("s", F.round("score", 9)), "s", "doc_id", 30)
    fused = R.fuse([lexical, vector], "doc_id").withColumn("score", F.round("score", 6))
    return R.top_k(fused, 10, "score", "doc_id")


@query(f"""WITH {BM25}, h AS (SELECT doc_id, lang, bm25 / (1 + bm25) AS score FROM bm JOIN documents USING (doc_id))
SELECT doc_id, lang AS language, round(score, 6) AS score FROM h WHERE score >= 0.1 AND lang IN ('en', 'de') ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def search_with_filters(spark, d):
    hits = _bm25(spark, d).join(_docs(spark, d).select("doc_id", F.col("lang").alias("language")), "doc_id")
    hits = R.post_filter(hits.withColumn("score", F.col("bm25") / (1 + F.col("bm25"))), 0.1, languages=["en", "de"])
    best = R.top_k(hits.withColumn("s", F.round("score", 9)), 10, "s", "doc_id")
    return best.select("doc_id", "language", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 2))) AS term FROM benchmark),
t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 2))) AS term FROM documents),
o AS (SELECT item_id, doc_id, count(*) AS shared FROM h JOIN t USING (term) GROUP BY ALL)
SELECT item_id, doc_id, shared FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) <= 3""".replace("\\\\", "\\"))
def golden_queries(spark, d):
    """For every benchmark item, the documents that share most of its terms. Documents are dealt by their id before
    they are cut into terms, so a task counts the shared terms of its own ones, and only the best of each task are shuffled."""
    terms = lambda df, key: df.select(key, F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("term"))
    items = terms(table(spark, d, "benchmark"), "item_id")
    shared = items.join(terms(dealt(_docs(spark, d).select("doc_id", "text"), "doc_id", TASK_DOCS), "doc_id"), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    from ..operators.aggregates import best_per_group

    return best_per_group(shared, "item_id", 3, F.col("shared").desc(), F.col("doc_id")).drop("rank")


META = "m AS (SELECT vec_id, embedding, '{\"label\":' || label || ',\"side\":\"' || CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END || '\"}' AS meta FROM embeddings)"


def _with_metadata(spark, d) -> DataFrame:
    side = F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b")
    return table(spark, d, "embeddings").withColumn("meta", F.concat(F.lit('{"label":'), "label", F.lit(',"side":"'), side, F.lit('"}')))


@query(f"""WITH {QV}, {META}, p AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM m, qv
WHERE json_extract_string(meta, '$.label') = '2' AND json_extract_string(meta, '$.side') = 'a'),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p)
SELECT query, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_search_json_filter(spark, d):
    rows = R.metadata_filter(_with_metadata(spark, d), "meta", '{"label": 2, "side": "a"}')
    return R.vector_search(rows, _query_vectors(spark, d), 5).select("query", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1000")
def list_vectors(spark, d):
    return R.list_all(R.metadata_filter(table(spark, d, "embeddings").select("vec_id", "label"), "label", "not json"), "vec_id", 1000)


@query(f"""WITH {BM25}, h AS (SELECT doc_id, row_number() OVER (ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30),
c AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)
SELECT b.doc_id, min(rank) AS rank FROM h JOIN c a ON a.doc_id = h.doc_id JOIN c b ON a.h = b.h AND b.n = 1 GROUP BY b.doc_id""")
def hits_by_content(spark, d):
    """Hits joined to the observations that hold their content, each once."""
    from ..operators import memory as M

    hits = R.ranked(_bm25(spark, d).withColumn("s", F.round("bm25", 9)), "s", "doc_id", 30).select("doc_id", F.col("rank").cast("long").alias("rank"))
    stored = M.first_of_content(_docs(spark, d), "text", "doc_id").select("content_hash", "doc_id")
    hashed = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash")).join(hits, "doc_id").select("content_hash", "rank")
    return hashed.join(stored, "content_hash").groupBy("doc_id").agg(F.min("rank").alias("rank"))


# --- indexes: written once for a folder of tables, then searched -----------------------------------
_WRITTEN: dict[tuple[str, str, str], object] = {}


def _index(spark, d, kind: str, build):
    """An index of this session over a folder's table, in the shared folder."""
    name = (spark.sparkContext.applicationId, d, kind)
    if name not in _WRITTEN:
        _WRITTEN[name] = build(f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}")
    return _WRITTEN[name]


def _text_index(spark, d) -> X.TextIndex:
    """Documents in two goes, the second with a first version of some of the texts replaced."""

    def build(path: str) -> X.TextIndex:
        index, docs = X.TextIndex(spark, path), _docs(spark, d).select("doc_id", "text")
        index.add(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "the old text").otherwise(F.col("text"))), "doc_id", "text")
        index.add(docs.where("doc_id % 7 = 0"), "doc_id", "text")
        return index

    return _index(spark, d, "text", build)


def _vector_index(spark, d) -> V.VectorIndex:
    """Fitted on most of the vectors, the others inserted later."""

    def build(path: str) -> V.VectorIndex:
        e = table(spark, d, "embeddings")
        index = V.VectorIndex.build(e.where("vec_id % 10 <> 3"), path)
        index.insert(e.where("vec_id % 10 = 3"))
        return index

    return _index(spark, d, "vectors", build)


def _match_sql(condition: str, terms: list[str]) -> str:
    """Documents under a condition on their tokens t and the string s of them, with BM25 of the terms."""
    return f"""WITH {TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), q AS (SELECT unnest({terms}) AS term),
tf AS (SELECT doc_id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id),
s AS (SELECT doc_id, t, ' ' || array_to_string(t, '  ') || ' ' AS s FROM tok)
SELECT doc_id, round(-bm25, 6) AS rank FROM bm JOIN s USING (doc_id) WHERE {condition}"""


def _matched(spark, d, match: str) -> DataFrame:
    return _text_index(spark, d).search(match).select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(_match_sql("contains(s, ' from  the ') OR contains(s, ' with  this ')", ["from", "the", "with", "this"]))
def match_phrases(spark, d):
    return _matched(spark, d, '"from the" OR with + this')


@query(_match_sql("regexp_matches(s, '( was (  ?[^ ]+ ){0,3} with | with (  ?[^ ]+ ){0,3} was )')", ["was", "with"]))
def match_near(spark, d):
    return _matched(spark, d, "NEAR(was with, 3)")


@query(_match_sql("contains(s, ' from ') AND NOT (contains(s, ' with ') OR contains(s, ' the  and '))", ["from"]))
def match_not(spark, d):
    return _matched(spark, d, 'from NOT (with OR "the and")')


@query(f"""WITH {TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: starts_with(x, 'thou'))) AS tf FROM tok WHERE list_contains(t, 'and')),
al AS (SELECT count(*) AS df FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'thou'))) > 0),
an AS (SELECT count(*) AS df2 FROM tok WHERE list_contains(t, 'and')), a2 AS (SELECT doc_id, len(list_filter(t, lambda x: x = 'and')) AS tf2 FROM tok)
SELECT doc_id, round(-(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + ln(1 + (n - df2 + 0.5) / (df2 + 0.5)) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank
FROM tf JOIN a2 USING (doc_id), st, al, an WHERE tf > 0""")
def match_prefix(spark, d):
    return _matched(spark, d, "thou* AND and")


@query(f"WITH {BM25} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm")
def indexed_bm25(spark, d):
    """All scores from the postings of three terms."""
    return _text_index(spark, d).search("the OR from OR this").select(F.col("key").alias("doc_id"), F.round(-F.col("rank"), 6).alias("bm25"))


@query(_vector_sql("list_cosine_similarity(embedding::DOUBLE[], q)", "0"))
def vector_index_all_lists(spark, d):
    """With all lists asked for, the codes choose the candidates of an exact search."""
    index = _vector_index(spark, d)
    hits = index.search(_query_vectors(spark, d), 5, probes=len(index.centroids))
    return hits.select("query", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT count(*) AS queries, sum(least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS wanted, true AS recall_reached
FROM embeddings WHERE vec_id % 20 = 0""")
def vector_index_recall(spark, d):
    """Ten neighbours of every query vector from the lists that the model asks, against the exact search: at least 0.9 of them."""
    queries = _query_vectors(spark, d)
    exact = R.vector_search(table(spark, d, "embeddings"), queries, 10)
    share = V.recall(_vector_index(spark, d).search(queries, 10), exact).withColumn("reached", F.col("found") >= 0.9 * F.col("wanted"))
    return queries.agg(F.count("*").alias("queries")).crossJoin(share.select("wanted", F.col("reached").alias("recall_reached")))  # one row each


QUERIES, ORACLE_SQL = query.queries, query.sql
