"""Lexical, vector and fused ranking."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..common import materialise
from ..functions import scalar as S

LEXICAL_WEIGHT, VECTOR_WEIGHT = 0.4, 0.6
BLOCK = 1024  # queries that meet all vectors at once


def bm25_stats(chunks: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(terms: term, df; corpus: n_docs, avgdl, unique terms from terms.count()).
    Terms are distinct within a text before they are exploded, so the shuffle
    carries one partial count for each term and task."""
    tok = chunks.select(S.tokens(F.col(text)).alias("t"))
    terms = tok.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    corpus = tok.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avgdl"))
    return terms, corpus


def bm25(chunks: DataFrame, key: str, text: str, query: str, query_terms: list[str] | None = None) -> DataFrame:
    """(key, bm25) of every text that holds a query term; repeated query terms
    count again. Texts are tokenized once: a row of counts for each text is kept, of
    which come the corpus's figures (one row) and the scores. No term of the corpus is
    exploded, as only the query's terms are counted."""
    terms = query_terms if query_terms is not None else terms_of(query)
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("bm25")).limit(0)
    rows, distinct = term_counts(chunks, key, text, terms)
    stats = rows.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(distinct))]
    )
    figures = stats.first()
    score: Column = F.lit(0.0)
    for k, t in enumerate(distinct):
        part = S.bm25_idf(F.lit(figures["n"]), F.lit(figures[f"df{k}"])) * S.bm25_weight(F.col(f"tf{k}"), F.col("dl"), F.lit(figures["avgdl"]))
        score = score + F.lit(float(terms.count(t))) * F.when(F.col(f"tf{k}") > 0, part).otherwise(0.0)
    return rows.select(key, score.alias("bm25")).where("bm25 > 0")


def terms_of(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if len(t.encode()) > 2]


def term_counts(chunks: DataFrame, key: str, text: str, terms: list[str]) -> tuple[DataFrame, list[str]]:
    """(key, dl, tf0, tf1, ... of the distinct terms in order) of every text, written once."""
    distinct = sorted(set(terms))
    tf = lambda t: F.size(F.filter("t", lambda x: x == t))
    rows = chunks.select(key, S.tokens(F.col(text)).alias("t")).select(
        key, F.size("t").alias("dl"), *[tf(t).alias(f"tf{k}") for k, t in enumerate(distinct)]
    )
    return materialise(rows), distinct


def full_text(rows: DataFrame, key: str, text: str, query: str, newest: str, limit: int) -> DataFrame:
    """(key, rank) of the rows that hold every term of the query, the best first: rank is
    BM25 below zero, so smaller is better. A blank query gives the newest rows, rank 0."""
    terms = terms_of(query)
    if not terms:
        return rows.orderBy(F.col(newest).desc(), F.col(key).desc()).limit(limit).select(key, F.lit(0.0).alias("rank"))
    every = reduce(lambda a, b: a & b, [F.array_contains("t", t) for t in set(terms)])
    whole = rows.select(key, S.tokens(F.col(text)).alias("t")).where(every).select(key)
    scores = bm25(rows, key, text, query).join(whole, key, "left_semi")
    return scores.select(key, (-F.col("bm25")).alias("rank")).orderBy(F.round("rank", 9), key).limit(limit)


def top_k(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query, key, score, distance, rank) of the k best vectors for each query, equal
    scores (to nine digits) by key. queries: (query, q), a stated set; filter vectors
    before. Queries go in blocks of BLOCK to the vectors, which don't move: each task
    keeps the k best of its vectors for each query of the block. Null vectors, and
    those of another length than a query's, are not found for it."""
    wanted = queries.select("query", F.col("q").cast("array<double>").alias("q")).where("q is not null and size(q) > 0")
    blocks = -(-wanted.count() // BLOCK)
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1))))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, score double, distance double"
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    found = [rows.sparkSession.createDataFrame([], kinds)]
    for block in range(blocks):
        part = dealt.where(F.col("block") == block).collect()  # BLOCK queries or about so many
        if part:
            near = rows.mapInArrow(_best_of_task([r["query"] for r in part], [r["q"] for r in part], k, metric, kinds), kinds)
            found.append(materialise(near) if blocks > 1 else near)
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), F.col(key))
    ranked = reduce(DataFrame.unionByName, found[1:] or found).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query", key, "score", "distance", "rank")


def _best_of_task(names: list, queries: list[list[float]], k: int, metric: str, kinds: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map from (key, vector) to the k best of all its rows for each query."""
    schema = to_arrow_schema(T._parse_datatype_string(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[int]] = {}
        for at, q in enumerate(queries):
            by.setdefault(len(q), []).append(at)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            for length, members in by.items():
                same = np.flatnonzero(lengths == length)
                if not len(same):
                    continue
                flat = vectors.values.to_numpy(zero_copy_only=False)
                v = flat[(vectors.offsets.to_numpy()[same])[:, None] + np.arange(length)]
                q = np.array([queries[x] for x in members])
                with np.errstate(all="ignore"):
                    if metric == "l2":
                        score = 1 / (1 + np.sqrt(((v[None, :, :] - q[:, None, :]) ** 2).sum(axis=2))) if len(q) * len(v) * length < 1 << 22 else np.stack([1 / (1 + np.sqrt(((v - x) ** 2).sum(axis=1))) for x in q])
                    else:
                        score = q @ v.T
                        if metric == "cosine":
                            score = score / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :]
                keys = batch.column(0).to_numpy(zero_copy_only=False)[same]
                for x, row in zip(members, score):
                    row = np.where(np.isnan(row), -np.inf, row)
                    if x in best:
                        row, own = np.concatenate((best[x][0], row)), np.concatenate((best[x][1], keys))
                    else:
                        own = keys
                    top = np.lexsort((own, -np.round(row, 9)))[:k] if len(row) <= 8 * k else _top(row, own, k)
                    best[x] = row[top], own[top]
        out = [(names[x], key, float(s)) for x, (scores, keys) in best.items() for s, key in zip(scores, keys.tolist()) if s > -np.inf]
        if out:
            query, key, score = (list(c) for c in zip(*out))
            away = [1 - s if metric == "cosine" else -s if metric == "dot" else (1 / s - 1) ** 2 for s in score]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((query, key, score, away), schema)], schema=schema)

    return run


def _top(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal ones by key, without sorting the rest."""
    least = np.round(np.partition(score, len(score) - k)[len(score) - k], 9)
    near = np.flatnonzero(np.round(score, 9) >= least)
    return near[np.lexsort((keys[near], -np.round(score[near], 9)))[:k]]


def metadata_filter(rows: DataFrame, column: str, spec: str | None) -> DataFrame:
    """Rows whose JSON metadata has all fields of a JSON object of equalities; a spec
    that isn't one asks for nothing."""
    try:
        wanted = json.loads(spec or "")
    except ValueError:
        return rows
    if not isinstance(wanted, dict):
        return rows
    for name, value in wanted.items():
        text = value if isinstance(value, str) else json.dumps(value)
        rows = rows.where(F.get_json_object(column, f"$.{name}") == text)
    return rows


def list_all(vectors: DataFrame, key: str, limit: int) -> DataFrame:
    """Vectors of a collection without a query: the first ones by key."""
    return vectors.orderBy(key).limit(limit)


def hybrid(semantic: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """(key, score): 0.4 * sigmoid(bm25) + 0.6 * semantic; without lexical hits the
    first part is 0."""
    joined = semantic.join(lexical, key, "left")
    lex = F.when(F.coalesce("bm25", F.lit(0.0)) > 0, S.sigmoid(F.col("bm25"))).otherwise(0.0)
    return joined.select(key, (LEXICAL_WEIGHT * lex + VECTOR_WEIGHT * F.col("score")).alias("score"))


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists, at most 1, as a share of the best
    that two lists can give."""
    parts = [r.select(key, S.rrf(F.col("rank")).alias("part")) for r in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = 2.0 / (S.RRF_K + 1)
    return every.groupBy(key).agg(F.least(F.lit(1.0), F.sum("part") / F.lit(best)).alias("score"))


def ranked(df: DataFrame, score: str, key: str, limit: int) -> DataFrame:
    """The best rows with 1-based rank."""
    best = top_k(df, limit, score, key)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def post_filter(hits: DataFrame, min_score: float | None = None, extensions: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Filters of a search; apply before a limit."""
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    if extensions:
        hits = hits.where(F.regexp_extract("file_path", r"\.([^./]+)$", 1).isin(extensions))
    if languages:
        hits = hits.where(F.col("language").isin(languages))
    return hits


def bucket_length(vectors: DataFrame, k: int, vector: str = "embedding", sample: int = 2000) -> float:
    """A bucket length for approximate_search: twice the median distance to the k-th
    nearest in a sample of that many vectors (a documented bound; every vector is indexed)."""
    share = min(1.0, 2 * sample / max(vectors.count(), 1))
    rows = vectors.where(F.col(vector).isNotNull()).sample(share, seed=7).limit(sample).select(F.col(vector).cast("array<double>").alias("v")).collect()
    v = np.array([r["v"] for r in rows])
    if len(v) <= k:
        return 2.0
    near = [np.partition(((v - x) ** 2).sum(axis=1), k)[k] for x in v[:: max(1, len(v) // 200)]]
    return float(2 * np.sqrt(np.median(near))) or 2.0


def approximate_search(
    vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", tables: int = 16, length: float | None = None
) -> DataFrame:
    """The k nearest by random-projection buckets (L2), verified by true distance; for
    collections too large to scan. The exact search is the default."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    length = bucket_length(vectors, k, vector) if length is None else length
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=length, numHashTables=tables, seed=7).fit(rows)
    near = model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance")
    return near.select(key, "distance", S.l2_score(F.col("distance") * F.col("distance")).alias("score"))
