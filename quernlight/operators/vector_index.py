"""An index of vectors as Parquet tables: inverted lists by nearest centroid, with residual codes.

    model      list, centroid, and (the same in each row) step, the codes' unit in each dimension, the metric, and probes
    rows       key, code, vector; one folder a list

The model is fitted on a bounded sample (SAMPLE vectors); every vector is indexed. A code
is the vector's difference to its list's centroid in steps, one byte a dimension. How many
lists to ask (probes) is fitted, too: so many that they hold RECALL of the ten neighbours of
TRIALS vectors within the sample, where neighbours are farther away than among all. A search
takes the lists nearest to each query, reads their keys and codes, keeps the best of each
task, merges them, and scores these candidates exactly by their vectors. Lists that no
query asks for are not read; a long list is many files, so many tasks. Inserts only add files.

Null vectors, vectors of another length and, for cosine, zero vectors are not indexed,
as an exact search does not find them either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..common import materialise
from ..functions import scalar as S
from .search import BLOCK, cosine, squared_l2, vector_search

SAMPLE = 65_536
MOST_LISTS = 4096
FILE_ROWS = 250_000
TRIALS, RECALL = 200, 0.95


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        model = spark.read.parquet(f"{path}/model").orderBy("list").collect()  # MOST_LISTS rows at most
        self.centroids = np.array([r["centroid"] for r in model])
        self.step, self.metric, self.probes = np.array(model[0]["step"]), model[0]["metric"], model[0]["probes"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", lists: int | None = None, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> VectorIndex:
        """Fit the lists and insert all vectors. Without a number of lists: the root of the number
        of vectors, as long as the sample has 16 vectors for each."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if metric not in ("cosine", "l2"):
            raise ValueError("an index is for cosine or l2")
        spark = vectors.sparkSession
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
        n = rows.count()
        if not n:
            raise ValueError("no vectors to fit an index on")
        sample = rows.sample(min(1.0, 1.2 * SAMPLE / n), seed=seed).limit(SAMPLE) if n > SAMPLE else rows
        dim = sample.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()["dim"]
        sample = materialise(rows_of(sample, dim, metric))
        held = sample.count()
        lists = min(lists or math.isqrt(n), MOST_LISTS, max(held // 16, 1))
        fitted = KMeans(k=lists, seed=seed, maxIter=12, featuresCol="x").fit(sample.select(array_to_vector("v").alias("x")))
        centroids = np.array(fitted.clusterCenters())

        def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            most = np.zeros(dim)
            for batch in batches:
                v = _matrix(batch.column(1), dim)
                if len(v):
                    most = np.maximum(most, np.abs(v - centroids[_nearest(v, centroids)]).max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(most)], names=["at", "most"])

        most = sample.mapInArrow(farthest, "at bigint, most double").groupBy("at").agg(F.max("most")).orderBy("at").collect()
        step = [max(m, 1e-12) / 127 for _, m in most]
        probes = _probes(sample, centroids, metric)
        model = [(k, c.tolist(), step, metric, probes) for k, c in enumerate(centroids)]
        spark.createDataFrame(model, "list int, centroid array<double>, step array<double>, metric string, probes int").coalesce(1).write.parquet(f"{path}/model")
        index = cls(spark, path)
        index.insert(vectors, key, vector)
        return index

    def insert(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Add vectors to their lists."""
        centroids, step, dim = self.centroids, self.step, self.centroids.shape[1]
        named = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        fields = T.StructType([
            T.StructField("list", T.IntegerType()), named.schema["key"], T.StructField("code", T.BinaryType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
        ])
        arrow = to_arrow_schema(fields)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1), dim)
                near = _nearest(v, centroids)
                code = np.clip(np.rint((v - centroids[near]) / step), -127, 127).astype(np.int8)
                bytes_ = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), bytes_, batch.column(1)], schema=arrow)

        rows = materialise(rows_of(named, dim, self.metric).mapInArrow(coded, fields))
        pieces = rows.groupBy(F.col("list").alias("l")).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("pieces"))  # a row for each list
        dealt = rows.join(F.broadcast(pieces), F.col("list") == F.col("l"))
        dealt = dealt.repartition("list", F.pmod(F.xxhash64("key"), F.col("pieces"))).select(*fields.names)
        dealt.sortWithinPartitions("list", "key").write.mode("append").partitionBy("list").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """list, key, code, vector (for cosine: of length 1)."""
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = 10) -> DataFrame:
        """(query, key, score, distance, rank) of the k nearest of each query (query, q), a stated set, among
        the vectors of the `probes` lists nearest to it (the model's own number, if not given); refine * k candidates of
        each are scored exactly. Queries go in blocks to the lists they ask for."""
        kind = dict(self.read().dtypes)["key"]
        wanted = rows_of(queries.select(F.col("query").alias("key"), F.col("q").cast("array<double>").alias("v")), self.centroids.shape[1], self.metric)
        wanted = materialise(wanted.withColumnRenamed("key", "query"))
        blocks = max(-(-wanted.count() // BLOCK), 1)
        dealt = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        probes = min(probes or self.probes, len(self.centroids))
        found = []
        for block in range(blocks):
            part = dealt.where(F.col("block") == block).select("query", "v").collect()  # BLOCK queries or about so many
            if part:
                found.append(self._search_block(part, wanted.schema["query"].dataType.simpleString(), kind, k, probes, refine))
        if not found:
            return self.spark.createDataFrame([], f"query {wanted.schema['query'].dataType.simpleString()}, key {kind}, score double, distance double, rank int")
        order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "key")
        ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= k).select("query", "key", "score", "distance", "rank")

    def _search_block(self, part: list, query_kind: str, kind: str, k: int, probes: int, refine: int) -> DataFrame:
        q = np.array([r["v"] for r in part])
        away = ((self.centroids**2).sum(axis=1)[None, :] - 2 * q @ self.centroids.T)
        asked = np.argsort(away, axis=1, kind="stable")[:, :probes]
        of_list: dict[int, np.ndarray] = {int(c): np.flatnonzero((asked == c).any(axis=1)) for c in np.unique(asked)}
        rows = self.read().select("list", "key", "code")
        if len(of_list) < len(self.centroids):
            rows = rows.where(F.col("list").isin(list(of_list)))  # folders
        schema = f"at int, list int, key {kind}, away double"
        near = rows.mapInArrow(_candidates(q, of_list, self.centroids, self.step, k * refine, schema), schema)
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy("away", "key"))).where(F.col("r") <= k * refine)
        best = materialise(best.select("at", F.col("list").alias("l"), F.col("key").alias("c")).distinct())  # BLOCK * k * refine rows at most
        names = self.spark.createDataFrame([(i, r["query"], r["v"]) for i, r in enumerate(part)], f"n int, query {query_kind}, q array<double>")
        whole = self.read().select("list", "key", "vector").join(F.broadcast(best), (F.col("list") == F.col("l")) & (F.col("key") == F.col("c")))
        whole = whole.join(F.broadcast(names), F.col("at") == F.col("n"))
        if self.metric == "cosine":
            score = cosine(F.col("vector"), F.col("q"))
            return whole.select("query", "key", score.alias("score"), (1 - score).alias("distance"))
        gap = squared_l2(F.col("vector"), F.col("q"))
        return whole.select("query", "key", S.l2_score(gap).alias("score"), gap.alias("distance"))


def _probes(sample: DataFrame, centroids: np.ndarray, metric: str) -> int:
    tried = sample.orderBy(F.xxhash64("v"), "key").limit(TRIALS).select(F.col("key").alias("query"), F.col("v").alias("q"))
    near = vector_search(sample, tried, 11, metric, "key", "v").where("query <> key").select("query", "key")
    pairs = near.join(sample, "key").join(tried, "query").select("q", "v").collect()  # eleven for each trial
    if not pairs:
        return len(centroids)
    q, v = (np.array([r[c] for r in pairs]) for c in ("q", "v"))
    away = (centroids**2).sum(axis=1)[None, :] - 2 * q @ centroids.T
    own = np.take_along_axis(away, _nearest(v, centroids)[:, None], axis=1)
    return int(np.quantile((away <= own).sum(axis=1), RECALL, method="higher"))


def rows_of(rows: DataFrame, dim: int, metric: str) -> DataFrame:
    """(key, v): vectors of the dimension, finite; for cosine of length 1."""
    good = rows.where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if metric != "cosine":
        return good
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return good.withColumn("norm", norm).where("norm > 0").select("key", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square, out = (centroids**2).sum(axis=1), np.zeros(len(v), np.int64)
    for at in range(0, len(v), 2048):
        out[at : at + 2048] = (square - 2 * v[at : at + 2048] @ centroids.T).argmin(axis=1)
    return out


def _candidates(q: np.ndarray, of_list: dict[int, np.ndarray], centroids: np.ndarray, step: np.ndarray, keep: int, schema: str):
    """An Arrow map from (list, key, code) to the nearest `keep` rows of the task for each query, by codes."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in (b.slice(at, 8192) for b in batches for at in range(0, b.num_rows, 8192)):
            lists, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, len(step))
            for c in np.unique(lists):
                inside = np.flatnonzero(lists == c)
                v = centroids[c] + code[inside] * step
                square = (v * v).sum(axis=1)
                for at, row in zip(of_list.get(int(c), ()), square - 2 * q[of_list.get(int(c), [])] @ v.T):
                    own, where = keys[inside], np.full(len(inside), c)
                    if at in best:
                        row, (own, where) = np.concatenate((best[at][0], row)), [np.concatenate(x) for x in zip(best[at][1], (own, where))]
                    if len(row) > keep:
                        top = np.argpartition(row, keep - 1)[:keep]
                        row, own, where = row[top], own[top], where[top]
                    best[at] = row, [own, where]
        for at, (row, (own, where)) in best.items():
            columns = np.full(len(row), at), where, own, row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return run


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> DataFrame:
    """(wanted, found): the exact neighbours (query, key), and how many of them an index found (query, key)."""
    hits = found.select(F.col("query").alias("q"), F.col("key").alias("k")).distinct()
    joined = exact.join(hits, (F.col("query") == F.col("q")) & (F.col(key) == F.col("k")), "left")
    return joined.agg(F.count("*").alias("wanted"), F.count("k").alias("found"))
