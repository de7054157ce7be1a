"""Centroid clustering by annulus search.

Lloyd's rounds in whole numbers. The centroids, broadcast and sorted by norm, are
searched for each vector: exact distances to a few probes (the centroid nearest in
norm, and some evenly spread over the norms) give an upper bound u; by the triangle
inequality a centroid within u has a norm within u of the vector's own, so a binary
search gives the annulus of candidates, and only these are compared, by exact
squared distances, ties to the smaller number. The annulus is widened by the
rounding of the norms, so that a centroid on its boundary is compared, too.

A round is one pass over the vectors: a task keeps a sum for each centroid and
hands on these only. The size of what is broadcast and collected is k times the
dimension, both parameters, and is refused beyond MOST.

Defined cases: vectors that are null, of another length, or that hold null or
non-finite components are left out; with fewer vectors than k there are as many
centroids as vectors; repeated rows are vectors of their own (rows of one id start
in the order of their components), a null vec_id comes last in the choice of
starts; an empty table gives an empty result; other columns are not read.
Components beyond 2**26 / scale raise an error (see whole_numbers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .integer_vectors import group_means, matrix, whole_numbers
from .shared import cut, drop

#: Most numbers in all centroids together.
MOST = 1 << 24


class Annulus:
    """Exact nearest centroid, by norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.lexsort((np.arange(len(norms)), norms))  # equal norms: smaller number first
        self.norms, self.sorted = norms[self.number], centroids[self.number]
        self.largest = int(np.abs(centroids).max(initial=0))
        self.probes = np.linspace(0, len(norms) - 1, int(np.sqrt(len(norms)))).astype(int)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) for each row, and how many exact comparisons it took."""
        n, k = len(rows), len(self.norms)
        # Products of doubles are exact as long as all sums stay below 2**53.
        reach = int(np.abs(rows).max(initial=0)) + self.largest
        kind = np.float64 if reach * reach * rows.shape[1] < 1 << 53 else np.int64
        x, c = rows.astype(kind), self.sorted.astype(kind)
        square = (x * x).sum(axis=1)
        c_square = (c * c).sum(axis=1)
        norms = np.sqrt(square.astype(np.float64))
        best, where = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        seen = 0

        def compare(which: np.ndarray, j: int) -> None:
            nonlocal seen
            seen += len(which)
            d = (square[which] - 2 * (x[which] @ c[j]) + c_square[j]).astype(np.int64)
            number = self.number[j]
            better = (d < best[which]) | ((d == best[which]) & (number < where[which]))
            hit = which[better]
            best[hit], where[hit] = d[better], number

        every = np.arange(n)
        for j in self.probes:
            compare(every, j)
        close = np.clip(np.searchsorted(self.norms, norms), 0, k - 1)
        for j in np.unique(close):
            if j not in self.probes:
                compare(np.flatnonzero(close == j), j)
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norms + self.norms[-1] + 1)
        low = np.searchsorted(self.norms, norms - bound - slack, "left")
        high = np.searchsorted(self.norms, norms + bound + slack, "right")
        done = set(self.probes.tolist())
        for j in range(low.min(initial=k), high.max(initial=0)):
            if j not in done:
                compare(np.flatnonzero((low <= j) & (j < high) & (close != j)), j)
        return where, best, seen


def start_centroids(q: DataFrame, k: int, seed: str, id_col: str) -> np.ndarray:
    """The vectors of the k smallest hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)
    rows = q.select(key.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance (squared, in steps of 1 / scale),
    cluster_inertia, inertia and centroid_sha256 (of the final centroid's components)."""
    if k * dim > MOST:
        raise ValueError(f"{k} centroids of {dim} components are more than {MOST} numbers")
    q = cut(whole_numbers(vectors, vector_col, scale, [id_col], dim))
    centroids = start_centroids(q, k, seed, id_col)
    kind = q.schema[id_col].dataType
    fields = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    hashes = ["" for _ in centroids]
    if len(centroids):
        for _ in range(rounds):
            search = q.sparkSession.sparkContext.broadcast(Annulus(centroids))

            def assign(batch: pa.RecordBatch, search=search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                rows = matrix(batch.column(1), dim)
                yield rows, search.value.nearest(rows)[0]

            for g, mean in group_means(q, len(centroids), dim, assign).items():
                centroids[g] = mean
            search.unpersist()
        hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    search = q.sparkSession.sparkContext.broadcast(Annulus(centroids) if len(centroids) else None)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = search.value.nearest(matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], schema=arrow)

    found = cut(q.mapInArrow(run, fields))
    drop(q)
    totals = {c: t for c, t in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    beside = [(c, totals[c], sum(totals.values()), hashes[c]) for c in totals]
    beside = found.sparkSession.createDataFrame(beside, "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(beside), F.col("cluster") == F.col("c")).drop("c")


def oracle(k: int = 8, rounds: int = 10) -> str:
    """All distances to all centroids, one table for each round."""
    parts = [
        """k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
  SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM k ORDER BY h LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, m.c AS c, m.d AS d FROM (
  SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (SELECT vec_id, k.v, c.c,
    list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{r} c) GROUP BY vec_id))""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.v, o.v) AS v FROM c0 JOIN c{r} o USING (c) LEFT JOIN (
  SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
