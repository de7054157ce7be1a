"""Vector code compression: product codes with a kd-tree for each codebook.

A vector is cut into equal consecutive parts; each part position has a codebook. In
every round the codebooks' kd-trees are broadcast; a part's nearest entry is found by
branch and bound: nearer child first, then every node whose box is no farther than
the best so far. Nodes at an equal bound are visited, so that of equally near entries
the lowest index is kept. Entries then become the floored means of their parts, from
whole-number sums that tasks hand on (one for each entry, not for each row).

What is broadcast and collected in a round is entries x dimension numbers, both
parameters of the model; at most 256 entries fit the two digits of a code.

Defined cases: rows whose vector is null or holds null or non-finite components are
left out. The dimension is that of the smallest kept vec_id (null ids last) whose
length is a positive multiple of the parts; rows of other lengths have no parts to line
up, stay, and get a null code and error. With fewer rows than entries a codebook is
smaller. Repeated rows are rows of their own (rows of one id start in the order of
their components). An empty table gives an empty result; other columns are not read.
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

LEAF = 4


class KdTree:
    """Exact nearest entry of a codebook, ties to the lowest index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple[np.ndarray, np.ndarray, tuple[int, int] | np.ndarray]] = []
        self._build(np.arange(len(entries)))

    def _build(self, held: np.ndarray) -> int:
        points = self.entries[held]
        low, high = points.min(axis=0), points.max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, held))
        widest = int((high - low).argmax())
        if len(held) > LEAF and high[widest] > low[widest]:
            order = held[np.argsort(points[:, widest], kind="stable")]
            middle = len(order) // 2
            children = self._build(np.sort(order[:middle])), self._build(np.sort(order[middle:]))
            self.nodes[at] = low, high, children
        return at

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row; all rows walk the tree together."""
        best, where = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.entries))

        def bound(node: int, which: np.ndarray) -> np.ndarray:
            low, high, _ = self.nodes[node]
            part = rows[which]
            gap = np.maximum(np.maximum(low - part, part - high), 0)
            return np.einsum("ij,ij->i", gap, gap)

        def visit(node: int, which: np.ndarray) -> None:
            if not len(which):
                return
            inside = self.nodes[node][2]
            if isinstance(inside, tuple):
                near, far = (bound(child, which) for child in inside)
                first = near <= far
                for child, other, part, gap in ((*inside, first, far), (*inside[::-1], ~first, near)):
                    visit(child, which[part])
                    visit(other, which[part][gap[part] <= best[which[part]]])
                return
            for e in inside:
                gap = rows[which] - self.entries[e]
                d = np.einsum("ij,ij->i", gap, gap)
                better = (d < best[which]) | ((d == best[which]) & (e < where[which]))
                hit = which[better]
                best[hit], where[hit] = d[better], e

        visit(0, np.arange(len(rows)))
        return where, best


def compress(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per kept row: id_col, label_col, code (two hex digits a part), error (squared, in steps
    of 1 / scale), label_error (over rows of an equal label, nulls together) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits has 1 to 256 entries")
    spark = vectors.sparkSession
    q = cut(whole_numbers(vectors, vector_col, scale, [id_col, label_col]))
    order = [F.col(id_col).asc_nulls_last(), F.col("q")]
    fitting = q.where((F.size("q") > 0) & (F.size("q") % parts == 0))
    first = fitting.select(id_col, "q").orderBy(*order).limit(1).collect()
    dim = len(first[0]["q"]) if first else 0
    width = dim // parts
    same = q.where(F.size("q") == dim) if dim else q.limit(0)
    starts = [r["q"] for r in same.select(id_col, "q").orderBy(*order).limit(entries).collect()]
    books = np.array(starts, np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2).copy()  # part, entry, position
    size = len(starts)
    for _ in range(rounds if size else 0):
        trees = spark.sparkContext.broadcast([KdTree(book) for book in books])

        def assign(batch: pa.RecordBatch, trees=trees) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            whole = matrix(batch.column(0), dim)
            for p, tree in enumerate(trees.value):
                rows = whole[:, p * width : (p + 1) * width]
                yield rows, tree.nearest(rows)[0] + p * size

        for g, mean in group_means(same.select("q"), parts * size, width, assign).items():
            books[divmod(g, size)] = mean
        trees.unpersist()
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    trees = spark.sparkContext.broadcast([KdTree(book) for book in books] if size else [])
    fields = T.StructType([q.schema[id_col], q.schema[label_col], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            fits = np.asarray(lists.value_lengths()) == dim if size else np.zeros(batch.num_rows, bool)
            whole = matrix(lists.filter(pa.array(fits)), dim) if size else np.zeros((0, 0), np.int64)
            digits, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p, tree in enumerate(trees.value):
                digits[:, p], gap = tree.nearest(whole[:, p * width : (p + 1) * width])
                error += gap
            place = np.cumsum(fits) - 1
            codes = [digits[k].tobytes().hex() if ok else None for k, ok in zip(place, fits)]
            errors = [int(error[k]) if ok else None for k, ok in zip(place, fits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema=arrow)

    found = cut(q.select(id_col, label_col, "q").mapInArrow(run, fields))
    drop(q)
    by_label = found.groupBy(F.col(label_col).alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col(label_col).eqNullSafe(F.col("of"))).select(
        id_col, label_col, "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, width: int = 8) -> str:
    """All distances to all entries, one table for each round; vectors of parts * width components."""
    tables = [
        """k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""s AS MATERIALIZED (SELECT vec_id, p, list_slice(q, p * {width} + 1, p * {width} + {width}) AS v FROM k, (SELECT unnest(range({parts})) AS p))""",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM s QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        tables.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, v, m.e AS e, m.d AS d FROM (
  SELECT vec_id, p, any_value(v) AS v, min({{'d': d, 'e': e}}) AS m FROM (SELECT vec_id, s.p, s.v, c.e,
    list_sum(list_transform(list_zip(s.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM s JOIN c{r} c ON s.p = c.p) GROUP BY vec_id, p))""")
        if r < rounds:
            tables.append(f"""c{r + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN (
  SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
    FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = o.p AND m.e = o.e)""")
    return "WITH " + ",\n".join(tables) + f""",
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN f USING (vec_id)"""
