"""Embedding near-dedup by collision counting over one-dimensional projections.

Vectors of one label are compared. Every vector is projected on `PROJECTIONS`
random lines; on each line the sorted values around a query vector, within a
window of half its width to either side, collide with it. A pair that collides
on at least `threshold` lines is a candidate and is verified by its cosine in
double precision. For a pair at the wanted cosine the difference on a line is
normal with the pair's distance as deviation, so the number of collisions is
binomial: the threshold is the largest count that all but `MISS` of such pairs
reach; closer pairs reach it more often.

Equal vectors of a label are one class first (direction and length: equal
components), so copies cost one row. Who meets whom in a label: a number of tables,
each of which parts the label by the sides of `bits` further lines, so vectors meet
where they fall on the same side of all lines of some table. A pair at the wanted
cosine falls on one side of a line with a chance that its angle alone gives, so
the number of tables for which all but MISS of such pairs meet follows from the bits,
whatever the data; the bits follow from the label's size (the fewest copies of a
vector; none, and so one table, for up to about 25,000 vectors). A cell of more than
BLOCK classes is dealt to blocks by hash, and each two blocks meet in one
bounded task, where the collisions are counted; a hot label or cell only makes
more tasks. A pair counts in the first table in which it meets. A task hands on one row for
each vector with links: how many vectors it is linked with there, and the smallest
node it is tied to.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing (0 links, their own
component, kept). Vectors of different lengths are never linked. Repeated rows
count as other vectors of the same id and are linked with one another. A null
vec_id links with nothing. One id under several labels names several vectors, each
with the links of its own label. Other columns are not read; an empty table stays
empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .components import connected_components
from .shared import cut, drop

PROJECTIONS = 28
WINDOW = 1.25  # half a window's width, in deviations of a pair at the wanted cosine
MISS = 1e-4
BLOCK = 2048
MOST_BITS = 24  # of one table; beyond 2**35 vectors of a label cells grow again, and are dealt to blocks


@lru_cache(maxsize=8)
def threshold(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """Largest count that a pair at the wanted cosine stays under in `miss` of cases."""
    p = math.erf(window / math.sqrt(2))
    under, count = 0.0, 0
    while count < projections:
        under += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if under > miss:
            break
        count += 1
    return count


@lru_cache(maxsize=8)
def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(977 + dim).standard_normal((dim, PROJECTIONS))


def candidates(left: np.ndarray, right: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in left, positions in right) of pairs that collide often enough;
    rows are unit vectors."""
    half = WINDOW * math.sqrt(2 - 2 * cosine)
    lines = _lines(left.shape[1])
    need = threshold()
    values = right @ lines
    orders = np.argsort(values, axis=0, kind="stable")
    ordered = np.take_along_axis(values, orders, axis=0)
    queries = left @ lines
    step = 256
    for at in range(0, len(left), step):
        part = queries[at : at + step]
        counts = np.zeros((len(part), len(right)), np.uint8)
        for line in range(PROJECTIONS):
            low = np.searchsorted(ordered[:, line], part[:, line] - half, "left")
            high = np.searchsorted(ordered[:, line], part[:, line] + half, "right")
            order = orders[:, line]
            for q in range(len(part)):
                counts[q, order[low[q] : high[q]]] += 1
        i, j = np.nonzero(counts >= need)
        yield i + at, j


def tables(bits: int, cosine: float, miss: float = MISS) -> int:
    """Tables of so many lines each for which all but `miss` of the pairs at that cosine meet."""
    side = 1 - math.acos(cosine) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(side**bits))) if bits else 1


def _cells(raw: np.ndarray, bits: int, count: int) -> np.ndarray:
    """The cell of each row in each table: sums of whole numbers, exact in any order, so that every task finds the same."""
    whole = np.rint(raw / np.abs(raw).max(axis=1, keepdims=True) * (1 << 20))
    cells = np.zeros((len(raw), count), np.int64)
    for table in range(count if bits else 0):
        lines = np.rint(np.random.default_rng([977, raw.shape[1], table]).standard_normal((raw.shape[1], bits)) * 1024)
        cells[:, table] = (whole @ lines > 0) @ (1 << np.arange(bits))
    return cells


def _meetings(rows: DataFrame, cosine: float) -> DataFrame:
    """(label, bits, node, place, cell) for each class and table: rows are (label, bits, node, vector)."""
    fields = T.StructType([*rows.schema.fields[:3], T.StructField("place", T.IntegerType()), T.StructField("cell", T.LongType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, bits = np.asarray(pc.list_value_length(batch.column(3))), np.asarray(batch.column(1))
            for length, b in sorted(set(zip(lengths.tolist(), bits.tolist()))):
                at = pa.array(np.flatnonzero((lengths == length) & (bits == b)))
                count, head = tables(b, cosine), [c.take(at) for c in batch.columns]
                cells = _cells(np.asarray(head[3].flatten(), np.float64).reshape(-1, length), b, count)
                again = pa.array(np.repeat(np.arange(len(at)), count))
                places = pa.array(np.tile(np.arange(count, dtype=np.int32), len(at)))
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in head[:3]), places, pa.array(cells.ravel())], schema=arrow)

    return rows.mapInArrow(run, fields)


def _pairs(rows: DataFrame, cosine: float) -> DataFrame:
    """(node, links, tied) for each class and task: rows are (label, bits, place, cell, i, j, own, node, held, vector), sorted by task."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("tied", pa.int64())])

    def task(part: list[tuple]) -> list[tuple[int, int, int]]:
        bits, place, _, i, j = part[0][1:6]
        own, node, held = (np.array([r[c] for r in part], np.int64) for c in (6, 7, 8))
        lengths = np.array([len(r[9]) for r in part])
        links = np.zeros(len(part), np.int64)
        up = list(range(len(part)))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            raw = np.array([part[k][9] for k in same], np.float64)
            # Scaled first: no overflow or underflow in the norm.
            unit = raw / np.abs(raw).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            left, right = np.flatnonzero(own[same] == i), np.flatnonzero(own[same] == j)
            if not len(left) or not len(right):
                continue
            for p, q in candidates(unit[left], unit[right], cosine):
                p, q = left[p], right[q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                true = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[true], q[true]
                if place and len(p):
                    which, where = np.unique(np.concatenate([p, q]), return_inverse=True)
                    cells = _cells(raw[which], bits, place)
                    new = ~(cells[where[: len(p)]] == cells[where[len(p) :]]).any(axis=1)
                    p, q = p[new], q[new]
                p, q = same[p], same[q]
                np.add.at(links, p, held[q])
                np.add.at(links, q, held[p])
                for a, b in zip(p.tolist(), q.tolist()):
                    a, b = root(a), root(b)
                    if a != b:
                        up[max(a, b)] = min(a, b)
        least: dict[int, int] = {}
        for k in range(len(part)):
            r, x = root(k), int(node[k])
            least[r] = min(least.get(r, x), x)
        return [(int(node[k]), int(links[k]), least[root(k)]) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if part and row[:6] != part[0][:6]:
                    out += task(part)
                    part = []
                part.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        if part and (out := task(part)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return rows.mapInArrow(run, "node bigint, links bigint, tied bigint")


def _with_bits(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """classes with the bits for their label's size: those that copy a vector least often."""
    n = F.count("*")
    copies = F.array(*(tables(b, cosine) * F.ceil(n / (block << b)) for b in range(MOST_BITS + 1)))
    bits = (F.array_position(copies, F.array_min(copies)) - 1).cast("int")
    sizes = classes.groupBy(F.col("label").alias("l")).agg(bits.alias("bits"))
    return classes.join(sizes, F.col("label") == F.col("l")).drop("l")


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    good = F.coalesce(whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # Equal components, -0.0 and 0.0 alike, whatever the float type.
    same = F.sha2(F.array_join(F.transform(vector, lambda x: (x + 0.0).cast("string")), ","), 256)
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("id"), "label", good.alias("good"), F.when(good, same).alias("same"), vector.alias("vector")
    )
    classes = rows.where("good").groupBy("label", "same").agg(
        F.min("id").alias("rep"), F.count("*").alias("held"), F.first("vector").alias("vector")
    )
    # A class is a node of its own, whatever its smallest id: a number that the written table keeps.
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    places = cut(_meetings(_with_bits(classes, cosine, block).select("label", "bits", "node", "vector"), cosine))
    cell = ["label", "place", "cell"]
    large = places.groupBy(*cell).count().where(F.col("count") > block)
    large = large.select(*(F.col(c).alias(f"{c}_") for c in cell), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    parts = places.join(large, [F.col(c) == F.col(f"{c}_") for c in cell], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    parts = parts.select(*cell, "bits", "node", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    parts = parts.select(F.col("node").alias("n"), "bits", "place", "cell", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tile = ["label", "bits", "place", "cell", "i", "j"]
    dealt = classes.join(parts, F.col("node") == F.col("n")).select(*tile, "own", "node", "held", "vector")
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile, "node")
    found = cut(_pairs(dealt, cosine))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("tied").alias("b"))).withColumnRenamed("node", "in")
    links = found.groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("links"))
    named = classes.select("label", "same", "rep", "held", "node").join(links, F.col("node") == F.col("of"), "left")
    named = cut(named.join(comps, F.col("node") == F.col("in"), "left").withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least"))
    named = cut(named.join(least, F.col("component") == F.col("c")).select(
        F.col("label").alias("l"), F.col("same").alias("s"), (F.coalesce("links", F.lit(0)) + F.col("held") - 1).alias("n_links"),
        F.col("least").alias("component"),
    ))
    drop(found, places, classes)
    out = rows.select("id", "label", "same").join(named, (F.col("label") == F.col("l")) & (F.col("same") == F.col("s")), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


#: Every pair within a label; components by the smallest id reachable.
ORACLE = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (
  SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(c) AS component_id, min(c) = vec_id AS kept
FROM embeddings JOIN r ON r.a = vec_id LEFT JOIN n ON n.a = vec_id GROUP BY vec_id
"""
