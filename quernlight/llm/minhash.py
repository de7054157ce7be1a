"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles of `WORDS` words. Its signature holds
the lowest 16 bits of `symbols` minima. For pairs at the wanted similarity the
number of differing symbols is binomial; `reach` is the distance that all but
one in 10,000 of them stay under. The signature is cut into chunks such that, by
the pigeonhole principle, a pair within `reach` has a chunk with at most one
differing symbol: each document is looked up under every chunk with each one
symbol left out, so no pair within reach is missed. More symbols (`LONG` in
all) only serve to turn down candidates. What remains is confirmed on full sets.

Equal sets are one class first, so copies cost one row. In a bucket every class
is a candidate of the smallest one; buckets whose classes are not all tied
together by that are searched in tiles of at most TILE by TILE signatures. Both
only pass on a spanning forest of the candidates, never a group's pairs. The
trees of that forest hold every candidate pair; their sets are compared in tiles
again (bounded in classes and shingles), and only a spanning forest of the
confirmed links leaves a tile. Before that, each class's set is compared with those
of its buckets' smallest classes; a tree that these links tie together whole, as
those of copies are, needs no tiles, and in others only what isn't tied yet is
compared. So no link between components is lost.

Defined cases: documents without words (null, empty, white space) have an empty
set, link with nothing and are kept; fewer than five words are one shingle.
Rows with a null doc_id link with nothing (component null, kept). Repeated rows
are one document and each get the same values; rows with one doc_id and
different texts are different texts that share a name. Other columns are not
read; an empty table stays empty. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .components import connected_components
from .shared import cut, drop, map_rows

WORDS = 5
LONG = 128
TILE = 512
_C1, _C2, _C3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; words in lower-case A-Z,
    split at \\x20 and \\x09-\\x0D (what bytes.lower and bytes.split do)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    width = min(n, words)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix(acc * _C3 + h[j : n - width + 1 + j])
    return np.unique(acc)


@lru_cache(maxsize=4)
def _functions(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(0, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, symbols, dtype=np.uint64)


def signature(s: np.ndarray, symbols: int = LONG) -> np.ndarray:
    """16-bit symbols of the minima; s must not be empty."""
    a, b = _functions(symbols)
    low = np.full(symbols, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        low = np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2")


def _under(n: int, p: float, miss: float) -> int:
    """Smallest r with P(Binomial(n, p) > r) <= miss."""
    r, left = -1, 1.0
    while left > miss:
        r += 1
        left -= math.comb(n, r) * p**r * (1 - p) ** (n - r)
    return r


@lru_cache(maxsize=8)
def layout(percent: int, miss: float = 1e-4) -> tuple[int, list[tuple[int, int]], int, int]:
    """Indexed symbols, their chunks, the distance within reach, and the most
    differing symbols of the whole signature that a candidate may have."""
    p = 1 - percent / 100
    for symbols in range(32, LONG + 1, 16):
        reach = _under(symbols, p, miss)
        chunks = -(-(reach + 1) // 2)
        if symbols / chunks >= 4.3 or symbols == LONG:
            cuts = [round(k * symbols / chunks) for k in range(chunks + 1)]
            return symbols, list(zip(cuts, cuts[1:])), reach, _under(LONG, p, miss / 10)
    raise AssertionError


def bucket_keys(sigs: np.ndarray, percent: int) -> np.ndarray:
    """One key for each signature (row) and symbol left out of its chunk (column)."""
    symbols, chunks, _, _ = layout(percent)
    out = np.empty((len(sigs), symbols), np.uint64)
    wide = sigs[:, :symbols].astype(np.uint64)
    for c, (a, b) in enumerate(chunks):
        for skip in range(a, b):
            acc = np.full(len(sigs), c * 1000 + skip, np.uint64)
            for j in range(a, b):
                if j != skip:
                    acc = mix(acc * _C3 + wide[:, j])
            out[:, skip] = acc
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, k1 and k2 (128 bits that tell sets apart), sig."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(ids, texts):
        for i, t in zip(ids, texts):
            s = shingles(t)
            if not len(s):
                yield i, 0, None, None, None
                continue
            k1, k2 = (mix(s ^ _C3).sum(dtype=np.uint64), mix(s + _C1).sum(dtype=np.uint64))
            yield i, len(s), int(k1.astype(np.int64)), int(k2.astype(np.int64)), signature(s).tobytes()

    return map_rows(
        docs.select(id_col, text_col), lambda: run,
        f"`{id_col}` {kind}, n_shingles bigint, k1 bigint, k2 bigint, sig binary",
    )


def _keys(classes: DataFrame, percent: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                reps = batch.column(0).to_numpy(zero_copy_only=False)
                sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, LONG)
                for at in range(0, len(reps), 2000):
                    keys = bucket_keys(sigs[at : at + 2000], percent)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(reps[at : at + 2000], keys.shape[1]))], schema=schema
                    )

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _close(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures don't rule the similarity out."""
    most = layout(percent)[3]
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(a, b, sa, sb):
        x = np.frombuffer(b"".join(sa), "<u2").reshape(-1, LONG) != np.frombuffer(b"".join(sb), "<u2").reshape(-1, LONG)
        return [(p, q) for p, q, far in zip(a, b, x.sum(axis=1)) if far <= most]

    return map_rows(both.select("a", "b", "sig_a", "sig_b"), lambda: run, "a bigint, b bigint")


def _tiles(rows: DataFrame, group: str, weight: str, heavy: int, cols: tuple[str, ...]) -> DataFrame:
    """Deal the rows of each group to tiles (group, i, j) of two blocks; a block has
    about TILE rows, or a weight of `heavy`, at most. Sorted by tile."""
    blocks = F.ceil(F.greatest(F.count("*") / TILE, F.sum(weight) / heavy)).cast("int")
    counts = cut(rows.groupBy(F.col(group).alias("g")).agg(blocks.alias("blocks"), F.count("*").alias("held")).where("held > 1"))
    rows = rows.join(counts, rows[group] == counts["g"])
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select(F.col("g"), *cols, own.alias("own"), every.alias("other"))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *cols)
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "rep")


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _each_tile(rows: DataFrame, tile: Callable[[list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """Edges (a, b) that tile() gives for the rows of each tile."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        out: list[tuple[int, int]] = []
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if part and row[:3] != part[0][:3]:
                    out += tile(part)
                    part = []
                part.append(row)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += tile(part) if part else []
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, "a bigint, b bigint")


def _candidate_forest(members: DataFrame, percent: int) -> DataFrame:
    """Edges that tie classes of one bucket which their signatures allow to link.
    members: (key, rep, comp, n, sig), comp: what is tied already."""
    most = layout(percent)[3]

    def tile(part: list[tuple]) -> list[tuple[int, int]]:
        i, j = part[0][1:3]
        own, rep, comp, n = (np.array([r[c] for r in part], np.int64) for c in (3, 4, 5, 6))
        if comp.min() == comp.max():
            return []
        sigs = np.frombuffer(b"".join(r[7] for r in part), "<u2").reshape(-1, LONG)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        forest, out = _Forest(), []
        for x in left:
            y = right[right > x] if i == j else right
            y = y[comp[y] != comp[x]]
            y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent]
            if len(y):
                for k in y[(sigs[y] != sigs[x]).sum(axis=1) <= most]:
                    if forest.tie(int(comp[x]), int(comp[k])):
                        out.append((int(rep[x]), int(rep[k])))
        return out

    return _each_tile(_tiles(members, "key", "one", 1 << 62, ("rep", "comp", "n", "sig")), tile)


def _link_forest(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that tie the classes which full sets link. rows: (tree, rep, comp, n, sig,
    set), comp: what is tied already."""
    most = layout(percent)[3]

    def tile(part: list[tuple]) -> list[tuple[int, int]]:
        i, j = part[0][1:3]
        own, rep, comp, n = (np.array([r[c] for r in part], np.int64) for c in (3, 4, 5, 6))
        if comp.min() == comp.max():
            return []
        sigs = np.frombuffer(b"".join(r[7] for r in part), "<u2").reshape(-1, LONG)
        sets = [np.frombuffer(r[8], "<u8") for r in part]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        forest, out = _Forest(), []
        for x in left:
            y = right[right > x] if i == j else right
            y = y[comp[y] != comp[x]]
            y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent]
            if not len(y):
                continue
            far = (sigs[y] != sigs[x]).sum(axis=1)
            for k in y[np.argsort(far, kind="stable")[: int((far <= most).sum())]]:
                if forest.root(int(comp[x])) != forest.root(int(comp[k])) and linked(sets[x], sets[k], percent):
                    forest.tie(int(comp[x]), int(comp[k]))
                    out.append((int(rep[x]), int(rep[k])))
        return out

    return _each_tile(_tiles(rows, "tree", "n", 1_000_000, ("rep", "comp", "n", "sig", "set")), tile)


def linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    p, q = (p, q) if len(p) < len(q) else (q, p)
    shared = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the edges (a, b) that full sets (rep, set) link. The sets of a's go to
    their b, once for each edge; a b that many have stands in several places."""
    edges = cut(edges.select("a", "b").distinct())
    places = cut(edges.groupBy(F.col("b").alias("to")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("places")))
    sides = edges.join(places, F.col("b") == F.col("to")).join(sets, F.col("a") == F.col("rep")).select(
        "b", F.pmod(F.xxhash64("a"), "places").cast("int").alias("place"), "a", "set"
    )
    hubs = places.join(sets, F.col("to") == F.col("rep")).select(
        F.col("to").alias("b"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(None).cast("long").alias("a"), "set"
    )
    stream = hubs.unionByName(sides).repartition("b", "place").sortWithinPartitions("b", "place", F.col("a").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hubs = None, []  # several sets where one id names several texts
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                for b, place, a, data in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns)):
                    if here != (b, place):
                        here, hubs = (b, place), []
                    one = np.frombuffer(data, "<u8")
                    if a is None:
                        hubs.append(one)
                    elif any(linked(one, hub, percent) for hub in hubs):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    found = cut(stream.mapInArrow(run, "a bigint, b bigint"))
    drop(edges, places)
    return found


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the wanted classes (rep, k1)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    # A merge join at every size: the texts are dealt once, and nothing depends on how few classes there are.
    rows = texts.join(wanted.hint("merge"), F.col("i") == F.col("rep")).select("rep", "k1", "t").dropDuplicates(["rep", "t"])

    def run(rep, k1, text):
        for r, k, t in zip(rep, k1, text):
            s = shingles(t)
            if len(s) and int(mix(s ^ _C3).sum(dtype=np.uint64).astype(np.int64)) == k:
                yield r, s.astype("<u8").tobytes()

    return map_rows(rows, lambda: run, "rep bigint, set binary", 500)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, kept. Linked are
    rows with 100 * intersection >= percent * union; component_id is the smallest
    id reachable, kept says that it is the row's own."""
    sigs = cut(signatures(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    classes = sigs.where("n_shingles > 0 and id is not null").groupBy("k1", "k2", "n_shingles")
    classes = cut(classes.agg(F.min(F.col("id").cast("bigint")).alias("rep"), F.first("sig").alias("sig")))
    keys = cut(_keys(classes, percent))
    shared = cut(keys.groupBy(F.col("key").alias("k")).agg(F.min("rep").alias("pivot"), F.count("*").alias("held")).where("held > 1"))
    members = cut(keys.join(shared, F.col("key") == F.col("k")).select("key", "rep", "pivot", "held"))
    drop(keys)

    star = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    star = cut(_close(classes, star, percent))
    tied = connected_components(star)
    wide = members.where("held > 2").join(tied, F.col("rep") == F.col("node"), "left")
    wide = cut(wide.select("key", "rep", F.coalesce("component", "rep").alias("comp")))
    mixed = wide.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    mixed = cut(mixed.select("k"))
    side = classes.select(F.col("rep").alias("r"), F.col("n_shingles").alias("n"), "sig", F.lit(1).alias("one"))
    loose = wide.join(mixed, F.col("key") == F.col("k")).join(side, F.col("rep") == F.col("r"))
    more = cut(_candidate_forest(loose.select("key", "rep", "comp", "n", "sig", "one"), percent))
    candidates, trees = star, tied
    if not more.isEmpty():
        candidates = star.unionByName(more)
        trees = connected_components(candidates)
    whole = cut(trees.join(classes, F.col("node") == F.col("rep")).select(F.col("component").alias("tree"), "rep", "k1", F.col("n_shingles").alias("n"), "sig"))
    drop(shared, members, wide, mixed)
    sets = cut(_sets(docs, whole.select("rep", "k1"), id_col, text_col))
    ties = _confirmed(candidates, sets, percent)
    tied = connected_components(ties)
    trees = whole.join(tied, F.col("rep") == F.col("node"), "left").select("tree", "rep", F.coalesce("component", "rep").alias("comp"), "n", "sig")
    trees = cut(trees)
    parted = trees.groupBy(F.col("tree").alias("t")).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("t")
    loose = trees.join(cut(parted), F.col("tree") == F.col("t")).join(sets.withColumnRenamed("rep", "of"), F.col("rep") == F.col("of"))
    full = cut(loose.select("tree", "rep", "comp", "n", "sig", "set"))
    edges = cut(_link_forest(full, percent))
    comps = tied if edges.isEmpty() else connected_components(ties.unionByName(edges))
    drop(full, edges, ties, trees, whole, sets, star, more)
    comps = comps.withColumnRenamed("node", "rep")
    named = cut(classes.join(comps, "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component")))
    out = sigs.join(named, ["k1", "k2", "n_shingles"], "left")
    lone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    component = F.when(lone, F.col("id").cast("bigint")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        (lone | (F.col("id").cast("bigint") == component)).alias("kept"),
    )


#: All pairs that share a shingle, and components by the smallest id reachable, in DuckDB.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id, min(c) = doc_id AS kept
FROM documents JOIN r ON r.a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
