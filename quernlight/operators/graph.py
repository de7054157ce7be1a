"""Edges: bounded walks, cycles, layers."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import materialise


def touching(edges: DataFrame, node) -> DataFrame:
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Edges reached from the start nodes (node) within `depth` steps, once each with
    the smallest depth. Each step joins the new frontier only."""
    frontier, seen, found = start.select("node").distinct(), start.select("node").distinct(), []
    for k in range(1, depth + 1):
        step = edges.join(frontier, F.col("src") == F.col("node")).select("src", "dst")
        found.append(step.withColumn("depth", F.lit(k)))
        frontier = step.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.union(frontier)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("src", "dst").agg(F.min("depth").alias("depth"))


#: Edges that one task takes to finish with.
PART_EDGES = 1 << 19


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that something enters and something leaves: no other edge is on a cycle."""
    entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst")


def _spliced(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(edges, hung): nodes with one way in and one out are taken out of their way u -> node -> w, if the coin of
    this turn falls so (never two neighbours at once). Such a node is strongly connected with u if and only if w is:
    any cycle through it is one through u and w. hung: node, u, w."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2))
    one_in = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("u"), F.count("*").alias("n")).where("n = 1").drop("n")
    one_out = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("w"), F.count("*").alias("n")).where("n = 1").drop("n")
    hung = materialise(one_in.join(one_out, "node").where((coin("node") == 1) & (coin("u") == 0)))
    gone = hung.select("node")
    kept = edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")
    return materialise(kept.union(hung.select("u", "w").where("u <> w")).distinct()), hung


def _local_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on cycles, within one task: for PART_EDGES edges or few more."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        after: dict = {}
        for pdf in batches:
            for u, v in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
                after.setdefault(u, []).append(v)
        order: dict = {}
        low: dict = {}
        open_: list = []
        inside: set = set()
        found: list[tuple] = []
        for root in after:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            open_.append(root)
            inside.add(root)
            path = [(root, iter(after[root]))]
            while path:
                node, ways = path[-1]
                for v in ways:
                    if v not in order:
                        order[v] = low[v] = len(order)
                        open_.append(v)
                        inside.add(v)
                        path.append((v, iter(after.get(v, ()))))
                        break
                    if v in inside:
                        low[node] = min(low[node], order[v])
                else:
                    path.pop()
                    if path:
                        low[path[-1][0]] = min(low[path[-1][0]], low[node])
                    if low[node] == order[node]:
                        at = len(open_) - 1
                        while open_[at] != node:
                            at -= 1
                        members = open_[at:]
                        del open_[at:]
                        inside.difference_update(members)
                        if len(members) > 1:
                            least = min(members)
                            found += [(m, least) for m in members]
        yield pd.DataFrame(found, columns=["node", "component"])

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def _least_origin(edges: DataFrame) -> DataFrame:
    """(node, origin): the smallest node from which a node is reached; only what changed
    goes on in a step."""
    origin = materialise(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("origin", F.col("node")))
    changed = origin
    while not changed.isEmpty():
        sent = edges.join(changed, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("to")).agg(F.min("origin").alias("new"))
        better = sent.join(origin, F.col("to") == F.col("node")).where("new < origin")
        changed = materialise(better.select("node", F.col("new").alias("origin")))
        update = changed.select(F.col("node").alias("at"), F.col("origin").alias("new"))
        origin = materialise(origin.join(update, F.col("node") == F.col("at"), "left").select("node", F.coalesce("new", "origin").alias("origin")))
    return origin


def _coloured(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component rows, edges left): each node gets the smallest one that reaches it; what goes back from these
    within what they reach is a component, and goes."""
    origin = _least_origin(rest)
    of = lambda side: origin.select(F.col("node").alias(side), F.col("origin").alias(f"of_{side}"))
    inner = materialise(rest.join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst", F.col("of_src").alias("component")))
    met = frontier = materialise(origin.where("node = origin").select("node", F.col("origin").alias("component")))
    while not frontier.isEmpty():
        step = inner.select("src", "dst").join(frontier, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "component").distinct()
        frontier = materialise(step.join(met, "node", "left_anti"))
        met = materialise(met.unionByName(frontier))
    gone = met.select("node")
    return met, materialise(rest.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))


def strong_components(edges: DataFrame, nodes: DataFrame, part_edges: int = PART_EDGES) -> DataFrame:
    """(node, component): nodes that reach each other, named by their smallest. While there are more edges
    than a task may take, the graph is contracted: dead ends go, nodes on plain ways are spliced out of them, and
    where that does little, whole components are found by colours and go. The rest is finished by one task, and
    spliced nodes follow their neighbours, the last ones first. Null ends are ignored."""
    rest, found, spliced, turn = materialise(edges.select("src", "dst").where("src <> dst").distinct()), [], [], 0
    n = rest.count()
    while n > part_edges:
        before, (rest, hung) = n, _spliced(_trimmed(rest), turn)
        spliced.append(hung)
        n, turn = rest.count(), turn + 1
        if part_edges < n > 0.9 * before:
            met, rest = _coloured(rest)
            found.append(met)
            n = rest.count()
    if n:
        found.append(_local_components(rest))
    if not found and not spliced:
        return nodes.select("node", F.col("node").alias("component"))
    kind = rest.schema["src"].dataType.simpleString()
    of = materialise(reduce(DataFrame.unionByName, found) if found else rest.sparkSession.createDataFrame([], f"node {kind}, component {kind}"))
    for hung in reversed(spliced):
        # u and w alone: their component is themselves, so the node joins them only where w is u.
        side = lambda name: of.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
        own = lambda name: F.coalesce(f"of_{name}", name)
        joined = hung.join(side("u"), "u", "left").join(side("w"), "w", "left").where(own("u") == own("w")).select("node", own("u").alias("component"))
        # A lone u has no row yet: it gets one.
        heads = joined.select(F.col("component").alias("node"), "component").distinct().join(of, "node", "left_anti")
        of = materialise(of.unionByName(joined).unionByName(heads))
    if spliced:  # a spliced node may be smaller than the name of its component
        least = of.groupBy(F.col("component").alias("c")).agg(F.min("node").alias("least"))
        of = of.join(least, F.col("component") == F.col("c")).select("node", F.col("least").alias("component"))
    every = of.select(F.col("node").alias("at"), "component")
    return nodes.join(every, F.col("node") == F.col("at"), "left").select("node", F.coalesce("component", "node").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(root): nodes that reach themselves, in any number of steps."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    comps = materialise(strong_components(edges, nodes))
    shared = comps.groupBy(F.col("component").alias("c")).count().where("count > 1").select("c")
    looped = edges.where("src = dst").select(F.col("src").alias("root"))
    return comps.join(shared, F.col("component") == F.col("c"), "left_semi").select(F.col("node").alias("root")).union(looped).distinct()


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """Two-node cycles, each once."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.intersect(back).where("src < dst")


#: Targets of one list; of one task pairs, and targets of all its lists; pairs that it holds at once.
TARGETS, TASK_PAIRS, TASK_TARGETS, HELD_PAIRS = 1024, 32_000_000, 4_000_000, 1 << 19


def _changes(values: pa.Array) -> np.ndarray:
    """Where a value isn't the one before it; True at the first."""
    return np.diff(values.dictionary_encode("encode").indices.to_numpy(), prepend=-1) != 0


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _packed(rows: DataFrame) -> DataFrame:
    """(owner_block, owner, parts) of rows (owner, part) sorted by both: different parts of an owner in lists of
    TARGETS at most. The rows of one partition are a block."""
    owners, parts = (rows.schema[c].dataType.simpleString() for c in ("owner", "part"))

    def run(batches):
        for batch in batches:
            block, owner, part = batch.columns
            new = _changes(owner)
            kept = np.flatnonzero(new | _changes(part))
            owner, part, new = owner.take(pa.array(kept)), part.take(pa.array(kept)), new[kept]
            new[::TARGETS] = True
            at = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(part)), pa.int32()), part)
            yield pa.RecordBatch.from_arrays([block.slice(0, len(at)), owner.take(pa.array(at)), lists], names=["owner_block", "owner", "parts"])

    fields = f"owner_block int, owner {owners}, parts array<{parts}>"
    return rows.select(F.spark_partition_id().alias("owner_block"), "owner", "part").mapInArrow(run, fields)


class _Lists:
    """Targets of parts, for the owners of one task."""

    def __init__(self, parts: list[pa.Array], lists: list[pa.Array]):
        part, held = pa.concat_arrays(parts).dictionary_encode(), pa.concat_arrays(lists)
        target = held.flatten().dictionary_encode("encode")
        self.parts, self.targets = part.dictionary, target.dictionary
        of, sizes = part.indices.to_numpy(), held.value_lengths().to_numpy().astype(np.int64)
        by = np.argsort(of, kind="stable")
        self.codes = target.indices.to_numpy()[_ranges((np.cumsum(sizes) - sizes)[by], sizes[by])]
        self.sizes = np.bincount(of, sizes, len(self.parts)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def pairs(self, owner: pa.Array, parts: pa.Array) -> Iterator[pa.RecordBatch]:
        """(owner, target), once each, of rows sorted by owner."""
        new = _changes(owner)
        first = np.flatnonzero(new)
        found = pc.index_in(parts.flatten(), value_set=self.parts)
        held = found.is_valid().to_numpy(zero_copy_only=False)
        which = np.repeat(np.cumsum(new) - 1, parts.value_lengths().to_numpy())[held]
        found = found.drop_null().to_numpy()
        before = np.append(0, np.cumsum(self.sizes[found]))
        upto = lambda s: max(int(np.searchsorted(before, before[s] + HELD_PAIRS, "right")) - 1, s + 1)
        s, n = 0, len(self.targets)
        while s < len(found):
            e = upto(s)
            if e < len(found):  # whole owners only; one at least
                low = int(np.searchsorted(which, which[e]))
                e = low if low > s else int(np.searchsorted(which, which[s], "right"))
            local = (which[s:e] - which[s]).astype(np.int64)
            several = (local[-1] + 1) * n
            keys, seen = [], np.zeros(several, bool) if not local[-1] or several <= 16 * HELD_PAIRS else None
            at = s
            while at < e:  # more than once for an owner of very many
                stop = min(upto(at), e)
                key = self.codes[_ranges(self.starts[found[at:stop]], self.sizes[found[at:stop]])] + np.repeat(local[at - s : stop - s] * n, self.sizes[found[at:stop]])
                if seen is None:
                    keys.append(key)
                else:
                    seen[key] = True
                at = stop
            key = np.unique(np.concatenate(keys)) if seen is None else np.flatnonzero(seen)
            for k in range(0, len(key), HELD_PAIRS):
                of, code = np.divmod(key[k : k + HELD_PAIRS], n)
                yield pa.RecordBatch.from_arrays([owner.take(pa.array(first[which[s] + of])), self.targets.take(pa.array(code))], names=["owner", "target"])
            s = e


def _met(stream: DataFrame) -> DataFrame:
    """(owner, target) of rows sorted by the first three columns, which name a task's share, lists first, then by owner."""
    owner, lists = (stream.schema[c].dataType for c in ("owner", "_t"))

    def run(batches):
        here, parts, lists, table, rest = None, [], [], None, None
        for batch in batches:
            names = np.stack([c.to_numpy() for c in batch.columns[:4]], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for s, e in zip(cuts, cuts[1:]):
                *of, what = names[s].tolist()
                part, targets, owner, asked = (c.slice(s, e - s) for c in batch.columns[4:])
                if of != here:
                    if rest:
                        yield from table.pairs(*rest)
                    here, parts, lists, table, rest = of, [], [], None, None
                if not what:
                    parts.append(part)
                    lists.append(targets)
                    continue
                if not parts:  # none of this share's lists has a target
                    continue
                table = table or _Lists(parts, lists)
                if rest:
                    owner, asked = pa.concat_arrays([rest[0], owner]), pa.concat_arrays([rest[1], asked])
                last = int(np.flatnonzero(_changes(owner))[-1])  # may go on
                rest = owner.slice(last), asked.slice(last)
                if last:
                    yield from table.pairs(owner.slice(0, last), asked.slice(0, last))
        if rest:
            yield from table.pairs(*rest)

    return stream.mapInArrow(run, f"owner {owner.simpleString()}, target {lists.elementType.simpleString()}")


def two_hops(contains: DataFrame, depends: DataFrame) -> DataFrame:
    """(owner, target), once each: what an owner's parts depend on; edges may repeat. Owners are dealt in order to
    blocks; a block gets the targets of every part that it asks for once, not once for each owner, in lists of TARGETS
    or so, and pairs are made and told apart there. A block with more pairs than a task may make is dealt
    to several by owner, one with more targets than a task may hold by target."""
    spark = contains.sparkSession
    rows = contains.select(F.col("src").alias("owner"), F.col("dst").alias("part")).where("part is not null")
    degree = materialise(rows.groupBy("part").agg(F.count("*").alias("n")))
    held = depends.select(F.col("src").alias("part"), "dst").join(degree, "part").groupBy("part", "n").agg(F.count("*").alias("m"))
    held = materialise(held)
    pairs = held.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).first()[0]
    tasks = max(math.ceil(pairs / TASK_PAIRS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = materialise(_packed(rows.repartitionByRange(tasks, "owner").sortWithinPartitions("owner", "part")))
    asked = edges.select("owner_block", F.explode("parts").alias("part")).groupBy("owner_block", "part").agg(F.count("*").alias("n"))
    asked = materialise(asked.join(held.select("part", "m"), "part"))
    shares = asked.groupBy("owner_block").agg(
        F.ceil(F.sum(F.col("n").cast("double") * F.col("m")) / TASK_PAIRS).cast("int").alias("_shares"), F.ceil(F.sum("m") / TASK_TARGETS).cast("int").alias("_classes")
    )
    shares = materialise(shares)
    tasks = shares.agg(F.coalesce(F.sum(F.col("_shares") * F.col("_classes")), F.lit(1))).first()[0]
    pieces = held.select("part", F.ceil(F.col("m") / TARGETS).alias("_k"))
    lists = depends.select(F.col("src").alias("part"), "dst").join(pieces, "part").groupBy("part", F.pmod(F.xxhash64("dst"), "_k").alias("_piece"))
    # A set has no null; a target may be one.
    null = F.array(F.lit(None).cast(depends.schema["dst"].dataType))
    lists = lists.agg(F.concat(F.sort_array(F.collect_set("dst")), F.when(F.max(F.col("dst").isNull()), null).otherwise(F.slice(null, 1, F.lit(0)))).alias("_t"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = asked.select("owner_block", "part").join(lists.hint("merge"), "part").join(shares, "owner_block")
    sent = sent.withColumn("_share", each("_shares")).withColumn("_class", each("_classes"))
    # Within a piece hashes agree modulo its part's number of pieces: classes go by another hash.
    own = F.filter("_t", lambda x: F.pmod(F.xxhash64(F.lit(1), x), F.col("_classes")) == F.col("_class"))
    sent = sent.withColumn("_t", F.when(F.col("_classes") == 1, F.col("_t")).otherwise(own)).where(F.size("_t") > 0)
    sent = sent.select("owner_block", "_share", "_class", F.lit(0).alias("_what"), "part", "_t")
    owners = edges.join(shares, "owner_block").withColumn("_share", F.pmod(F.xxhash64("owner"), "_shares").cast("int")).withColumn("_class", each("_classes"))
    owners = owners.select("owner_block", "_share", "_class", F.lit(1).alias("_what"), "owner", "parts")
    by = ["owner_block", "_share", "_class"]
    return _met(sent.unionByName(owners, allowMissingColumns=True).repartition(tasks, *by).sortWithinPartitions(*by, "_what", "owner"))


def prefix_edges(imports: DataFrame, modules: DataFrame, separator: str = "::") -> DataFrame:
    """(src, module) where an import names a module or something in it. Each import
    is exploded into its prefixes, so the join is on equal names."""
    parts = F.split("import", separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    named = imports.select("src", F.explode(prefixes).alias("module")).distinct()
    return named.join(modules.select("module").distinct(), "module", "left_semi").select("src", "module")


def module_graph(imports: DataFrame, files: DataFrame, separator: str = "::") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files and modules: `contains` from a file to each of its modules,
    `depends` from a module to each module that its file's imports name, or name
    something in. imports: (path, import); files: (path, module)."""
    held = files.select("path", "module").distinct()
    contains = held.select(F.col("path").alias("src"), F.col("module").alias("dst"), F.lit("contains").alias("kind"))
    named = prefix_edges(imports.select(F.col("path").alias("src"), "import"), held, separator)
    depends = named.join(held.select(F.col("path").alias("src"), F.col("module").alias("of")), "src").where("of <> module")
    depends = depends.select(F.col("of").alias("src"), F.col("module").alias("dst"), F.lit("depends").alias("kind")).distinct()
    nodes = held.select(F.col("path").alias("node"), F.lit("file").alias("kind")).union(held.select("module", F.lit("module"))).distinct()
    return nodes, contains.unionByName(depends)


def layer_violations(contains: DataFrame, depends: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(owner, target) of two-hop edges whose owner and target hold the two parts of one
    of the forbidden patterns."""
    pairs = two_hops(contains, depends)
    return pairs.where(reduce(lambda a, b: a | b, [F.contains("owner", F.lit(x)) & F.contains("target", F.lit(y)) for x, y in patterns]))
