"""Mixing sources to target weights by pivotal dependent rounding (native).

Each source gets a share of all words by its weight; a target stops at
`max_repeats` times its source's words, and the excess goes to the others by
weight until no target is above (solved as one water level over the sources
sorted by cap over weight). Each document then stands for target / source words
copies: the whole part is taken, the fraction is rounded dependently. Two
documents at a time, words move at random from one to the other until one of
the two is taken whole or not at all; the chances keep every document's
expectation, the words of the pair stay the same. Groups of about FAN documents
are combined this way and hand one unfinished document to the next level of a
reduction tree, FAN groups to one, until one document a source is left; of it
as many words are taken as are missing (copies are rounded to whole documents).

Chances are hashes of the seed and the documents, so reruns agree.

Defined cases: a null text has size 0 and is never taken; null doc_id and null
source are values like others (null source last); repeated rows (same doc_id,
source and size) count as one document of all their words, whose words and copies
are dealt to the rows as evenly as whole numbers go, so that totals stay right; a
source without words has target 0; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import cut

FAN = 32
CHUNK = 4096  # repeats of one row that a task writes together
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sorted_parts(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """rows sorted by `order` over parts: with `part` and `at` (from 1 within it); and for
    each part its rows (`held`) and sums. What stands before a row is then in its own
    part, or in one row for each part: no task sees all rows."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ranged = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    parts = ranged.groupBy("part").agg(F.count("*").alias("held"), *[F.sum(c).alias(k) for k, c in sums.items()])
    return ranged, cut(parts)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, n_docs, target from (source, size) rows; one row a source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranged, parts = _sorted_parts(by, [F.col("source").asc_nulls_last()], {})
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each source
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    every = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(every, (F.pmod(F.col("before") + F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = ranged.join(parts, F.col("part") == F.col("p")).select("source", "source_size", "n_docs", weight.alias("weight"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))

    # The water level: sources by cap over weight; a source is full if its own level is above that.
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    sums = {"caps": F.col("cap"), "weights": F.col("weight"), "words": F.col("source_size").cast("double")}
    ranged, parts = _sorted_parts(by, order, sums)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    parts = parts.select(
        F.col("part").alias("p"), F.coalesce(F.sum("caps").over(earlier), F.lit(0.0)).alias("caps"),
        F.coalesce(F.sum("weights").over(later), F.lit(0.0)).alias("weights"), F.sum("words").over(everything).alias("words"),
    )
    within = Window.partitionBy("part").orderBy("at")
    caps = F.col("caps") + F.coalesce(F.sum("cap").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.col("weights") + F.sum("weight").over(within.rowsBetween(0, Window.unboundedFollowing))
    by = cut(ranged.join(parts, F.col("part") == F.col("p")).withColumn("level", (F.col("words") - caps) / left))
    # The first source that isn't full at its own level gives the level of all.
    open_ones = by.where(F.col("cap") / F.col("weight") >= F.col("level"))
    level = open_ones.agg(F.min(F.struct("part", "at", "level"))["level"]).first()[0]  # one number
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.lit(level).cast("double"), F.col("cap")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _item(df: DataFrame, fields: tuple[str, ...]) -> T.StructType:
    return T.StructType([df.schema[f] for f in fields])


def _pivot(items: Column, level: int, seed: int, item_sql: str) -> Column:
    """Combine a sorted array of documents: struct(carry, done)."""

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        both = c["mass"] + x["mass"]
        to_x = F.least(c["mass"], x["words"] - x["mass"])
        to_c = F.least(x["mass"], c["words"] - c["mass"])
        chance = F.pmod(
            F.xxhash64(F.lit(seed), F.lit(level), c["doc_id"], c["words"], x["doc_id"], x["words"]), F.lit(1 << 53)
        ) / F.lit(float(1 << 53))
        give_x = (to_x + to_c <= 0) | (chance * (to_x + to_c) < to_c)
        as_item = lambda y, mass: y.withField("mass", mass)
        # (finished with all or nothing, unfinished)
        ended = F.when(
            give_x,
            F.when(both <= x["words"], F.struct(as_item(c, F.lit(0.0)).alias("done"), as_item(x, both).alias("carry"))).otherwise(
                F.struct(as_item(x, x["words"]).alias("done"), as_item(c, both - x["words"]).alias("carry"))
            ),
        ).otherwise(
            F.when(both <= c["words"], F.struct(as_item(x, F.lit(0.0)).alias("done"), as_item(c, both).alias("carry"))).otherwise(
                F.struct(as_item(c, c["words"]).alias("done"), as_item(x, both - c["words"]).alias("carry"))
            )
        )
        return F.struct(ended["carry"].alias("carry"), F.array_append(state["done"], ended["done"]).alias("done"))

    start = F.struct(
        F.element_at(items, 1).alias("carry"), F.array().cast(f"array<{item_sql}>").alias("done")
    )
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1))), start, step)


def mix_items(
    documents: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 20250101,
    text_col: str = "text",
) -> DataFrame:
    """One row per document (doc_id, source, size): rows (how often it stands in the table), source_size,
    target, and for all its rows together taken (words, repeats counted) and copies (whole documents)."""
    sized = documents.select("doc_id", "source", word_count(F.col(text_col)).alias("size"))
    items = cut(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")))
    targets = cut(
        source_targets(items.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, max_repeats)
    )
    t = targets.withColumnRenamed("source", "t_source")
    items = items.join(t, items["source"].eqNullSafe(t["t_source"]), "left").drop("t_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(copies + 1e-12).cast("double")
    words = (F.col("size") * F.col("rows")).cast("double")
    buckets = F.ceil(F.col("n_docs") / FAN)
    items = items.select(
        "doc_id", "source", "size", "rows", "source_size", "target", whole.alias("whole"), words.alias("words"),
        (F.greatest(copies - whole, F.lit(0.0)) * words).alias("mass"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), buckets).alias("bucket"),
        buckets.alias("buckets"), F.lit(False).alias("last"),
    )
    items = cut(items)
    settled = items.where(F.col("mass") <= 0).drop("bucket", "buckets")
    left = items.where(F.col("mass") > 0)
    # Documents in a group, the largest first: what is left over at the end is small.
    keep = ("order", "doc_id", "size", "rows", "words", "mass")
    left = left.withColumn("order", F.struct((-F.col("words")).alias("w"), F.xxhash64(F.lit(seed), "doc_id").alias("h")))
    item_sql = _item(left, keep).simpleString()
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    level, parts = 0, [settled]
    common = ["source", "source_size", "target", "whole"]
    while most > 0:
        grouped = left.groupBy(*common, "bucket", "buckets").agg(
            F.array_sort(F.collect_list(F.struct(*keep))).alias("items")
        )
        grouped = cut(grouped.select(*common, "bucket", "buckets", _pivot(F.col("items"), level, seed, item_sql).alias("s")))
        done = grouped.select(*common, F.explode("s.done").alias("i"))
        parts.append(done.select("i.doc_id", "source", "i.size", "i.rows", "source_size", "target", "whole", "i.words", "i.mass", F.lit(False).alias("last")))
        carried = grouped.select(*common, "bucket", "buckets", "s.carry.*")
        over = carried.where(F.col("buckets") <= 1)
        parts.append(over.select("doc_id", "source", "size", "rows", "source_size", "target", "whole", "words", "mass", F.lit(True).alias("last")))
        left = carried.where(F.col("buckets") > 1).select(
            *common, F.floor(F.col("bucket") / FAN).alias("bucket"), F.ceil(F.col("buckets") / FAN).alias("buckets"), *keep
        )
        most = 0 if most <= FAN else -(-most // FAN)
        level += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Of a source's last document a part: the words that are missing.
    extra = F.least(F.floor(F.col("mass") + 0.5), F.col("words")).cast("long")
    copies = F.when(F.col("size") > 0, F.least(F.floor(F.col("mass") / F.col("size") + 0.5), F.col("rows"))).otherwise(0).cast("long")
    every = F.col("whole").cast("long") * F.col("rows")
    return out.select(
        "doc_id", "source", "size", "rows", "source_size", "target",
        (every * F.col("size") + extra).alias("taken"), (every + copies).alias("copies"),
    )


def dealt(total: Column, rows: Column, row: Column) -> Column:
    """A row's part of a total (rows from 0): all parts are whole, differ by one at most, and sum up to it."""
    return F.floor(total / rows).cast("long") + F.when(row < total % rows, 1).otherwise(0)


def each_row(items: DataFrame) -> DataFrame:
    """`rows` rows for every row of items, with their number (`row`, from 0). Those of one item with many are
    dealt to tasks by CHUNK; no array is longer than that or the number of chunks."""
    numbers = lambda first, end: F.explode(F.sequence(first, end - 1)).alias("row")
    few = items.where(F.col("rows") <= CHUNK).select("*", numbers(F.lit(0).cast("long"), F.col("rows")))
    many = items.where(F.col("rows") > CHUNK).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))).alias("chunk"))
    many = many.repartition("doc_id", "source", "size", "chunk")
    many = many.select("*", numbers(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("rows")))).drop("chunk")
    return few.unionByName(many)


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_repeats: int = 3,
    seed: int = 20250101,
    text_col: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target,
    taken (words, repeats counted) and copies (whole documents)."""
    rows = each_row(cut(mix_items(documents, weights, max_repeats, seed, text_col)))
    part = lambda c: dealt(F.col(c), F.col("rows"), F.col("row")).alias(c)
    return rows.select("doc_id", "source", "size", "source_size", "target", part("taken"), part("copies"))
