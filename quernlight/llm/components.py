"""Connected components of a distributed edge list by large and small stars.

Every round hooks the neighbours of each node to the smallest of them, until
each node has one edge, to the smallest id of its component. Tables between
rounds are written to the shared checkpoint folder. Minima are pre-aggregated;
the joins that bring a hub's minimum to its edges have their own exchange on
both sides, so that adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _minima(edges: DataFrame, name: str) -> DataFrame:
    return cut(edges.groupBy(F.col("u").alias(name)).agg(F.min("v").alias("m")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node with an edge to another one; component is
    the smallest node reachable. Null ends, loops and repeated edges are ignored."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        small = _minima(e, "x")
        tied = e.join(small, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_star = cut(tied.union(small.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        drop(e, small)
        small = _minima(small_star, "x")
        hooked = small_star.join(small, F.col("v") == F.col("x"), "left")
        moved = cut(hooked.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().cast("long").alias("deep")))
        deep, n = moved.agg(F.sum("deep"), F.count("*")).first()
        settled = not n or (not deep and n == small.count())
        drop(small_star, small)
        if settled:
            return moved.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                moved.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        e = cut(moved.select("u", "v").distinct())
        drop(moved)
    raise RuntimeError("components did not settle")
