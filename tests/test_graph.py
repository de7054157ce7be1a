"""Strong components against plain reachability, over every way through the contraction."""

import random

import pytest

from quernlight.operators.graph import strong_components


def plain(edges, nodes):
    after = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            for v in after.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    reached = {n: reach(n) for n in nodes}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in nodes}


def components(spark, edges, nodes, part_edges):
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    rows = strong_components(e, spark.createDataFrame([(n,) for n in nodes], "node bigint"), part_edges).collect()
    assert len(rows) == len(nodes)
    return {r["node"]: r["component"] for r in rows}


@pytest.mark.parametrize("part_edges", [0, 12, 1 << 19])
@pytest.mark.parametrize("shape", ["rings", "random", "chain"])
def test_components(spark, shape, part_edges):
    rnd = random.Random(len(shape))
    if shape == "rings":  # rings, two of them joined one way, a pair, a loop, and a tail
        rings = [list(range(0, 9)), list(range(20, 25)), [40, 41]]
        edges = [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r))] + [(3, 22), (50, 50), (24, 60), (60, 61)]
    elif shape == "random":
        edges = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(60)]
    else:
        edges = [(k, k + 1) for k in range(30)] + [(17, 9)]
    nodes = sorted({n for e in edges for n in e} | {999})
    assert components(spark, edges, nodes, part_edges) == plain(edges, nodes)


def test_large_ring_takes_few_jobs(spark):
    """100,000 nodes in a row that is not that of their numbers."""
    ring = list(range(100_000))
    random.Random(3).shuffle(ring)
    edges = spark.createDataFrame([(ring[k], ring[k - 1]) for k in range(len(ring))], "src bigint, dst bigint")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ring", "ring")
    out = strong_components(edges, edges.selectExpr("src as node")).groupBy("component").count().collect()
    jobs = len(tracker.getJobIdsForGroup("ring"))
    spark.sparkContext.setJobGroup("", "")
    assert [tuple(r) for r in out] == [(0, 100_000)] and jobs <= 20
