"""Annulus search and product codes against plain Python; SQL is in test_oracles."""

import hashlib

import numpy as np
import pytest

from quernlight.llm.annulus import Annulus, cluster
from quernlight.llm.integer_vectors import Sums
from quernlight.llm.vector_codes import KdTree, compress

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, cluster string, c int, of int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", 7, 8) for i, v, l in rows], SCHEMA)


def brute(rows, points):
    d = ((rows[:, None, :] - points[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)  # argmin gives the first of ties


@pytest.mark.parametrize("k,dim,spread", [(1, 3, 5), (8, 2, 2), (40, 5, 3), (300, 8, 50), (60, 4, 1 << 24)])
def test_annulus_is_exact_with_ties(k, dim, spread):
    rng = np.random.default_rng(k)
    points = rng.integers(-spread, spread + 1, (k, dim))
    points[k // 2 :] = points[: k - k // 2]  # equal centroids
    rows = np.concatenate([rng.integers(-spread, spread + 1, (500, dim)), points, np.zeros((3, dim), int)])
    number, distance, seen = Annulus(points).nearest(rows)
    want, least = brute(rows, points)
    assert (number == want).all() and (distance == least).all() and seen <= len(rows) * k


def test_annulus_skips_far_norms():
    rng = np.random.default_rng(1)
    points = rng.integers(-9, 10, (100, 6)) + np.arange(100)[:, None] * 100
    rows = points[rng.integers(0, 100, 2000)] + rng.integers(-3, 4, (2000, 6))
    number, distance, seen = Annulus(points).nearest(rows)
    assert (number == brute(rows, points)[0]).all()
    assert seen < 2000 * 15  # of 100 centroids each


@pytest.mark.parametrize("k,dim,spread", [(1, 2, 4), (2, 1, 1), (16, 8, 2), (16, 8, 4000), (200, 3, 6)])
def test_kd_tree_is_exact_with_ties(k, dim, spread):
    rng = np.random.default_rng(k + dim)
    points = rng.integers(-spread, spread + 1, (k, dim))
    points[k // 2 :] = points[: k - k // 2]
    rows = np.concatenate([rng.integers(-spread - 1, spread + 2, (800, dim)), points])
    where, best = KdTree(points).nearest(rows)
    want, least = brute(rows, points)
    assert (where == want).all() and (best == least).all()


def test_sums_are_exact():
    rows = np.array([[1 << 60, -1], [1 << 60, -2], [5, 5]])
    s = Sums(4, 2)
    s.add(rows, np.array([2, 2, 0]))
    s.add(rows[2:], np.array([0]))
    assert s.sums.tolist() == [[10, 10], [0, 0], [1 << 61, -3], [0, 0]] and s.counts.tolist() == [2, 0, 2, 0]


def plain_clusters(vectors, k, rounds):
    q = {i: np.floor(np.array(v, np.float64) * 1024).astype(np.int64) for i, v in vectors.items()}
    start = sorted(q, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    points = np.array([q[i] for i in start])
    rows = np.array(list(q.values()))
    for _ in range(rounds):
        group = brute(rows, points)[0]
        for g in range(len(points)):
            if (group == g).any():
                points[g] = rows[group == g].sum(axis=0) // (group == g).sum()
    return dict(zip(q, zip(*map(np.ndarray.tolist, brute(rows, points))))), points


def test_cluster_against_plain_python_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = {int(i): rng.integers(-3, 4, 4).astype(float).tolist() for i in range(60)}
    bad = [(100, None, 1), (101, [], 1), (102, [1.0, 2.0], 1), (103, [1.0, None, 2.0, 3.0], 1), (104, [1.0, float("nan"), 0.0, 0.0], 1), (105, [float("inf")] * 4, 1)]
    got = cluster(frame(spark, [(i, v, i) for i, v in good.items()] + bad), k=5, rounds=4, dim=4)
    want, points = plain_clusters(good, 5, 4)
    rows = {r["vec_id"]: r for r in got.collect()}
    assert {i: (r["cluster"], r["distance"]) for i, r in rows.items()} == want
    total = sum(d for _, d in want.values())
    for r in rows.values():
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for c, d in want.values() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, points[r["cluster"]].tolist())).encode()).hexdigest()


def test_cluster_small_repeated_and_empty(spark):
    assert cluster(frame(spark, [])).count() == 0
    rows = [(1, [0.5, 0.25], None)] * 3 + [(None, [0.5, 0.25], 2), (None, [4.0, 4.0], 2)]
    got = cluster(frame(spark, rows), k=8, dim=2).collect()
    assert len(got) == 5 and all(r["distance"] == 0 for r in got)
    assert {r["cluster"] for r in got if r["vec_id"] == 1} == {0}  # equal centroids: the smallest number
    with pytest.raises(ValueError):
        cluster(frame(spark, []), k=1 << 20, dim=64)


def plain_codes(vectors, parts, entries, rounds):
    """vectors: [(id, floats, label)]"""
    rows = [(i, np.floor(np.array(v, np.float64) * 4096).astype(np.int64), l) for i, v, l in vectors]
    w = len(rows[0][1]) // parts
    first = [r[1] for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1].tolist()))[:entries]]
    code, error, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        cut = slice(p * w, p * w + w)
        x, book = np.array([r[1][cut] for r in rows]), np.array([f[cut] for f in first])
        for _ in range(rounds):
            g = brute(x, book)[0]
            for e in set(g.tolist()):
                book[e] = x[g == e].sum(axis=0) // (g == e).sum()
        g, d = brute(x, book)
        code, error = [c + f"{e:02x}" for c, e in zip(code, g)], [a + int(b) for a, b in zip(error, d)]
        books += book.ravel().tolist()
    by: dict = {}
    for (_, _, l), e in zip(rows, error):
        by[l] = by.get(l, 0) + e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((i is None, i or 0, c, e, by[l], sha) for (i, _, l), c, e in zip(rows, code, error))


def test_codes_against_plain_python_with_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(int(i), rng.integers(-2, 3, 6).astype(float).tolist(), int(i) % 3 or None) for i in range(80)]
    good += [(5, good[5][1], 1), (5, [2.0] * 6, 1), (None, [0.5] * 6, None)]
    bad = [(-1, None, 1), (-2, [1.0, None] + [0.0] * 4, 1), (-3, [float("-inf")] * 6, None)]
    got = compress(frame(spark, good + bad), parts=3, entries=7, rounds=4)
    have = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())
    assert have == plain_codes(good, 3, 7, 4)


def test_codes_other_lengths_few_rows_and_empty(spark):
    assert compress(frame(spark, [])).count() == 0
    rows = [(1, [1.0] * 7, 4), (2, [1.0] * 8, 4), (3, [0.0] * 16, 4), (4, [], 4), (5, [2.0] * 8, 4)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in compress(frame(spark, rows)).collect()}
    assert got == {1: (None, None, 0), 2: ("00" * 8, 0, 0), 3: (None, None, 0), 4: (None, None, 0), 5: ("01" * 8, 0, 0)}
    alone = compress(frame(spark, [(1, [1.0] * 7, 4)])).collect()
    assert len(alone) == 1 and alone[0]["code"] is None


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="don't fit"):
        cluster(frame(spark, [(1, [1e30, 0.0], 1)]), dim=2).count()
