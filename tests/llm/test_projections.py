import math
import random

import numpy as np

from quernlight.llm.projections import BLOCK, MOST_BITS, PROJECTIONS, _cells, candidates, near_vectors, tables, threshold

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def good(r):
    return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])


def brute(rows):
    links = {k: [] for k in range(len(rows))}
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if good(r) else None for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                links[a].append(b)
                links[b].append(a)
    out = []
    for k, r in enumerate(rows):
        seen, queue = {k}, [k]
        while queue:
            for x in links[queue.pop()]:
                if x not in seen:
                    seen.add(x)
                    queue.append(x)
        least = min((rows[x][0] for x in seen), key=lambda x: (x is None, x))
        out.append((r[0], len(links[k]), least, r[0] is None or least == r[0]))
    return out


def test_equals_brute_force(spark):
    rng, rnd = np.random.default_rng(5), random.Random(5)
    rows = []
    for i in range(600):
        if rows and rnd.random() < 0.6:
            v = np.array(rnd.choice(rows)[1]) + rng.standard_normal(64) * rnd.choice([0, 0.1, 0.3, 0.4])
        else:
            v = rng.standard_normal(64)
        rows.append((i, [float(np.float32(x)) for x in v], rnd.choice([0, 0, 0, 1]), "r"))
    rows += [(700, None, 0, None), (701, [0.0] * 64, 0, None), (702, [float("nan")] * 64, 0, None), (703, [1.0, None], 0, None), (704, [], 0, None),
             (705, rows[0][1], None, None), (None, rows[0][1], 0, None), (706, [1.0, 2.0], 0, None), (707, [2.0, 4.0], 0, None), (708, [1e30, 2e30], 0, None),
             (709, rows[1][1], rows[1][2], "x"), rows[2]]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    # Blocks of 16 make tables of cells, and blocks within cells, of the same rows.
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA), block=16).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_id_under_two_labels(spark):
    """Each label has its own links, and components join where vectors do, not where ids do."""
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.99, 0.05, 0.0]
    rows = [(5, v, 1), (6, near, 1), (5, w, 2), (7, w, 2), (8, w, 2), (9, v, 2)]
    got = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 2, 5, False), (9, 0, 9, True)]


def test_recall_at_the_threshold():
    """Pairs just at the wanted cosine are found, far ones hardly ever."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal(a.shape)
    d -= (d * a).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    b = 0.9301 * a + math.sqrt(1 - 0.9301**2) * d
    found = {(int(i), int(j)) for p, q in candidates(a, b, 0.93) for i, j in zip(p, q)}
    assert sum((k, k) in found for k in range(2000)) >= 1990
    assert len(found) < 2000 + 0.02 * 2000 * 2000
    assert 0 < threshold() < PROJECTIONS


def at_the_threshold(n):
    rng = np.random.default_rng(9)
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = rng.standard_normal(a.shape)
    d -= (d * a).sum(axis=1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return a, 0.9301 * a + math.sqrt(1 - 0.9301**2) * d


def test_pairs_meet_in_some_table():
    """Pairs just at the wanted cosine share a cell, whatever the number of bits; others seldom do."""
    a, b = at_the_threshold(4000)
    for bits in (1, 3, 6, 10):
        x, y = (_cells(v, bits, tables(bits, 0.93)) for v in (a, b))
        assert (x == y).any(axis=1).sum() >= 3995
        far = (x == np.roll(y, 1, axis=0)).mean()
        assert far < 1.5 / 2**bits
    # A row's cells don't depend on the rows beside it.
    assert (_cells(a[:7], 6, 5) == _cells(a, 6, 5)[:7]).all()


def test_copies_of_a_vector_grow_slowly():
    """Copies of a vector, as near_vectors deals a label of n: near linear work, where tiles of all pairs would be n / BLOCK."""
    def copies(n):
        return min(tables(b, 0.93) * math.ceil(n / (BLOCK << b)) for b in range(MOST_BITS + 1))

    assert copies(BLOCK) == 1
    assert copies(16 * 10_000) <= 4 * copies(10_000)
    assert copies(10**7) < 50 and copies(10**9) < 110 < 10**9 / BLOCK / 1000
