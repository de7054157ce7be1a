import itertools
import random

import numpy as np
import pytest

from quernlight.llm.components import connected_components
from quernlight.llm.minhash import LONG, bucket_keys, layout, near_duplicates


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = {}
    for base in range(12):
        w = rnd.choices(words, k=rnd.choice([3, 30, 120, 400]))
        for _ in range(25):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            out[len(out)] = (" " if rnd.random() < 0.9 else "\t\n").join(v)
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_equals_brute_force(spark, texts, percent):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) and r.n_shingles == len(sets[i]) for i, r in got.items())


def test_odd_rows(spark):
    rows = [(5, "a b c d e f", "x"), (3, "A B c d\te f", "x"), (3, "A B c d\te f", "x"), (None, "a b c d e f", None), (7, None, None), (8, "", "y"),
            (9, " \n", "y"), (10, "one", "z"), (4, "one", "z"), (11, "w " * 50000, "z"), (12, "É É É É É É", "z"), (13, "é é é é é é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (0, 2, None, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 4, False),
                          (4, 1, 4, True), (11, 1, 11, True), (12, 1, 12, True), (13, 1, 13, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [85, 80])
def test_index_guarantee(percent):
    """Any signature within reach shares a key."""
    symbols, chunks, reach, _ = layout(percent)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 16, (500, LONG), dtype=np.uint16)
    other = base.copy()
    for row in other:
        row[rng.choice(symbols, reach, replace=False)] ^= np.uint16(1)
    assert (bucket_keys(base, percent) == bucket_keys(other, percent)).any(axis=1).all()
    assert not (bucket_keys(base, percent) == bucket_keys(base[::-1].copy(), percent)).any()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = components(nodes, edges)
    got = connected_components(spark.createDataFrame(edges + [(None, 4), (9, 9)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
