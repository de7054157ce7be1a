import random

import pytest

from quernlight.operators import near_clones as N

WORDS = [f"w{k}" for k in range(400)]
OPS = ["+", "-", "*", "/", "=", "<", ">", "&&", "||", "%"]
BRACKETS = ["(", ")", "{", "}", "[", "]", ";", ",", "."]
KEYS = ["if", "else", "for", "while", "let", "return", "match"]


def code(rng: random.Random, n: int) -> list[str]:
    """Tokens whose kinds vary, as names and values are put aside."""
    return [rng.choice(rng.choice((WORDS, OPS, BRACKETS, KEYS))) for _ in range(n)]


def written(tokens: list[str]) -> str:
    return "\n".join(" ".join(tokens[k : k + 8]) for k in range(0, len(tokens), 8))


def edited(rng: random.Random, tokens: list[str], every: int) -> list[str]:
    out = []
    for k, t in enumerate(tokens):
        kind = rng.randrange(3) if k % every == every // 2 else 3
        if kind == 0:
            continue
        out += [rng.choice(BRACKETS + OPS + KEYS)] if kind == 1 else [rng.choice(KEYS), t] if kind == 2 else [t]
    return out


@pytest.mark.parametrize("every, least", [(50, 0.95), (30, 0.95), (20, 0.9)])
def test_planted_recall(spark, every, least):
    rng = random.Random(every)
    rows, wanted = [], set()
    for k in range(40):
        part = code(rng, 120)
        rows.append((2 * k, written(code(rng, 60) + part + code(rng, 60))))
        rows.append((2 * k + 1, written(code(rng, 40) + edited(rng, part, every) + code(rng, 40))))
        wanted.add((2 * k, 2 * k + 1))
    got = N.near_clones(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()
    found = {(r["a"], r["b"]) for r in got}
    assert len(found & wanted) >= least * len(wanted)
    assert found <= wanted  # texts that share nothing aren't told
    assert all(0.7 <= r["similarity"] < 1 and r["tokens"] >= 50 and r["rule"] == ("DUP003" if r["similarity"] >= 0.8 else "DUP004") for r in got)


def test_common_equals_the_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [[rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        whole = table[-1][-1]
        assert N.common(a, b, 0.0) == whole
        assert N.common(a, b, 0.7) == (whole if 2 * whole >= 0.7 * (len(a) + len(b)) - 1e-9 else -1)


def test_winnowing_guarantee(spark):
    rng = random.Random(3)
    shared = code(rng, N.GRAM + N.TAKE - 1)
    rows = [(k, code(rng, rng.randrange(30)) + shared + code(rng, rng.randrange(30))) for k in range(20)]
    prints = N.fingerprints(spark.createDataFrame(rows, "k int, _norm array<string>"), "k").where("run = 1")
    held = {}
    for r in prints.collect():
        held.setdefault(r["print"], set()).add(r["k"])
    assert any(len(v) == 20 for v in held.values())


def test_many_holders_are_linked(spark):
    """More places of the same tokens than PLACES: each is still told with another."""
    rng = random.Random(9)
    part = code(rng, 160)
    rows = [(k, written(code(rng, 30) + edited(random.Random(k), part, 60) + code(rng, 30))) for k in range(60)]
    found = {(r["a"], r["b"]) for r in N.near_clones(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert {b for _, b in found} | {a for a, _ in found} == set(range(60))


def test_renamed_and_equal_texts_have_no_edit(spark):
    rng = random.Random(2)
    part = code(rng, 100)
    renamed = [f"v{t[1:]}" if t.startswith("w") and t[1:].isdigit() else t for t in part]
    rows = [(0, written(part)), (1, written(renamed)), (2, written(part)), (3, None), (4, ""), (5, "a")]
    assert N.near_clones(spark.createDataFrame(rows, "k int, t string"), "k", "t").count() == 0
    assert N.near_clones(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0
