"""A budget of characters over the newest rows, whatever their number."""

import random

import pytest

from quernlight.operators.memory import within_budget


def plain(rows, budget):
    out, sum_ = [], 0
    for i, t, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True):
        sum_ += len(text or "")
        if sum_ > budget:
            break
        out.append((i, sum_))
    return sorted(out)


@pytest.mark.parametrize("budget", [0, 3, 700, 9000, 10_000_000])
@pytest.mark.parametrize("candidates", [10, 1000])
def test_budget(spark, budget, candidates):
    rnd = random.Random(budget)
    rows = [(i, rnd.choice([None, *range(60)]), rnd.choice([None, "", "a", "ab" * rnd.randint(0, 9)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, at bigint, text string").repartition(4)
    got = within_budget(df, "text", budget, "at", "id", candidates)
    assert got.columns == ["id", "at", "text", "chars_so_far"]
    assert sorted((r["id"], r["chars_so_far"]) for r in got.collect()) == plain(rows, budget)


def test_five_thousand_rows_fit(spark):
    df = spark.range(6000).selectExpr("id", "id as at", "'x' as text")
    assert within_budget(df, "text", 5000, "at", "id").count() == 5000
    assert within_budget(df.limit(0), "text", 5000, "at", "id").count() == 0
