"""Code queries over many files: nothing that grows with them is sent whole, and files are dealt to tasks."""

from __future__ import annotations

import random

import __spark_entry__
import pytest
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["code_dead_functions", "technical_debt"])
def test_dead_functions_send_no_side_whole(spark, sf_dir, name):
    assert "Broadcast" not in plan(__spark_entry__.queries()[name](spark, sf_dir))


def test_files_are_dealt_to_tasks(spark, tmp_path):
    from quernlight.plans.check_queries import TASK_FILES, sources

    spark.range(10 * TASK_FILES).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = sources(spark, str(tmp_path)).select("path").rdd.glom().map(len).collect()
    assert sum(sizes) == 10 * TASK_FILES and len(sizes) == 10 and max(sizes) < 1.2 * TASK_FILES


def test_pairs_of_two_hops_are_not_shuffled(spark):
    from quernlight.operators import graph

    edges = spark.createDataFrame([(k, k * j % 7) for k in range(12) for j in range(5)] + [(None, 1), (3, None)], "src long, dst long").distinct()
    got = graph.two_hops(edges, edges)
    assert "hashpartitioning(owner" in plan(got) and ", target#" not in "".join(x for x in plan(got).splitlines() if "Exchange" in x)
    rows = {tuple(r) for r in edges.collect()}
    wanted = {(a, c) for a, b in rows for b2, c in rows if b is not None and b == b2}
    assert len(got.collect()) == len(wanted) and {tuple(r) for r in got.collect()} == wanted


def shuffled(spark, df):
    """Rows that the stages of df write to shuffles, and the number of its own rows."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    n = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).sum()
    return sum(n for k, n in stages().items() if k not in before), n


def test_targets_of_a_part_go_once_to_many_owners(spark):
    from quernlight.operators import graph

    owners = spark.range(2000).selectExpr("id + 1000 as src", "explode(sequence(0, 29)) as x").selectExpr("src", "(src * 7 + x * 3) % 100 as dst")
    parts = spark.range(100).selectExpr("id as src", "explode(sequence(0, 29)) as x").selectExpr("src", "(src + x * 11) % 1000 as dst")
    sent, n = shuffled(spark, graph.two_hops(owners, parts))
    assert n == owners.join(parts.toDF("of", "target"), owners.dst == F.col("of")).select("src", "target").distinct().count()
    assert sent < 20_000


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("named", [True, False])
def test_two_hops_of_any_shares(spark, monkeypatch, small, named):
    """Blocks dealt by owner and by target, owners and parts with very many, repeated edges, nulls and names."""
    from quernlight.operators import graph

    if small:
        for name, most in {"TARGETS": 4, "TASK_PAIRS": 50, "TASK_TARGETS": 20, "HELD_PAIRS": 7}.items():
            monkeypatch.setattr(graph, name, most)
    rnd = random.Random(5)
    name = lambda k: None if k is None else f"n{k}" if named else k
    contains = [(rnd.randrange(30), rnd.randrange(12)) for _ in range(150)] + [(3, k) for k in range(40)] + [(None, 2), (5, None)]
    depends = [(rnd.randrange(15), rnd.randrange(100)) for _ in range(60)] + [(2, k) for k in range(80)] + [(2, None), (None, 4), (39, 1)]
    contains, depends = ([(name(a), name(b)) for a, b in rows * 2] for rows in (contains, depends))
    kind = "src string, dst string" if named else "src long, dst long"
    rows = [tuple(r) for r in graph.two_hops(spark.createDataFrame(contains, kind), spark.createDataFrame(depends, kind)).collect()]
    wanted = {(a, c) for a, b in contains for b2, c in depends if b is not None and b == b2}
    assert len(rows) == len(wanted) and set(rows) == wanted
    assert graph.two_hops(spark.createDataFrame([], kind), spark.createDataFrame(depends, kind)).collect() == []


def test_items_are_parsed_once_for_their_checks(spark):
    from quernlight.operators import checks

    files = spark.createDataFrame([
        ("a/adapters/x.rs", "pub struct One {\n    a: u32,\n}\npub struct Two {\n    a: u32,\n}\n"), ("a/y.rs", "impl Port for One {\n}\n"), ("a/z.rs", None),
    ], "path string, text string")
    got = checks.item_checks(files)
    assert "Contains(text" in plan(got)
    assert [r["line_no"] for r in got.where("rule = 'PORT001'").collect()] == [4]


def test_trees_are_made_once_for_all_conditions(spark, sf_dir):
    assert plan(__spark_entry__.queries()["syntax_ancestors"](spark, sf_dir)).count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["clone_links", "clone_members", "fingerprint_stats"])
def test_windows_are_shuffled_once(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    got.collect()
    final = plan(got).split("== Initial Plan ==")[0]
    by_print = [x for x in final.splitlines() if " Exchange hashpartitioning(print" in x]
    assert len([x for x in by_print if "ReusedExchange" not in x]) == 1


def test_prints_tell_windows_apart(spark):
    from quernlight.operators import code

    texts = ["a b a b a b", " a b\na\tb x", "x", None, "b a b a"]
    rows = code.windows(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", 3).collect()
    held = {}
    for r in rows:
        held.setdefault(r["print"], set()).add(" ".join(texts[r["k"]].split()[r["at"] : r["at"] + 3]))
    assert len(rows) == 9 and sorted(map(sorted, held.values())) == [["a b a"], ["a b x"], ["b a b"]]


def test_filters_on_texts_stay_behind_the_deal(spark, sf_dir):
    from quernlight.plans.check_queries import sources

    files = sources(spark, sf_dir)
    lines = plan(files.where("size(split(text, '\\n')) > 20")).splitlines()
    deal = next(k for k, x in enumerate(lines) if "Exchange" in x)
    assert not any("split(" in x for x in lines[deal:])
    assert files.schema.names == ["path", "text"]
