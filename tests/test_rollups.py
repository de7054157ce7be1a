"""Rollups merged from parts equal the aggregates of all events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quernlight.operators import rollups


def test_merged_parts(spark, tmp_path):
    rnd = random.Random(1)
    start = dt.datetime(2024, 3, 1)
    ids = [None, 0, 1, -1, -40_000, 32_767, 32_768, 32_769, 5_000_000_000]
    rows = [(start + dt.timedelta(hours=rnd.randint(0, 200)), rnd.choice(ids), rnd.choice("ab")) for _ in range(400)] + [(start, None, "only nulls")]
    events = spark.createDataFrame(rows, "at timestamp, who bigint, kind string")
    path = str(tmp_path / "r")
    for part in (rows[:150], rows[150:]):
        rollups.append(rollups.daily(spark.createDataFrame(part, events.schema), "at", "who", "kind"), path)
    for by in (["kind"], ["day"], ["kind", "day"]):
        want = events.withColumn("day", F.to_date("at")).groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("who").alias("distinct"))
        assert sorted(map(tuple, rollups.merged(rollups.read(spark, path), *by).collect())) == sorted(map(tuple, want.collect()))
    assert rollups.daily(events.limit(0), "at", "who", "kind").count() == 0
