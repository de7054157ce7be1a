"""Daily partial aggregates that merge: counts, and exact distinct whole-number ids as bitmaps.

A row is (day, the dimensions, bucket, n, ids): of the events of a day with their ids in one bucket of 32,768
numbers, how many there are and which ids. Rollups of different events, or of different days, are put together by
appending; a query merges what it finds, so any range of days is answered without the events.
Events without an id count in n only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, time: str, ids: str, *dimensions: str) -> DataFrame:
    """day, dimensions, bucket, n, ids of new events: one row for each day, value and bucket."""
    number = F.col(ids).cast("bigint")
    named = events.select(F.to_date(time).alias("day"), *dimensions, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("_bit"))
    # Without a bit an event sets none: the aggregate leaves nulls out.
    return named.groupBy("day", *dimensions, "bucket").agg(F.count("*").alias("n"), F.bitmap_construct_agg("_bit").alias("ids"))


def append(rollup: DataFrame, path: str) -> None:
    rollup.write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(rollup: DataFrame, *by: Column | str) -> DataFrame:
    """by, n, distinct: events and different ids, from the rollup alone."""
    names = [rollup.select(c).columns[0] for c in by]
    buckets = rollup.select(*by, "bucket", "n", "ids").groupBy(*names, "bucket").agg(F.sum("n").alias("n"), F.bitmap_or_agg("ids").alias("ids"))
    held = F.when(F.col("bucket").isNotNull(), F.bitmap_count("ids")).otherwise(0)
    return buckets.groupBy(*names).agg(F.sum("n").alias("n"), F.sum(held).alias("distinct"))
