"""Shared helpers of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a step's shuffle files once the step's table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is
    unset and all executors run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernlight-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that steps of a loop don't repeat the plans before them."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}", spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str, most: int, least: int = 512) -> DataFrame:
    """rows dealt by a key to tasks of about `most` rows; fewer, down to `least`, where that would leave cores
    without a task. The table's own splits are as few as its files and row groups ask for."""
    n = rows.count()
    return rows.repartition(max(-(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, n // least), 1), key)
