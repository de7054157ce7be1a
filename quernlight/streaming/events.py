"""Event streams: topics, windows, tool-call memory and workflow states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATES = ("initializing", "ready", "planning", "executing", "verifying", "phase_complete", "completed", "failed")
#: Fixed transitions: (state, trigger) -> state. An error fails any state but the last.
TRANSITIONS = {
    ("initializing", "context_discovered"): "ready",
    ("ready", "start_planning"): "planning",
    ("planning", "start_execution"): "executing",
    ("executing", "start_verification"): "verifying",
    ("verifying", "verification_passed"): "phase_complete",
    ("verifying", "verification_failed"): "executing",
    ("phase_complete", "start_planning"): "planning",
    ("phase_complete", "complete_phase"): "completed",
    ("failed", "recover"): "ready",
}


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def topic(events: DataFrame, *kinds: str, column: str = "event_type") -> DataFrame:
    return events.where(F.col(column).isin(*kinds))


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone (the session's)."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are left out."""
    rows = _timed(events, time).withWatermark(time, late).groupBy(F.window(time, length).alias("w"), kind).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", time: str = "ts") -> DataFrame:
    rows = _timed(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def observations_of_calls(calls: DataFrame) -> DataFrame:
    """One observation for each tool call; calls without a project are left out."""
    text = F.concat_ws(" ", F.lit("tool"), F.col("event_type"), F.col("props"))
    return calls.where(F.col("project_id").isNotNull()).select("event_id", "project_id", text.alias("content"), F.sha2(text, 256).alias("content_hash"))


def write_observations(calls: DataFrame, path: str, checkpoint: str) -> object:
    """Append each batch's observations once, by content. The table is partitioned by the
    first two digits of the hash, and a batch reads those partitions only that it has
    hashes for, and of them the hashes."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = observations_of_calls(df).dropDuplicates(["content_hash"]).withColumn("prefix", F.substring("content_hash", 1, 2))
        fresh = fresh.persist()
        prefixes = [r["prefix"] for r in fresh.select("prefix").distinct().collect()]  # 256 at most
        try:
            stored = df.sparkSession.read.schema("content_hash string, prefix string").parquet(path).where(F.col("prefix").isin(prefixes)).select("content_hash")
        except Exception as e:  # the first batch: nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            new = fresh
        else:
            new = fresh.join(stored, "content_hash", "left_anti")
        new.write.mode("append").partitionBy("prefix").parquet(path)
        fresh.unpersist()

    return calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step(state: str, trigger: str) -> str | None:
    """The next state, or None where the trigger is not allowed."""
    if state == "completed":
        return None
    if trigger == "error":
        return "failed"
    return TRANSITIONS.get((state, trigger))


def _fold(state: str, triggers: Iterator[str]) -> tuple[str, int, int]:
    done = refused = 0
    for t in triggers:
        following = step(state, t)
        if following is None:
            refused += 1
        else:
            state, done = following, done + 1
    return state, done, refused


def workflow(log: DataFrame, key: str = "session_id", order: str = "at") -> DataFrame:
    """(key, state, transitions, refused) after each session's triggers in order."""
    kind = log.schema[key].dataType.simpleString()

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], *_fold("initializing", pdf.sort_values(order)["trigger"]))], columns=[key, "state", "transitions", "refused"])

    return log.groupBy(key).applyInPandas(run, f"`{key}` {kind}, state string, transitions long, refused long")


def workflow_stream(log: DataFrame, key: str = "session_id") -> DataFrame:
    """The same over a stream: the state is kept for each session."""
    kind = log.schema[key].dataType.simpleString()

    def run(k, frames, state):
        now = state.get if state.exists else ("initializing", 0, 0)
        for pdf in frames:
            following, done, refused = _fold(now[0], pdf.sort_values("at")["trigger"])
            now = (following, now[1] + done, now[2] + refused)
        state.update(now)
        yield pd.DataFrame([(k[0], *now)], columns=[key, "state", "transitions", "refused"])

    return log.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind}, state string, transitions long, refused long", "state string, transitions long, refused long", "update", "NoTimeout"
    )


def job_progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(tasks done, tasks known) of the jobs of a group; known ones grow as stages begin."""
    tracker = spark.sparkContext.statusTracker()
    done = known = 0
    for job in tracker.getJobIdsForGroup(name):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                # Stages of an ended job that have tasks left were skipped: their files were there.
                done, known = done + s.numCompletedTasks, known + (s.numTasks if info.status == "RUNNING" else s.numCompletedTasks)
    return done, known


def cancel(spark: SparkSession, name: str) -> None:
    """End the jobs of a group."""
    spark.sparkContext.cancelJobGroup(name)


def jobs(spark: SparkSession, name: str, work: Callable[[], object]) -> object:
    """Run work as a named job group that can be cancelled and watched."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        return work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
