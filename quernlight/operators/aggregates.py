"""Dashboard series and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def per_period(df: DataFrame, period: Column, limit: int) -> DataFrame:
    return df.groupBy(period.alias("period")).agg(F.count("*").alias("n")).orderBy(F.col("period").desc()).limit(limit)


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def session_stats(df: DataFrame, session: str, agent: str) -> DataFrame:
    return df.agg(F.countDistinct(session).alias("sessions"), F.countDistinct(agent).alias("agents"))


def file_counts(chunks: DataFrame, file: str, language: str) -> DataFrame:
    return chunks.groupBy(file).agg(F.count("*").alias("chunks"), F.min(language).alias("language"))


def severity_summary(violations: DataFrame) -> DataFrame:
    """Counts by category and severity; `passed` where none is an error."""
    by = violations.groupBy("category").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")]
    )
    return by.withColumn("passed", F.col("error") == 0)


def status_counters(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def best_per_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def rows_in_windows(df: DataFrame, time: str, length: str, key: str) -> DataFrame:
    return df.groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def branch_counts(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(branch, files, commits): distinct files (branch, path) and commits (branch, hash)."""
    f = files.groupBy("branch").agg(F.countDistinct("path").alias("files"))
    c = commits.groupBy("branch").agg(F.countDistinct("hash").alias("commits"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return f.join(c, "branch", "full_outer").select("branch", zero("files"), zero("commits"))


def tree_level(paths: DataFrame, path: str, folder: str) -> DataFrame:
    """(name, is_dir, place) of what stands in a folder: folders first, then by name."""
    inside = paths.where(F.startswith(path, F.lit(folder))).select(F.substr(path, F.lit(len(folder) + 1)).alias("rest")).where("rest <> ''")
    name, is_dir = F.split("rest", "/")[0], F.contains("rest", F.lit("/"))
    level = inside.select(name.alias("name"), is_dir.alias("is_dir")).distinct()
    return level.withColumn("place", F.row_number().over(Window.orderBy(F.col("is_dir").desc(), "name")).cast("long"))


def clone_stats(clones: DataFrame) -> DataFrame:
    """(rule, clones, lines) of clones (rule, start_line, end_line) by their type: lines
    are those of the later copy."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return clones.groupBy("rule").agg(F.count("*").alias("clones"), F.sum(lines).cast("long").alias("lines"))
