"""The observation store: filters, lists, timelines, budgets, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..common import materialise


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equalities(**wanted) -> Column:
    """Conjunction of equalities; None asks for nothing."""
    return all_of([F.col(k) == v for k, v in wanted.items() if v is not None])


def time_range(column: str, start=None, end=None) -> Column:
    """Inclusive range; an open end is None."""
    return all_of([c for c in (F.col(column) >= start if start is not None else None, F.col(column) <= end if end is not None else None) if c is not None])


def json_equals(column: str, **paths) -> Column:
    return all_of([F.get_json_object(column, f"$.{p.replace('__', '.')}") == v for p, v in paths.items()])


def has_all_tags(column: str, tags: list[str]) -> Column:
    return all_of([F.array_contains(column, t) for t in tags])


def under_directory(column: str, prefix: str) -> Column:
    return F.startswith(F.replace(F.col(column), F.lit("\\"), F.lit("/")), F.lit(prefix))


def one_of(column: str, values: list) -> Column:
    return F.col(column).isin(values)


def constraints(spec: dict) -> Column:
    """Conjunction of what a search asks for: equalities (project_id, workspace_id, org_id,
    entity_type, language), `extension`, `directory` (a prefix of file_path), `tags` (all of
    them), `start` and `end` (inclusive), `metadata` (JSON path: value). `min_score` is no
    condition on stored rows: it is applied to hits. Unknown names are a ValueError."""
    plain = ("project_id", "workspace_id", "org_id", "entity_type", "language")
    wrong = set(spec) - {*plain, "extension", "directory", "tags", "start", "end", "metadata", "min_score"}
    if wrong:
        raise ValueError(f"unknown constraints: {sorted(wrong)}")
    found = [F.col(k) == spec[k] for k in plain if spec.get(k) is not None]
    if spec.get("extension"):
        found.append(F.endswith("file_path", F.lit("." + spec["extension"].lstrip("."))))
    if spec.get("directory"):
        found.append(under_directory("file_path", spec["directory"]))
    found.append(has_all_tags("tags", spec.get("tags", [])))
    found.append(time_range("created_at", spec.get("start"), spec.get("end")))
    found += [F.get_json_object("metadata", f"$.{path}") == value for path, value in spec.get("metadata", {}).items()]
    return all_of(found)


def issues(df: DataFrame, limit: int = 10, label: str | None = None, **equal) -> DataFrame:
    """Issues by equalities and a label of theirs, the last updated first."""
    found = df.where(equalities(**equal))
    return newest(found if label is None else found.where(F.array_contains("labels", label)), "updated_at", "id", limit)


def ordered(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The first rows by columns ('-' in front: descending) with their place from 1 on."""
    order = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in columns]
    return df.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def chunks_of_file(chunks: DataFrame, path: str, file: str, start: str, key: str) -> DataFrame:
    """Chunks of one file by their first line; separators of paths are alike."""
    return chunks.where(F.replace(F.col(path), F.lit("\\"), F.lit("/")) == file.replace("\\", "/")).orderBy(start, key)


#: Rows that a new session is given.
CONTEXT_LIMIT = 10


def newest(df: DataFrame, time: str, key: str, limit: int = 10) -> DataFrame:
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def timeline(df: DataFrame, anchor, before: int, after: int, time: str, key: str, compat: bool = False) -> DataFrame:
    """The anchor with its nearest rows on both sides (compat: the newest rows on the
    later side), oldest first. Rows at the anchor's own time are ordered by key."""
    at = df.where(F.col(key) == anchor).select(F.struct(time, key).alias("_at"))
    rows = df.crossJoin(F.broadcast(at.limit(1))).withColumn("_me", F.struct(time, key))
    earlier = rows.where("_me < _at").orderBy(F.col(time).desc(), F.col(key).desc()).limit(before)
    order = [F.col(time).desc(), F.col(key).desc()] if compat else [F.col(time), F.col(key)]
    later = rows.where("_me > _at").orderBy(*order).limit(after)
    return earlier.unionByName(rows.where("_me = _at")).unionByName(later).drop("_at", "_me").orderBy(time, key)


def within_budget(df: DataFrame, text: str, budget: int, time: str, key: str, candidates: int = 1000) -> DataFrame:
    """The newest rows whose texts fit in a budget of characters, up to the first that
    doesn't, with `chars_so_far`; a null text has none, null times come last. If the budget ends within the
    `candidates` newest rows, only these are sorted. Else the times' sums give the time
    at which it ends, and the rows since then are summed up in range-sorted parts: no number of rows is too many,
    and no task has them all."""
    order = [F.col(time).desc(), F.col(key).desc()]
    rows = df.withColumn("_chars", F.coalesce(F.length(text), F.lit(0)).cast("bigint"))
    near = rows.select(time, key, "_chars").orderBy(*order).limit(candidates)
    held, chars = near.agg(F.count("*"), F.coalesce(F.sum("_chars"), F.lit(0))).first()
    if held < candidates or chars > budget:
        first = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        some = rows.orderBy(*order).limit(candidates)
        return some.withColumn("chars_so_far", F.sum("_chars").over(first)).where(F.col("chars_so_far") <= budget).drop("_chars")
    times = rows.groupBy(F.col(time).alias("_time")).agg(F.sum("_chars").alias("_chars"))
    last = _running(times, [F.col("_time").desc()]).where(F.col("chars_so_far") - F.col("_chars") <= budget)
    end = last.orderBy(F.col("_time").asc_nulls_first()).select("_time").first()[0]
    since = rows if end is None else rows.where(F.col(time) >= F.lit(end))
    return _running(since, order).where(F.col("chars_so_far") <= budget).drop("_chars")


def _running(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with chars_so_far, the running sum of _chars in the order, over range-sorted parts."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = ranged.groupBy("_part").agg(F.sum("_chars").alias("_sum"))
    parts = parts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.join(parts, F.col("_part") == F.col("_of")).withColumn("chars_so_far", F.col("_before") + F.sum("_chars").over(within))
    return summed.drop("_part", "_of", "_before")


def latest_per(df: DataFrame, group: list[str], time: str, key: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col(time).desc(), F.col(key).desc())
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def first_of_content(df: DataFrame, text: str, key: str, project: str | None = None) -> DataFrame:
    """One row for each content hash (in all, or in each project): the smallest key."""
    by = ["content_hash"] + ([project] if project else [])
    hashed = df.withColumn("content_hash", F.sha2(text, 256))
    return hashed.groupBy(*by).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def store(existing: DataFrame, incoming: DataFrame, text: str, key: str, project: str) -> DataFrame:
    """The incoming rows to append: blank projects are turned away, contents that are
    stored or came earlier are left out."""
    hashed = incoming.where(F.trim(project) != "").withColumn("content_hash", F.sha2(text, 256))
    order = Window.partitionBy("content_hash").orderBy(key)
    fresh = hashed.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return fresh.join(existing.select(F.sha2(text, 256).alias("content_hash")).distinct(), "content_hash", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Latest wins by key: of a key that both have, only `update` is taken from incoming."""
    e = existing.withColumn("_old", F.lit(True))
    i = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in keys], F.lit(True).alias("_new"))
    joined = e.join(i, keys, "full_outer")
    pick = [
        F.when(F.col("_new") & (F.col("_old").isNull() | F.lit(c in update)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        for c in existing.columns if c not in keys
    ]
    return joined.select(*keys, *pick).select(*existing.columns)


def soft_delete(state: DataFrame, gone: DataFrame, keys: list[str], now: int) -> DataFrame:
    """Mark rows that are gone, once."""
    g = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    marked = F.when(F.col("_gone") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))
    return state.join(g, keys, "left").withColumn("deleted_at", marked.cast("long")).select(*state.columns)


def purge(state: DataFrame, now: int, ttl: int = 7 * 86400) -> DataFrame:
    return state.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= now - ttl))


def file_changes(current: DataFrame, stored: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys and status: new, changed, unchanged or deleted."""
    c = current.select(*keys, F.col(digest).alias("_now"))
    s = stored.where(F.col("deleted_at").isNull()).select(*keys, F.col(digest).alias("_was"))
    status = (
        F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "deleted").when(F.col("_now") == F.col("_was"), "unchanged").otherwise("changed")
    )
    return c.join(s, keys, "full_outer").select(*keys, status.alias("status"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, file: str) -> DataFrame:
    """Chunks after indexing again: those of files that were read anew are replaced."""
    return stored.join(fresh.select(file).distinct(), file, "left_anti").unionByName(fresh)
