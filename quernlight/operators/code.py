"""Text and code analytics: lines, blocks, functions, complexity, clones, rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import scalar as S

BLOCK_LINES = 15
MIN_BLOCK_BYTES = 20
CLONE_TOKENS, CLONE_LINES = 50, 6


def line_table(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, text) of every line."""
    return files.select(key, F.posexplode(S.lines(F.col(text))).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


def matching_lines(files: DataFrame, key: str, text: str, needle: str, limit: int) -> DataFrame:
    """Lines that hold a string in either case, first files and lines first."""
    found = line_table(files, key, text).where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return found.select(key, "line_no", F.trim("line").alias("snippet")).orderBy(key, "line_no").limit(limit)


def blocks(files: DataFrame, key: str, text: str, size: int = BLOCK_LINES) -> DataFrame:
    """Chunks of `size` lines with at least 20 bytes: (key, start_line, end_line, content).
    Cut within the row: no shuffle."""
    parts = S.lines(F.col(text))
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / size).cast("int"))
    cut = F.transform(starts, lambda k: F.struct((k * size + 1).alias("start_line"), F.array_join(F.slice(parts, k * size + 1, F.lit(size)), "\n").alias("content"), F.least((k + 1) * size, F.size(parts)).alias("end_line")))
    rows = files.select(key, F.explode(cut).alias("c")).select(key, "c.start_line", "c.end_line", "c.content")
    return rows.where(F.octet_length(F.trim("content")) >= MIN_BLOCK_BYTES)


def brace_depth(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, depth after the line)."""
    rows = line_table(files, key, text)
    change = F.length("line") - F.length(F.replace("line", F.lit("{"), F.lit(""))) - (F.length("line") - F.length(F.replace("line", F.lit("}"), F.lit(""))))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(key, "line_no", F.sum(change).over(order).alias("depth"))


def functions(files: DataFrame, key: str, text: str, pattern: str = r"fn\s+(\w+)") -> DataFrame:
    """(key, name, line_no) of function heads."""
    rows = line_table(files, key, text).where(F.col("line").rlike(pattern))
    return rows.select(key, F.regexp_extract("line", pattern, 1).alias("name"), "line_no")


def function_bodies(files: DataFrame, key: str, text: str, head: str = r"\bfn\s+(\w+)") -> DataFrame:
    """(key, name, line_no, body) with balanced braces; bodies need a scan with
    state, so this is an Arrow map over whole files."""
    import re

    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        find = re.compile(head)
        for pdf in batches:
            out = []
            for i, t in zip(pdf[key], pdf[text]):
                for m in find.finditer(t or ""):
                    start = t.find("{", m.end())
                    semi = t.find(";", m.end())
                    if start < 0 or 0 <= semi < start:
                        continue
                    depth, end = 0, len(t)
                    for x in re.finditer(r"[{}]", t[start:]):
                        depth += 1 if x.group() == "{" else -1
                        if not depth:
                            end = start + x.end()
                            break
                    out.append((i, m.group(1), t.count("\n", 0, m.start()) + 1, t[start:end]))
            yield pd.DataFrame(out, columns=[key, "name", "line_no", "body"])

    return files.select(key, text).mapInPandas(run, f"`{key}` {kind}, name string, line_no int, body string")


def identifier_counts(files: DataFrame, key: str, text: str) -> DataFrame:
    """(identifier, n, files): occurrences over all files by exploding identifiers."""
    words = files.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("identifier"))
    return words.groupBy("identifier").agg(F.count("*").alias("n"), F.countDistinct(key).alias("files"))


def dead_functions(heads: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Function heads whose name occurs once at most. Both sides grow with the files, and their sizes are
    guessed from the files' own: neither is ever sent whole to each task."""
    once = counts.where("n <= 1").select(F.col("identifier").alias("_i")).hint("merge")
    return heads.join(once, F.col("name") == F.col("_i")).select(key, "name", "line_no")


def technical_debt(files: DataFrame, complexity: DataFrame, dead: DataFrame, key: str, above: float) -> DataFrame:
    """files: (key, sloc); complexity: (key, cyclomatic); dead: (key, ...)."""
    worst = complexity.groupBy(key).agg(F.max("cyclomatic").alias("worst"))
    lost = dead.groupBy(key).agg(F.count("*").alias("dead"))
    rows = files.join(worst.hint("merge"), key, "left").join(lost.hint("merge"), key, "left")  # as many rows as files
    return rows.select(key, S.debt_gradient(F.col("worst"), F.col("dead"), F.col("sloc")).alias("tdg")).where(F.col("tdg") > above)


def repeated_strings(files: DataFrame, key: str, text: str, at_least: int = 4, pattern: str = r'"([^"\\]{10,})"') -> DataFrame:
    """(value, files): literals in at least four distinct files."""
    found = files.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("value"))
    return found.groupBy("value").agg(F.countDistinct(key).alias("files")).where(F.col("files") >= at_least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64 bits of x scattered over all 64 (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` words in a row: of one, two, four, ... words, put together by size's binary digits."""
    out, taken, power, width = None, 0, words, 1
    while True:
        if size & width:
            here = power[taken : taken + len(words) - size + 1]
            out = here if out is None else _mixed(out * np.uint64(0x9E3779B97F4A7C15) + here)
            taken += width
        width *= 2
        if width > size:
            return out
        power = _mixed(power[: -(width // 2)] * np.uint64(0x9E3779B97F4A7C15) + power[width // 2 :])


def windows(files: DataFrame, key: str, text: str, size: int = CLONE_TOKENS) -> DataFrame:
    """(key, at, print): 128 bits for every window of `size` words, within the row.
    Words are hashed once with two seeds, then windows of 1, 2, 4, ... of them."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = files.select(key, words.alias("_w")).where(F.size("_w") >= size)
    rows = rows.select(key, F.transform("_w", lambda w: F.xxhash64(w)).alias("_a"), F.transform("_w", lambda w: F.xxhash64(F.lit(7), w)).alias("_b"))
    fields = T.StructType([
        rows.schema[key], T.StructField("at", T.IntegerType()),
        T.StructField("print", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])),
    ])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            ends = batch.column(1).offsets.to_numpy()
            a, b = (batch.column(k).values.to_numpy().view(np.uint64) for k in (1, 2))
            for row in range(batch.num_rows):
                left, right = ends[row], ends[row + 1]
                prints = [pa.array(_spans(x[left:right], size).view(np.int64)) for x in (a, b)]
                n = len(prints[0])
                keys = batch.column(0).take(pa.array(np.full(n, row)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(n, dtype=np.int32)), pa.StructArray.from_arrays(prints, fields=list(arrow.field(2).type))], schema=arrow)

    return rows.mapInArrow(run, fields)


def clone_links(files: DataFrame, key: str, text: str, size: int = CLONE_TOKENS) -> DataFrame:
    """(a, b, shared windows): every row with the first row that holds a window too. A
    window that n rows hold gives n - 1 links, not n squared pairs. Links don't tell
    which rows beside the first share a window: clone_members does. Windows are shuffled
    once: what follows finds them by their prints."""
    # Without null keys, which give no link: else Spark would leave them out on one side only, and shuffle twice.
    prints = windows(files, key, text, size).select(key, "print").where(F.col(key).isNotNull() & F.col("print").isNotNull()).repartition("print").distinct()
    first = prints.groupBy(F.col("print").alias("p")).agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").select("p", "a").hint("merge")
    return prints.join(first, F.col("print") == F.col("p")).where(F.col("a") < F.col(key)).groupBy("a", F.col(key).alias("b")).agg(F.count("*").alias("shared"))


def members(prints: DataFrame, key: str) -> DataFrame:
    """(first_key, first_at, key, at) of prints (key, at, print): every place of every
    window that stands in several places, of one row too, with the first of them,
    which names the window. Prints are shuffled once."""
    prints = prints.repartition("print")
    first = prints.groupBy(F.col("print").alias("p")).agg(F.min(F.struct(F.col(key).alias("k"), F.col("at").alias("at"))).alias("f"), F.count("*").alias("n")).where("n > 1")
    held = prints.join(first.hint("merge"), F.col("print") == F.col("p"))
    return held.select(F.col("f.k").alias("first_key"), F.col("f.at").alias("first_at"), key, "at")


def clone_members(files: DataFrame, key: str, text: str, size: int = CLONE_TOKENS) -> DataFrame:
    """Every place of every repeated window, as members gives them: a row for each
    place, not for each pair; clone_pairs makes the pairs of those one looks at."""
    return members(windows(files, key, text, size), key)


def clone_pairs(held: DataFrame, key: str, size: int = CLONE_TOKENS) -> DataFrame:
    """(a, a_at, b, b_at): all pairs of places of one window, those of one row if they
    don't overlap. Quadratic in a window's places: choose members before."""
    name = ["first_key", "first_at"]
    x = held.select(*name, F.col(key).alias("a"), F.col("at").alias("a_at"))
    y = held.select(*name, F.col(key).alias("b"), F.col("at").alias("b_at"))
    apart = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("b_at") >= F.col("a_at") + size))
    return x.join(y, name).where(apart).select("a", "a_at", "b", "b_at")


def print_stats(prints: DataFrame) -> DataFrame:
    by = prints.select("print").repartition("print").groupBy("print").agg(F.count("*").alias("places"))  # few repeat: nothing to gain before the shuffle
    return by.agg(
        F.count("*").alias("prints"), F.sum("places").alias("places"), F.count_if(F.col("places") == 1).alias("single"),
        F.count_if(F.col("places") > 1).alias("repeated"),
    )


def without_overlaps(spans: DataFrame, group: list[str], start: str, end: str, *best: Column) -> DataFrame:
    """Greedy choice of spans that don't overlap, the best first, in each group."""
    cols = spans.columns
    order = Window.partitionBy(*group).orderBy(*best)
    ranked = spans.withColumn("_order", F.row_number().over(order))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        starts: list[int] = []  # of the spans taken, in order, with their ends
        ends: list[int] = []
        for k, (s, e) in enumerate(zip(pdf[start], pdf[end])):
            at = bisect_right(starts, s)
            if (not at or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
                kept.append(k)
                starts.insert(at, s)
                ends.insert(at, e)
        return pdf.iloc[kept][cols]

    return ranked.groupBy(*group).applyInPandas(lambda pdf: choose(pdf.sort_values("_order")), spans.schema)


def line_rules(lines: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """Violations of regex rules over lines: one for each rule and line that any of
    its patterns match and none of its ignores. rules: id, category, severity,
    message, patterns, ignore, files (globs). One pass over the lines."""
    hits = []
    for r in rules:
        ok = reduce(lambda a, b: a | b, [F.col("line").rlike(p) for p in r["patterns"]])
        for p in r.get("ignore", ()):
            ok = ok & ~F.col("line").rlike(p)
        if r.get("files"):
            ok = ok & S.matches_globs(F.col("path"), r["files"])
        named = F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["category"]).alias("category"), F.lit(r["severity"]).alias("severity"), F.lit(r["message"]).alias("message"))
        hits.append(F.when(ok, named))
    return lines.select(key, "line_no", F.explode(F.array_compact(F.array(*hits))).alias("v")).select(key, "line_no", "v.*")


def complexity_report(files: DataFrame, text: str) -> DataFrame:
    """Mean cyclomatic, cognitive (1.2 times it), source lines and maintainability."""
    t = F.col(text)
    rows = files.select(S.cyclomatic(t).alias("c"), S.sloc(t).alias("s"))
    total = rows.agg(F.avg("c").alias("cyclomatic"), F.sum("s").alias("sloc"))
    return total.select("cyclomatic", (F.col("cyclomatic") * 1.2).alias("cognitive"), "sloc", S.maintainability(F.col("sloc"), F.col("cyclomatic")).alias("maintainability"))
