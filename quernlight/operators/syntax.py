"""Syntax: node tables with selectors, typed tokens for clones, context lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from .code import members, without_overlaps
from .trees import NODE, numbered

KEYWORDS = ("fn", "let", "if", "else", "for", "while", "loop", "match", "return", "pub", "struct", "enum", "impl", "trait", "use", "mod", "def", "class", "import", "from")
_TOKEN = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\]|\\.)*\"|[A-Za-z_]\w*|\d[\w.]*|[-+*/%=<>!&|^~?:]+|[(){}\[\],;.]"


def typed_tokens(text: Column) -> Column:
    """array<struct<text, kind>>: keyword, identifier, number, literal, operator or
    punctuation; comments are left out."""

    def kind(t: Column) -> Column:
        return (
            F.when(t.isin(*KEYWORDS), "keyword").when(t.rlike(r"^[A-Za-z_]"), "identifier").when(t.rlike(r"^\d"), "number")
            .when(t.startswith('"'), "literal").when(t.rlike(r"^[(){}\[\],;.]$"), "punctuation").otherwise("operator")
        )

    found = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.rlike(r"^(//|/\*)"))
    return F.transform(found, lambda t: F.struct(t.alias("text"), kind(t).alias("kind")))


def normalised(tokens: Column) -> Column:
    """Token texts with identifiers as $ID and values as $LIT: equal for renamed clones."""
    return F.transform(tokens, lambda t: F.when(t["kind"] == "identifier", "$ID").when(t["kind"].isin("number", "literal"), "$LIT").otherwise(t["text"]))


def _token_rows(files: DataFrame, key: str, text: str, size: int) -> DataFrame:
    toks = files.select(key, typed_tokens(F.col(text)).alias("t"))
    return toks.select(key, F.transform("t", lambda t: t["text"]).alias("raw"), normalised(F.col("t")).alias("norm")).where(F.size("raw") >= size)


def clone_kind_members(files: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(kind, first_key, first_at, key, at): every place of every repeated window of
    tokens, `exact` and `renamed`, as code.members gives them."""
    rows = _token_rows(files, key, text, size)

    def held(column: str, kind: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size(column) - size + 1)
        prints = rows.select(key, F.posexplode(F.transform(starts, lambda k: F.xxhash64(F.slice(column, k, F.lit(size))))).alias("at", "print"))
        return members(prints, key).select(F.lit(kind).alias("kind"), "*")

    return held("raw", "exact").unionByName(held("norm", "renamed"))


def clone_kinds(files: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(a, b, exact, renamed): windows shared with the first holder, as they stand
    and with names and values put aside."""
    rows = _token_rows(files, key, text, size)

    def links(column: str, name: str) -> DataFrame:
        starts = F.sequence(F.lit(1), F.size(column) - size + 1)
        prints = rows.select(key, F.explode(F.array_distinct(F.transform(starts, lambda k: F.xxhash64(F.slice(column, k, F.lit(size)))))).alias("p"))
        first = prints.groupBy("p").agg(F.min(key).alias("a"), F.count("*").alias("n")).where("n > 1").select("p", "a")
        return prints.join(first, "p").where(F.col("a") < F.col(key)).groupBy("a", F.col(key).alias("b")).agg(F.count("*").alias(name))

    both = links("raw", "exact").join(links("norm", "renamed"), ["a", "b"], "full_outer")
    return both.select("a", "b", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("renamed", F.lit(0)).alias("renamed"))


def with_context(files: DataFrame, key: str, text: str, hits: DataFrame, around: int = 3) -> DataFrame:
    """hits (key, start_line, end_line) with the lines around them."""
    rows = hits.join(files.select(key, S.lines(F.col(text)).alias("_l")), key)
    low = F.greatest(F.col("start_line") - around, F.lit(1))
    return rows.withColumn("context", F.array_join(F.slice("_l", low, F.col("end_line") + around - low + 1), "\n")).drop("_l")


def python_nodes(files: DataFrame) -> DataFrame:
    """Rows of trees.NODE for every syntax node of Python files; files that don't parse
    give no rows."""

    def run(batches):
        import ast

        import pandas as pd

        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    stack = [(ast.parse(text or ""), -1, "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                n = 0
                found = []
                while stack:
                    node, parent, field = stack.pop()
                    name = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None)
                    found.append([parent, type(node).__name__, name if isinstance(name, str) else None, field, getattr(node, "lineno", None), getattr(node, "end_lineno", None)])
                    children = [(child, n, f) for f, value in ast.iter_fields(node) for child in (value if isinstance(value, list) else [value]) if isinstance(child, ast.AST)]
                    stack += reversed(children)
                    n += 1
                last, depth = numbered([r[0] for r in found])
                out += [(path, k, last[k], depth[k], *r) for k, r in enumerate(found)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])
            yield frame.astype({"start_line": "Int64", "end_line": "Int64"})

    return files.select("path", "text").mapInPandas(run, NODE)


def _numbered_tests() -> dict:
    """Conditions on nodes numbered as in trees.NODE, as columns of windows."""
    # A file's subtrees don't cross: a node lies within a kind if the furthest end of such
    # nodes before it reaches it, and holds a kind if the next such node is in its subtree.
    ahead = Window.partitionBy("path").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("path").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    beside = Window.partitionBy("path", "parent").orderBy("id")
    return {
        "inside": lambda k: F.max(F.when(F.col("kind") == k, F.col("last"))).over(ahead) >= F.col("id"),
        "holds": lambda k: F.first(F.when(F.col("kind") == k, F.col("id")), ignorenulls=True).over(behind) <= F.col("last"),
        "follows": lambda k: F.lag("kind").over(beside) == k,
        "precedes": lambda k: F.lead("kind").over(beside) == k,
    }


def select_each(nodes: DataFrame, kind: str, tests: dict[str, list[tuple]]) -> DataFrame:
    """(found, and the columns of nodes): a row for each of the tests (name: conditions of the numbered kinds of
    select_nodes) that a node of the kind passes. The nodes are made and ordered once for all tests."""
    known = _numbered_tests()
    flags = {c: F.coalesce(known[c[0].removeprefix("not_")](c[1]), F.lit(False)) != F.lit(c[0].startswith("not_")) for c in sorted({c for t in tests.values() for c in t})}
    column = {c: f"_c{k}" for k, c in enumerate(flags)}
    rows = nodes.withColumns({column[c]: flag for c, flag in flags.items()}).where(F.col("kind") == kind)
    passed = [F.when(reduce(lambda a, b: a & b, [F.col(column[c]) for c in t], F.lit(True)), F.lit(name)) for name, t in tests.items()]
    return rows.select(F.explode(F.array_compact(F.array(*passed))).alias("found"), *nodes.columns)


def select_nodes(nodes: DataFrame, kind: str, conditions: list[tuple] = ()) -> DataFrame:
    """Nodes of a kind under conditions: (has_field, f), (not_has_field, f),
    (name_matches, regex), (has_child, kind), (no_child, kind), (metadata_equals,
    (column, value)), (custom, a condition of one's own as a Column). Children are met
    by semi and anti joins on (path, parent). With nodes numbered as in trees.NODE also
    (inside, kind), (not_inside, kind): nodes around it; (holds, kind), (not_holds, kind):
    nodes within it at any depth; (follows, kind), (precedes, kind): the sibling next to
    it. These are windows over a file's nodes in order, without a join."""
    numbered_tests = _numbered_tests()
    told = [(test.removeprefix("not_"), test.startswith("not_"), value) for test, value in conditions if test.removeprefix("not_") in numbered_tests]
    flags = {f"_c{k}": F.coalesce(numbered_tests[test](value), F.lit(False)) != F.lit(no) for k, (test, no, value) in enumerate(told)}
    rows = nodes.withColumns(flags).where(F.col("kind") == kind) if flags else nodes.where(F.col("kind") == kind)
    for flag in flags:
        rows = rows.where(flag)
    rows = rows.drop(*flags)
    for test, value in conditions:
        if test.removeprefix("not_") in numbered_tests:
            continue
        if test == "name_matches":
            rows = rows.where(F.coalesce("name", F.lit("")).rlike(value))
            continue
        if test in ("metadata_equals", "custom"):
            rows = rows.where(value if test == "custom" else F.col(value[0]) == value[1])
            continue
        column = {"has_field": "field", "not_has_field": "field", "has_child": "kind", "no_child": "kind"}.get(test)
        if column is None:
            raise ValueError(f"unknown condition: {test}")
        children = nodes.where(F.col(column) == value).select(F.col("path").alias("_p"), F.col("parent").alias("_i")).distinct()
        how = "left_semi" if test in ("has_field", "has_child") else "left_anti"
        rows = rows.join(children, (F.col("path") == F.col("_p")) & (F.col("id") == F.col("_i")), how)
    return rows


#: Fixed thresholds: (tokens, lines, similarity) of a clone.
DEFAULT, STRICT, LENIENT = (50, 6, 0.8), (30, 4, 0.9), (100, 10, 0.7)
MAX_GAP = 5
#: Fixed least similarity of each kind of clone.
KINDS = (("DUP001", 1.0), ("DUP002", 0.95), ("DUP003", 0.8), ("DUP004", 0.7))


def clones(files: DataFrame, key: str, text: str, thresholds: tuple[int, int, float] = DEFAULT, gap: int = MAX_GAP) -> DataFrame:
    """(rule, a, a_start, a_end, b, b_start, b_end, tokens, similarity): places, by lines,
    that hold the same tokens with names and values put aside, each with the first that
    does. Windows in a row on one diagonal are one clone, and so are those at most `gap`
    tokens apart. Similarity is the share of tokens that are equal as they stand; the
    kind is the one of KINDS whose least similarity it reaches. Of clones that overlap
    in b the longest stays. Comments are no tokens."""
    size, least_lines, least = thresholds
    toks = files.select(key, typed_tokens(F.col(text)).alias("t"), token_lines(F.col(text)).alias("_n"))
    toks = toks.select(key, F.transform("t", lambda t: t["text"]).alias("_raw"), normalised(F.col("t")).alias("_norm"), "_n").where(F.size("_raw") >= size)
    starts = F.sequence(F.lit(1), F.size("_norm") - size + 1)
    prints = toks.select(key, F.posexplode(F.transform(starts, lambda k: F.sha1(F.array_join(F.slice("_norm", k, F.lit(size)), " ")))).alias("at", "print"))
    held = members(prints, key).where(~((F.col("first_key") == F.col(key)) & (F.col("first_at") + size > F.col("at"))))
    held = held.select(F.col("first_key").alias("a"), F.col("first_at").alias("a_at"), F.col(key).alias("b"), F.col("at").alias("b_at"))
    order = Window.partitionBy("a", "b", F.col("b_at") - F.col("a_at")).orderBy("b_at")
    apart = F.coalesce(F.col("b_at") - F.lag("b_at").over(order) > size + gap, F.lit(True))
    held = held.withColumn("_part", F.sum(apart.cast("int")).over(order))
    runs = held.groupBy("a", "b", (F.col("b_at") - F.col("a_at")).alias("_d"), "_part").agg(F.min("a_at").alias("a_at"), F.min("b_at").alias("b_at"), (F.max("b_at") - F.min("b_at") + size).alias("tokens"))
    side = lambda s: toks.select(F.col(key).alias(f"_{s}"), F.col("_raw").alias(f"_raw_{s}"), F.col("_n").alias(f"_n_{s}"))
    rows = runs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    words = lambda s: F.slice(f"_raw_{s}", F.col(f"{s}_at") + 1, F.col("tokens"))
    equal = F.size(F.filter(F.zip_with(words("a"), words("b"), lambda x, y: x == y), lambda e: e))
    line = lambda s, at: F.get(f"_n_{s}", at)
    ends = [c for s in ("a", "b") for c in (line(s, F.col(f"{s}_at")).alias(f"{s}_start"), line(s, F.col(f"{s}_at") + F.col("tokens") - 1).alias(f"{s}_end"))]
    rows = rows.select("a", "b", "tokens", (equal / F.col("tokens")).alias("similarity"), *ends)
    rule = F.coalesce(*[F.when(F.col("similarity") >= share, F.lit(id)) for id, share in KINDS])
    rows = rows.withColumn("rule", rule).where((F.col("b_end") - F.col("b_start") + 1 >= least_lines) & (F.col("similarity") >= least) & F.col("rule").isNotNull())
    kept = without_overlaps(rows.withColumn("_end", F.col("b_end") + 1), ["b"], "b_start", "_end", F.col("tokens").desc(), F.col("similarity").desc(), F.col("a"), F.col("b_start"))
    return kept.select("rule", "a", "a_start", "a_end", "b", "b_start", "b_end", "tokens", "similarity")


def token_lines(text: Column) -> Column:
    """The line (from 1) of each of typed_tokens."""
    parts = S.lines(F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"/\*[^\n]*?\*/", ""))
    per = F.transform(parts, lambda s, k: F.array_repeat(k + 1, F.size(F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(0)))))
    return F.flatten(per)
