"""Rule engines: applicability, expressions, JSON conditions, forward chaining."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Facts that expressions may use.
FACTS = ("file_count", "has_unwrap", "has_expect", "has_async", "has_tests", "workspace_path_len")
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(&&|\|\||==|!=|<=|>=|[<>!()+\-*/]))")


def applicable(rule: dict) -> Column:
    """languages AND dependencies AND globs AND NOT skip AND (NOT deny OR allow),
    over columns path, language and deps (array)."""
    ok = F.lit(True)
    if rule.get("languages"):
        ok = ok & F.col("language").isin(rule["languages"])
    if rule.get("dependencies"):
        ok = ok & F.arrays_overlap("deps", F.array(*[F.lit(d) for d in rule["dependencies"]]))
    if rule.get("files"):
        ok = ok & S.matches_globs(F.col("path"), rule["files"])
    for skip in rule.get("skip", ()):
        ok = ok & ~F.col("path").rlike(S.glob_to_regex(skip))
    if rule.get("deny"):
        denied = reduce(lambda a, b: a | b, [F.col("path").rlike(S.glob_to_regex(g)) for g in rule["deny"]])
        allowed = reduce(lambda a, b: a | b, [F.col("path").rlike(S.glob_to_regex(g)) for g in rule.get("allow", ())], F.lit(False))
        ok = ok & (~denied | allowed)
    return ok


def files_for_rules(files: DataFrame, rules: list[dict]) -> DataFrame:
    """(path, rule) of every applicable pair; the rules are literals, no join."""
    hits = F.array_compact(F.array(*[F.when(applicable(r), F.lit(r["id"])) for r in rules]))
    return files.select("path", F.explode(hits).alias("rule"))


def expression(text: str, known: tuple[str, ...] = FACTS) -> Column:
    """A boolean expression over facts as a Column. Only numbers, true/false, known
    names and operators are let through; anything else is a ValueError."""
    out, at = [], 0
    words = {"&&": " AND ", "||": " OR ", "!": " NOT ", "==": " = ", "true": "true", "false": "false"}
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in an expression: {text[at:]!r}")
        number, name, sign = m.groups()
        if name and name not in known and name not in ("true", "false"):
            raise ValueError(f"unknown fact: {name}")
        out.append(number or words.get(name or sign, name or f" {sign} "))
        at = m.end()
    return F.expr("".join(out))


def facts(files: DataFrame, text: str, root: str = "") -> DataFrame:
    """One row of FACTS over a set of files."""
    has = lambda p: F.coalesce(F.bool_or(F.col(text).rlike(p)), F.lit(False))
    return files.agg(
        F.count("*").alias("file_count"), has(r"\.unwrap\(\)").alias("has_unwrap"), has(r"\.expect\(").alias("has_expect"),
        has(r"\basync\b").alias("has_async"), has(r"#\[(cfg\()?test").alias("has_tests"),
    ).withColumn("workspace_path_len", F.lit(len(root)))


def condition(spec: dict) -> Column:
    """A JSON condition over files (path, text, deps) as a Column: all, any, not,
    dependency (exists or not_exists), file_size (lines over), pattern."""
    if "all" in spec:
        return reduce(lambda a, b: a & b, map(condition, spec["all"]), F.lit(True))
    if "any" in spec:
        return reduce(lambda a, b: a | b, map(condition, spec["any"]), F.lit(False))
    if "not" in spec:
        return ~condition(spec["not"])
    if "dependency" in spec:
        found = F.exists("deps", lambda d: d.rlike(S.glob_to_regex(spec["dependency"])))
        return ~found if spec.get("mode", "exists") == "not_exists" else found
    if "file_size" in spec:
        return F.size(S.lines(F.col("text"))) > int(spec["file_size"])
    if "pattern" in spec:
        return F.col("text").rlike(spec["pattern"])
    raise ValueError(f"unknown condition: {sorted(spec)}")


def forward_chain(facts: dict, rules: list[dict], most_steps: int = 1000) -> tuple[dict, list[str]]:
    """Rules (name, when, then, salience) over a small set of facts until nothing
    changes; each rule fires once. Control plane, no data."""
    state, fired = dict(facts), []
    for _ in range(most_steps):
        ready = [r for r in rules if r["name"] not in fired and all(_holds(state, c) for c in r["when"])]
        if not ready:
            return state, fired
        rule = max(ready, key=lambda r: r.get("salience", 0))
        state.update(rule["then"])
        fired.append(rule["name"])
    return state, fired


def _holds(state: dict, test: tuple) -> bool:
    name, op, value = test
    have = state.get(name)
    if have is None:
        return op == "!=" and value is not None
    return {"==": have == value, "!=": have != value}.get(op) if op in ("==", "!=") else {">": have > value, ">=": have >= value, "<": have < value, "<=": have <= value}[op]


def route(rule: dict) -> str:
    """The engine that runs a rule: its `engine` field, else what it holds."""
    if rule.get("engine"):
        return rule["engine"]
    for field, engine in (("expression", "expression"), ("condition", "json"), ("when", "chain"), ("selector", "ast"), ("patterns", "regex")):
        if field in rule:
            return engine
    return "path" if "files" in rule else "regex"


def merge_rule(rule: dict, templates: dict[str, dict], values: dict[str, str] | None = None) -> dict:
    """`extends` merged under the rule's own fields, `{{name}}` substituted."""
    base = merge_rule(templates[rule["extends"]], templates) if rule.get("extends") else {}
    merged = base | {k: v for k, v in rule.items() if k != "extends"}
    names = {**merged.get("variables", {}), **(values or {})}

    def fill(x):
        if isinstance(x, str):
            return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(names.get(m.group(1), m.group(0))), x)
        if isinstance(x, list):
            return [fill(y) for y in x]
        return {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else x

    return {k: fill(v) for k, v in merged.items() if k != "variables"}


def lint_rows(output: DataFrame, raw: str, tool: str) -> DataFrame:
    """Captured linter output (one JSON value a row) as violations."""
    if tool == "ruff":
        kind = "array<struct<code:string,message:string,filename:string,location:struct<row:int>>>"
        rows = output.select(F.explode(F.from_json(raw, kind)).alias("x"))
        return rows.select(F.col("x.filename").alias("file"), F.col("x.location.row").alias("line"), F.col("x.code").alias("rule"), F.col("x.message").alias("message"))
    kind = "struct<reason:string,message:struct<message:string,level:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,is_primary:boolean>>>>"
    rows = output.select(F.from_json(raw, kind).alias("x")).where("x.reason = 'compiler-message' and x.message.code is not null")
    span = F.element_at(F.filter("x.message.spans", lambda s: s["is_primary"]), 1)
    return rows.select(span["file_name"].alias("file"), span["line_start"].alias("line"), F.col("x.message.code.code").alias("rule"), F.col("x.message.message").alias("message"))
