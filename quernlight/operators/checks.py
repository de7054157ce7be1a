"""Code checks as data: rules over lines, items, layers and whole sets of files.

Every check gives rows (path, line_no, rule, category, severity, message). Rules over
lines and items are literals of one pass; what needs several files is a join or an
aggregate. Layers are told by path."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..sources.files import cargo_dependencies
from . import code, graph, patterns
from .items import items, parse

#: Fixed thresholds.
MAX_FILE_LINES = 500
MAX_STRUCT_FIELDS, MAX_PARAMETERS, MAX_NESTING, MAX_FUNCTION_LINES = 7, 5, 3, 50
MAX_ITEM_LINES, MAX_ARMS, MAX_TRAIT_METHODS, MAX_IMPL_METHODS, MAX_STRUCTS_PER_FILE, MIN_STRING_ARMS = 200, 10, 10, 15, 5, 3
COGNITIVE, CYCLOMATIC, LENGTH, NESTING = 15, 10, 50, 4
COMPLEXITY, DEBT = 15, 50
STRING_FILES = 4
#: Layers from the innermost, and what each may use.
LAYERS = {
    "utils": (), "domain": ("utils",), "application": ("domain", "utils"), "providers": ("application", "domain", "utils"),
    "infrastructure": ("application", "domain", "providers", "utils", "validate"), "server": ("application", "domain", "infrastructure", "providers", "utils"),
    "validate": ("utils",),
}
#: The rule that a layer breaks by using what it may not.
BOUNDARY = {"utils": "CA015", "domain": "CA001", "application": "CA002", "providers": "CA010", "infrastructure": "CA011", "server": "CA012", "validate": "CA014"}
OUTER = ("server", "providers", "infrastructure", "validate")
#: What the domain may use from outside.
PLAIN = ("std", "core", "alloc", "serde", "serde_json", "thiserror", "crate", "self", "super")
#: Names of old schemas and imports; a project sets its own.
LEGACY = {"imports": "legacy::|compat::", "symbols": r"\bLegacy\w+", "macros": r"\blegacy_schema!", "schemas": r"schema::legacy", "roots": r"crate::schema::"}


def _rule(id: str, category: str, severity: str, message: str, *patterns: str, ignore: tuple[str, ...] = (), files: tuple[str, ...] = (), tests: bool = False) -> dict:
    return {"id": id, "category": category, "severity": severity, "message": message, "patterns": patterns, "ignore": ignore, "files": list(files), "tests": tests}


_RS = ("**/*.rs",)
_CONFIG = ("**/config/**", "**/*config*.rs")
#: One rule each; they see neither comments nor (unless `tests`) test code.
LINE_RULES = [
    _rule("QUAL001", "quality", "WARNING", "unwrap in production code", r"\.unwrap\(\)", ignore=(r"//.*(SAFETY|safe|ignore)",), files=_RS),
    _rule("QUAL002", "quality", "WARNING", "expect in production code", r"\.expect\(", ignore=(r"lock\(\)|poison",), files=_RS),
    _rule("QUAL003", "quality", "WARNING", "panic in production code", r"\b(panic|unreachable|unimplemented)!\s*\(", files=_RS),
    _rule("QUAL020", "quality", "WARNING", "dead code is allowed", r"#\[allow\(.*dead_code", files=_RS),
    _rule("ORG001", "organization", "INFO", "magic number", r"(^|[^\w.])\d{5,}($|[^\w.])", ignore=(r"\b(const|static)\b",), files=_RS),
    _rule("ORG003", "organization", "INFO", "a constant outside the constants files", r"^\s*pub\s+const\s+[A-Z]", files=("!**/constants*", "!**/constants/**", "**/*.rs")),
    _rule("ORG010", "organization", "INFO", "a common number without a name", r"[^\w.](1024|3600|8080|86400|65535)($|[^\w.])", ignore=(r"\b(const|static)\b",), files=_RS),
    _rule("ORG013", "organization", "ERROR", "the server makes a service", r"\b\w+Service(Impl)?::new\(", files=("**/server/**",)),
    _rule("PERF003", "performance", "WARNING", "Arc<Mutex> where something simpler may do", r"Arc<Mutex<(bool|usize|u\d+|i\d+)>>", files=_RS),
    _rule("PERF004", "performance", "INFO", "collect before an iterator goes on", r"\.collect::<Vec<[^>]*>>\(\)\s*\.(iter|into_iter)\(\)", files=_RS),
    _rule("PERF005", "performance", "INFO", "a string is formatted only to be turned into a string", r"format!\([^)]*\)\.to_string\(\)|\.to_string\(\)\.to_string\(\)", files=_RS),
    _rule("ASYNC002", "async", "ERROR", "block_on in async code", r"\bblock_on\(", files=_RS),
    _rule("ASYNC003", "async", "WARNING", "std mutex in async code", r"use std::sync::(Mutex|RwLock)|std::sync::Mutex::new", files=_RS),
    _rule("ASYNC004", "async", "WARNING", "a spawned task is not awaited or kept", r"^\s*tokio::spawn\(", files=_RS),
    _rule("PAT001", "pattern", "WARNING", "a concrete service behind Arc", r"Arc<[A-Z]\w*(Impl|Provider|Service|Repository)>", files=_RS),
    _rule("PAT004", "pattern", "WARNING", "std Result with a dynamic error", r"Result<[^>]*,\s*Box<dyn\s+(std::error::)?Error", files=_RS),
    _rule("ERR002", "errors", "WARNING", "an inner error type crosses a boundary", r"\b(sqlx|reqwest|std::io|sea_orm)::Error\b", files=("**/domain/**", "**/handlers/**")),
    _rule("ERR003", "errors", "ERROR", "a response shows inner errors", r"format!\(\"[^\"]*\{(\w+)?:\?\}|\b(e|err|error)\.to_string\(\)", files=("**/handlers/**", "**/controllers/**")),
    _rule("PORT002", "ports", "WARNING", "an adapter uses another adapter", r"use\s+(crate|super)::(\w+::)*adapters::", files=("**/adapters/**",)),
    _rule("VIS001", "visibility", "INFO", "a public item in an internal module", r"^\s*pub\s+(fn|struct|enum|trait)\b", files=("**/internal/**", "**/helpers/**")),
    _rule("VIS002", "visibility", "WARNING", "a domain type that others can't use", r"^\s*pub\(crate\)\s+(struct|enum|trait)\b", files=("**/domain/**",)),
    _rule("VIS003", "visibility", "INFO", "a utility module with public items", r"^\s*pub\s+(fn|struct|enum)\b", files=("**/util.rs", "**/utils.rs", "**/common.rs")),
    _rule("SSOT002", "ssot", "ERROR", "a legacy import", rf"^\s*use\s.*({LEGACY['imports']})", files=_RS),
    _rule("SSOT003", "ssot", "ERROR", "a legacy schema symbol", LEGACY["symbols"], files=_RS),
    _rule("SSOT004", "ssot", "ERROR", "a legacy schema macro", LEGACY["macros"], files=_RS),
    _rule("SSOT005", "ssot", "ERROR", "a legacy schema import", rf"^\s*use\s.*{LEGACY['schemas']}", files=_RS),
    _rule("SSOT006", "ssot", "ERROR", "a path from the root schema", LEGACY["roots"], files=_RS),
    _rule("SSOT007", "ssot", "ERROR", "an id field of a raw type", r"^\s*(pub\s+)?\w*_?id\s*:\s*(String|Uuid|u64|i64)\b", files=("**/domain/**",)),
    _rule("IMPL006", "implementation", "WARNING", "an empty catch-all arm", r"_\s*=>\s*(\{\s*\}|\(\))\s*,?", files=_RS),
    _rule("DEP004", "dependency", "ERROR", "an admin path reaches repositories on its own", r"^\s*use\s.*\brepos?(itories)?::", files=("**/admin/**", "**/admin.rs")),
    _rule("DEP005", "dependency", "ERROR", "a command line path goes round the unified one", r"\b\w*validate::\w", files=("**/cli/**", "**/cli.rs")),
    _rule("CFG001", "config", "WARNING", "a fixed string in configuration", r":\s*\"[^\"]+\"\.(to_string|into|to_owned)\(\)", files=_CONFIG),
    _rule("CFG001", "config", "WARNING", "a secret in a config file", r"(password|secret|api_?key|PASSWORD|SECRET|API_?KEY)\s*[:=]\s*[\"'][^\"'$]{4,}", files=("**/*.toml", "**/*.yml", "**/*.yaml")),
    _rule("CFG002", "config", "WARNING", "a magic number in configuration", r":\s*\d{3,}\s*,?\s*$", ignore=(r"\b(const|static)\b",), files=_CONFIG),
    _rule("CFG005", "config", "WARNING", "a fixed namespace", r"\bnamespace\w*\s*[:=]\s*\"[^\"]+\"", files=(*_CONFIG, "**/*.toml", "**/*.yml")),
    _rule("NAME001", "naming", "WARNING", "a type name is not CamelCase", r"^\s*(pub(\(\w+\))?\s+)?(struct|enum|trait)\s+\w", ignore=(r"^\s*(pub(\(\w+\))?\s+)?(struct|enum|trait)\s+[A-Z][A-Za-z0-9]*\b",), files=_RS),
    _rule("NAME002", "naming", "WARNING", "a function name is not snake_case", r"\bfn\s+\w", ignore=(r"\bfn\s+[a-z_][a-z0-9_]*\b",), files=_RS),
    _rule("NAME003", "naming", "WARNING", "a constant is not UPPER_CASE", r"^\s*(pub(\(\w+\))?\s+)?(const|static)\s+\w+\s*:", ignore=(r"^\s*(pub(\(\w+\))?\s+)?(const|static)\s+[A-Z_][A-Z0-9_]*\s*:",), files=_RS),
    _rule("CA016", "architecture", "ERROR", "a constants module outside the one place", r"^\s*(pub(\(\w+\))?\s+)?mod\s+constants\b", files=("!**/utils/**", "!**/*-utils/**", "**/*.rs")),
    _rule("CA017", "architecture", "WARNING", "a concrete type where a trait is to be injected", r"Arc<[A-Z][A-Za-z0-9_]*(Impl|Provider|Service|Repository)>", files=("**/application/**", "**/domain/**", "**/server/**")),
    _rule("CA018", "architecture", "ERROR", "a re-export of the utils", r"^\s*pub\s+use\s+(\w+_)?utils::", files=_RS),
    _rule("SOLID004", "solid", "WARNING", "a high layer depends on a concrete type", r"\b(Arc|Box|Rc)<[A-Z]\w*(Impl|Adapter|Client|Store)>", files=("**/domain/**", "**/application/**")),
    _rule("TEST001", "hygiene", "WARNING", "an inline test module", r"^\s*(pub\s+)?mod\s+tests?\s*\{", files=("!**/tests/**", "**/*.rs"), tests=True),
    _rule("TEST005", "hygiene", "WARNING", "an assertion that always holds", r"assert!\(\s*true\s*\)|assert_eq!\(\s*(\w+)\s*,\s*true\s*\)\s*;\s*//\s*always", files=_RS, tests=True),
    _rule("TEST008", "hygiene", "WARNING", "a mock type", r"\bMock[A-Z]\w*", files=_RS, tests=True),
    _rule("TEST009", "hygiene", "WARNING", "a test that skips itself", r"(eprintln|println)!\(\"[Ss]kip", files=_RS, tests=True),
    _rule("TEST010", "hygiene", "WARNING", "a stub macro", r"\b(todo|unimplemented)!\s*\(", files=_RS, tests=True),
    _rule("TST005", "tests", "WARNING", "a stub assertion", r"assert!\(\s*true\s*\)", files=_RS, tests=True),
]
PENDING = r"\b(TODO|FIXME|XXX|HACK)\b"
TEST_FILE = re.compile(r"(^|/)tests?/|_tests?\.rs$")


def _row(line: Column, id: str, category: str, severity: str, message: Column | str) -> list[Column]:
    text = F.lit(message) if isinstance(message, str) else message
    return [F.col("path"), line.cast("int").alias("line_no"), F.lit(id).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("message")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def layer_of(path: Column) -> Column:
    """The layer that a path names, as a folder or the end of one; null without."""
    found = F.regexp_extract(path, rf"(?:^|/)(?:[a-z]+-)?({'|'.join(LAYERS)})(?:/|$)", 1)
    return F.when(found != "", found)


# --- lines ---------------------------------------------------------------------
def test_ranges(files: DataFrame) -> DataFrame:
    """(path, first, last): lines of test modules and test functions. Braces end them."""
    found = items(files).where("is_test and kind in ('mod', 'fn')")
    return found.select("path", F.col("line_no").alias("first"), (F.col("line_no") + F.size(S.lines(F.col("body"))) - 1).alias("last"))


def within_ranges(rows: DataFrame, ranges: DataFrame, group: str = "path", at: str = "line_no", first: str = "first", last: str = "last") -> DataFrame:
    """rows with `inside`: whether a range of their group (its ends included) holds their place. One sweep
    over a group's places in order counts the ranges that are open, so that neither the number of ranges nor
    their nesting matters; no row meets a range."""
    ends = lambda place, kind, step: ranges.select(F.col(group), F.col(place).cast("bigint").alias("_at"), F.lit(kind).alias("_kind"), F.lit(step).alias("_step"))
    marked = rows.select("*", F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"))
    every = marked.unionByName(ends(first, 0, 1), allowMissingColumns=True).unionByName(ends(last, 2, -1), allowMissingColumns=True)
    order = Window.partitionBy(group).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = every.withColumn("inside", F.sum("_step").over(order) > 0).where("_kind = 1")
    return swept.drop("_at", "_kind", "_step")


def _marks(path: str, text: str | None) -> list[bool]:
    """For each line whether it is in a test module or test function."""
    text = text or ""
    out = [False] * (text.count("\n") + 1)
    if "test]" in text or "cfg(test)" in text or TEST_FILE.search(path):
        for _, kind, _, _, _, line, _, body, _, _, test, _ in parse(path, text):
            if test and kind in ("mod", "fn"):
                last = min(line + body.count("\n"), len(out))
                out[line - 1 : last] = [True] * (last - line + 1)
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _line_marks(paths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([_marks(p, t) for p, t in zip(paths, texts)])


def flagged_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line, is_comment, is_test: lines within test modules and test
    functions, and all of test files. Nothing is shuffled: a file's marks are made beside its text."""
    both = F.arrays_zip(S.lines(F.col("text")).alias("line"), F.col("_marks").alias("mark"))
    rows = files.select("path", "text", _line_marks(F.coalesce("path", F.lit("")), "text").alias("_marks")).select("path", F.posexplode(both).alias("n", "l"))
    test = F.coalesce(F.col("l.mark"), F.lit(False)) | F.col("path").rlike(TEST_FILE.pattern)
    comment = F.col("l.line").rlike(r"^\s*(//|/\*|\*)")
    return rows.select("path", (F.col("n") + 1).alias("line_no"), F.col("l.line").alias("line"), comment.alias("is_comment"), test.alias("is_test"))


def _test_lines(path: str, text: str) -> list[bool]:
    """For each line whether it is test code: all lines of a test file are."""
    return [True] * (text.count("\n") + 1) if TEST_FILE.search(path) else _marks(path, text)


def line_checks(files: DataFrame, rules: list[dict] = LINE_RULES) -> DataFrame:
    """LINE_RULES and marks of pending work (QUAL005), in one pass over the files."""
    pending = _rule("QUAL005", "quality", "INFO", "pending work", PENDING) | {"tests": None}
    return patterns.rule_hits(files, [*rules, pending], _test_lines)


# --- files ---------------------------------------------------------------------
def file_checks(files: DataFrame, most: int = MAX_FILE_LINES) -> DataFrame:
    """Rules on one file by its name and size: QUAL004, ORG009, ORG011, NAME004 to
    NAME006, TEST002, ORG005, ORG015. Within the row."""
    path, text, n = F.col("path"), F.col("text"), F.size(S.lines(F.col("text")))
    stem = F.regexp_extract(path, r"([^/]+)\.rs$", 1)
    rust, in_tests = path.endswith(".rs"), path.rlike(r"(^|/)tests/")
    folder = lambda *names: path.rlike(rf"(^|/)({'|'.join(names)})/")
    declares = lambda p: F.coalesce(text, F.lit("")).rlike(p)
    layer = layer_of(path)
    hits = [
        (n > most, "QUAL004", "quality", "WARNING", F.concat(F.lit("lines: "), n)),
        (rust & path.rlike("constants") & (n > most), "ORG009", "organization", "WARNING", F.concat(F.lit("lines of constants: "), n)),
        (rust & ~path.rlike("constants") & (n > most) & ~declares(r"(?m)^\s*(pub(\(\w+\))?\s+)?mod\s+\w+"), "ORG011", "organization", "WARNING", F.concat(F.lit("lines without modules: "), n)),
        (rust & (stem != "") & ~stem.rlike(r"^[a-z][a-z0-9_]*$"), "NAME004", "naming", "WARNING", "a module name is not snake_case"),
        (rust & folder("repositories", "repos") & ~folder("tests") & ~stem.rlike(r"(repo|repository|mod|common)$"), "NAME005", "naming", "WARNING", "a repository file without its suffix"),
        (rust & folder("handlers") & stem.rlike(r"_(repo|repository|entity)$"), "NAME006", "naming", "WARNING", "a file name of another layer"),
        (in_tests & rust & ~folder("common", "fixtures", "utils") & ~stem.rlike(r"(^test_|_tests?$|^(mod|lib|main)$)"), "TEST002", "hygiene", "WARNING", "a test file name does not say it is one"),
        (rust & layer.isin("server", "providers") & folder("entities"), "ORG005", "organization", "WARNING", "an entities folder outside the domain"),
        (rust & ~folder("handlers", "tests") & path.rlike(r"_handler\.rs$") & layer.isNotNull(), "ORG015", "organization", "ERROR", "a handler file outside handlers"),
    ]
    return _hits(files.select("path", "text"), F.lit(0), hits)


def _hits(rows: DataFrame, line: Column, hits: list[tuple], *also: str) -> DataFrame:
    """A row for each hit (condition, rule, category, severity, message), with the columns `also`; one pass."""
    named = [
        F.when(test, F.struct(F.lit(id).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), (F.lit(m) if isinstance(m, str) else m).cast("string").alias("message")))
        for test, id, category, severity, m in hits
    ]
    found = rows.select("path", line.cast("int").alias("line_no"), *also, F.explode(F.array_compact(F.array(*named))).alias("v"))
    return found.select("path", "line_no", "v.*", *also)


# --- items ---------------------------------------------------------------------
def item_checks(files: DataFrame) -> DataFrame:
    """Rules on items and their bodies: KISS, SOLID, IMPL, PERF001-002, ASYNC001, PAT002,
    PAT003, PAT005, PORT, CA002-CA006, ORG004, ORG007, ORG008, ORG016 to ORG018, CFG003,
    CFG004, TEST004, TEST006, TEST007, TST001 to TST004, DOC003, QUAL021."""
    rows = items(files)
    kind, name, body, text, head, before = (F.col(c) for c in ("kind", "name", "code", "body", "head", "before"))
    path, test, layer = F.col("path"), F.col("is_test"), layer_of(F.col("path"))
    is_a = lambda *kinds: kind.isin(*kinds) & ~test
    # Measures are shared by several rules, so Spark takes them of every row: of other kinds they are null.
    of = lambda measure, *kinds: F.when(kind.isin(*kinds), measure)
    count = lambda p, *kinds: of(F.regexp_count(body, F.lit(p)), *kinds)
    fields = count(r"(?m)^\s*(pub(\([a-z]+\))?\s+)?\w+\s*:\s*\S", "struct")
    optional, builder = count(r":\s*Option<", "struct"), name.rlike("Builder$")
    methods = count(r"(?m)^\s*(pub(\([a-z]+\))?\s+)?(async\s+)?fn\s+\w+", "trait", "impl")
    n_lines = of(F.size(S.lines(text)), "fn", "struct", "impl", "trait")
    arguments = F.filter(F.split(F.regexp_extract(head, r"\bfn\s+\w+[^(]*\(([^)]*)\)", 1), ","), lambda a: (F.trim(a) != "") & ~F.trim(a).rlike(r"^&?\s*(mut\s+)?self$"))
    n_args = of(F.size(arguments), "fn")
    arms = count(r"=>", "match")
    string_arms = of(F.regexp_count(text, F.lit(r'(?m)^\s*"[^"]*"(\s*\|\s*"[^"]*")*\s*=>')), "match")
    squeeze = lambda c: of(F.trim(F.regexp_replace(F.regexp_replace(c, r"^\{|\}$", ""), r"\s+", " ")), "fn")
    inner, said = squeeze(body), squeeze(text)
    no_body = body == ""
    public = head.rlike(r"^\s*pub\s")
    is_test_fn = (kind == "fn") & before.rlike(r"#\[(\w+::)?test\]")
    asserts = of(body.rlike(r"\bassert\w*!|\bpanic!|\?|should_panic|expect_err"), "fn")
    numbered = lambda label, n: F.concat(F.lit(label + ": "), n)
    ports = path.rlike(r"(^|/)ports(/|\.rs$)")
    adapter = path.rlike(r"(^|/)adapters/")
    hits = [
        (is_a("struct") & ~builder & (fields > MAX_STRUCT_FIELDS), "KISS001", "kiss", "WARNING", numbered("fields", fields)),
        (is_a("fn") & (n_args > MAX_PARAMETERS), "KISS002", "kiss", "WARNING", numbered("parameters", n_args)),
        (is_a("struct") & builder & (optional > MAX_STRUCT_FIELDS), "KISS003", "kiss", "WARNING", numbered("optional fields", optional)),
        (is_a("fn") & (F.col("nesting") > MAX_NESTING), "KISS004", "kiss", "WARNING", numbered("nesting", F.col("nesting"))),
        (is_a("fn") & (n_lines > MAX_FUNCTION_LINES), "KISS005", "kiss", "WARNING", numbered("lines", n_lines)),
        (is_a("struct", "impl", "trait") & (n_lines > MAX_ITEM_LINES), "SOLID001", "solid", "WARNING", numbered("lines", n_lines)),
        (is_a("match") & (arms > MAX_ARMS), "SOLID002", "solid", "WARNING", numbered("arms", arms)),
        (is_a("trait") & (methods > MAX_TRAIT_METHODS), "SOLID003", "solid", "WARNING", numbered("methods", methods)),
        (is_a("fn") & F.col("trait").isNotNull() & body.rlike(r"\b(panic|todo|unimplemented)!"), "SOLID006", "solid", "WARNING", "a partial implementation"),
        (is_a("impl") & F.col("trait").isNull() & (methods > MAX_IMPL_METHODS), "SOLID007", "solid", "WARNING", numbered("methods", methods)),
        (is_a("match") & (string_arms >= MIN_STRING_ARMS), "SOLID008", "solid", "WARNING", numbered("string arms", string_arms)),
        (is_a("fn") & ~no_body & inner.rlike(r"^(Ok\(\(\)\)|None|Vec::new\(\)|String::new\(\)|Default::default\(\)|)$") & ~said.contains("//"), "IMPL001", "implementation", "WARNING", "an empty body"),
        (is_a("fn") & ~no_body & said.rlike(r'^(return )?(true|false|-?\d[\d_.]*|"[^"]*"(\.to_string\(\)|\.into\(\))?);?$'), "IMPL002", "implementation", "WARNING", "a hard-coded return value"),
        (is_a("fn") & inner.rlike(r"^self\.\w+\.\w+\([^;{}]*\)(\.await)?\??$"), "IMPL003", "implementation", "INFO", "only passes the call on"),
        (is_a("fn") & said.rlike(r"^((tracing::|log::)?(trace|debug|info|warn|error|println|eprintln)!\([^;]*\);? ?)+(Ok\(\(\)\))?$"), "IMPL004", "implementation", "WARNING", "only logs"),
        (is_a("fn") & body.rlike(r"\b(todo|unimplemented)!\s*\("), "IMPL005", "implementation", "ERROR", "a stub"),
        (is_a("loop") & body.rlike(r"\.clone\(\)"), "PERF001", "performance", "INFO", "a clone in a loop"),
        (is_a("loop") & body.rlike(r"\b(Vec::new|String::new|vec!|format!)"), "PERF002", "performance", "INFO", "an allocation in a loop"),
        (is_a("fn") & head.rlike(r"\basync\s+fn\b") & body.rlike(r"std::thread::sleep|std::fs::|std::net::|\.lock\(\)\.unwrap\(\)"), "ASYNC001", "async", "ERROR", "a blocking call in async code"),
        (is_a("trait") & body.rlike(r"\basync\s+fn\b") & ~head.rlike(r":[^{]*\bSend\b"), "PAT002", "pattern", "WARNING", "an async trait without Send and Sync"),
        (is_a("trait") & body.rlike(r"\basync\s+fn\b") & ~before.contains("async_trait"), "PAT003", "pattern", "WARNING", "async functions without async_trait"),
        (is_a("trait") & ports & ~head.rlike(r":[^{]*\b(Interface|Send)\b"), "PAT005", "pattern", "WARNING", "a port without its bounds"),
        (is_a("struct") & adapter, "PORT001", "ports", "WARNING", "an adapter implements no port"),
        (is_a("trait") & ports & (methods > MAX_TRAIT_METHODS), "PORT003", "ports", "INFO", numbered("methods", methods)),
        (is_a("trait") & ports & (methods <= 1), "PORT004", "ports", "INFO", numbered("methods", methods)),
        (is_a("impl") & F.col("trait").isNull() & (layer == "domain") & ports, "CA003", "architecture", "ERROR", "an implementation beside the domain's traits"),
        (is_a("fn") & path.rlike(r"(^|/)handlers/") & body.rlike(r"\b\w+(Service|Repository)(Impl)?::new\("), "CA004", "architecture", "ERROR", "a handler makes what it should be given"),
        (is_a("struct") & path.rlike(r"(^|/)entities/") & ~body.rlike(r"(?m)^\s*(pub\s+)?(\w+_)?(id|uuid)\s*:"), "CA005", "architecture", "WARNING", "an entity without identity"),
        (is_a("fn") & path.rlike(r"(^|/)value_objects/") & head.rlike(r"\(\s*&mut\s+self"), "CA006", "architecture", "ERROR", "a value object that changes"),
        (is_a("struct") & name.rlike("(Repository|Adapter)$") & (layer == "domain"), "ORG004", "organization", "WARNING", "a type of another layer"),
        (is_a("trait") & name.rlike("(Provider|Repository|Port)$") & (layer == "domain") & ~ports, "ORG007", "organization", "WARNING", "a port trait outside ports"),
        (is_a("impl") & name.rlike("Adapter$") & layer.isin("domain", "application"), "ORG008", "organization", "WARNING", "an adapter outside infrastructure"),
        (is_a("impl") & F.col("trait").isNull() & (layer == "domain") & body.rlike(r"\b(sqlx|reqwest|tokio::fs|std::fs)::"), "ORG016", "organization", "ERROR", "the domain does outside work"),
        (is_a("struct") & name.rlike("Handler$") & (layer == "server") & ~path.rlike(r"(^|/)handlers/"), "ORG017", "organization", "WARNING", "a handler outside handlers"),
        (is_a("trait") & name.rlike("Port$") & ~ports, "ORG018", "organization", "WARNING", "a port outside ports"),
        (is_a("impl") & (F.col("trait") == "Default") & path.rlike("config") & ~before.contains("///"), "CFG003", "config", "INFO", "defaults without docs"),
        (is_a("struct") & name.rlike("(Config|Settings)$") & text.rlike(r"(?m)^(?!\s*///)[^\n]*\n\s*pub\s+\w+\s*:"), "CFG004", "config", "INFO", "configuration fields without docs"),
        (is_test_fn & ~asserts & ~name.rlike("(smoke|compiles|_ok)$") & (inner != "") & ~body.rlike(r"\.unwrap\(\)"), "TEST004", "hygiene", "WARNING", "a test without assertion"),
        (is_test_fn & ~asserts & body.rlike(r"\.unwrap\(\)"), "TEST006", "hygiene", "WARNING", "a test that only unwraps"),
        (is_test_fn & (inner == "") & (said != ""), "TEST007", "hygiene", "WARNING", "a test of comments only"),
        (is_test_fn & before.rlike(r"#\[ignore\]") & ~before.contains("//"), "TST001", "tests", "WARNING", "an ignored test without a reason"),
        ((kind == "fn") & test & ~is_test_fn & body.rlike(r"\b(todo|unimplemented)!"), "TST002", "tests", "WARNING", "a stub in a test fixture"),
        (is_test_fn & (said == ""), "TST003", "tests", "WARNING", "an empty test"),
        (is_test_fn & ~before.contains("///"), "TST004", "tests", "WARNING", "a test without docs"),
        (is_a("fn") & public & before.contains("///") & ~before.rlike("(?i)# example|```"), "DOC003", "documentation", "INFO", "docs without an example"),
    ]
    # What implements something anywhere takes PORT001 away again, from hits, not from items with their bodies.
    # Files without the word have no such item, and are not parsed for it.
    done = items(files.where(F.contains("text", F.lit("impl")))).where("kind = 'impl' and trait is not null").select(F.col("name").alias("_n")).distinct()
    found = _hits(rows, F.col("line_no"), hits, "name")
    own = F.when(F.col("rule") == "PORT001", F.col("name")).otherwise(F.concat(F.lit("\0"), F.coalesce("path", F.lit("")), F.col("line_no")))
    return found.withColumn("_own", own).join(done, F.col("_own") == F.col("_n"), "left_anti").drop("_own", "name")


def unused_parts(files: DataFrame) -> DataFrame:
    """QUAL021: struct fields under an allowed-dead-code mark that their file names once
    only; QUAL022: functions under such a mark that no file names again; PMAT002 and
    REF006: private functions and types that no file names again."""
    rows = items(files).where("not is_test")
    marked = F.col("before").contains("dead_code")
    used = code.identifier_counts(files, "path", "text").select(F.col("identifier").alias("_i"), F.col("n").alias("_n"))
    named = rows.where("kind in ('fn', 'struct', 'enum', 'trait') and name <> 'main'").join(used, F.col("name") == F.col("_i")).where("_n = 1 and trait is null")
    hits = [
        (marked & (F.col("kind") == "fn"), "QUAL022", "quality", "WARNING", F.col("name")),
        (F.col("kind") == "fn", "PMAT002", "pmat", "WARNING", F.concat(F.lit("dead: "), "name")),
        (~F.col("head").rlike(r"^\s*pub\s") & (F.col("kind") != "fn"), "REF006", "refactoring", "WARNING", F.concat(F.lit("dead: "), "name")),
    ]
    fields = F.regexp_extract_all("code", F.lit(r"(?m)^\s*(?:pub\s+)?(\w+)\s*:"), F.lit(1))
    held = rows.where((F.col("kind") == "struct") & marked).select("path", "line_no", F.explode(fields).alias("field")).join(files.select("path", "text"), "path")
    once = held.where(F.size(F.array_remove(F.transform(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)), lambda w: w == F.col("field")), False)) == 1)
    return _hits(named, F.col("line_no"), hits).unionByName(once.select(*_row(F.col("line_no"), "QUAL021", "quality", "WARNING", F.concat(F.lit("unused field: "), "field"))))


def documentation(files: DataFrame) -> DataFrame:
    """DOC001 modules and DOC002 public items without a doc comment before them."""
    rows = code.line_table(files, "path", "text")
    order = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("before", F.lag("line", 1).over(order))
    bare = F.col("line").rlike(r"^\s*pub\s+(async\s+)?(fn|struct|enum|trait)\s+\w+") & ~F.coalesce(F.col("before"), F.lit("")).rlike(r"^\s*(///|#\[|#!\[)")
    found = rows.where(bare).select(*_row(F.col("line_no"), "DOC002", "documentation", "WARNING", "a public item without docs"))
    modules = files.where(F.col("path").rlike(r"(lib|mod)\.rs$") & ~F.ltrim("text").startswith("//!"))
    return found.unionByName(modules.select(*_row(F.lit(1), "DOC001", "documentation", "WARNING", "a module without docs")))


# --- across files ----------------------------------------------------------------
def missing_tests(files: DataFrame) -> DataFrame:
    """REF003: sources no test file is named after; empty ones need none."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.rs$", 1), r"(^test_|_tests?$)", "")
    is_test = F.col("path").rlike(r"(^|/)tests?/|_tests?\.rs$")
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    named = files.where(F.col("path").endswith(".rs")).select("path", stem.alias("stem"), is_test.alias("t"), empty.alias("e"))
    rest = named.where("not t and not e and stem not in ('lib', 'main', 'mod')").join(named.where("t").select("stem"), "stem", "left_anti")
    return rest.select(*_row(F.lit(0), "REF003", "refactoring", "WARNING", "no test file"))


def duplicate_types(files: DataFrame, at_least: int = 2) -> DataFrame:
    """(name, folders) of types declared in several folders."""
    names = F.regexp_extract_all("text", F.lit(r"(?m)^\s*pub\s+(?:struct|enum|trait)\s+(\w+)"), F.lit(1))
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.explode(F.array_distinct(names)).alias("name"))
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("folder")).alias("folders")).where(F.size("folders") >= at_least)


def type_checks(files: DataFrame) -> DataFrame:
    """Types declared again: REF002 in several folders, ORG006 in several files, ORG012 in
    several layers, SSOT001 ports in several files; SOLID005 many unrelated structs in one file."""
    rows = items(files).where("kind in ('struct', 'enum', 'trait') and not is_test and head like 'pub %'")
    rows = rows.select("path", "kind", "name", "line_no", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), layer_of(F.col("path")).alias("layer"))
    by = rows.groupBy("name").agg(
        F.min("path").alias("path"), F.countDistinct("path").alias("files"), F.countDistinct("folder").alias("folders"), F.countDistinct("layer").alias("layers"),
        F.max(F.col("kind") == "trait").alias("trait"),
    )
    hits = [
        (F.col("folders") > 1, "REF002", "refactoring", "WARNING", F.concat(F.lit("folders: "), "folders")),
        (F.col("files") > 1, "ORG006", "organization", "WARNING", F.concat(F.lit("files: "), "files")),
        (F.col("layers") > 1, "ORG012", "organization", "ERROR", F.concat(F.lit("layers: "), "layers")),
        (F.col("trait") & F.col("name").rlike("(Port|Provider|Repository)$") & (F.col("files") > 1), "SSOT001", "ssot", "ERROR", F.concat(F.lit("files: "), "files")),
    ]
    stem = lambda n: F.substring(n, 1, 4)
    structs = rows.where("kind = 'struct'").groupBy("path").agg(F.count("*").alias("n"), F.countDistinct(stem(F.col("name"))).alias("stems"))
    many = structs.where((F.col("n") > MAX_STRUCTS_PER_FILE) & (F.col("stems") > MAX_STRUCTS_PER_FILE))
    return _hits(by, F.lit(0), hits).unionByName(many.select(*_row(F.lit(0), "SOLID005", "solid", "INFO", F.concat(F.lit("structs: "), "n"))))


def module_checks(files: DataFrame) -> DataFrame:
    """REF005: a declared module without a file; REF001: an import of the crate, and REF004
    a re-export, whose first name no file, folder or item of it has."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    stem = F.regexp_extract("path", r"([^/]+)\.rs$", 1)
    home = F.when(stem.isin("lib", "main", "mod"), folder).otherwise(F.concat_ws("/", folder, stem))
    declared = code.line_table(files, "path", "text").where(F.col("line").rlike(r"^\s*(pub(\(\w+\))?\s+)?mod\s+\w+\s*;"))
    declared = declared.select("path", "line_no", F.concat_ws("/", home, F.regexp_extract("line", r"\bmod\s+(\w+)", 1)).alias("_module"))
    there = files.select(F.regexp_replace("path", r"(/mod)?\.rs$", "").alias("_module")).distinct()
    gone = declared.join(there, "_module", "left_anti").select(*_row(F.col("line_no"), "REF005", "refactoring", "WARNING", F.concat(F.lit("no file: "), "_module")))
    root = F.regexp_extract("path", r"^(.*?)/src/", 1)
    uses = code.line_table(files, "path", "text").select("path", "line_no", "line", root.alias("_root"), F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+crate::(\w+)", 1).alias("_name"))
    known = files.select(root.alias("_root"), F.explode(F.filter(F.split(F.regexp_replace(F.regexp_extract("path", r"/src/(.*)$", 1), r"\.rs$", ""), "/"), lambda x: x != "")).alias("_name"))
    known = known.unionByName(items(files).where("name <> ''").select(root.alias("_root"), F.col("name").alias("_name"))).distinct()
    lost = uses.where("_name <> '' and _root <> ''").join(known, ["_root", "_name"], "left_anti")
    again = F.col("line").rlike(r"^\s*pub\s+use")
    return gone.unionByName(_hits(lost, F.col("line_no"), [(~again, "REF001", "refactoring", "WARNING", F.col("_name")), (again, "REF004", "refactoring", "WARNING", F.col("_name"))]))


def layer_checks(files: DataFrame) -> DataFrame:
    """What layers import: LAYER001 and the boundary of each layer (CA001, CA002, CA010 to
    CA015), CA007 concrete services, CA008 ports from elsewhere than the domain, CA009,
    CA019, ORG014, DEP002, LAYER003 and, for pairs that import each other, LAYER002."""
    rows = flagged_lines(files).where("not is_test and not is_comment").withColumn("layer", layer_of(F.col("path"))).where("layer is not null")
    names = "|".join(LAYERS)
    used = F.regexp_extract("line", rf"^\s*(?:pub\s+)?use\s+(?:crate::)?(?:[a-z]+_)?({names})::", 1)
    rows = rows.select("path", "line_no", "line", "layer", F.when(used != "", used).alias("used"), F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+(\w+)::", 1).alias("crate"))
    layer, used = F.col("layer"), F.col("used")
    allowed = reduce(lambda a, b: a | b, [(layer == k) & used.isin(*v) for k, v in LAYERS.items() if v])
    forbidden = used.isNotNull() & (used != layer) & ~allowed
    outside = (F.col("crate") != "") & ~F.col("crate").isin(*PLAIN) & used.isNull()
    hits = [
        (forbidden, "LAYER001", "layers", "ERROR", F.concat(layer, F.lit(" uses "), used)),
        *[(forbidden & (layer == k), id, "architecture", "ERROR", F.concat(F.lit("uses "), used)) for k, id in BOUNDARY.items()],
        ((layer == "infrastructure") & (used == "application") & F.col("line").rlike(r"::[A-Z]\w*(Service|Impl)\b") & ~F.col("line").rlike("ports::|dyn "), "CA007", "architecture", "ERROR", "a concrete service"),
        ((layer == "application") & F.col("line").rlike(r"::ports::") & (F.coalesce(used, F.lit("")) != "domain"), "CA008", "architecture", "ERROR", "a port from elsewhere than the domain"),
        ((layer == "infrastructure") & (used == "application") & ~F.col("path").contains("/di/"), "CA009", "architecture", "ERROR", "infrastructure uses the application"),
        (layer.isin(*OUTER) & used.isin(*OUTER) & (layer != used), "CA019", "architecture", "ERROR", F.concat(F.lit("uses "), used)),
        ((layer == "application") & (used == "server"), "ORG014", "organization", "ERROR", "the application uses the server"),
        ((layer == "domain") & used.isin("infrastructure", "server", "providers"), "DEP002", "dependency", "ERROR", F.concat(F.lit("uses "), used)),
        ((layer == "domain") & outside, "LAYER003", "layers", "WARNING", F.concat(F.lit("uses "), F.col("crate"))),
    ]
    edges = rows.where("used is not null and used <> layer").select(F.col("layer").alias("src"), F.col("used").alias("dst"), "path", "line_no")
    pairs = graph.mutual_pairs(edges)
    places = edges.groupBy("src", "dst").agg(F.min(F.struct("path", "line_no")).alias("at"))
    rounds = pairs.join(places, ["src", "dst"]).select(F.col("at.path").alias("path"), F.col("at.line_no").alias("line_no"), "src", "dst")
    return _hits(rows, F.col("line_no"), hits).unionByName(rounds.select(*_row(F.col("line_no"), "LAYER002", "layers", "ERROR", F.concat_ws(" <-> ", "src", "dst"))))


def dependency_checks(files: DataFrame) -> DataFrame:
    """DEP001: manifests that depend on a layer they may not; DEP003: manifests on a cycle."""
    manifests = files.where(F.col("path").endswith("Cargo.toml"))
    known = F.regexp_extract("dependency", rf"^(?:[a-z]+-)?({'|'.join(LAYERS)})$", 1)
    rows = cargo_dependencies(manifests).select("path", layer_of(F.regexp_replace("path", r"Cargo\.toml$", "")).alias("layer"), F.when(known != "", known).alias("used"), "dependency")
    rows = rows.where("layer is not null and used is not null and used <> layer")
    allowed = reduce(lambda a, b: a | b, [(F.col("layer") == k) & F.col("used").isin(*v) for k, v in LAYERS.items() if v])
    found = rows.where(~allowed).select(*_row(F.lit(0), "DEP001", "dependency", "ERROR", F.concat(F.lit("depends on "), "dependency")))
    ring = graph.on_cycles(rows.select(F.col("layer").alias("src"), F.col("used").alias("dst")))
    at = rows.select("path", F.col("layer").alias("root")).distinct().join(ring, "root")
    return found.unionByName(at.select(*_row(F.lit(0), "DEP003", "dependency", "ERROR", F.concat(F.lit("on a cycle: "), "root"))))


def layer_flow(uses: DataFrame, layer_of: dict[str, int]) -> DataFrame:
    """(src, dst) where an inner layer uses an outer one. uses: src and dst components."""
    level = F.create_map(*[F.lit(x) for kv in layer_of.items() for x in kv])
    return uses.where(F.element_at(level, F.col("src")) < F.element_at(level, F.col("dst")))


def string_checks(files: DataFrame) -> DataFrame:
    """ORG002: string literals in at least STRING_FILES files."""
    found = code.repeated_strings(files, "path", "text", STRING_FILES)
    return found.select(F.lit("").alias("path"), F.lit(0).alias("line_no"), F.lit("ORG002").alias("rule"), F.lit("organization").alias("category"), F.lit("INFO").alias("severity"), F.concat(F.lit('"'), "value", F.lit('" in files: '), F.col("files")).alias("message"))


# --- measures --------------------------------------------------------------------
def debt_checks(files: DataFrame) -> DataFrame:
    """PMAT001: functions above COMPLEXITY; PMAT003: files above DEBT, by their most
    complex function, dead functions and lines."""
    fns = items(files).where("kind = 'fn' and not is_test")
    c = S.cyclomatic(F.col("code"))
    complex_ones = fns.where(c > COMPLEXITY).select(*_row(F.col("line_no"), "PMAT001", "pmat", "WARNING", F.concat(F.lit("complexity: "), c)))
    heads, counts = code.functions(files, "path", "text"), code.identifier_counts(files, "path", "text")
    sizes = files.where("text is not null").select("path", S.sloc(F.col("text"), True).alias("sloc"))
    debt = code.technical_debt(sizes, fns.select("path", c.alias("cyclomatic")), code.dead_functions(heads, counts, "path"), "path", DEBT)
    return complex_ones.unionByName(debt.select(*_row(F.lit(0), "PMAT003", "pmat", "WARNING", F.concat(F.lit("debt: "), "tdg"))))


def metric_checks(files: DataFrame) -> DataFrame:
    """METRIC rules on functions: cyclomatic, cognitive, length and nesting."""
    from .metrics import function_metrics

    line = F.col("line_no")
    limits = (("cyclomatic", CYCLOMATIC), ("cognitive", COGNITIVE), ("length", LENGTH), ("nesting", NESTING))
    hits = [(F.col(k) > most, f"METRIC-{k}", "metrics", "WARNING", F.col(k)) for k, most in limits]
    return _hits(function_metrics(files), line, hits)


CHECKS = {
    "lines": line_checks, "files": file_checks, "items": item_checks, "unused": unused_parts, "documentation": documentation, "tests": missing_tests,
    "types": type_checks, "modules": module_checks, "layers": layer_checks, "dependencies": dependency_checks, "strings": string_checks,
    "debt": debt_checks, "metrics": metric_checks,
}


def run(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """All or the named checks; an unknown name is a ValueError."""
    wrong = set(names or ()) - set(CHECKS)
    if wrong:
        raise ValueError(f"unknown checks: {sorted(wrong)}")
    return _union([CHECKS[name](files) for name in names or list(CHECKS)])


#: Numbers of the rules of each family that the checks can give.
FAMILIES = {
    "ASYNC": (1, 2, 3, 4), "CA": (*range(1, 13), 14, 15, 16, 17, 18, 19), "CFG": (1, 2, 3, 4, 5), "DEP": (1, 2, 3, 4, 5), "DOC": (1, 2, 3), "ERR": (2, 3),
    "IMPL": (1, 2, 3, 4, 5, 6), "KISS": (1, 2, 3, 4, 5), "LAYER": (1, 2, 3), "NAME": (1, 2, 3, 4, 5, 6), "ORG": (*range(1, 19),), "PAT": (1, 2, 3, 4, 5),
    "PERF": (1, 2, 3, 4, 5), "PMAT": (1, 2, 3), "PORT": (1, 2, 3, 4), "QUAL": (1, 2, 3, 4, 5, 20, 21, 22), "REF": (1, 2, 3, 4, 5, 6), "SOLID": (1, 2, 3, 4, 5, 6, 7, 8),
    "SSOT": (1, 2, 3, 4, 5, 6, 7), "TEST": (1, 2, 4, 5, 6, 7, 8, 9, 10), "TST": (1, 2, 3, 4, 5), "VIS": (1, 2, 3),
}


def rule_ids() -> list[str]:
    measured = [f"METRIC-{k}" for k in ("cognitive", "cyclomatic", "length", "nesting")]
    return sorted([f"{family}{n:03d}" for family, numbers in FAMILIES.items() for n in numbers] + measured)


def report_of(report: DataFrame, file: str | None = None, severities: list[str] | None = None) -> DataFrame:
    """A report narrowed to files whose path holds a string, and to severities."""
    if file is not None:
        report = report.where(F.contains("path", F.lit(file)))
    return report if severities is None else report.where(F.col("severity").isin(severities))


def facts(files: DataFrame) -> DataFrame:
    """(path, kind, name, parent): modules, imports, structs and functions."""
    stem = F.regexp_extract("path", r"([^/]+)\.\w+$", 1)
    module = F.concat(F.lit("module::"), stem)
    kinds = (("import", r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);"), ("struct", r"\bstruct\s+(\w+)"), ("function", r"\bfn\s+(\w+)"))

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = F.flatten(F.array(*[named(k, p) for k, p in kinds]))
    inner = files.select("path", F.explode(found).alias("f"), module.alias("parent")).select("path", "f.kind", "f.name", "parent")
    return inner.unionByName(files.select("path", F.lit("module").alias("kind"), module.alias("name"), F.lit(None).cast("string").alias("parent")))
