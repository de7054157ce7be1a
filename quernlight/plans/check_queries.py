"""Queries of the code checks, over source files made from the table of parts.

The same SQL text gives the files in Spark and in DuckDB; what the checks find in them is
told again in SQL by regular expressions, as the files' layout is known (items end with a
brace at a line's start)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import checks as K
from ..operators import chunkers, code, graph, items, metrics, near_clones, syntax, trees
from .registry import Registry, table

query = Registry()

_N = "p_partkey"
#: `~` stands for a line's end, `^` for a double quote.
PATH = f"concat('crates/c', CAST({_N} % 5 AS STRING), '/src/', CASE WHEN {_N} % 4 = 0 THEN 'domain' WHEN {_N} % 4 = 1 THEN 'handlers' WHEN {_N} % 4 = 2 THEN 'internal' ELSE 'adapters' END, '/f', CAST({_N} AS STRING), '.rs')"
TEXT = f"""replace(replace(concat(
 CASE WHEN {_N} % 3 = 0 THEN '//! A module.~' ELSE '' END,
 CASE WHEN {_N} % 5 = 0 THEN 'use my_infrastructure::db;~' WHEN {_N} % 5 = 1 THEN 'use tokio::fs;~' ELSE 'use std::fmt;~' END,
 CASE WHEN {_N} % 6 = 1 THEN '/// A part.~' ELSE '' END,
 'pub struct Part', CAST({_N} % 63 AS STRING), ' {{~', repeat('    field: u32,~', CAST({_N} % 12 AS INT)), '}}~',
 'pub fn run_', CAST({_N} AS STRING), '(', repeat('a: u32, ', CAST({_N} % 9 AS INT)), ') -> u32 {{~',
 CASE WHEN {_N} % 2 = 0 THEN concat('    let x = store.get(', CAST(10000 + {_N} % 7 AS STRING), ').unwrap();~') ELSE '' END,
 CASE WHEN {_N} % 7 = 0 THEN '    // TODO: not unwrap() here~' ELSE '' END,
 CASE WHEN {_N} % 4 = 1 THEN '    for i in 0..10 {{~        let c = x.clone();~    }}~' ELSE '' END,
 CASE WHEN {_N} % 6 = 0 THEN '    if a && b || c {{~        return 1;~    }}~' ELSE '' END,
 CASE WHEN {_N} % 10 = 3 THEN concat('    log(^a message of number ', CAST({_N} % 50 AS STRING), '^);~') ELSE '' END,
 repeat('    x += 1;~', CAST({_N} % 60 AS INT)), '    x~}}~',
 'fn helper_', CAST({_N} % 900 AS STRING), '() {{~    helper_', CAST(({_N} + 1) % 900 AS STRING), '();~}}~',
 'pub trait Store', CAST({_N} AS STRING), ' {{~', repeat('    fn get(&self);~', CAST({_N} % 14 AS INT)), '}}~',
 CASE WHEN {_N} % 8 = 0 THEN '#[cfg(test)]~mod tests {{~    #[test]~    fn t1() {{~        run().unwrap();~        assert!(true);~    }}~}}~' ELSE '' END
), '~', chr(10)), '^', chr(34))"""
FILES = f"fl AS (SELECT {_N} AS k, {PATH} AS path, {TEXT} AS text FROM part)"
LINES = f"{FILES}, ln AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM fl)"
#: Test code stands behind its mark, to the file's end.
CODE = f"{LINES}, mk AS (SELECT path, min(line_no) FILTER (contains(line, '#[cfg(test)]')) AS mark FROM ln GROUP BY path), cd AS (SELECT ln.*, coalesce(line_no > mark AND line <> '', false) AS is_test, regexp_matches(line, '^\\s*(//|/\\*|\\*)') AS is_comment FROM ln JOIN mk USING (path))"


#: Files of one task, about 6 MB of text; fewer where that would leave cores without a task.
TASK_FILES, LEAST_FILES = 4096, 512


def sources(spark, d) -> DataFrame:
    """A row of parts is small, its file isn't: parts are dealt to as many tasks as their files ask for
    before these are made, as the table's own splits are as few as its bytes."""
    parts = table(spark, d, "part").select(_N)
    n = parts.count()
    tasks = max(-(-n // TASK_FILES), min(spark.sparkContext.defaultParallelism, n // LEAST_FILES), 1)
    # Made by inline: Spark would put a filter on a column of texts before the deal, where the tasks are few.
    return parts.repartition(tasks, _N).select(F.inline(F.array(F.struct(F.expr(PATH).alias("path"), F.expr(TEXT).alias("text")))))


def _found(rows: DataFrame, *ids: str) -> DataFrame:
    rows = rows.where(F.col("rule").isin(*ids)) if ids else rows
    return rows.select("path", "line_no", "rule")


def _line_sql(*rules: tuple[str, str]) -> str:
    """Rules (id, condition) over lines that are neither comments nor test code."""
    return " UNION ALL ".join(f"SELECT path, line_no::INT AS line_no, '{id}' AS rule FROM cd WHERE NOT is_comment AND NOT is_test AND {test}" for id, test in rules)


@query("WITH " + CODE + " " + _line_sql(
    ("QUAL001", "contains(line, '.unwrap()')"), ("ORG001", "regexp_matches(line, '(^|[^\\w.])\\d{5,}($|[^\\w.])')"),
    ("VIS001", "path LIKE '%/internal/%' AND regexp_matches(line, '^\\s*pub\\s+(fn|struct|enum|trait)\\b')"),
) + " UNION ALL SELECT path, line_no::INT, 'QUAL005' FROM cd WHERE regexp_matches(line, '\\b(TODO|FIXME|XXX|HACK)\\b')"
  + " UNION ALL SELECT path, line_no::INT, 'TST005' FROM cd WHERE is_test AND contains(line, 'assert!(true)') UNION ALL SELECT path, line_no::INT, 'TEST005' FROM cd WHERE is_test AND contains(line, 'assert!(true)')")
def code_line_checks(spark, d):
    return _found(K.line_checks(sources(spark, d)), "QUAL001", "ORG001", "VIS001", "QUAL005", "TST005", "TEST005")


@query(f"WITH {CODE} SELECT path, count(*) FILTER (is_test) AS test_lines, count(*) FILTER (is_comment) AS comment_lines FROM cd GROUP BY path")
def code_test_ranges(spark, d):
    rows = K.flagged_lines(sources(spark, d))
    return rows.groupBy("path").agg(F.count_if("is_test").alias("test_lines"), F.count_if("is_comment").alias("comment_lines"))


#: Items by their heads and a closing brace at a line's start.
_ITEM = r"regexp_extract(text, '(?s)\n?({head}.*?\n\}})', 1)"
ITEMS = f"""{FILES}, it AS (SELECT k, path, text,
 regexp_extract(text, '(?s)(pub struct .*?\\n\\}})', 1) AS struct_, regexp_extract(text, '(?s)(pub fn .*?\\n\\}})', 1) AS run_, regexp_extract(text, '(?s)(\\nfn helper_.*?\\n\\}})', 1) AS helper_,
 regexp_extract(text, '(?s)(pub trait .*?\\n\\}})', 1) AS trait_ FROM fl),
nt AS (SELECT *, len(regexp_extract_all(struct_, 'field:')) AS fields, len(string_split(run_, chr(10))) AS run_lines, len(regexp_extract_all(regexp_extract(run_, '\\(([^)]*)\\)', 1), 'a: u32')) AS args,
 len(regexp_extract_all(trait_, 'fn get')) AS methods, len(string_split(split_part(text, 'pub struct ', 1), chr(10))) AS struct_at, len(string_split(split_part(text, 'pub fn run_', 1), chr(10))) AS run_at,
 len(string_split(split_part(text, 'pub trait ', 1), chr(10))) AS trait_at, len(string_split(split_part(text, '    for i in', 1), chr(10))) AS loop_at FROM it)"""


@query(f"""WITH {ITEMS} SELECT path, struct_at::INT AS line_no, 'KISS001' AS rule FROM nt WHERE fields > 7 UNION ALL SELECT path, run_at::INT, 'KISS002' FROM nt WHERE args > 5
UNION ALL SELECT path, run_at::INT, 'KISS005' FROM nt WHERE run_lines > 50 UNION ALL SELECT path, trait_at::INT, 'SOLID003' FROM nt WHERE methods > 10
UNION ALL SELECT path, loop_at::INT, 'PERF001' FROM nt WHERE contains(run_, '.clone()')
UNION ALL SELECT path, struct_at::INT, 'PORT001' FROM nt WHERE path LIKE '%/adapters/%'""")
def code_item_checks(spark, d):
    return _found(K.item_checks(sources(spark, d)), "KISS001", "KISS002", "KISS005", "SOLID003", "PERF001", "PORT001")


@query(f"""WITH {LINES}, p AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS before FROM ln)
SELECT path, line_no::INT AS line_no, 'DOC002' AS rule FROM p WHERE regexp_matches(line, '^\\s*pub\\s+(fn|struct|enum|trait)\\s+\\w+') AND NOT regexp_matches(coalesce(before, ''), '^\\s*(///|#\\[)')""")
def code_documentation(spark, d):
    return _found(K.documentation(sources(spark, d)))


@query(f"""WITH {FILES}, t AS (SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder, unnest(regexp_extract_all(text, 'pub (?:struct|enum|trait) (\\w+)', 1)) AS name FROM fl)
SELECT name, count(DISTINCT folder) AS folders FROM t GROUP BY name HAVING count(DISTINCT folder) >= 2""")
def code_duplicate_types(spark, d):
    return K.duplicate_types(sources(spark, d)).select("name", F.size("folders").cast("long").alias("folders"))


@query(f"""WITH {FILES}, t AS (SELECT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder, unnest(regexp_extract_all(text, 'pub (?:struct|enum|trait) (\\w+)', 1)) AS name FROM fl),
g AS (SELECT name, min(path) AS path, count(DISTINCT path) AS files, count(DISTINCT folder) AS folders FROM t GROUP BY name)
SELECT path, 0 AS line_no, 'REF002' AS rule FROM g WHERE folders > 1 UNION ALL SELECT path, 0, 'ORG006' FROM g WHERE files > 1""")
def code_type_checks(spark, d):
    return _found(K.type_checks(sources(spark, d)), "REF002", "ORG006")


@query(f"""WITH {LINES}, l AS (SELECT path, line_no, regexp_extract(line, '^use my_(infrastructure)::', 1) AS used, regexp_extract(line, '^use (\\w+)::', 1) AS crate FROM ln WHERE path LIKE '%/domain/%')
SELECT path, line_no::INT AS line_no, unnest(['LAYER001', 'CA001', 'DEP002']) AS rule FROM l WHERE used <> ''
UNION ALL SELECT path, line_no::INT, 'LAYER003' FROM l WHERE used = '' AND crate = 'tokio'""")
def code_layer_checks(spark, d):
    return _found(K.layer_checks(sources(spark, d)))


@query(f"""WITH {FILES}, v AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '"([^"]{{10,}})"', 1)) AS value FROM fl)
SELECT value, count(*) AS files FROM v GROUP BY 1 HAVING count(*) >= 4""")
def code_duplicate_literals(spark, d):
    return code.repeated_strings(sources(spark, d), "path", "text")


@query(f"""WITH {FILES}, w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS i FROM fl), n AS (SELECT i, count(*) AS n FROM w GROUP BY i),
h AS (SELECT path, unnest(regexp_extract_all(text, 'fn (\\w+)', 1)) AS name FROM fl) SELECT path, name FROM h JOIN n ON i = name WHERE n <= 1""")
def code_dead_functions(spark, d):
    files = sources(spark, d)
    dead = code.dead_functions(code.functions(files, "path", "text"), code.identifier_counts(files, "path", "text"), "path")
    return dead.select("path", "name")


_BRANCHES = "len(regexp_extract_all(x, '\\b(if|while|for|loop|match|case|catch)\\b|&&|\\|\\|'))"


@query(f"""WITH {ITEMS}, w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS i FROM fl), n AS (SELECT i, count(*) AS n FROM w GROUP BY i),
h AS (SELECT path, unnest(regexp_extract_all(text, 'fn (\\w+)', 1)) AS name FROM fl), dd AS (SELECT path, count(*) AS dead FROM h JOIN n ON i = name WHERE n <= 1 GROUP BY path),
z AS (SELECT path, 1 + {_BRANCHES.replace('x,', 'run_,')} AS worst, len(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '')) AS sloc FROM nt)
SELECT path, (2 * worst + 10 * coalesce(dead, 0) + 10 * (sloc // 200))::BIGINT AS tdg FROM z LEFT JOIN dd USING (path) WHERE 2 * worst + 10 * coalesce(dead, 0) + 10 * (sloc // 200) > 15""")
def technical_debt(spark, d):
    files = sources(spark, d)
    fns = code.function_bodies(files, "path", "text").select("path", S.cyclomatic(F.col("body")).alias("cyclomatic"))
    dead = code.dead_functions(code.functions(files, "path", "text"), code.identifier_counts(files, "path", "text"), "path")
    sizes = files.select("path", S.sloc(F.col("text"), True).alias("sloc"))
    return code.technical_debt(sizes, fns, dead, "path", 15).select("path", F.col("tdg").cast("long").alias("tdg"))


@query(f"""WITH {ITEMS} SELECT path, 'run_' || k AS name, (1 + {_BRANCHES.replace('x,', 'run_,')})::INT AS cyclomatic,
(CASE WHEN contains(run_, 'for i') THEN 1 ELSE 0 END + CASE WHEN contains(run_, 'if a') THEN 3 ELSE 0 END)::INT AS cognitive,
(CASE WHEN contains(run_, 'for i') OR contains(run_, 'if a') THEN 1 ELSE 0 END)::INT AS nesting, run_lines::INT AS length,
(CASE WHEN contains(run_, 'return') THEN 1 ELSE 0 END)::INT AS exits, args::INT AS arguments FROM nt""")
def function_metrics(spark, d):
    rows = metrics.function_metrics(sources(spark, d)).where("name like 'run!_%' escape '!'")
    return rows.select("path", "name", "cyclomatic", "cognitive", "nesting", "length", "exits", "arguments")


@query(f"""WITH {ITEMS} SELECT path, run_at::INT AS line_no, 'METRIC-length' AS rule FROM nt WHERE run_lines > 50""")
def metric_rules(spark, d):
    return _found(K.metric_checks(sources(spark, d)))


@query(f"WITH {LINES}, x AS (SELECT path, line_no, len(line) - len(replace(line, '{{', '')) - (len(line) - len(replace(line, '}}', ''))) AS d FROM ln) SELECT path, max(s)::BIGINT AS deepest, count(*) FILTER (s > 0) AS inner_lines FROM (SELECT path, sum(d) OVER (PARTITION BY path ORDER BY line_no) AS s FROM x) GROUP BY path")
def code_brace_depth(spark, d):
    rows = code.brace_depth(sources(spark, d), "path", "text")
    return rows.groupBy("path").agg(F.max("depth").cast("long").alias("deepest"), F.count_if(F.col("depth") > 0).alias("inner_lines"))


@query(f"""WITH {FILES}, f AS (SELECT path, 'module::' || regexp_extract(path, '([^/]+)\\.\\w+$', 1) AS m, text FROM fl)
SELECT path, 'module' AS kind, m AS name, NULL AS parent FROM f UNION ALL SELECT path, 'struct', unnest(regexp_extract_all(text, '\\bstruct\\s+(\\w+)', 1)), m FROM f
UNION ALL SELECT path, 'function', unnest(regexp_extract_all(text, '\\bfn\\s+(\\w+)', 1)), m FROM f UNION ALL SELECT path, 'import', unnest(regexp_extract_all(text, 'use ([^;]+);', 1)), m FROM f""")
def code_facts(spark, d):
    return K.facts(sources(spark, d))


_TOKENS = r"""regexp_extract_all(regexp_replace(text, '//[^\n]*', '', 'g'), '"(?:[^"\\]|\\.)*"|[A-Za-z_]\w*|\d[\w.]*|[-+*/%=<>!&|^~?:]+|[(){}\[\],;.]')"""


@query(f"""WITH {FILES}, t AS (SELECT path, unnest({_TOKENS}) AS t FROM fl)
SELECT path, count(*) FILTER (regexp_matches(t, '^[A-Za-z_]') AND NOT t IN ('fn', 'let', 'if', 'for', 'return', 'pub', 'struct', 'trait', 'use', 'mod')) AS identifiers,
count(*) FILTER (t IN ('fn', 'let', 'if', 'for', 'return', 'pub', 'struct', 'trait', 'use', 'mod')) AS keywords, count(*) FILTER (regexp_matches(t, '^\\d')) AS numbers,
count(*) FILTER (starts_with(t, '"')) AS literals, count(*) FILTER (regexp_matches(t, '^[(){{}}\\[\\],;.]$')) AS punctuation FROM t GROUP BY path""")
def typed_tokens(spark, d):
    t = sources(spark, d).select("path", syntax.typed_tokens(F.col("text")).alias("t"))
    count = lambda k: F.size(F.filter("t", lambda x: x["kind"] == k)).cast("long")
    return t.select("path", count("identifier").alias("identifiers"), count("keyword").alias("keywords"), count("number").alias("numbers"), count("literal").alias("literals"), count("punctuation").alias("punctuation"))


@query(f"""WITH {ITEMS}, f AS (SELECT path, string_split(text, chr(10)) AS l, run_at FROM nt)
SELECT path, array_to_string(l[greatest(run_at - 3, 1) : run_at + 3], chr(10)) AS context FROM f""")
def context_lines(spark, d):
    files = sources(spark, d)
    heads = code.functions(files, "path", "text", r"\bfn\s+(run_\w+)").select("path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))
    return syntax.with_context(files, "path", "text", heads).select("path", "context")


@query(f"""WITH {ITEMS}, c AS (SELECT path, 10 AS priority, (CASE WHEN length(struct_) - 4 >= 40 THEN 1 ELSE 0 END + CASE WHEN length(trait_) - 4 >= 40 THEN 1 ELSE 0 END
+ CASE WHEN length(run_) - 4 >= 40 THEN 1 ELSE 0 END + CASE WHEN length(helper_) - 1 >= 40 THEN 1 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END)::BIGINT AS chunks FROM nt
UNION ALL SELECT path, 1, 1 FROM nt WHERE k % 5 = 0) SELECT * FROM c WHERE chunks > 0""")
def code_chunks(spark, d):
    found = chunkers.code_chunks(sources(spark, d)).where("priority > 0")
    return found.groupBy("path", "priority").agg(F.count("*").alias("chunks"))


@query(f"""WITH {CODE}, v AS (SELECT path, 'ERROR' AS severity FROM cd WHERE false UNION ALL SELECT path, 'WARNING' FROM cd WHERE NOT is_comment AND NOT is_test AND contains(line, '.unwrap()') UNION ALL
SELECT path, 'INFO' FROM cd WHERE regexp_matches(line, '\\b(TODO|FIXME|XXX|HACK)\\b')) SELECT path, severity, count(*) AS n FROM v WHERE contains(path, '/domain/') AND severity IN ('WARNING') GROUP BY 1, 2""")
def report_filters(spark, d):
    rules = [r for r in K.LINE_RULES if r["id"] == "QUAL001"]
    report = K.report_of(K.line_checks(sources(spark, d), rules), "/domain/", ["WARNING"])
    return report.groupBy("path", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, l AS (SELECT regexp_extract(path, 'crates/(\\w+)/', 1) AS src, CASE WHEN contains(line, 'use my_infrastructure') THEN 'c' || (line_no % 5) WHEN contains(line, 'use tokio') THEN 'c' || (line_no % 3) END AS dst FROM ln)
SELECT DISTINCT src, dst FROM l WHERE dst IS NOT NULL AND src < dst""")
def layer_flow(spark, d):
    rows = code.line_table(sources(spark, d), "path", "text")
    at = F.when(F.contains("line", F.lit("use my_infrastructure")), F.col("line_no") % 5).when(F.contains("line", F.lit("use tokio")), F.col("line_no") % 3)
    uses = rows.select(F.regexp_extract("path", r"crates/(\w+)/", 1).alias("src"), F.concat(F.lit("c"), at).alias("dst")).where("dst is not null").distinct()
    return K.layer_flow(uses, {f"c{k}": k for k in range(5)})


@query(f"""WITH {FILES}, m AS (SELECT DISTINCT path, regexp_extract(path, '/src/(\\w+)/', 1) AS module FROM fl), i AS (SELECT path, 'adapters::f' || (k % 7) AS import FROM fl WHERE k % 5 = 0)
SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'contains' AS kind, path AS src, module AS dst FROM m UNION
SELECT DISTINCT 'depends', m.module, 'adapters' FROM i JOIN m USING (path) WHERE m.module <> 'adapters') GROUP BY kind""")
def module_graph(spark, d):
    files = sources(spark, d).select("path", F.regexp_extract("path", r"/src/(\w+)/", 1).alias("module"), F.regexp_extract("path", r"/f(\d+)\.rs", 1).cast("int").alias("k"))
    imports = files.where("k % 5 = 0").select("path", F.concat(F.lit("adapters::f"), F.col("k") % 7).alias("import"))
    return graph.module_graph(imports, files)[1].distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {FILES}, c AS (SELECT path AS part, regexp_extract(path, 'crates/(\\w+)/', 1) || '/' || regexp_extract(path, '/src/(\\w+)/', 1) AS owner, CASE WHEN k % 5 = 0 THEN 'infrastructure' WHEN k % 5 = 1 THEN 'tokio' ELSE 'std' END AS target FROM fl)
SELECT DISTINCT owner, target FROM c WHERE (contains(owner, 'domain') AND contains(target, 'infra')) OR (contains(owner, 'handlers') AND contains(target, 'tokio'))""")
def layer_violations(spark, d):
    files = sources(spark, d)
    owner = F.concat(F.regexp_extract("path", r"crates/(\w+)/", 1), F.lit("/"), F.regexp_extract("path", r"/src/(\w+)/", 1))
    contains = files.select(owner.alias("src"), F.col("path").alias("dst"))
    depends = files.select(F.col("path").alias("src"), F.regexp_extract("text", r"(?m)^use (?:my_)?(\w+)::", 1).alias("dst"))
    return graph.layer_violations(contains, depends, [("domain", "infra"), ("handlers", "tokio")])


@query(f"""WITH {LINES}, r AS (SELECT path, 'R-' || line_no AS rule, CASE WHEN contains(line, 'unwrap') THEN 'ERROR' ELSE 'INFO' END AS severity FROM ln WHERE contains(line, 'unwrap') OR contains(line, 'clone'))
SELECT rule AS category, count(*) AS total, count(*) FILTER (severity = 'ERROR') AS error, 0::BIGINT AS warning, count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'ERROR') = 0 AS passed FROM r GROUP BY rule""")
def violation_summary(spark, d):
    rows = code.line_table(sources(spark, d), "path", "text").where(F.contains("line", F.lit("unwrap")) | F.contains("line", F.lit("clone")))
    severity = F.when(F.contains("line", F.lit("unwrap")), "ERROR").otherwise("INFO")
    return A.severity_summary(rows.select(F.concat(F.lit("R-"), "line_no").alias("category"), severity.alias("severity")))


@query(f"""WITH {FILES} SELECT path, 'struct' AS kind, unnest(regexp_extract_all(text, '\\bstruct\\s+(\\w+)', 1)) AS name FROM fl
UNION ALL SELECT path, 'trait', unnest(regexp_extract_all(text, '\\btrait\\s+(\\w+)', 1)) FROM fl UNION ALL SELECT path, 'fn', unnest(regexp_extract_all(text, '\\bfn\\s+(\\w+)', 1)) FROM fl
UNION ALL SELECT path, 'mod', unnest(regexp_extract_all(text, '\\bmod\\s+(\\w+)', 1)) FROM fl""")
def code_items(spark, d):
    return items.items(sources(spark, d)).where("kind in ('struct', 'trait', 'fn', 'mod')").select("path", "kind", "name")


QUERIES, ORACLE_SQL = query.queries, query.sql


#: Nodes by lines: an item or loop begins with its head and ends at the next closing
#: brace at its own indentation; calls stand on one line.
NODES = f"""{LINES}, hd AS (SELECT path, line_no, length(line) - length(ltrim(line)) AS ind, line,
 CASE WHEN regexp_matches(line, '^\\s*(pub )?fn ') THEN 'function_item' WHEN regexp_matches(line, '^\\s*pub struct ') THEN 'struct_item' WHEN regexp_matches(line, '^\\s*pub trait ') THEN 'trait_item'
  WHEN regexp_matches(line, '^\\s*mod ') THEN 'mod_item' WHEN regexp_matches(line, '^\\s*for ') THEN 'for_expression' WHEN regexp_matches(line, '^\\s*if ') THEN 'if_expression' END AS kind FROM ln),
nd AS (SELECT path, kind, coalesce(nullif(regexp_extract(line, '(?:fn|struct|trait|mod) (\\w+)', 1), ''), NULL) AS name, line_no AS s,
 CASE WHEN line LIKE '%;' OR line LIKE '%}}' THEN line_no ELSE (SELECT min(e.line_no) FROM ln e WHERE e.path = h.path AND e.line_no > h.line_no AND e.line = concat(repeat(' ', h.ind::INT), '}}')) END AS e FROM hd h WHERE kind IS NOT NULL)"""


@query(f"WITH {NODES} SELECT path, kind, name, s::BIGINT AS start_line, e::BIGINT AS end_line FROM nd")
def syntax_nodes(spark, d):
    """Items, loops and conditions of Rust files by their syntax trees."""
    rows = trees.nodes(sources(spark, d), ["function_item", "struct_item", "trait_item", "mod_item", "for_expression", "if_expression"])
    return rows.select("path", "kind", "name", "start_line", "end_line")


@query(f"""WITH RECURSIVE {NODES}, pr AS (SELECT a.path, a.s, a.kind, max(b.s) AS parent FROM nd a LEFT JOIN nd b ON a.path = b.path AND b.s < a.s AND b.e >= a.e GROUP BY 1, 2, 3),
up AS (SELECT path, s, kind, parent AS around FROM pr WHERE parent IS NOT NULL UNION ALL SELECT up.path, up.s, up.kind, pr.parent FROM up JOIN pr ON pr.path = up.path AND pr.s = up.around WHERE pr.parent IS NOT NULL),
an AS (SELECT DISTINCT up.path, up.s, up.kind, pr.kind AS outer_kind, up.around FROM up JOIN pr ON pr.path = up.path AND pr.s = up.around)
SELECT 'function_inside_mod' AS found, path, s::BIGINT AS start_line FROM an WHERE kind = 'function_item' AND outer_kind = 'mod_item'
UNION ALL SELECT DISTINCT 'function_holds_for', path, around::BIGINT FROM an WHERE kind = 'for_expression' AND outer_kind = 'function_item'
UNION ALL SELECT 'function_without_if', path, s::BIGINT FROM nd n WHERE kind = 'function_item' AND NOT EXISTS (SELECT 1 FROM an WHERE an.path = n.path AND an.around = n.s AND an.kind = 'if_expression')
UNION ALL SELECT 'trait_function_outside_mod', path, s::BIGINT FROM an WHERE kind = 'function_item' AND outer_kind = 'trait_item' AND NOT EXISTS (SELECT 1 FROM an m WHERE m.path = an.path AND m.s = an.s AND m.outer_kind = 'mod_item')""")
def syntax_ancestors(spark, d):
    """Conditions on ancestors and descendants, told again by a recursive walk up."""
    rows = trees.nodes(sources(spark, d), ["function_item", "mod_item", "trait_item", "for_expression", "if_expression"])
    tests = {
        "function_inside_mod": [("inside", "mod_item")], "function_holds_for": [("holds", "for_expression")],
        "function_without_if": [("not_holds", "if_expression")], "trait_function_outside_mod": [("inside", "trait_item"), ("not_inside", "mod_item")],
    }
    return syntax.select_each(rows, "function_item", tests).select("found", "path", "start_line")


@query(None)
def gapped_clones(spark, d):
    """Places alike but for edits, of source files; tested by planted ones (test_near_clones)."""
    return near_clones.near_clones(sources(spark, d), "path", "text")
