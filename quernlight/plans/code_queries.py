"""Text and code analytics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import code as C
from ..operators import rules as R
from .registry import Registry, table

query = Registry()


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


LINES = "ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("WITH x AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages) SELECT page_id, len(l) AS line_count, len(list_filter(l, lambda s: trim(s, ' ') <> '' AND NOT starts_with(ltrim(s, ' '), '//'))) AS sloc FROM x")
def source_lines(spark, d):
    t = F.col("html")
    return table(spark, d, "pages").select("page_id", F.size(S.lines(t)).cast("long").alias("line_count"), S.sloc(t).cast("long").alias("sloc"))


@query(f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, trim(line, ' ') AS snippet FROM ln WHERE contains(lower(line), 'license') ORDER BY doc_id, line_no LIMIT 50")
def search_lines(spark, d):
    return C.matching_lines(_docs(spark, d), "doc_id", "text", "LICENSE", 50)


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, l, unnest(range((len(l) - 1) // 15 + 1)) AS k FROM p),
c AS (SELECT doc_id, k * 15 + 1 AS start_line, least((k + 1) * 15, len(l)) AS end_line, array_to_string(l[k * 15 + 1 : k * 15 + 15], chr(10)) AS content FROM k)
SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line, sha256(content) AS digest FROM c WHERE strlen(trim(content, ' ')) >= 20""")
def generic_chunks(spark, d):
    return C.blocks(_docs(spark, d), "doc_id", "text").select("doc_id", "start_line", "end_line", F.sha2("content", 256).alias("digest"))


@query("""WITH c AS (SELECT page_id, 1 + len(regexp_extract_all(html, '\\b(if|else if|while|for|loop|match|case|catch)\\b|&&|\\|\\|')) AS cyclomatic FROM pages)
SELECT page_id, cyclomatic::INT AS cyclomatic FROM c""".replace("\\\\", "\\"))
def cyclomatic_complexity(spark, d):
    return table(spark, d, "pages").select("page_id", S.cyclomatic(F.col("html")).alias("cyclomatic"))


@query("""WITH c AS (SELECT avg(1 + len(regexp_extract_all(text, '\\b(if|else if|while|for|loop|match|case|catch)\\b|&&|\\|\\|'))) AS c,
sum(len(list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ') <> '' AND NOT starts_with(ltrim(s, ' '), '//')))) AS s FROM documents)
SELECT round(c, 6) AS cyclomatic, round(c * 1.2, 6) AS cognitive, s::BIGINT AS sloc,
round(greatest(0, least(100, (171 - 5.2 * ln(greatest(c, 1)) - 0.23 * c - 16.2 * ln(s)) * 100 / 171)), 6)::DOUBLE AS maintainability FROM c""".replace("\\\\", "\\"))
def complexity_report(spark, d):
    r = C.complexity_report(_docs(spark, d), "text")
    return r.select(F.round("cyclomatic", 6).alias("cyclomatic"), F.round("cognitive", 6).alias("cognitive"), "sloc", F.round("maintainability", 6).alias("maintainability"))


WORDS = r"wd AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents)"
PRINTS = f"{WORDS}, pr AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 50], ' ') AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM wd WHERE len(w) >= 50))"


@query(f"WITH {PRINTS}, s AS (SELECT p, min(doc_id) AS a FROM pr GROUP BY p) SELECT a, doc_id AS b, count(*) AS shared FROM pr JOIN s USING (p) WHERE a < doc_id GROUP BY 1, 2")
def clone_links(spark, d):
    return C.clone_links(_docs(spark, d), "doc_id", "text")


@query(f"""WITH {WORDS}, p AS (SELECT doc_id, i AS place, array_to_string(w[i + 1 : i + 50], ' ') AS p FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM wd WHERE len(w) >= 50)),
f AS (SELECT first_value(doc_id) OVER v AS first_key, first_value(place) OVER v AS first_at, doc_id, place, count(*) OVER (PARTITION BY p) AS n FROM p WINDOW v AS (PARTITION BY p ORDER BY doc_id, place))
SELECT first_key, first_at, doc_id, place AS "at" FROM f WHERE n > 1""")
def clone_members(spark, d):
    return C.clone_members(_docs(spark, d), "doc_id", "text")


@query(f"WITH {WORDS}, p AS (SELECT array_to_string(w[i + 1 : i + 50], ' ') AS p FROM (SELECT w, unnest(range(len(w) - 49)) AS i FROM wd WHERE len(w) >= 50)), g AS (SELECT count(*) AS n FROM p GROUP BY p) SELECT count(*) AS prints, sum(n)::BIGINT AS places, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS repeated FROM g")
def fingerprint_stats(spark, d):
    return C.print_stats(C.windows(_docs(spark, d), "doc_id", "text"))


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS identifier FROM documents)
SELECT identifier, count(*) AS n, count(DISTINCT doc_id) AS files FROM x GROUP BY 1""")
def identifier_counts(spark, d):
    return C.identifier_counts(_docs(spark, d), "doc_id", "text")


@query(f"WITH {LINES} SELECT line AS value, count(DISTINCT doc_id) AS files FROM ln WHERE length(line) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4")
def duplicate_strings(spark, d):
    return C.repeated_strings(_docs(spark, d), "doc_id", "text", 4, r"(?m)^([^\n]{20,})$")


RULES = [
    {"id": "R1", "category": "license", "severity": "INFO", "message": "license line", "patterns": ["[Ll]icensed", "License"], "ignore": ["CC BY"]},
    {"id": "R2", "category": "secret", "severity": "ERROR", "message": "token", "patterns": ["token = ", "password="]},
]


@query(f"""WITH {LINES}, v AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '[Ll]icensed|License') AND NOT contains(line, 'CC BY') THEN 1 END AS r1,
CASE WHEN contains(line, 'token = ') OR contains(line, 'password=') THEN 1 END AS r2 FROM ln)
SELECT doc_id, line_no::INT AS line_no, 'R1' AS rule, 'INFO' AS severity FROM v WHERE r1 = 1 UNION ALL SELECT doc_id, line_no::INT, 'R2', 'ERROR' FROM v WHERE r2 = 1""")
def regex_rules(spark, d):
    return C.line_rules(C.line_table(_docs(spark, d), "doc_id", "text"), RULES, "doc_id").select("doc_id", "line_no", "rule", "severity")


@query(f"""WITH {LINES}, v AS (SELECT 'license' AS category, count(*) AS n FROM ln WHERE regexp_matches(line, '[Ll]icensed|License') AND NOT contains(line, 'CC BY')),
w AS (SELECT 'secret' AS category, count(*) AS n FROM ln WHERE contains(line, 'token = ') OR contains(line, 'password='))
SELECT category, n AS total, 0::BIGINT AS error, 0::BIGINT AS warning, n AS info, true AS passed FROM v WHERE n > 0 UNION ALL SELECT category, n, n, 0, 0, false FROM w WHERE n > 0""")
def rule_report(spark, d):
    return A.severity_summary(C.line_rules(C.line_table(_docs(spark, d), "doc_id", "text"), RULES, "doc_id"))


@query("SELECT url AS path, 'deep' AS rule FROM pages WHERE regexp_matches(url, '^https://([^/]+)/.*$') AND NOT regexp_matches(url, '^.*/p/.*$')")
def rule_applicability(spark, d):
    files = table(spark, d, "pages").select(F.col("url").alias("path"), F.lit("html").alias("language"), F.array().cast("array<string>").alias("deps"))
    return R.files_for_rules(files, [{"id": "deep", "languages": ["html"], "files": ["https://*/**", "!**/p/**"]}])


@query("SELECT count(*) AS file_count, coalesce(bool_or(contains(text, '.unwrap()')), false) AS has_unwrap, count(*) > 10 AND NOT coalesce(bool_or(contains(text, '.unwrap()')), false) AS violated FROM documents")
def expression_rule(spark, d):
    facts = R.facts(_docs(spark, d), "text")
    return facts.select("file_count", "has_unwrap", R.expression("file_count > 10 && !has_unwrap").alias("violated"))


@query("SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) > 3 AND NOT contains(text, 'license') AND (lang IN ('en', 'de') OR starts_with(source, 'src1'))")
def json_condition(spark, d):
    files = table(spark, d, "documents").withColumn("deps", F.array("lang", "source"))
    spec = {"all": [{"file_size": 3}, {"not": {"pattern": "license"}}, {"any": [{"dependency": "en"}, {"dependency": "de"}, {"dependency": "src1*"}]}]}
    return files.where(R.condition(spec)).select("doc_id")


@query(r"SELECT page_id, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS ext FROM pages")
def file_extension(spark, d):
    return table(spark, d, "pages").select("page_id", S.extension(F.col("url")).alias("ext"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS preview, length(text) // 4 AS tokens FROM documents")
def previews(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", S.preview(t).alias("preview"), S.token_estimate(t).alias("tokens"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Z][A-Za-z0-9]*$') AS camel, regexp_matches(p_name, '^_*[a-z][a-z0-9_]*$') AS snake, regexp_matches(p_brand, '^[A-Z][A-Z0-9_]*$') AS upper FROM part")
def naming_tests(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", S.is_camel_case(n).alias("camel"), S.is_snake_case(n).alias("snake"), S.is_upper_case(F.col("p_brand")).alias("upper"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return A.rows_in_windows(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark, d):
    w = F.session_window("ts", "30 minutes")
    return table(spark, d, "events").groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


QUERIES, ORACLE_SQL = query.queries, query.sql
