"""Store, list, session and dashboard queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import shared_folder
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import memory as M
from ..operators import rollups as U
from .registry import Registry, table

query = Registry()
#: Documents stand for observations.
OBS = """obs AS (SELECT doc_id AS id, lang AS project_id, source AS kind, text AS content, 1700000000 + (doc_id // 3) * 3600 AS created_at,
 [lang, source] AS tags, '{"session_id":"s' || (doc_id % 7) || '","origin":{"branch":"b' || (doc_id % 3) || '"}}' AS metadata FROM documents)"""


def _obs(spark, d) -> DataFrame:
    i = F.col("doc_id")
    meta = F.concat(F.lit('{"session_id":"s'), i % 7, F.lit('","origin":{"branch":"b'), i % 3, F.lit('"}}'))
    return table(spark, d, "documents").select(
        i.alias("id"), F.col("lang").alias("project_id"), F.col("source").alias("kind"), F.col("text").alias("content"),
        (F.lit(1700000000) + F.floor(i / 3) * 3600).alias("created_at"), F.array("lang", "source").alias("tags"), meta.alias("metadata"),
    )


@query(f"WITH {OBS} SELECT id, kind, created_at FROM obs WHERE project_id = 'en' AND kind = 'src3' AND created_at BETWEEN 1700000000 AND 1700900000")
def observation_filter(spark, d):
    o = _obs(spark, d).where(M.equalities(project_id="en", kind="src3") & M.time_range("created_at", 1700000000, 1700900000))
    return o.select("id", "kind", "created_at")


@query(f"WITH {OBS} SELECT id FROM obs WHERE json_extract_string(metadata, '$.session_id') = 's4' AND json_extract_string(metadata, '$.origin.branch') = 'b1'")
def metadata_path_filter(spark, d):
    return _obs(spark, d).where(M.json_equals("metadata", session_id="s4", origin__branch="b1")).select("id")


@query(f"WITH {OBS} SELECT id FROM obs WHERE list_contains(tags, 'de') AND list_contains(tags, 'src5')")
def all_tags_filter(spark, d):
    return _obs(spark, d).where(M.has_all_tags("tags", ["de", "src5"])).select("id")


@query(f"""WITH {OBS}, x AS (SELECT *, 'src\\' || kind || '/f' || id || CASE WHEN id % 2 = 0 THEN '.rs' ELSE '.py' END AS file_path FROM obs)
SELECT id FROM x WHERE project_id = 'en' AND starts_with(replace(file_path, '\\', '/'), 'src/src') AND file_path LIKE '%.rs' AND list_contains(tags, 'en')
AND created_at BETWEEN 1700000000 AND 1700900000 AND json_extract_string(metadata, '$.origin.branch') = 'b1'""")
def constraint_builder(spark, d):
    o = _obs(spark, d)
    name = F.concat(F.lit("src\\"), "kind", F.lit("/f"), "id", F.when(F.col("id") % 2 == 0, ".rs").otherwise(".py"))
    spec = {"project_id": "en", "directory": "src/src", "extension": "rs", "tags": ["en"], "start": 1700000000, "end": 1700900000, "metadata": {"origin.branch": "b1"}, "min_score": 0.5}
    return o.withColumn("file_path", name).where(M.constraints(spec)).select("id")


@query(f"WITH {OBS} SELECT id, created_at FROM obs ORDER BY created_at DESC, id DESC LIMIT 10")
def newest_observations(spark, d):
    return M.newest(_obs(spark, d), "created_at", "id").select("id", "created_at")


@query(f"WITH {OBS} SELECT id, kind FROM obs WHERE kind = 'src2' ORDER BY created_at DESC, id DESC LIMIT 10")
def observations_by_type(spark, d):
    return M.newest(_obs(spark, d).where(M.equalities(kind="src2")), "created_at", "id").select("id", "kind")


@query(f"""WITH {OBS}, a AS (SELECT created_at AS t, id AS i FROM obs WHERE id = 100),
x AS (SELECT id, created_at FROM obs, a WHERE (created_at, id) < (t, i) ORDER BY created_at DESC, id DESC LIMIT 5),
y AS (SELECT id, created_at FROM obs, a WHERE (created_at, id) > (t, i) ORDER BY created_at, id LIMIT 5)
SELECT * FROM x UNION ALL SELECT i, t FROM a UNION ALL SELECT * FROM y""")
def memory_timeline(spark, d):
    return M.timeline(_obs(spark, d).select("id", "created_at"), 100, 5, 5, "created_at", "id")


@query(f"""WITH {OBS}, a AS (SELECT created_at AS t, id AS i FROM obs WHERE id = 100),
x AS (SELECT id, created_at FROM obs, a WHERE (created_at, id) < (t, i) ORDER BY created_at DESC, id DESC LIMIT 5),
y AS (SELECT id, created_at FROM obs, a WHERE (created_at, id) > (t, i) ORDER BY created_at DESC, id DESC LIMIT 5)
SELECT * FROM x UNION ALL SELECT i, t FROM a UNION ALL SELECT * FROM y""")
def memory_timeline_newest_after(spark, d):
    return M.timeline(_obs(spark, d).select("id", "created_at"), 100, 5, 5, "created_at", "id", compat=True)


@query(f"""WITH {OBS},
s AS (SELECT id, sum(length(content)) OVER (ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS chars_so_far FROM obs)
SELECT id, chars_so_far::BIGINT AS chars_so_far FROM s WHERE chars_so_far <= 20000""")
def inject_context(spark, d):
    return M.within_budget(_obs(spark, d), "content", 20000, "created_at", "id").select("id", "chars_so_far")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return M.first_of_content(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT sha256(text) AS content_hash, lang, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def content_dedup_per_project(spark, d):
    return M.first_of_content(table(spark, d, "documents"), "text", "doc_id", "lang")


@query("""WITH n AS (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE lang <> 'en' AND trim(lang) <> ''
 QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1)
SELECT content_hash, doc_id FROM n WHERE content_hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')""")
def store_observations(spark, d):
    docs = table(spark, d, "documents")
    return M.store(docs.where("lang = 'en'"), docs.where("lang <> 'en'"), "text", "doc_id", "lang").select("content_hash", "doc_id")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lang, b.lang) AS lang, CASE WHEN b.doc_id IS NOT NULL THEN 'new' ELSE a.source END AS source
FROM (SELECT * FROM documents WHERE source <> 'src3') a FULL JOIN (SELECT * FROM documents WHERE lang = 'de') b ON a.doc_id = b.doc_id""")
def upsert_by_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return M.upsert(docs.where("source <> 'src3'"), docs.where("lang = 'de'").withColumn("source", F.lit("new")), ["doc_id"], ["source"])


STATE = """cur AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src5'),
old AS (SELECT doc_id, CASE WHEN source = 'src7' THEN 'x' ELSE sha256(text) END AS h, CASE WHEN source = 'src11' THEN 1000 END AS deleted_at FROM documents WHERE lang <> 'fr')"""


def _state(spark, d):
    """Files now, and as they were stored: some are gone, some new, some changed."""
    docs = table(spark, d, "documents")
    h, s = F.sha2("text", 256), F.col("source")
    current = docs.where("source <> 'src5'").select("doc_id", h.alias("h"))
    deleted = F.when(s == "src11", 1000).cast("long")
    return current, docs.where("lang <> 'fr'").select("doc_id", F.when(s == "src7", "x").otherwise(h).alias("h"), deleted.alias("deleted_at"))


@query(f"""WITH {STATE} SELECT coalesce(c.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN c.doc_id IS NULL THEN 'deleted'
 WHEN c.h = o.h THEN 'unchanged' ELSE 'changed' END AS status FROM cur c FULL JOIN (SELECT * FROM old WHERE deleted_at IS NULL) o ON c.doc_id = o.doc_id""")
def incremental_changes(spark, d):
    current, stored = _state(spark, d)
    return M.file_changes(current, stored, ["doc_id"], "h")


@query(f"""WITH {STATE}, m AS (SELECT doc_id, CASE WHEN deleted_at IS NULL AND doc_id NOT IN (SELECT doc_id FROM cur) THEN 900000 ELSE deleted_at END AS deleted_at FROM old)
SELECT doc_id, deleted_at FROM m WHERE deleted_at IS NULL OR deleted_at >= 1000000 - 604800""")
def soft_delete_and_purge(spark, d):
    current, stored = _state(spark, d)
    gone = stored.join(current, "doc_id", "left_anti")
    return M.purge(M.soft_delete(stored, gone, ["doc_id"], 900000), 1000000).select("doc_id", "deleted_at")


@query("SELECT count(*) FILTER (d IS NULL) AS live, count(d) AS tombstones, max(CASE WHEN d IS NULL THEN doc_id END) AS last_id FROM (SELECT doc_id, CASE WHEN source = 'src11' THEN 1000 END AS d FROM documents WHERE lang <> 'fr')")
def index_stats(spark, d):
    s = _state(spark, d)[1]
    live = F.col("deleted_at").isNull()
    return s.agg(F.count_if(live).alias("live"), F.count("deleted_at").alias("tombstones"), F.max(F.when(live, F.col("doc_id"))).alias("last_id"))


@query("SELECT source, doc_id FROM documents WHERE source NOT IN ('src1', 'src2') OR lang = 'en'")
def reindexed_chunks(spark, d):
    """Two sources are read anew and then hold English texts only."""
    f = table(spark, d, "documents").select("source", "doc_id", "lang")
    return M.replace_chunks(f, f.where("source in ('src1', 'src2') and lang = 'en'"), "source").select("source", "doc_id")


# --- dashboard ----------------------------------------------------------------
@query("SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12")
def events_per_month(spark, d):
    return A.per_period(table(spark, d, "events"), F.date_format("ts", "yyyy-MM"), 12)


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def events_per_day(spark, d):
    return A.per_period(table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), 7)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def tool_call_counts(spark, d):
    return A.counts_by(table(spark, d, "events"), "event_type")


@query("SELECT count(DISTINCT user_id) AS sessions, count(DISTINCT event_type) AS agents FROM events")
def session_stats(spark, d):
    return A.session_stats(table(spark, d, "events"), "user_id", "event_type")


def _rollup(spark, d) -> DataFrame:
    """Events rolled up in two goes, the second with later arrivals of the same days."""
    events, path = table(spark, d, "events"), f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    for late in (False, True):
        U.append(U.daily(events.where((F.col("event_id") % 5 == 0) == F.lit(late)), "ts", "user_id", "event_type"), path)
    return U.read(spark, path)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= DATE '2024-01-03' AND ts < DATE '2024-01-20' GROUP BY 1")
def rollup_of_days(spark, d):
    """A range of days, by type: counts and different users of the whole range."""
    days = _rollup(spark, d).where("day >= date '2024-01-03' and day < date '2024-01-20'")  # folders
    return U.merged(days, "event_type").withColumnRenamed("distinct", "users")


@query("SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def rollup_per_month(spark, d):
    return U.merged(_rollup(spark, d), F.date_format("day", "yyyy-MM").alias("period")).withColumnRenamed("distinct", "users")


@query("SELECT source, count(*) AS chunks, min(lang) AS language FROM documents GROUP BY 1")
def file_chunk_counts(spark, d):
    return A.file_counts(table(spark, d, "documents"), "source", "lang")


@query("SELECT label, count(*) AS vectors, count(DISTINCT vec_id) AS files FROM embeddings GROUP BY 1")
def collections(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.countDistinct("vec_id").alias("files"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_key_counts(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT source AS category, count(*) AS total, count(*) FILTER (toxic = 1) AS error, count(*) FILTER (toxic = 0 AND quality = 0) AS warning,
count(*) FILTER (toxic = 0 AND quality = 1) AS info, count(*) FILTER (toxic = 1) = 0 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def report_summary(spark, d):
    v = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("category")), "doc_id")
    severity = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARNING").otherwise("INFO")
    return A.severity_summary(v.select("category", severity.alias("severity")))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders")
def job_counts(spark, d):
    return A.status_counters(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P"])


@query("""SELECT l_returnflag AS status, count(*) AS files, sum(l_linenumber) AS changes,
round(least(100, 10 * ln(1 + count(*)) + 5 * ln(1 + sum(l_linenumber))), 6) AS impact FROM lineitem GROUP BY 1""")
def change_impact(spark, d):
    by = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("files"), F.sum("l_linenumber").alias("changes"))
    return by.withColumn("impact", F.round(S.impact(F.col("files"), F.col("changes")), 6))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1")
def latest_session_summary(spark, d):
    return M.latest_per(table(spark, d, "conversations").select("conv_id", "turn", "role").distinct(), ["conv_id"], "turn", "role")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND turn = 1 ORDER BY conv_id DESC, turn LIMIT 100")
def agent_sessions(spark, d):
    c = table(spark, d, "conversations").where(M.equalities(role="assistant", turn=1))
    return c.orderBy(F.col("conv_id").desc(), "turn").limit(100).select("conv_id", "turn")


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 50")
def browse_collections(spark, d):
    return A.best_per_group(table(spark, d, "embeddings").select("label", "vec_id"), "label", 50, F.col("vec_id")).drop("rank")


# --- entities -------------------------------------------------------------------
#: Orders stand for issues.
ISSUES = """iss AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 3) AS project_id, 'ph' || (o_orderkey % 4) AS phase_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bug' ELSE 'task' END AS issue_type,
o_orderstatus AS status, o_orderpriority AS priority, 'c' || (o_custkey % 5) AS assignee, ['l' || (o_orderkey % 6), o_orderpriority] AS labels, o_orderdate AS updated_at FROM orders)"""


def _issues(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("p"), c % 3).alias("project_id"), F.concat(F.lit("ph"), k % 4).alias("phase_id"), F.when(k % 2 == 0, "bug").otherwise("task").alias("issue_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.concat(F.lit("c"), c % 5).alias("assignee"),
        F.array(F.concat(F.lit("l"), k % 6), F.col("o_orderpriority")).alias("labels"), F.col("o_orderdate").alias("updated_at"),
    )


@query(f"""WITH {ISSUES} SELECT id, updated_at FROM iss WHERE project_id = 'p1' AND phase_id = 'ph0' AND issue_type = 'bug' AND status = 'O' AND assignee = 'c2' AND list_contains(labels, 'l4')
ORDER BY updated_at DESC, id DESC LIMIT 10""")
def issue_filter(spark, d):
    found = M.issues(_issues(spark, d), label="l4", project_id="p1", phase_id="ph0", issue_type="bug", status="O", assignee="c2", priority=None)
    return found.select("id", "updated_at")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def active_operations(spark, d):
    return table(spark, d, "orders").where(M.one_of("o_orderstatus", ["O", "P"])).select("o_orderkey", "o_orderstatus")


@query("SELECT l_returnflag AS branch, count(DISTINCT l_partkey) AS files, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1")
def branch_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("branch"), F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("hash"))
    return A.branch_counts(rows.select("branch", "path"), rows.select("branch", "hash"))


@query(r"""WITH c AS (SELECT page_id, replace(replace(url, 'https://', ''), '/', '\') AS file_path, page_id % 40 AS start_line FROM pages)
SELECT page_id, start_line FROM c WHERE starts_with(replace(file_path, '\', '/'), 'example') OR replace(file_path, '\', '/') = (SELECT min(replace(file_path, '\', '/')) FROM c) ORDER BY start_line""".replace("\\\\", "\\"))
def chunks_of_file(spark, d):
    url = F.replace(F.replace("url", F.lit("https://"), F.lit("")), F.lit("/"), F.lit("\\"))
    c = table(spark, d, "pages").select("page_id", url.alias("file_path"), (F.col("page_id") % 40).alias("start_line"))
    first = c.agg(F.min(S.slashes(F.col("file_path")))).first()[0]
    own = M.chunks_of_file(c, "file_path", first, "start_line", "page_id")
    return own.unionByName(c.where(F.startswith(S.slashes(F.col("file_path")), F.lit("example")) & (S.slashes(F.col("file_path")) != first))).select("page_id", "start_line")


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages), t AS (
SELECT DISTINCT split_part(path, '/', 1) AS name, contains(path, '/') AS is_dir FROM p)
SELECT name, is_dir, row_number() OVER (ORDER BY is_dir DESC, name) AS place FROM t""")
def file_tree(spark, d):
    paths = table(spark, d, "pages").select(F.regexp_replace("url", r"^https?://", "").alias("path"))
    return A.tree_level(paths, "path", "")


@query(f"""WITH {OBS} SELECT id, kind, created_at FROM obs WHERE project_id = 'de' AND kind = 'src1' ORDER BY created_at DESC, id DESC LIMIT 10""")
def session_start_context(spark, d):
    return M.newest(_obs(spark, d).where(M.equalities(project_id="de", kind="src1")), "created_at", "id", M.CONTEXT_LIMIT).select("id", "kind", "created_at")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def tenant_scope(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def labels_of_issues(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT event_id, u.label FROM events LEFT JOIN (SELECT vec_id, label FROM embeddings) u ON user_id = vec_id WHERE event_type = 'error'")
def calls_with_session(spark, d):
    s = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), "label")
    return table(spark, d, "events").where("event_type = 'error'").join(s, "user_id", "left").select("event_id", "label")


#: The four orders of lists: (columns, as SQL).
ORDERS = {
    "phases": (["o_orderstatus", "o_orderdate", "o_orderkey"], "o_orderstatus, o_orderdate, o_orderkey"),
    "decisions": (["-o_orderdate", "-o_orderkey"], "o_orderdate DESC, o_orderkey DESC"),
    "projects": (["o_orderpriority", "o_orderkey"], "o_orderpriority, o_orderkey"),
    "operations": (["-o_totalprice", "o_orderkey"], "o_totalprice DESC, o_orderkey"),
}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS list, o_orderkey, row_number() OVER (ORDER BY {sql}) AS place FROM orders QUALIFY place <= 50)" for k, (_, sql) in ORDERS.items()))
def ordered_list(spark, d):
    o = table(spark, d, "orders")
    parts = [M.ordered(o, columns, 50).select(F.lit(k).alias("list"), "o_orderkey", "place") for k, (columns, _) in ORDERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Parts depend on their suppliers; suppliers' numbers are parts' numbers too.
EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
#: A small graph of nations: groups that are cycles, each leads to the next.
LINKS = "f AS (SELECT DISTINCT c_nationkey AS src, least(24, c_nationkey // 5 * 5 + c_custkey % 7)::INT AS dst FROM customer)"


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def _edges(spark, d) -> DataFrame:
    return _lines(spark, d).distinct()


def _links(spark, d) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, d, "customer").select(n.alias("src"), F.least(F.lit(24), F.floor(n / 5) * 5 + k % 7).cast("int").alias("dst")).distinct()


@query(f"WITH {EDGES} SELECT src, dst FROM e WHERE src = 7 OR dst = 7")
def dependencies_of(spark, d):
    return G.touching(_edges(spark, d), 7)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT src, dst, 1 AS depth FROM e WHERE src = 7 UNION SELECT e.src, e.dst, depth + 1 FROM w JOIN e ON e.src = w.dst WHERE depth < 3)
SELECT src, dst, min(depth)::INT AS depth FROM w GROUP BY 1, 2""")
def dependency_walk(spark, d):
    e = _edges(spark, d)
    return G.walk(e, spark.range(1).select(F.lit(7).cast("long").alias("node")), 3)


@query(f"WITH {EDGES} SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_dependencies(spark, d):
    return G.mutual_pairs(_edges(spark, d))


@query(f"""WITH RECURSIVE {LINKS}, w AS (SELECT src AS root, dst AS node FROM f
UNION SELECT root, f.dst FROM w JOIN f ON f.src = w.node) SELECT DISTINCT root FROM w WHERE root = node""")
def dependency_cycles(spark, d):
    return G.on_cycles(_links(spark, d))


@query(f"""WITH RECURSIVE {LINKS}, w AS (SELECT src, dst FROM f UNION SELECT w.src, f.dst FROM w JOIN f ON w.dst = f.src),
m AS (SELECT a.src, min(a.dst) AS o FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT n AS node, least(n, coalesce(o, n)) AS component FROM (SELECT DISTINCT src AS n FROM f) LEFT JOIN m ON n = src""")
def strong_components(spark, d):
    f = _links(spark, d)
    return G.strong_components(f, f.select(F.col("src").alias("node")).distinct())


@query("""WITH RECURSIVE f AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a
  JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_quantity >= 47),
w AS (SELECT src, dst FROM f UNION SELECT w.src, f.dst FROM w JOIN f ON w.dst = f.src),
m AS (SELECT a.src, min(a.dst) AS o FROM w a JOIN w b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
SELECT s_suppkey AS node, least(s_suppkey, coalesce(o, s_suppkey)) AS component FROM supplier LEFT JOIN m ON s_suppkey = src""")
def supplier_components(spark, d):
    """Suppliers that follow each other, by any number of steps, in orders with large returned lines."""
    lines = table(spark, d, "lineitem")
    large = lines.where("l_returnflag = 'R' and l_quantity >= 47").select("l_orderkey", F.col("l_suppkey").alias("src"), (F.col("l_linenumber") + 1).alias("next"))
    after = lines.select("l_orderkey", F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("next"))
    edges = large.join(after, ["l_orderkey", "next"]).select("src", "dst")
    return G.strong_components(edges, table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"WITH {EDGES} SELECT DISTINCT a.src AS owner, b.dst AS target FROM e a JOIN e b ON a.dst = b.src")
def two_hop_layers(spark, d):
    e = _lines(spark, d)
    return G.two_hops(e, e)


@query("""WITH i AS (SELECT p_partkey AS src, replace(p_type, ' ', '::') AS import FROM part), m AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS module FROM part)
SELECT DISTINCT src, module FROM i JOIN m ON import = module OR starts_with(import, module || '::')""")
def import_modules(spark, d):
    p = table(spark, d, "part")
    imports = p.select(F.col("p_partkey").alias("src"), F.replace("p_type", F.lit(" "), F.lit("::")).alias("import"))
    return G.prefix_edges(imports, p.select(F.split("p_type", " ")[0].alias("module")))


QUERIES, ORACLE_SQL = query.queries, query.sql
