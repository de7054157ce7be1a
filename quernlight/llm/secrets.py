"""Secret scan with corpus-wide ownership frequency (native).

Base spans come from three patterns in every whole text. The method then takes
candidate credentials (long opaque tokens with letters and digits, and assigned
values), hashes them, and counts for each hash the distinct repositories and
owners that hold it over the whole corpus, in the same text or in others. What at
least `wide` owners hold, and so as many repositories, is a widely copied example and gives a span of kind `shared`.
Of the rest, what looks alive (enough different characters, no placeholder) gives a
span of kind `reused` if at least `wide` repositories of few owners hold it, else
of kind `live`; others give none. Values leave the scan as SHA-256 hashes only.

Positions come from splitting the text by the same pattern that finds the
matches: lengths of the gaps and matches are summed up.

Defined cases: a null text counts as empty; empty texts have no spans and the
digest of the empty string. A null owner counts as one owner of its own.
Repeated rows each get their row, with equal values, and count once as owners;
null ids are kept; other columns are not read; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Fixed patterns.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"
#: Matches are whole runs, so they can only start where a run starts.
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
OPAQUE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "0123456789", "your")
KINDS = ("assign", "access", "hex", "live", "shared", "reused")
WIDE = 4
BLOCK = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: inside another lambda an expression is
    worked out again for each element, a lambda's own variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Sums before each element, in blocks so that no array is copied n times."""
    zero = F.lit(0).cast("bigint")

    def sums(a: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            a, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
            lambda s: s["out"],
        )

    def whole(lengths: Column) -> Column:
        n = F.size(lengths)
        starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: k * BLOCK + 1)
        blocks = F.transform(starts, lambda k: F.slice(lengths, k, F.lit(BLOCK)))
        totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
        spread = once(blocks, lambda b: F.flatten(F.zip_with(b, sums(totals(b), zero), sums)))
        return F.when(n > 0, spread).otherwise(F.array().cast("array<bigint>"))

    return once(lengths, whole)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, from, to>> of the leftmost matches, code points."""
    none = F.array().cast("array<struct<value:string,from:bigint,to:bigint>>")

    def spans(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        steps = F.zip_with(values, gaps, lambda v, g: (F.length(g) + F.length(v)).cast("bigint"))
        found = once(steps, lambda s: F.zip_with(
            F.arrays_zip(values.alias("v"), s.alias("s")), running_sums(s),
            lambda x, at: F.struct(x["v"].alias("value"), (at + x["s"] - F.length(x["v"])).alias("from"), (at + x["s"]).alias("to")),
        ))
        return F.when(F.size(values) > 0, found).otherwise(none)

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["from"].alias("from"), F.lit(kind).alias("kind"), m["to"].alias("to"))
    )


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed; comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["from"], s["to"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(
    documents: DataFrame,
    repository: str = "source",
    owner: str | Column | None = None,
    wide: int = WIDE,
    min_distinct: int = 8,
    with_row: bool = False,
) -> DataFrame:
    """One row per document row: doc_id, counts of base spans, base_spans and
    spans (text form) and the number of live, shared and reused candidates; with_row adds
    `row`, the text's xxhash64, which tells rows of one id apart. The owner is the part of the repository's name before its first '/', if none is given."""
    repo = F.col(repository)
    who = F.split(repo, "/")[0] if owner is None else (F.col(owner) if isinstance(owner, str) else owner)
    text = F.coalesce(F.col("text"), F.lit(""))
    hint = F.lit(False)
    for h in ("passw", "secret", "token", "apikey", "api_key"):
        hint = hint | F.col("low").contains(h)
    none = F.array().cast("array<struct<value:string,from:bigint,to:bigint>>")
    rows = documents.select(
        "doc_id", F.coalesce(repo, F.lit("\u0000")).alias("repo"), F.coalesce(who, F.lit("\u0000")).alias("owner"),
        F.xxhash64(F.col("text")).alias("row"), text.alias("text"), F.lower(text).alias("low"),
    )
    text = F.col("text")
    rows = rows.select(
        "doc_id", "repo", "owner", "row",
        # The hints are ASCII, so no text with a match lacks one.
        F.when(hint, matches(text, ASSIGN)).otherwise(none).alias("assign"),
        F.when(text.contains("AKIA"), matches(text, ACCESS)).otherwise(none).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, OPAQUE).alias("opaque"),
    )
    value_at = lambda m: F.length(m["value"]) - F.length(F.regexp_extract(m["value"], ASSIGN, 2))
    rows = rows.withColumn("assign", F.filter("assign", lambda m: F.length(m["value"]) - value_at(m) >= 12))
    assigned = F.transform(
        "assign",
        lambda m: F.struct(
            F.regexp_extract(m["value"], ASSIGN, 2).alias("value"), (m["from"] + value_at(m)).alias("from"), m["to"].alias("to")
        ),
    )
    opaque = F.filter("opaque", lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]"))
    plain = lambda v: F.lower(v)
    odd = lambda v: F.exists(F.array(*[F.lit(p) for p in PLACEHOLDERS]), lambda p: plain(v).contains(p))
    looks_alive = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= min_distinct) & ~odd(v)
    # A value may stand here twice, assigned and opaque: its spans are a set in the end.
    candidates = F.transform(
        F.concat(assigned, opaque),
        lambda m: F.struct(
            F.sha2(m["value"], 256).alias("hash"), looks_alive(m["value"]).alias("alive"), m["from"].alias("from"), m["to"].alias("to")
        ),
    )
    base = F.concat(_spans(F.col("assign"), 0), _spans(F.col("access"), 1), _spans(F.col("hex"), 2))
    # Small from here on: spans and hashes, no text.
    rows = cut(
        rows.select(
            "doc_id", "repo", "owner", "row",
            *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), candidates.alias("candidates"),
        )
    )
    found = rows.select("doc_id", "row", "repo", "owner", F.explode("candidates").alias("c")).select("doc_id", "row", "repo", "owner", "c.*")
    # Each repository once for a hash, before they are counted: a hot hash or repository is one row for each task.
    held = found.groupBy("hash", "repo", "owner").agg(F.lit(1).alias("one"))
    owners = held.groupBy(F.col("hash").alias("held")).agg(F.countDistinct("repo").alias("n_repos"), F.countDistinct("owner").alias("n_owners"))
    owners = cut(owners)
    kind = F.when((F.col("n_owners") >= wide) & (F.col("n_repos") >= wide), 4).when(F.col("alive"), F.when(F.col("n_repos") >= wide, 5).otherwise(3))
    marked = found.join(owners, found["hash"] == owners["held"]).where(kind.isNotNull())
    marked = marked.select("doc_id", "row", F.struct(F.col("from"), kind.alias("kind"), F.col("to")).alias("span"))
    marked = marked.groupBy(F.col("doc_id").alias("m_id"), F.col("row").alias("m_row")).agg(F.collect_set("span").alias("more"))
    out = rows.join(marked, rows["doc_id"].eqNullSafe(marked["m_id"]) & rows["row"].eqNullSafe(marked["m_row"]), "left")
    more = F.coalesce("more", F.array().cast("array<struct<from:bigint,kind:int,to:bigint>>"))
    n_of = lambda k: F.size(F.filter(more, lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *["row"] * with_row, "n_assign", "n_access", "n_hex", render(F.col("base")).alias("base_spans"),
        render(F.concat(F.col("base"), more)).alias("spans"), n_of(3).alias("n_live"), n_of(4).alias("n_shared"), n_of(5).alias("n_reused"),
    )


#: The same in DuckDB.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(source, chr(0)) AS repo,
         coalesce(text, '') AS text FROM documents),
m AS (
  SELECT rid, k, unnest(regexp_extract_all(text, p)) AS v,
         unnest(list_transform(string_split_regex(text, p)[1:len(regexp_extract_all(text, p))], lambda g: length(g))) AS gap,
         generate_subscripts(regexp_extract_all(text, p), 1) AS i
  FROM t, (VALUES (0, '<ASSIGN>'), (1, 'AKIA[A-Z0-9]{14,}'), (2, '[0-9a-f]{16,}'), (9, '[A-Za-z0-9+/_=-]{16,}')) AS q(k, p)),
s AS (
  SELECT rid, k, v, sum(gap + length(v)) OVER (PARTITION BY rid, k ORDER BY i) AS e,
         CASE WHEN k = 0 THEN regexp_extract(v, '<ASSIGN>', 2) ELSE v END AS val FROM m),
b AS (SELECT rid, k, e - length(v) AS a, e, val FROM s WHERE k IN (1, 2) OR (k = 0 AND length(val) >= 12)),
c AS (
  SELECT DISTINCT rid, sha256(val) AS h, e - length(val) AS a, e, val FROM s
  WHERE (k = 0 AND length(val) >= 12) OR (k = 9 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]'))),
o AS (SELECT h, count(DISTINCT repo) AS n_repos, count(DISTINCT split_part(repo, '/', 1)) AS n_owners FROM c JOIN t USING (rid) GROUP BY h),
x AS (
  SELECT rid, a, e, CASE WHEN n_owners >= 4 AND n_repos >= 4 THEN 4
    WHEN len(list_distinct(string_split(val, ''))) >= 8
      AND NOT regexp_matches(lower(val), 'example|changeme|placeholder|xxxx|0123456789|your') THEN CASE WHEN n_repos >= 4 THEN 5 ELSE 3 END END AS k
  FROM c JOIN o USING (h)),
u AS (SELECT rid, k, a, e FROM b UNION SELECT rid, k, a, e FROM x WHERE k IS NOT NULL),
g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'live', 'shared', 'reused'][k + 1] || ':' || a::BIGINT || ':' || e::BIGINT, ',' ORDER BY a, k, e) FILTER (k < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'live', 'shared', 'reused'][k + 1] || ':' || a::BIGINT || ':' || e::BIGINT, ',' ORDER BY a, k, e) AS spans
  FROM u GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
""".replace("<ASSIGN>", ASSIGN.replace("'", "''"))
