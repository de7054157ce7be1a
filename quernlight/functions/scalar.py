"""Scalar expressions: tokens, scores, ids, paths and code measures as Columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60.0
#: Fixed map of file extensions to languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby",
    "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits with more than two bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 2)


def bm25_idf(n_docs: Column, df: Column) -> Column:
    n, d = n_docs.cast("double"), df.cast("double")
    return F.when(n > 1, F.log(1.0 + (n - d + 0.5) / (d + 0.5))).otherwise(F.lit(1.0))


def bm25_weight(tf: Column, length: Column, average: Column) -> Column:
    tf = tf.cast("double")
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * length / average))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def rrf(rank: Column) -> Column:
    """Share of a 1-based rank in a reciprocal rank fusion."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def l2_score(squared: Column) -> Column:
    return 1.0 / (1.0 + F.sqrt(squared))


def impact(files: Column, changes: Column) -> Column:
    return F.least(F.lit(100.0), 10.0 * F.log1p(files.cast("double")) + 5.0 * F.log1p(changes.cast("double")))


def maintainability(sloc: Column, cyclomatic: Column) -> Column:
    raw = 171.0 - 5.2 * F.log(F.greatest(cyclomatic.cast("double"), F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.log(sloc.cast("double"))
    return F.when(sloc <= 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100.0 / 171.0)))


def debt_gradient(max_complexity: Column, dead: Column, sloc: Column) -> Column:
    return 2 * F.coalesce(max_complexity, F.lit(0)) + 10 * F.coalesce(dead, F.lit(0)) + 10 * F.floor(sloc / 200)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_OID) -> Column:
    """Version-5 UUID of a name, from its SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.substring(F.lit("89ab"), nibble + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def mask_id(value: Column, shown: int = 8) -> Column:
    return F.when(F.length(value) > shown, F.concat(F.substring(value, 1, shown), F.lit("..."))).otherwise(value)


def preview(text: Column, length: int = 120) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def month(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM")


def day(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, extension(path)), F.lit("unknown"))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(slashes(path), F.lit(root)), F.substring(slashes(path), len(root) + 1, 1 << 30)).otherwise(slashes(path))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sloc(text: Column, count_comments: bool = False) -> Column:
    code = lambda s: (F.trim(s) != "") & (F.lit(count_comments) | ~F.startswith(F.ltrim(s), F.lit("//")))
    return F.size(F.filter(lines(text), code))


#: Branches for cyclomatic complexity: keywords and short-circuit operators.
BRANCH = r"\b(if|else if|while|for|loop|match|case|catch)\b|&&|\|\|"


def cyclomatic(body: Column) -> Column:
    return F.lit(1) + F.regexp_count(body, F.lit(BRANCH))


def is_camel_case(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Za-z0-9]*$")


def is_snake_case(name: Column) -> Column:
    return name.rlike("^_*[a-z][a-z0-9_]*$")


def is_upper_case(name: Column) -> Column:
    return name.rlike("^[A-Z][A-Z0-9_]*$")


def name_words(name: Column) -> Column:
    """Words of a CamelCase or snake_case name, lower case."""
    parted = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(parted), "_+"), lambda w: w != "")


def names_related(a: Column, b: Column) -> Column:
    """Whether two names share their first or last word, or any word over three letters."""
    x, y = name_words(a), name_words(b)
    ends = (F.element_at(x, 1) == F.element_at(y, 1)) | (F.element_at(x, -1) == F.element_at(y, -1))
    return ends | F.exists(F.array_intersect(x, y), lambda w: F.length(w) > 3)


def glob_to_regex(glob: str) -> str:
    """`*` within a folder, `**` over folders, `?` one character."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" + glob[k] if glob[k] in ".+()[]{}^$|\\" else glob[k]), k + 1
    return f"^(?:{out})$"


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Included by a pattern (or there is none), and by no `!` pattern excluded."""
    yes = [glob_to_regex(g) for g in globs if not g.startswith("!")]
    no = [glob_to_regex(g[1:]) for g in globs if g.startswith("!")]
    ok = F.lit(True) if not yes else F.lit(False)
    for r in yes:
        ok = ok | path.rlike(r)
    for r in no:
        ok = ok & ~path.rlike(r)
    return ok
