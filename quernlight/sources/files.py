"""Files, manifests, rule files and git repositories as DataFrames."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

SKIPPED = (".git", "node_modules", "target", "__pycache__")
#: Fixed marker files of project kinds.
MARKERS = {"Cargo.toml": "cargo", "package.json": "npm", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "go.mod": "go", "pom.xml": "maven"}


def text_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(S.LANGUAGES), ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, text, digest) of supported files below a folder of any store
    that Spark reads; skipped folders and ignore patterns (`dir/`, `*ext`, else a
    part of the path) are left out before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("path")
    ok = S.extension(path).isin([e.lower() for e in extensions])
    for d in SKIPPED:
        ok = ok & ~path.contains(f"/{d}/")
    for p in ignore:
        ok = ok & ~(path.contains("/" + p) if p.endswith("/") else F.endswith(path, F.lit(p[1:])) if p.startswith("*") else path.contains(p))
    found = files.where(ok)
    rules = _ignore_rules(spark, root)
    if rules:
        found = _without_ignored(found, rules)
    text = F.decode("content", "UTF-8")
    return found.select("path", S.language_of(path).alias("language"), text.alias("text"), F.sha2("content", 256).alias("digest"))


def _ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str, bool]]:
    """(folder, pattern, whether it hides) of all .gitignore files below a folder, outer
    ones first: the project's own rules, a few lines."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows, level = [], root.rstrip("/")
    while fs.globStatus(path(level)):  # level by level; Spark's own listing leaves out names with a dot in front
        for status in fs.globStatus(path(f"{level}/.gitignore")) or ():
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            rows.append((status.getPath().getParent().toString(), text))
        level += "/*"
    return [(folder, line.lstrip("!"), not line.startswith("!")) for folder, text in sorted(rows) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#")]


def ignore_regex(folder: str, pattern: str) -> str:
    """Paths that a gitignore pattern of a folder means: anywhere below it without an inner
    slash, else from it on; with a slash behind it folders only; what is in them, too."""
    inner = pattern.rstrip("/")
    anchored, inner = "/" in inner, inner.lstrip("/")
    out = inner.replace("**/", "\0").replace("**", "\1")
    out = "".join({"*": "[^/]*", "?": "[^/]", "\0": "(?:.*/)?", "\1": ".*"}.get(c, re.escape(c)) for c in out)
    below = "" if anchored else "(?:.*/)?"
    return f"^{re.escape(folder)}/{below}{out}{'/.*' if pattern.endswith('/') else '(?:/.*)?'}$"


def _without_ignored(files: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """Files that no rule hides; of several rules that mean a file the last counts."""
    hits = [F.when(F.col("path").rlike(ignore_regex(folder, pattern)), F.struct(F.lit(k).alias("at"), F.lit(hides).alias("hides"))) for k, (folder, pattern, hides) in enumerate(rules)]
    last = F.array_max(F.array_compact(F.array(*hits)))
    return files.where(~F.coalesce(last["hides"], F.lit(False)))


def inventory(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, digest) of the files that git lists below a folder, and of those that
    a walk finds where there is no repository."""
    try:
        listed = _git(root, "ls-files", "-co", "--exclude-standard").splitlines()
    except (subprocess.CalledProcessError, FileNotFoundError):
        return text_files(spark, root, ignore=ignore).select("path", "text", "digest")
    names = spark.createDataFrame([(os.path.join(os.path.realpath(root), n),) for n in listed], "name string")
    found = text_files(spark, os.path.realpath(root), ignore=ignore)
    plain = F.regexp_replace("path", r"^file:/*", "/")
    return found.join(names, plain == F.col("name"), "left_semi").select("path", "text", "digest")


def git_ignored(paths: list[str], patterns: list[str]) -> set[str]:
    """Paths that gitignore-like patterns leave out; `!` takes back, later ones win."""
    out = set()
    for p in paths:
        hidden = False
        for pattern in patterns:
            take, glob = not pattern.startswith("!"), pattern.lstrip("!").rstrip("/")
            parts = p.split("/")
            tails = ["/".join(parts[: k + 1]) for k in range(len(parts))]
            hit = any(fnmatch.fnmatch(t, glob.lstrip("/")) for t in tails) if "/" in glob.strip("/") else any(fnmatch.fnmatch(x, glob) for x in parts)
            hidden = take if hit else hidden
        if hidden:
            out.add(p)
    return out


def projects(files: DataFrame) -> DataFrame:
    """(root, kind) of project folders by marker files."""
    table = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    name, root = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.select(root.alias("root"), F.element_at(table, name).alias("kind")).where("kind is not null").distinct()


def cargo_dependencies(manifests: DataFrame, text: str = "text") -> DataFrame:
    """(path, dependency) from the dependency tables of Cargo manifests, by lines."""
    section = F.regexp_extract_all(text, F.lit(r"(?ms)^\[(?:workspace\.)?(?:dev-|build-)?dependencies\]\s*\n(.*?)(?=^\[|\z)"), F.lit(1))
    names = F.flatten(F.transform(section, lambda s: F.regexp_extract_all(s, F.lit(r"(?m)^([A-Za-z0-9_-]+)(?:\.[a-z]+)?\s*="), F.lit(1))))
    return manifests.select("path", F.explode(F.array_distinct(names)).alias("dependency"))


def rule_files(paths: list[str]) -> list[dict]:
    """Rules of YAML or JSON files; needs PyYAML for YAML."""
    import json

    out = []
    for p in paths:
        with open(p, encoding="utf-8") as f:
            if p.endswith(".json"):
                out.append(json.load(f))
            else:
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("YAML rules need PyYAML") from e
                out.append(yaml.safe_load(f))
    for r in out:
        missing = {"id", "category", "severity"} - set(r)
        if missing:
            raise ValueError(f"a rule lacks {sorted(missing)}")
    return out


def table(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A relational table over JDBC, or Parquet where url is a folder."""
    if url.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    return spark.read.parquet(f"{url.rstrip('/')}/{name}.parquet")


def write_table(rows: DataFrame, url: str, name: str, mode: str = "append", **options) -> None:
    """Rows to a relational table over JDBC, or to Parquet where url is a folder."""
    if url.startswith("jdbc:"):
        rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()
    else:
        rows.write.mode(mode).parquet(f"{url.rstrip('/')}/{name}.parquet")


# --- git: listing on the driver (metadata of one repository), contents as rows ----
def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout


def git_files(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    names = _git(root, "ls-tree", "-r", "--name-only", ref).splitlines()
    return spark.createDataFrame([(n,) for n in names], "path string")


def git_blobs(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """(path, text, is_binary) of a tree's files as they stand in a ref; text is null for
    files that hold a zero byte or aren't UTF-8. Files are read by the tasks, from a
    repository that they can reach."""
    names = git_files(spark, root, ref)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                data = subprocess.run(["git", "-C", root, "show", f"{ref}:{path}"], check=True, capture_output=True).stdout
                try:
                    text = None if b"\0" in data else data.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                rows.append((path, text, text is None))
            yield pd.DataFrame(rows, columns=["path", "text", "is_binary"])

    return names.mapInPandas(run, "path string, text string, is_binary boolean")


def git_commits(spark: SparkSession, root: str, ref: str = "HEAD", limit: int = 100) -> DataFrame:
    rows = [x.split("\x1f") for x in _git(root, "log", f"-{limit}", "--format=%H%x1f%an%x1f%at%x1f%s", ref).splitlines()]
    return spark.createDataFrame([(h, a, int(t), s) for h, a, t, s in rows], "hash string, author string, time long, subject string")


def git_branches(spark: SparkSession, root: str) -> DataFrame:
    head = _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    rows = [x.split("\x1f") for x in _git(root, "for-each-ref", "--format=%(refname:short)%1f%(objectname)%1f%(upstream:short)", "refs/heads").splitlines()]
    return spark.createDataFrame([(n, h, u or None, n == head) for n, h, u in rows], "name string, hash string, upstream string, is_default boolean")


def git_diff(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """(path, status, additions, deletions) between two refs."""
    status = dict(x.split("\t")[::-1] for x in _git(root, "diff", "--name-status", "--no-renames", base, head).splitlines())
    rows = []
    for line in _git(root, "diff", "--numstat", "--no-renames", base, head).splitlines():
        a, d, p = line.split("\t")
        rows.append((p, status[p], int(a) if a != "-" else 0, int(d) if d != "-" else 0))
    return spark.createDataFrame(rows, "path string, status string, additions long, deletions long")


def git_repositories(root: str, depth: int = 3) -> list[str]:
    out = []
    for folder, names, _ in os.walk(root):
        if ".git" in names:
            out.append(folder)
            names.remove(".git")
        if os.path.relpath(folder, root).count(os.sep) + (folder != root) >= depth:
            names.clear()
    return sorted(out)


def git_submodules(root: str, depth: int = 3) -> list[tuple[str, int]]:
    """(path, depth) of submodules, breadth first."""
    queue, out = [(root, 0)], []
    while queue:
        at, d = queue.pop(0)
        listing = os.path.join(at, ".gitmodules")
        if d < depth and os.path.exists(listing):
            for line in _git(at, "config", "-f", ".gitmodules", "--get-regexp", r"\.path$").splitlines():
                sub = os.path.join(at, line.split(" ", 1)[1])
                out.append((sub, d + 1))
                queue.append((sub, d + 1))
    return out
