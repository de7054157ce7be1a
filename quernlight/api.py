"""The engine's calls, over tables in one folder: index, search, remember, validate, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .entities import Entities
from .functions import embed as E
from .functions import scalar as S
from .operators import aggregates, checks, chunkers, code, memory, search
from .sources import files as FS
from .sources.store import Collections, chunk_rows


class Engine:
    """Tables are Parquet below `root`: vectors, files, observations, calls."""

    def __init__(self, spark: SparkSession, root: str, dim: int = 384, provider: str = "hashing"):
        self.spark, self.root, self.dim, self.provider = spark, root.rstrip("/"), dim, provider
        self.vectors = Collections(spark, f"{self.root}/vectors")
        self.entities = Entities(spark, self.root)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    # --- code ------------------------------------------------------------------
    def index_repo(self, path: str, collection: str, ignore: tuple[str, ...] = ()) -> dict[str, int]:
        """Chunk and embed changed files; chunks of changed and deleted files are replaced."""
        schema = "collection string, path string, digest string, deleted_at long"
        stored = self._read("files", schema).where(F.col("collection") == collection)
        found = FS.text_files(self.spark, path, ignore=ignore).withColumn("collection", F.lit(collection))
        changes = materialise(memory.file_changes(found, stored, ["collection", "path"], "digest"))
        todo = changes.where("status in ('new', 'changed')").select("path")
        rows = found.join(todo, "path", "left_semi")
        chunks = chunkers.code_chunks(rows.select("path", "text")).join(rows.select("path", "language"), "path")
        chunks = chunks.select(F.sha2(F.concat_ws(":", "path", "start_line", "end_line", "kind"), 256).alias("id"), "content", F.col("path").alias("file_path"), "start_line", "end_line", "language")
        fresh = materialise(chunk_rows(chunks, E.embed(F.col("content"), self.dim, self.provider)))
        gone = changes.where("status in ('changed', 'deleted')").select(F.col("path").alias("file_path"))
        if self.vectors.exists(collection):
            old = self.vectors.read(collection).join(gone, "file_path", "left_semi").select("id")
            self.vectors.delete(collection, materialise(old))
        self.vectors.insert(fresh, collection)
        state = found.select("collection", "path", "digest", F.lit(None).cast("long").alias("deleted_at"))
        rest = self._read("files", schema).where(F.col("collection") != collection)
        materialise(rest.unionByName(state)).write.mode("overwrite").parquet(f"{self.root}/files")
        return {r["status"]: r["n"] for r in aggregates.counts_by(changes, "status").collect()}

    def index_status(self, collection: str) -> dict:
        """Files that are indexed, vectors, and files by language."""
        files = self._read("files", "collection string, path string, digest string, deleted_at long").where((F.col("collection") == collection) & F.col("deleted_at").isNull())
        vectors = self.vectors.read(collection) if self.vectors.exists(collection) else None
        by = {} if vectors is None else {r["language"]: r["n"] for r in vectors.groupBy("language").agg(F.countDistinct("file_path").alias("n")).collect()}
        return {"files": files.count(), "vectors": 0 if vectors is None else vectors.count(), "languages": by}

    def clear_index(self, collection: str) -> None:
        self.vectors.drop(collection)
        rest = materialise(self._read("files", "collection string, path string, digest string, deleted_at long").where(F.col("collection") != collection))
        rest.write.mode("overwrite").parquet(f"{self.root}/files")

    def search_code(self, query: str, collection: str, limit: int = 10, **filters) -> DataFrame:
        """Hybrid ranking of chunks: (id, file_path, start_line, content, language, score)."""
        if not query.strip():
            raise ValueError("the query is empty")
        chunks = self.vectors.read(collection)
        q = self.spark.createDataFrame([(0, [float(x) for x in E.PROVIDERS[self.provider]([query], self.dim)[0]])], "query int, q array<float>")
        semantic = chunks.crossJoin(F.broadcast(q)).select("id", search.cosine(F.col("vector"), F.col("q")).alias("score"))
        semantic = semantic.select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        ranked = search.hybrid(semantic, search.bm25(chunks, "id", "content", query), "id")
        hits = ranked.join(chunks.select("id", "file_path", "start_line", "content", "language"), "id")
        return search.top_k(search.post_filter(hits, **filters), limit, "score", "id")

    def validate_code(self, path: str, names: list[str] | None = None, file: str | None = None, severities: list[str] | None = None) -> DataFrame:
        files = FS.text_files(self.spark, path, (*S.LANGUAGES, "toml", "yml", "yaml")).select("path", "text")
        return checks.report_of(checks.run(files, names), file, severities)

    def analyze_code(self, path: str) -> DataFrame:
        return code.complexity_report(FS.text_files(self.spark, path), "text")

    @staticmethod
    def list_rules() -> list[str]:
        return checks.rule_ids()

    # --- memory ----------------------------------------------------------------
    _OBSERVATIONS = "id string, project_id string, content string, content_hash string, tags array<string>, kind string, metadata string, created_at long"

    def store_memory(self, rows: DataFrame) -> int:
        fresh = memory.store(self._read("observations", self._OBSERVATIONS), rows, "content", "id", "project_id")
        fresh = materialise(fresh.select(*[x.split(" ")[0] for x in self._OBSERVATIONS.split(", ")]))
        fresh.write.mode("append").parquet(f"{self.root}/observations")
        return fresh.count()

    def list_memories(self, limit: int = 10, tags: list[str] = (), start=None, end=None, **equal) -> DataFrame:
        rows = self._read("observations", self._OBSERVATIONS)
        rows = rows.where(memory.equalities(**equal) & memory.has_all_tags("tags", list(tags)) & memory.time_range("created_at", start, end))
        return memory.newest(rows, "created_at", "id", limit)

    def get_memories(self, ids: list[str]) -> DataFrame:
        """Observations by id, in the order of the ids."""
        place = self.spark.createDataFrame(list(enumerate(ids)), "place int, id string")
        return self._read("observations", self._OBSERVATIONS).join(place, "id").orderBy("place").drop("place")

    def session_start_context(self, project_id: str, query: str = "") -> DataFrame:
        """What a new session is given: the best memories for its query, or the newest."""
        return self.search_memory(query, memory.CONTEXT_LIMIT, project_id=project_id)

    def search_memory(self, query: str, limit: int = 10, tags: list[str] = (), **equal) -> DataFrame:
        """Filters first, then the fusion of a lexical and a vector ranking; a blank query gives the newest."""
        if not query.strip():
            return self.list_memories(limit, tags, **equal)
        rows = self._read("observations", self._OBSERVATIONS).where(memory.equalities(**equal) & memory.has_all_tags("tags", list(tags)))
        q = self.spark.createDataFrame([([float(x) for x in E.PROVIDERS[self.provider]([query], self.dim)[0]],)], "q array<float>")
        near = rows.select("id", E.embed(F.col("content"), self.dim, self.provider).alias("v")).crossJoin(F.broadcast(q))
        near = near.select("id", F.coalesce(search.cosine(F.col("v"), F.col("q")), F.lit(0.0)).alias("score"))
        lexical = search.ranked(search.bm25(rows, "id", "content", query), "bm25", "id", 3 * limit)
        fused = search.fuse([lexical, search.ranked(near, "score", "id", 3 * limit)], "id")
        return search.top_k(fused.join(rows, "id"), limit, "score", "id").withColumn("preview", S.preview(F.col("content")))

    def memory_timeline(self, anchor: str, before: int = 5, after: int = 5) -> DataFrame:
        return memory.timeline(self._read("observations", self._OBSERVATIONS), anchor, before, after, "created_at", "id")

    def inject_context(self, tokens: int = 2000) -> DataFrame:
        return memory.within_budget(self._read("observations", self._OBSERVATIONS), "content", 4 * tokens, "created_at", "id")

    # --- entities, sessions, agents ----------------------------------------------
    def entity(self, action: str, resource: str, org_id: str, id: str | None = None, data: dict | None = None, **equal):
        """One call for all resources: create, get, list, update, delete."""
        calls = {
            "create": lambda: self.entities.create(resource, org_id, data or {}, id), "get": lambda: self.entities.get(resource, org_id, id or ""),
            "list": lambda: self.entities.list(resource, org_id, **equal), "update": lambda: self.entities.update(resource, org_id, id or "", data or {}),
            "delete": lambda: self.entities.delete(resource, org_id, id or ""),
        }
        if action not in calls:
            raise ValueError(f"unknown action: {action}")
        return calls[action]()

    def project(self, action: str, resource: str, org_id: str, project_id: str, id: str | None = None, data: dict | None = None, **equal):
        """entity() within one project; `dependencies` of an issue besides."""
        if resource not in ("project", "phase", "issue", "dependency", "decision"):
            raise ValueError(f"not of a project: {resource}")
        if action == "dependencies":
            return self.entities.dependencies(org_id, id or "", **equal)
        if resource != "project":
            data, equal = (data or {}) | {"project_id": project_id}, equal | {"project_id": project_id}
        return self.entity(action, resource, org_id, id or (project_id if resource == "project" else None), data, **equal)

    def start_session(self, org_id: str, agent_type: str, **fields) -> str:
        return self.entities.start_session(org_id, agent_type, **fields)

    def get_session(self, org_id: str, session: str) -> dict:
        return self.entities.get("session", org_id, session)

    def list_sessions(self, org_id: str, **equal) -> DataFrame:
        return self.entities.list_sessions(org_id, **equal)

    def summarize_session(self, org_id: str, session: str, summary: dict | None = None) -> dict:
        return self.entities.summarize_session(org_id, session, summary)

    def log_tool_call(self, org_id: str, session: str, tool: str, **more) -> str:
        return self.entities.log_tool_call(org_id, session, tool, **more)

    def log_delegation(self, org_id: str, parent: str, child: str, prompt: str, **more) -> str:
        return self.entities.log_delegation(org_id, parent, child, prompt, **more)

    # --- version control ---------------------------------------------------------
    def list_repos(self, path: str, depth: int = 3) -> DataFrame:
        """(path, branches, files, commits) of the repositories below a folder."""
        rows = []
        for root in FS.git_repositories(path, depth):
            rows.append((root, FS.git_branches(self.spark, root).count(), FS.git_files(self.spark, root).count(), FS.git_commits(self.spark, root, limit=1 << 30).count()))
        return self.spark.createDataFrame(rows, "path string, branches long, files long, commits long")

    def compare_branches(self, path: str, base: str, head: str) -> DataFrame:
        return FS.git_diff(self.spark, path, base, head)

    def analyze_impact(self, path: str, base: str, head: str) -> DataFrame:
        by = FS.git_diff(self.spark, path, base, head).agg(
            F.count("*").alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("changes"),
            *[F.count_if(F.col("status") == s).alias(n) for s, n in (("A", "added"), ("M", "modified"), ("D", "deleted"))],
        )
        return by.withColumn("impact", S.impact(F.col("files"), F.coalesce("changes", F.lit(0))))

    def search_branch(self, path: str, needle: str, limit: int = 50) -> DataFrame:
        return code.matching_lines(FS.text_files(self.spark, path), "path", "text", needle, limit)
