"""Entities, sessions and their events: append-only tables of which the latest row counts.

A change is a new row, so writes never rewrite what is there, and a failed write leaves
nothing behind (Spark commits its files at the end). Reads keep the latest row of each
entity. Every read and write names the organisation it is for."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, memory

RESOURCES = (
    "org", "user", "team", "team_member", "api_key", "project", "phase", "issue", "dependency", "decision", "repository", "branch", "worktree", "assignment",
    "plan", "plan_version", "plan_review", "issue_comment", "issue_label", "label_assignment", "session", "summary",
)
_VERSIONS = "org_id string, id string, data string, created_at long, updated_at long, version long, deleted boolean, resource string"
_EVENTS = "id string, session_id string, project_id string, name string, success boolean, duration_ms long, data string, created_at long, kind string"
SESSION_LIMIT = 100


class Entities:
    """Tables below `root`: entities (by resource) and events (by kind)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    # --- entities ----------------------------------------------------------------
    def _latest(self, resource: str, org_id: str) -> DataFrame:
        if resource not in RESOURCES:
            raise ValueError(f"unknown resource: {resource}; there are {sorted(RESOURCES)}")
        rows = self._table("entities", _VERSIONS).where((F.col("resource") == resource) & (F.col("org_id") == org_id))
        return memory.latest_per(rows, ["id"], "version", "updated_at").where("not deleted")

    def _append(self, resource: str, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _VERSIONS).coalesce(1).write.mode("append").partitionBy("resource").parquet(f"{self.root}/entities")

    def create(self, resource: str, org_id: str, data: dict, id: str | None = None, now: int | None = None) -> str:
        """The new entity's id; one that exists is a ValueError."""
        id, now = id or uuid.uuid4().hex, int(time.time()) if now is None else now
        if not self._latest(resource, org_id).where(F.col("id") == id).isEmpty():
            raise ValueError(f"{resource} {id} exists")
        self._append(resource, [(org_id, id, json.dumps(data), now, now, time.time_ns(), False, resource)])
        return id

    def _found(self, resource: str, org_id: str, id: str):
        row = self._latest(resource, org_id).where(F.col("id") == id).first()
        if row is None:
            raise KeyError(f"no {resource} {id} in {org_id}")
        return row

    def get(self, resource: str, org_id: str, id: str) -> dict:
        """Its fields; a KeyError if there is none in this organisation."""
        row = self._found(resource, org_id, id)
        return json.loads(row["data"]) | {"id": id, "created_at": row["created_at"], "updated_at": row["updated_at"]}

    def list(self, resource: str, org_id: str, limit: int = 100, **equal) -> DataFrame:
        """(id, data, created_at, updated_at) by equalities of fields, the last updated first."""
        rows = self._latest(resource, org_id)
        for name, value in equal.items():
            if value is not None:
                rows = rows.where(F.get_json_object("data", f"$.{name}") == (value if isinstance(value, str) else json.dumps(value)))
        return memory.newest(rows.select("id", "data", "created_at", "updated_at"), "updated_at", "id", limit)

    def update(self, resource: str, org_id: str, id: str, changes: dict, now: int | None = None) -> dict:
        row = self._found(resource, org_id, id)
        data, now = json.loads(row["data"]) | changes, int(time.time()) if now is None else now
        self._append(resource, [(org_id, id, json.dumps(data), row["created_at"], now, time.time_ns(), False, resource)])
        return data

    def delete(self, resource: str, org_id: str, id: str, now: int | None = None) -> None:
        row, now = self._found(resource, org_id, id), int(time.time()) if now is None else now
        self._append(resource, [(org_id, id, row["data"], row["created_at"], now, time.time_ns(), True, resource)])

    def dependencies(self, org_id: str, issue: str, depth: int = 3) -> DataFrame:
        """(src, dst, depth): what an issue depends on, step by step."""
        rows = self._latest("dependency", org_id)
        edges = rows.select(F.get_json_object("data", "$.from_issue").alias("src"), F.get_json_object("data", "$.to_issue").alias("dst"))
        return graph.walk(edges, self.spark.createDataFrame([(issue,)], "node string"), depth)

    # --- sessions ------------------------------------------------------------------
    def start_session(self, org_id: str, agent_type: str, id: str | None = None, now: int | None = None, **fields) -> str:
        return self.create("session", org_id, {"agent_type": agent_type, "status": "active"} | fields, id, now)

    def list_sessions(self, org_id: str, limit: int = SESSION_LIMIT, **equal) -> DataFrame:
        """By up to six equalities (agent_type, status, project_id, parent_session_id,
        worktree_id, model), the last started first."""
        wrong = set(equal) - {"agent_type", "status", "project_id", "parent_session_id", "worktree_id", "model"}
        if wrong:
            raise ValueError(f"unknown fields: {sorted(wrong)}")
        rows = self.list("session", org_id, 1 << 30, **equal)
        return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)

    def summarize_session(self, org_id: str, session: str, summary: dict | None = None, now: int | None = None) -> dict:
        """Store a summary (the latest counts) if one is given; the session's summary."""
        if summary is not None:
            self._found("session", org_id, session)
            fresh = self._latest("summary", org_id).where(F.col("id") == session).isEmpty()
            (self.create("summary", org_id, summary, session, now) if fresh else self.update("summary", org_id, session, summary, now))
        return self.get("summary", org_id, session)

    # --- events --------------------------------------------------------------------
    def _event(self, kind: str, org_id: str, session: str, name: str, success: bool, duration_ms: int, data: dict, now: int | None) -> str:
        """Append an event with its session's project; a session that isn't known is made."""
        now = int(time.time()) if now is None else now
        if self._latest("session", org_id).where(F.col("id") == session).isEmpty():
            self.start_session(org_id, "unknown", session, now)
        id = uuid.uuid4().hex
        row = self.spark.createDataFrame([(id, session, name, success, duration_ms, json.dumps(data), now, kind)], "id string, session_id string, name string, success boolean, duration_ms long, data string, created_at long, kind string")
        of = self._latest("session", org_id).select(F.col("id").alias("session_id"), F.get_json_object("data", "$.project_id").alias("project_id"))
        row = row.join(of, "session_id", "left").select(*[c.split()[0] for c in _EVENTS.split(", ")])
        row.coalesce(1).write.mode("append").partitionBy("kind").parquet(f"{self.root}/events")
        return id

    def log_tool_call(self, org_id: str, session: str, tool: str, success: bool = True, duration_ms: int = 0, params: dict | None = None, now: int | None = None) -> str:
        return self._event("tool_call", org_id, session, tool, success, duration_ms, params or {}, now)

    def log_delegation(self, org_id: str, parent: str, child: str, prompt: str, success: bool = True, duration_ms: int = 0, now: int | None = None) -> str:
        return self._event("delegation", org_id, parent, child, success, duration_ms, {"prompt": prompt}, now)

    def log_checkpoint(self, org_id: str, session: str, description: str, snapshot: dict, now: int | None = None) -> str:
        return self._event("checkpoint", org_id, session, description, True, 0, snapshot, now)

    def events(self, kind: str | None = None) -> DataFrame:
        rows = self._table("events", _EVENTS)
        return rows if kind is None else rows.where(F.col("kind") == kind)
