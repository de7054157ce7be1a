import math
import subprocess
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernlight.functions import embed as E
from quernlight.functions import scalar as S
from quernlight.operators import checks, chunkers, code, graph, rules, search, syntax
from quernlight.sources import files as FS
from quernlight.sources.store import Collections, annotations, chunk_rows, decrypt_metadata, encrypt_metadata
from quernlight.streaming import events as ev

RUST = '''pub struct Wide {
    a: u8, 
    b: u8,
    c: u8,
    d: u8,
    e: u8,
    f: u8,
    g: u8,
    h: u8,
}
// TODO: later
pub fn many(a: u8, b: u8, c: u8, d: u8, e: u8, f: u8) -> u8 {
    let x = foo().unwrap();
    for i in 0..3 {
        let y = x.clone();
    }
    if a > 1 && b > 2 || c > 3 { panic!("no") }
    match s {
        "a" => 1,
        "b" => 2,
        "c" => 3,
        _ => {}
    }
}
fn empty() {}
fn BadName() { self.inner.call() }
#[cfg(test)]
mod tests {
    #[ignore]
    fn t1() { x.unwrap(); }
}
'''


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("src/a.rs", RUST), ("src/lib.rs", "//! docs\n" + "let x = 1;\n" * 600), ("conf/a.toml", 'password = "hunter22"\n'), ("src/b.rs", None)], "path string, text string")


def test_checks(sources):
    found = {(r.path, r.line_no, r.rule) for r in checks.run(sources).collect()}
    a = "src/a.rs"
    want = {(a, 1, "KISS001"), (a, 11, "QUAL005"), (a, 12, "KISS002"), (a, 13, "QUAL001"), (a, 14, "PERF001"), (a, 17, "QUAL003"), (a, 18, "SOLID008"), (a, 22, "IMPL006"),
            (a, 25, "IMPL001"), (a, 26, "NAME002"), (a, 26, "IMPL003"), (a, 12, "DOC002"), (a, 0, "REF003"), ("src/lib.rs", 0, "QUAL004"), ("conf/a.toml", 1, "CFG001")}
    assert want <= found
    assert (a, 30, "QUAL001") not in found
    with pytest.raises(ValueError):
        checks.run(sources, ["nothing"])
    facts = {(r.kind, r.name) for r in checks.facts(sources).collect()}
    assert ("function", "many") in facts and ("struct", "Wide") in facts and ("module", "module::a") in facts
    lines = [r.line for r in annotations(checks.run(sources, ["files"])).collect()]
    assert any(x.startswith("::warning file=src/lib.rs,line=0::[QUAL004]") for x in lines)


def test_complexity_and_dead_code(sources):
    bodies = code.function_bodies(sources, "path", "text").select("name", S.cyclomatic(F.col("body")).alias("c"))
    assert {r.name: r.c for r in bodies.collect()}["many"] == 1 + 5
    heads, counts = code.functions(sources, "path", "text"), code.identifier_counts(sources, "path", "text")
    dead = code.dead_functions(heads, counts, "path")
    assert "empty" in {r.name for r in dead.collect()}
    sizes = sources.where("text is not null").select("path", S.sloc(F.col("text"), True).alias("sloc"))
    full = code.function_bodies(sources, "path", "text").select("path", S.cyclomatic(F.col("body")).alias("cyclomatic"))
    tdg = {r.path: r.tdg for r in code.technical_debt(sizes, full, dead, "path", 0).collect()}
    assert tdg["src/a.rs"] == 2 * 6 + 10 * dead.where("path = 'src/a.rs'").count() and tdg["src/lib.rs"] == 30
    spans = sources.sparkSession.createDataFrame([("a", 0, 10, 5), ("a", 5, 12, 9), ("a", 12, 20, 1)], "g string, s int, e int, score int")
    kept = code.without_overlaps(spans, ["g"], "s", "e", F.col("score").desc(), F.col("s"))
    assert {(r.s, r.e) for r in kept.collect()} == {(5, 12), (12, 20)}


def test_worked_examples(spark):
    docs = spark.createDataFrame([("d1", "authenticate the user and validate their credentials for secure access"), ("d2", "process the data and compress it for efficient storage optimization")], "id string, text string")
    rows = {r.id: r.bm25 for r in search.bm25(docs, "id", "text", "authenticate user validate credentials").collect()}
    assert rows == {"d1": pytest.approx(2.714150, abs=1e-6)}
    semantic = spark.createDataFrame([("d1", 0.70), ("d2", 0.75)], "id string, score double")
    h = {r.id: r.score for r in search.hybrid(semantic, search.bm25(docs, "id", "text", "authenticate user validate credentials"), "id").collect()}
    assert h["d1"] == pytest.approx(0.795143, abs=1e-6) and h["d2"] == pytest.approx(0.45)
    lex = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id string, rank int")
    vec = spark.createDataFrame([("B", 1), ("D", 2)], "id string, rank int")
    f = {r.id: round(r.score, 6) for r in search.fuse([lex, vec], "id").collect()}
    assert f == {"B": 0.991935, "A": 0.5, "D": 0.491935, "C": 0.484127}
    one = spark.range(1).select(
        S.l2_score(F.lit(4.0)).alias("a"), S.impact(F.lit(3), F.lit(40)).alias("b"), S.maintainability(F.lit(100), F.lit(5.0)).alias("c"),
        S.debt_gradient(F.lit(7), F.lit(1), F.lit(450)).alias("d"), S.uuid5(F.lit("x")).alias("u"), S.mask_id(F.lit("abcdefghij")).alias("m"),
        S.names_related(F.lit("UserService"), F.lit("user_store")).alias("n"), S.language_of(F.lit("a/B.RS")).alias("l"), S.relative_path(F.lit("C:\\w\\a.rs"), "C:/w").alias("p"),
    ).first()
    assert one.a == pytest.approx(1 / 3) and one.b == pytest.approx(32.430804, abs=1e-6) and one.c == pytest.approx(50.805360, abs=1e-6) and one.d == 44
    assert one.u == str(uuid.uuid5(uuid.NAMESPACE_OID, "x")) and one.m == "abcdefgh..." and one.n and one.l == "rust" and one.p == "a.rs"


def test_rules(spark, sources):
    with pytest.raises(ValueError):
        rules.expression("file_count > 1; drop")
    with pytest.raises(ValueError):
        rules.expression("secret > 1")
    assert rules.facts(sources, "text").where(rules.expression("has_unwrap && (file_count >= 4 || has_async)")).count() == 1
    state, fired = rules.forward_chain({"n": 3}, [{"name": "a", "when": [("n", ">", 2)], "then": {"big": True}}, {"name": "b", "when": [("big", "==", True)], "then": {"done": 1}}])
    assert fired == ["a", "b"] and state["done"] == 1
    merged = rules.merge_rule({"id": "X", "extends": "t", "variables": {"what": "unwrap"}}, {"t": {"severity": "ERROR", "patterns": ["\\.{{what}}"]}})
    assert merged == {"severity": "ERROR", "patterns": ["\\.unwrap"], "id": "X"} and rules.route(merged) == "regex"
    assert rules.route({"engine": "ast"}) == "ast" and rules.route({"files": ["*"]}) == "path"
    out = spark.createDataFrame([('[{"code":"F401","message":"unused","filename":"a.py","location":{"row":3}}]',)], "raw string")
    assert rules.lint_rows(out, "raw", "ruff").first()[:] == ("a.py", 3, "F401", "unused")
    assert S.glob_to_regex("**/*.rs") and [p for p in ("a/b.rs", "b.rs", "b.rsx") if __import__("re").match(S.glob_to_regex("**/*.rs"), p)] == ["a/b.rs", "b.rs"]


def test_files_and_git(spark, tmp_path):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "target").mkdir()
    (root / "src/a.rs").write_text("fn main() {}\n")
    (root / "src/b.PY").write_text("def f(x):\n    return x + 1  # long enough\n")
    (root / "target/c.rs").write_text("x")
    (root / "Cargo.toml").write_text('[package]\nname = "x"\n[dependencies]\nserde = "1"\ntokio.workspace = true\n[dev-dependencies]\nrstest = "1"\n')
    found = FS.text_files(spark, str(root), ignore=("*.toml",))
    assert sorted((r.path.rsplit("/", 1)[1], r.language) for r in found.collect()) == [("a.rs", "rust"), ("b.PY", "python")]
    manifests = FS.text_files(spark, str(root), extensions=("toml",))
    assert sorted(r.dependency for r in FS.cargo_dependencies(manifests).collect()) == ["rstest", "serde", "tokio"]
    assert [r.kind for r in FS.projects(manifests).collect()] == ["cargo"]
    assert chunkers.code_chunks(found.where("language = 'python'")).first().name == "f"
    assert FS.git_ignored(["a/x.log", "b.txt", "keep.log"], ["*.log", "!keep.log"]) == {"a/x.log"}
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "src/a.rs").write_text("fn main() {}\nfn two() {}\n")
    git("commit", "-qam", "two")
    assert FS.git_commits(spark, str(root)).select("subject").first().subject == "two"
    assert FS.git_diff(spark, str(root), "HEAD~1", "HEAD").first()[:] == ("src/a.rs", "M", 1, 0)
    assert FS.git_branches(spark, str(root)).first().is_default and FS.git_repositories(str(tmp_path)) == [str(root)]
    assert FS.git_files(spark, str(root)).count() == 4


def test_gitignore(spark, tmp_path):
    """Ignore rules of every folder, in and out of a repository; blobs, modules within, tables and rule files."""
    root = tmp_path / "r"
    (root / "src/deep").mkdir(parents=True)
    (root / "out").mkdir()
    for name in ("src/a.rs", "src/gen.rs", "src/keep_gen.rs", "src/deep/b.rs", "src/deep/c.rs", "out/d.rs", "top.rs"):
        (root / name).write_text("fn f() {}\n")
    (root / ".gitignore").write_text("# rules\n*gen.rs\n!keep_gen.rs\nout/\n/top.rs\n")
    (root / "src/deep/.gitignore").write_text("c.rs\n")
    names = lambda df: sorted(r.path.split("/r/", 1)[1] for r in df.collect())
    assert names(FS.text_files(spark, str(root))) == ["src/a.rs", "src/deep/b.rs", "src/keep_gen.rs"]
    assert names(FS.inventory(spark, str(root))) == ["src/a.rs", "src/deep/b.rs", "src/keep_gen.rs"]
    git = lambda at, *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", "-c", "protocol.file.allow=always", *a], check=True, capture_output=True)
    (root / "blob.bin").write_bytes(b"a\0b")
    git(root, "init", "-q", "-b", "main")
    git(root, "add", ".")
    git(root, "commit", "-qm", "one")
    assert names(FS.inventory(spark, str(root))) == ["src/a.rs", "src/deep/b.rs", "src/keep_gen.rs"]
    blobs = {r.path: (r.text, r.is_binary) for r in FS.git_blobs(spark, str(root)).collect()}
    assert blobs["blob.bin"] == (None, True) and blobs["src/a.rs"] == ("fn f() {}\n", False) and "out/d.rs" not in blobs
    outer = tmp_path / "outer"
    outer.mkdir()
    git(outer, "init", "-q", "-b", "main")
    git(outer, "submodule", "add", "-q", str(root), "inner")
    assert FS.git_submodules(str(outer)) == [(str(outer / "inner"), 1)] and FS.git_submodules(str(outer), 0) == []
    FS.write_table(spark.createDataFrame([(1, "a")], "k long, v string"), str(tmp_path), "t")
    FS.write_table(spark.createDataFrame([(2, "b")], "k long, v string"), str(tmp_path), "t")
    assert FS.table(spark, str(tmp_path), "t").count() == 2
    (tmp_path / "r1.json").write_text('{"id": "A", "category": "c", "severity": "ERROR"}')
    (tmp_path / "r2.json").write_text('{"id": "B"}')
    assert FS.rule_files([str(tmp_path / "r1.json")])[0]["id"] == "A"
    with pytest.raises(ValueError):
        FS.rule_files([str(tmp_path / "r2.json")])


def test_safe_deletes(spark, tmp_path):
    """Deleting all ids leaves an empty collection; one that ended half way comes back."""
    rows = spark.createDataFrame([("1", [1.0], "x")], "id string, vector array<float>, content string")
    c = Collections(spark, str(tmp_path / "v"))
    c.insert(rows, "one")
    c.delete("one", spark.createDataFrame([("1",)], "id string"))
    assert c.exists("one") and c.read("one").count() == 0
    c.insert(rows, "one")
    (tmp_path / "v/collection=one").rename(tmp_path / "v/.one.old")
    c.recover("one")
    assert c.read("one").count() == 1 and not (tmp_path / "v/.one.old").exists()


def test_store(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "hello world", "a.rs", 3, 9, "rust"), ("2", "other", "b.rs", 1, 2, "rust")], "id string, content string, file_path string, start_line int, end_line int, language string")
    rows = chunk_rows(chunks, E.embed(F.col("content")))
    c = Collections(spark, str(tmp_path / "v"))
    c.insert(rows, "one")
    assert c.exists("one") and not c.exists("two") and c.get("one", ["1"]).first().start_line == 3
    v = np.array(c.get("one", ["1"]).first().vector)
    assert len(v) == 384 and math.isclose(float(v @ v), 1, rel_tol=1e-5)
    c.delete("one", spark.createDataFrame([("1",)], "id string"))
    assert [r.id for r in c.read("one").collect()] == ["2"]
    secret = encrypt_metadata(rows, "0123456789abcdef")
    assert "end_line" not in secret.first().metadata
    assert decrypt_metadata(secret, "0123456789abcdef").select("id", "metadata").collect() == rows.select("id", "metadata").collect()
    with pytest.raises(ValueError):
        E.embed(F.col("content"), name="none")


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    assert {r.node: r.component for r in graph.strong_components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {r.root for r in graph.on_cycles(edges).collect()} == {1, 2, 3, 5}
    assert {(r.src, r.dst, r.depth) for r in graph.walk(edges, nodes.where("node = 1"), 2).collect()} == {(1, 2, 1), (2, 3, 2)}


def test_long_cycles(spark):
    """Cycles of any length, beside trees that lead in and out, against all pairs that reach each other."""
    import random

    rnd = random.Random(3)
    edges = [(k, k + 1) for k in range(1, 12)] + [(12, 1), (20, 1), (5, 21), (21, 22)] + [(rnd.randrange(30, 50), rnd.randrange(30, 50)) for _ in range(25)]
    reach = {a: {b for x, b in edges if x == a} for a in range(60)}
    for _ in range(60):
        reach = {a: to | {c for b in to for c in reach[b]} for a, to in reach.items()}
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r.root for r in graph.on_cycles(frame).collect()} == {a for a in reach if a in reach[a]}
    nodes = spark.createDataFrame([(k,) for k in range(60)], "node long")
    want = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in reach}
    assert {r.node: r.component for r in graph.strong_components(frame, nodes).collect()} == want


def test_workflow(spark):
    path = ["context_discovered", "start_planning", "nonsense", "start_execution", "error", "recover"]
    log = spark.createDataFrame([(1, k, t) for k, t in enumerate(path)] + [(2, 0, "start_planning")], "session_id long, at long, trigger string")
    got = {r.session_id: (r.state, r.transitions, r.refused) for r in ev.workflow(log).collect()}
    assert got == {1: ("ready", 5, 1), 2: ("initializing", 0, 1)}
    assert ev.step("completed", "error") is None


def test_streams(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ev.source(spark, str(tmp_path / "in"), table.schema)
    q = ev.windowed_counts(ev.topic(stream, "click", "view"), late="400 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = table.where("event_type in ('click', 'view')").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
    calls = stream.withColumn("project_id", F.when(F.col("user_id") % 2 == 0, F.lit("p")))
    for _ in range(2):
        ev.write_observations(calls, str(tmp_path / "obs"), str(tmp_path / "ck")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "obs"))
    expected = ev.observations_of_calls(table.withColumn("project_id", F.when(F.col("user_id") % 2 == 0, F.lit("p"))))
    assert stored.count() == stored.select("content_hash").distinct().count() == expected.select("content_hash").distinct().count()


def test_workflow_stream(spark, tmp_path):
    """States go on from batch to batch, as over the whole log."""
    rows = [(1, 0, "context_discovered"), (2, 0, "error"), (1, 1, "start_planning"), (1, 2, "nonsense"), (2, 1, "recover"), (1, 3, "start_execution")]
    schema = "session_id long, at long, trigger string"
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}

    def keep(df, _):
        got.update({r.session_id: (r.state, r.transitions, r.refused) for r in df.collect()})

    q = ev.workflow_stream(log).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {r.session_id: (r.state, r.transitions, r.refused) for r in ev.workflow(spark.createDataFrame(rows, schema)).collect()}


def test_jobs(spark):
    assert ev.jobs(spark, "counting", lambda: spark.range(1000).repartition(4).count()) == 1000
    done, known = ev.job_progress(spark, "counting")
    assert done == known > 0 and ev.job_progress(spark, "nothing") == (0, 0)


def test_event_sessions_stream(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ev.sessions(ev.source(spark, str(tmp_path / "in"), table.schema), late="400 days").writeStream.format("memory").queryName("ended").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    w = F.session_window(F.col("ts").cast("timestamp"), "30 minutes")
    want = spark.read.parquet(str(tmp_path / "in")).groupBy(w.alias("w"), "user_id").count().select("user_id", "w.start", "w.end", "count")
    assert sorted(map(tuple, spark.table("ended").collect())) == sorted(map(tuple, want.collect()))


def test_clone_pairs(spark):
    """Rows that share a window which a smaller row holds too are a pair; so are places of one row that don't overlap."""
    w, v = [" ".join(f"{c}{k}" for k in range(6)) for c in "wv"]
    files = spark.createDataFrame([(1, w), (2, f"x {w} y"), (3, f"{w} z {v} q {v}"), (4, "a a a a a a a")], "k long, t string")
    held = code.clone_members(files, "k", "t", 6)
    assert {tuple(r) for r in held.collect()} == {(1, 0, 1, 0), (1, 0, 2, 1), (1, 0, 3, 0), (3, 7, 3, 7), (3, 7, 3, 14), (4, 0, 4, 0), (4, 0, 4, 1)}
    pairs = sorted(tuple(r) for r in code.clone_pairs(held, "k", 6).collect())
    assert pairs == [(1, 0, 2, 1), (1, 0, 3, 0), (2, 1, 3, 0), (3, 7, 3, 14)]
    text = [(1, "let a = f(1);"), (2, "let b = g(2);"), (3, "let c = h(3);")]
    kinds = syntax.clone_kind_members(spark.createDataFrame(text, "k long, t string"), "k", "t", 6)
    assert {(r.kind, r.k) for r in kinds.collect()} == {("renamed", 1), ("renamed", 2), ("renamed", 3)}
