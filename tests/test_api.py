import pytest
from pyspark.sql import functions as F

from quernlight.api import Engine
from quernlight.operators import search, syntax


def test_engine(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "auth.py").write_text("def authenticate(user, credentials):\n    return validate(user, credentials)\n" * 3)
    (src / "data.rs").write_text("fn compress_data() { storage.optimize().unwrap(); }\n" * 3)
    e = Engine(spark, str(tmp_path / "db"))
    assert e.index_repo(str(src), "c") == {"new": 2}
    assert e.search_code("authenticate user credentials", "c").first().file_path.endswith("auth.py")
    assert e.search_code("unwrap", "c", languages=["rust"]).count() == 1
    with pytest.raises(ValueError):
        e.search_code(" ", "c")
    (src / "auth.py").write_text("def authenticate(user, token):\n    return check(user, token)\n" * 3)
    assert e.index_repo(str(src), "c") == {"changed": 1, "unchanged": 1}
    assert e.vectors.read("c").count() == 4  # three functions, and one block of lines
    assert e.index_status("c") == {"files": 2, "vectors": 4, "languages": {"python": 1, "rust": 1}}
    assert "QUAL001" in {r.rule for r in e.validate_code(str(src)).collect()} and "QUAL001" in e.list_rules()
    assert e.analyze_code(str(src)).first().sloc == 9 and e.search_branch(str(src), "COMPRESS").count() == 3
    e.clear_index("c")
    assert not e.vectors.exists("c")
    rows = spark.createDataFrame(
        [("1", "p", "first note about parsers", None, ["a"], "context", None, 1), ("2", "p", "second note", None, ["a", "b"], "context", None, 2), ("3", " ", "x", None, [], "", None, 3),
         ("4", "p", "second note", None, [], "context", None, 4)], e._OBSERVATIONS,
    )
    assert e.store_memory(rows) == 2 and e.store_memory(rows) == 0
    assert [r.id for r in e.list_memories(tags=["a"]).collect()] == ["2", "1"] and [r.id for r in e.list_memories(tags=["b"]).collect()] == ["2"]
    assert e.search_memory("parsers").first().id == "1" and e.search_memory("", tags=["b"]).count() == 1
    assert [r.id for r in e.get_memories(["2", "1"]).collect()] == ["2", "1"] and [r.id for r in e.session_start_context("p").collect()] == ["2", "1"]
    assert [r.id for r in e.memory_timeline("2", 1, 1).collect()] == ["1", "2"] and e.inject_context(3).count() == 1


def test_syntax(spark):
    files = spark.createDataFrame([("a.py", "class A:\n    def f(self):\n        return g(1)\n\ndef h():\n    pass\n"), ("b.py", "def (:")], "path string, text string")
    nodes = syntax.python_nodes(files)
    assert {r.name for r in syntax.select_nodes(nodes, "FunctionDef", [("has_child", "Return")]).collect()} == {"f"}
    assert {r.name for r in syntax.select_nodes(nodes, "FunctionDef", [("no_child", "Return"), ("name_matches", "^h")]).collect()} == {"h"}
    with pytest.raises(ValueError):
        syntax.select_nodes(nodes, "FunctionDef", [("odd", "x")])
    code = spark.createDataFrame([(1, "let a = f(1); // x\nlet b = a + 2;"), (2, "let a = f(1);\nlet b = a + 2;"), (3, "let z = q(7); let y = z + 9;")], "k long, t string")
    got = {(r.a, r.b): (r.exact, r.renamed) for r in syntax.clone_kinds(code, "k", "t", 10).collect()}
    assert got[1, 2][0] == got[1, 2][1] > 0 and got[1, 3][0] == 0 and got[1, 3][1] > 0
    hits = spark.createDataFrame([("a.py", 3, 3)], "path string, start_line int, end_line int")
    assert syntax.with_context(files, "path", "text", hits, 1).first().context == "    def f(self):\n        return g(1)\n"


def test_clones(spark):
    body = "".join(f"    let a{k} = call({k}{', b' * k});\n" for k in range(8))
    renamed = "".join(f"    let z{k} = do_it({k + 50}{', y' * k});\n" for k in range(8))
    changed = body.replace("let a4", "let q4")
    files = spark.createDataFrame([("a", "// one\n\n" + body), ("b", body + "x();\n"), ("c", changed), ("d", renamed), ("e", "fn f() {}\n")], "k string, t string")
    got = {r.b: r for r in syntax.clones(files, "k", "t").collect()}
    assert set(got) == {"b", "c"}  # renamed ones are too unlike as they stand
    assert (got["b"].rule, got["b"].a, got["b"].a_start, got["b"].a_end, got["b"].b_start, got["b"].b_end, got["b"].similarity) == ("DUP001", "a", 3, 10, 1, 8, 1.0)
    assert got["c"].rule == "DUP002" and 0.95 <= got["c"].similarity < 1
    assert syntax.clones(files, "k", "t", syntax.LENIENT).count() == 0
    from quernlight.operators.aggregates import clone_stats

    stats = clone_stats(syntax.clones(files, "k", "t").select("rule", F.col("b_start").alias("start_line"), F.col("b_end").alias("end_line")))
    assert {(r.rule, r.clones, r.lines) for r in stats.collect()} == {("DUP001", 1, 8), ("DUP002", 1, 8)}


def test_entities(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    p = e.project("create", "project", "org", "p1", data={"name": "one"})
    assert p == "p1" and e.project("get", "project", "org", "p1")["name"] == "one"
    for k in (1, 2, 3):
        e.project("create", "issue", "org", "p1", f"i{k}", {"title": f"t{k}", "status": "open"})
    e.project("update", "issue", "org", "p1", "i2", {"status": "closed"})
    assert sorted(r.id for r in e.project("list", "issue", "org", "p1", status="open").collect()) == ["i1", "i3"]
    assert e.project("list", "issue", "org", "p2").count() == 0
    e.project("create", "dependency", "org", "p1", data={"from_issue": "i1", "to_issue": "i2"})
    e.project("create", "dependency", "org", "p1", data={"from_issue": "i2", "to_issue": "i3"})
    assert {(r.src, r.dst, r.depth) for r in e.project("dependencies", "dependency", "org", "p1", "i1").collect()} == {("i1", "i2", 1), ("i2", "i3", 2)}
    e.project("delete", "issue", "org", "p1", "i3")
    with pytest.raises(KeyError):
        e.project("get", "issue", "org", "p1", "i3")
    with pytest.raises(KeyError):
        e.entity("get", "issue", "other", "i1")  # another organisation's
    with pytest.raises(ValueError):
        e.entity("create", "issue", "org", "i1", {})
    with pytest.raises(ValueError):
        e.entity("create", "planet", "org")
    s = e.start_session("org", "coder", project_id="p1", model="m")
    e.entities.log_tool_call("org", s, "search", True, 12)
    e.log_tool_call("org", "new", "search")
    e.log_delegation("org", s, "child", "do it")
    calls = {r.session_id: r.project_id for r in e.entities.events("tool_call").collect()}
    assert calls == {s: "p1", "new": None} and e.get_session("org", "new")["agent_type"] == "unknown"
    assert [r.id for r in e.list_sessions("org", agent_type="coder").collect()] == [s]
    assert e.summarize_session("org", s, {"topics": ["a"]})["topics"] == ["a"] and e.summarize_session("org", s, {"topics": ["b"]})["topics"] == ["b"]
    with pytest.raises(KeyError):
        e.summarize_session("org", "nobody", {})


def test_approximate_search(spark, sf_dir):
    """The index against brute force, for every query whose id is divisible by 20."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    want = {}
    for r in search.vector_search(e, queries, 5, "l2").collect():
        want.setdefault(r["query"], set()).add(r.vec_id)
    length = search.bucket_length(e, 5)
    hits = n = 0
    for r in queries.orderBy("query").limit(6).collect():
        found = search.approximate_search(e, [float(x) for x in r.q], 5, length=length).collect()
        assert r["query"] in {f.vec_id for f in found}
        hits, n = hits + len({f.vec_id for f in found} & want[r["query"]]), n + 5
    assert hits >= 0.9 * n
