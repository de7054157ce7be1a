import pytest

from quernlight.operators import syntax, trees

RUST = """use std::fmt;
#[derive(Debug)]
pub struct P { a: Vec<u8>, b: Fn(u8) }
impl<T: X> fmt::Display for P<T> where T: Y {
    pub const fn go(&self, n: u32) -> u32 {
        let x = if n > 1 { call(n) } else if n == 3 { other!(a, b) } else { 2 };
        for i in v.iter().map(|y| { y.unwrap() }) { match i { A => return Q { a: 1 }, _ => {} } }
        x
    }
}
mod tests { fn t<'a>(x: &'a str) { check(x.is_empty()); "}{"; '}'; r#"{"# } /* { */ }
struct U(u8);
"""
SCRIPT = """import a from "b"
export default class A extends B {
  constructor(x) { super(x); this.y = () => { go(x) } }
  async run(a, b) { if (a) { return b } else { throw new Error("}") } }
}
const f = function (z) { try { q(z) } catch (e) { log(e) } finally { done() } }
function g() { const h = xs.map(x => x.y(1)); for (let i = 0; i < 3; i++) { w(i) } do { v() } while (u) }
"""


def tree(name: str, text: str) -> list[tuple]:
    return trees.rows_of(name, text, trees.parse(trees.GRAMMARS[name.split(".")[1]], text))


def chain(rows: list[tuple], kind: str, name: str | None = None) -> list[str]:
    """Kinds from the root to the first such node, without blocks."""
    row = next(r for r in rows if r[5] == kind and name in (None, r[6]))
    out = []
    while row[4] >= 0:
        out.insert(0, row[5])
        row = rows[row[4]]
    return [k for k in out if k != "block"]


def test_rust():
    rows = tree("a.rs", RUST)
    assert chain(rows, "call_expression", "unwrap") == ["impl_item", "function_item", "for_expression", "call_expression", "call_expression"]
    assert chain(rows, "macro_invocation") == ["impl_item", "function_item", "let_declaration", "if_expression", "if_expression", "macro_invocation"]
    assert chain(rows, "return_expression") == ["impl_item", "function_item", "for_expression", "match_expression", "return_expression"]
    assert chain(rows, "call_expression", "is_empty") == ["mod_item", "function_item", "call_expression", "call_expression"]
    assert [(r[5], r[6], r[8], r[9]) for r in rows if r[5].endswith("_item") and r[5] != "attribute_item"] == [
        ("struct_item", "P", 3, 3), ("impl_item", "P", 4, 10), ("function_item", "go", 5, 9), ("mod_item", "tests", 11, 11), ("function_item", "t", 11, 11), ("struct_item", "U", 12, 12),
    ]
    assert {r[6] for r in rows if r[5] == "call_expression"} == {"call", "iter", "map", "unwrap", "check", "is_empty"}


def test_javascript():
    rows = tree("a.js", SCRIPT)
    assert chain(rows, "method_definition", "run") == ["export_statement", "class_declaration", "method_definition"]
    assert chain(rows, "call_expression", "go") == ["export_statement", "class_declaration", "method_definition", "arrow_function", "call_expression"]
    assert chain(rows, "call_expression", "y") == ["function_declaration", "lexical_declaration", "call_expression", "arrow_function", "call_expression"]
    assert chain(rows, "call_expression", "done") == ["lexical_declaration", "function_expression", "try_statement", "call_expression"]
    assert chain(rows, "call_expression", "v") == ["function_declaration", "do_statement", "call_expression"]
    assert rows[1][5:7] == ("import_statement", 'a from "b"')


def test_go_and_java():
    go = tree("a.go", "package main\nfunc (r *T) Name(a int) (int, error) {\n\tx := f(a)\n\tdefer r.close()\n\tif err := g(); err != nil { return 0, err }\n\treturn x, nil\n}\n")
    assert chain(go, "return_statement") == ["function_declaration", "if_statement", "return_statement"]
    assert [r[6] for r in go if r[5] == "function_declaration"] == ["Name"]
    java = tree("a.java", "package a.b;\npublic class C { int x; int get(int y) throws E { return y; } void h() { if (x) { g(); } } }\n")
    assert [r[6] for r in java if r[5] == "method_declaration"] == ["get", "h"]
    assert chain(java, "call_expression", "g") == ["class_declaration", "method_declaration", "if_statement", "call_expression"]


@pytest.mark.parametrize("text", ["", "}", "{{(", "fn", "impl", "fn f(", "})]fn g() {", "a => {", '"', "/*", "if x", "match {", "use", "#[", "!("])
def test_broken_texts(text):
    for name in ("a.rs", "a.js", "a.ts", "a.go", "a.java", "a.cpp"):
        rows = tree(name, text)
        assert [r[1] for r in rows] == list(range(len(rows))) and rows[0][2] == len(rows) - 1
        assert all(r[4] < r[1] <= r[2] <= rows[r[4]][2] and r[3] == rows[r[4]][3] + 1 for r in rows[1:])


def test_a_long_file_takes_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        start = time.time()
        rows = tree("a.rs", "impl S { fn f() { if a { g(); } } }\n" * n)
        took.append(time.time() - start)
        assert len(rows) == 8 * n + 1
    assert took[1] < 10 * took[0] + 1


CONDITIONS = [("inside", "for_expression"), ("not_inside", "for_expression"), ("inside", "impl_item"), ("holds", "call_expression"), ("not_holds", "call_expression"),
              ("follows", "call_expression"), ("precedes", "block")]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("a.rs", RUST), ("b.rs", RUST.replace("for i", "while i")), ("c.js", SCRIPT), ("d.rs", None), ("e.rs", ""), ("f.txt", RUST)]
    return trees.nodes(spark.createDataFrame(rows, "path string, text string")).persist()


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_equal_a_walk(nodes, condition):
    rows = {(r["path"], r["id"]): r for r in nodes.collect()}
    around = lambda r: [] if r["parent"] < 0 else [(p := rows[r["path"], r["parent"]])["kind"], *around(p)]
    inner = lambda r: [x["kind"] for x in rows.values() if x["path"] == r["path"] and r["id"] < x["id"] <= r["last"]]

    def beside(r, step):
        row = sorted(x["id"] for x in rows.values() if x["path"] == r["path"] and x["parent"] == r["parent"])
        at = row.index(r["id"]) + step
        return rows[r["path"], row[at]]["kind"] if 0 <= at < len(row) else None

    test, kind = condition
    holds = {
        "inside": lambda r: kind in around(r), "not_inside": lambda r: kind not in around(r), "holds": lambda r: kind in inner(r),
        "not_holds": lambda r: kind not in inner(r), "follows": lambda r: beside(r, -1) == kind, "precedes": lambda r: beside(r, 1) == kind,
    }[test]
    for of in ("call_expression", "block", "function_item"):
        found = {(r["path"], r["id"]) for r in syntax.select_nodes(nodes, of, [condition]).collect()}
        assert found == {k for k, r in rows.items() if r["kind"] == of and holds(r)}


def test_conditions_together(nodes):
    found = syntax.select_nodes(nodes, "call_expression", [("inside", "function_item"), ("name_matches", "^unwrap$"), ("not_inside", "mod_item")])
    assert sorted(r["path"] for r in found.collect()) == ["a.rs", "b.rs"]
    assert {r["path"] for r in nodes.collect()} == {"a.rs", "b.rs", "c.js", "e.rs"}


def test_python_nodes_are_numbered(spark):
    text = "class A:\n    def f(self):\n        for x in y:\n            g(x)\n    def h(self): pass\n"
    rows = syntax.python_nodes(spark.createDataFrame([("a.py", text)], "path string, text string"))
    assert [r["name"] for r in syntax.select_nodes(rows, "FunctionDef", [("holds", "Call")]).collect()] == ["f"]
    assert [r["name"] for r in syntax.select_nodes(rows, "FunctionDef", [("follows", "FunctionDef")]).collect()] == ["h"]
