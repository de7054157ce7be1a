import re

import pytest

from quernlight.operators import checks, chunkers, items, metrics

WIDE = "".join(f"    f{k}: u8,\n" for k in range(9))
LONG = "    x += 1;\n" * 60
#: For each rule a file (path, text) that breaks it, and the line.
BROKEN = {
    "QUAL001": ("src/a.rs", "fn f() {\n    x.unwrap();\n}\n", 2),
    "QUAL002": ("src/a.rs", 'fn f() {\n    x.expect("no");\n}\n', 2),
    "QUAL003": ("src/a.rs", 'fn f() {\n    panic!("no");\n}\n', 2),
    "QUAL004": ("src/a.rs", "let x;\n" * 501, 0),
    "QUAL005": ("src/a.rs", "// TODO: later\n", 1),
    "QUAL020": ("src/a.rs", "#[allow(dead_code)]\nfn f() { f(); }\n", 1),
    "QUAL021": ("src/a.rs", "#[allow(dead_code)]\nstruct S {\n    lonely: u8,\n}\n", 2),
    "QUAL022": ("src/a.rs", "#[allow(dead_code)]\nfn lonely_one() { g(); }\n", 2),
    "KISS001": ("src/a.rs", "struct S {\n" + WIDE + "}\n", 1),
    "KISS002": ("src/a.rs", "fn f(&self, a: u8, b: u8, c: u8, d: u8, e: u8, g: u8) { h(); }\n", 1),
    "KISS003": ("src/a.rs", "struct PartBuilder {\n" + "".join(f"    f{k}: Option<u8>,\n" for k in range(9)) + "}\n", 1),
    "KISS004": ("src/a.rs", "fn f() {\n    if a { for b in c { while d { if e { g(); } } } }\n}\n", 1),
    "KISS005": ("src/a.rs", "fn f() {\n" + LONG + "}\n", 1),
    "SOLID001": ("src/a.rs", "impl S {\n" + "    // x\n" * 201 + "}\n", 1),
    "SOLID002": ("src/a.rs", "fn f() {\n    match x {\n" + "".join(f"        {k} => g(),\n" for k in range(11)) + "    }\n}\n", 2),
    "SOLID003": ("src/a.rs", "trait T {\n" + "".join(f"    fn f{k}();\n" for k in range(11)) + "}\n", 1),
    "SOLID004": ("crates/domain/src/a.rs", "struct S {\n    c: Arc<HttpClient>,\n}\n", 2),
    "SOLID005": ("src/a.rs", "".join(f"pub struct {c * 5};\n" for c in "ABCDEF"), 0),
    "SOLID006": ("src/a.rs", "impl T for S {\n    fn f() {\n        todo!()\n    }\n}\n", 2),
    "SOLID007": ("src/a.rs", "impl S {\n" + "".join(f"    fn f{k}() {{ g(); }}\n" for k in range(16)) + "}\n", 1),
    "SOLID008": ("src/a.rs", 'fn f() {\n    match x {\n        "a" => 1,\n        "b" => 2,\n        "c" => 3,\n    }\n}\n', 2),
    "IMPL001": ("src/a.rs", "fn f() {}\n", 1),
    "IMPL002": ("src/a.rs", "fn f() -> bool {\n    true\n}\n", 1),
    "IMPL003": ("src/a.rs", "impl S {\n    fn f(&self) { self.inner.call() }\n}\n", 2),
    "IMPL004": ("src/a.rs", 'fn f() {\n    info!("called");\n}\n', 1),
    "IMPL005": ("src/a.rs", "fn f() {\n    todo!()\n}\n", 1),
    "IMPL006": ("src/a.rs", "fn f() {\n    match x {\n        1 => g(),\n        _ => {}\n    }\n}\n", 4),
    "PERF001": ("src/a.rs", "fn f() {\n    for i in x {\n        y.clone();\n    }\n}\n", 2),
    "PERF002": ("src/a.rs", "fn f() {\n    for i in x {\n        let v = Vec::new();\n    }\n}\n", 2),
    "PERF003": ("src/a.rs", "struct S {\n    n: Arc<Mutex<bool>>,\n}\n", 2),
    "PERF004": ("src/a.rs", "fn f() {\n    x.collect::<Vec<_>>().iter();\n}\n", 2),
    "PERF005": ("src/a.rs", 'fn f() {\n    format!("a").to_string();\n}\n', 2),
    "ASYNC001": ("src/a.rs", "async fn f() {\n    std::thread::sleep(x);\n}\n", 1),
    "ASYNC002": ("src/a.rs", "fn f() {\n    block_on(x);\n}\n", 2),
    "ASYNC003": ("src/a.rs", "use std::sync::Mutex;\n", 1),
    "ASYNC004": ("src/a.rs", "fn f() {\n    tokio::spawn(x);\n}\n", 2),
    "PAT001": ("src/a.rs", "struct S {\n    s: Arc<MailService>,\n}\n", 2),
    "PAT002": ("src/a.rs", "trait T {\n    async fn f();\n}\n", 1),
    "PAT003": ("src/a.rs", "trait T: Send {\n    async fn f();\n}\n", 1),
    "PAT004": ("src/a.rs", "fn f() -> Result<u8, Box<dyn std::error::Error>> { g() }\n", 1),
    "PAT005": ("src/domain/ports/a.rs", "pub trait MailPort {\n    fn f();\n    fn g();\n}\n", 1),
    "ERR002": ("src/handlers/a.rs", "fn f() -> Result<u8, sqlx::Error> { g() }\n", 1),
    "ERR003": ("src/handlers/a.rs", "fn f() {\n    reply(e.to_string());\n}\n", 2),
    "PORT001": ("src/adapters/a.rs", "pub struct MailAdapter {\n    x: u8,\n}\n", 1),
    "PORT002": ("src/adapters/a.rs", "use crate::infra::adapters::other::Other;\n", 1),
    "PORT003": ("src/ports/a.rs", "trait T {\n" + "".join(f"    fn f{k}();\n" for k in range(11)) + "}\n", 1),
    "PORT004": ("src/ports/a.rs", "trait T {\n    fn f();\n}\n", 1),
    "VIS001": ("src/internal/a.rs", "pub fn f() { g(); }\n", 1),
    "VIS002": ("src/domain/a.rs", "pub(crate) struct S {\n    x: u8,\n}\n", 1),
    "VIS003": ("src/utils.rs", "pub fn f() { g(); }\n", 1),
    "SSOT002": ("src/a.rs", "use crate::legacy::Old;\n", 1),
    "SSOT003": ("src/a.rs", "let x = LegacySchema;\n", 1),
    "SSOT004": ("src/a.rs", "legacy_schema!(x);\n", 1),
    "SSOT005": ("src/a.rs", "use a::schema::legacy::X;\n", 1),
    "SSOT006": ("src/a.rs", "let x = crate::schema::t;\n", 1),
    "SSOT007": ("src/domain/a.rs", "pub struct S {\n    pub user_id: String,\n}\n", 2),
    "DEP004": ("src/admin/a.rs", "use crate::repositories::users;\n", 1),
    "DEP005": ("src/cli/a.rs", "my_validate::run();\n", 1),
    "DEP001": ("crates/my-domain/Cargo.toml", '[dependencies]\nmy-server = "1"\n', 0),
    "CFG001": ("src/config/a.rs", 'let c = C {\n    host: "here".to_string(),\n};\n', 2),
    "CFG002": ("src/config/a.rs", "let c = C {\n    port: 9999,\n};\n", 2),
    "CFG003": ("src/config/a.rs", "impl Default for C {\n    fn default() -> Self { g() }\n}\n", 1),
    "CFG004": ("src/a.rs", "pub struct AppConfig {\n    pub host: String,\n}\n", 1),
    "CFG005": ("conf/a.toml", 'namespace = "one"\n', 1),
    "NAME001": ("src/a.rs", "struct bad_name;\n", 1),
    "NAME002": ("src/a.rs", "fn BadName() { g(); }\n", 1),
    "NAME003": ("src/a.rs", "const bad: u8 = 1;\n", 1),
    "NAME004": ("src/BadName.rs", "let x;\n", 0),
    "NAME005": ("src/repositories/users.rs", "let x;\n", 0),
    "NAME006": ("src/handlers/user_repository.rs", "let x;\n", 0),
    "ORG001": ("src/a.rs", "let x = 123456;\n", 1),
    "ORG003": ("src/a.rs", "pub const LIMIT: u8 = 3;\n", 1),
    "ORG004": ("src/domain/a.rs", "struct UserRepository {\n    x: u8,\n}\n", 1),
    "ORG005": ("src/server/entities/a.rs", "let x;\n", 0),
    "ORG007": ("src/domain/a.rs", "trait MailProvider {\n    fn f();\n    fn g();\n}\n", 1),
    "ORG008": ("src/application/a.rs", "impl MailAdapter {\n    fn f() { g(); }\n}\n", 1),
    "ORG009": ("src/constants.rs", "let x;\n" * 501, 0),
    "ORG010": ("src/a.rs", "let x = f(8080);\n", 1),
    "ORG011": ("src/a.rs", "let x;\n" * 501, 0),
    "ORG013": ("src/server/a.rs", "let s = MailService::new();\n", 1),
    "ORG014": ("src/application/a.rs", "use my_server::x;\n", 1),
    "ORG015": ("src/server/user_handler.rs", "let x;\n", 0),
    "ORG016": ("src/domain/a.rs", "impl S {\n    fn f() { std::fs::read(x); }\n}\n", 1),
    "ORG017": ("src/server/a.rs", "struct UserHandler {\n    x: u8,\n}\n", 1),
    "ORG018": ("src/a.rs", "trait MailPort {\n    fn f();\n    fn g();\n}\n", 1),
    "CA001": ("src/domain/a.rs", "use my_server::x;\n", 1),
    "CA002": ("src/application/a.rs", "use my_infrastructure::x;\n", 1),
    "CA003": ("src/domain/ports/a.rs", "impl S {\n    fn f() { g(); }\n}\n", 1),
    "CA004": ("src/handlers/a.rs", "fn f() {\n    let s = MailService::new();\n}\n", 1),
    "CA005": ("src/domain/entities/a.rs", "pub struct User {\n    name: String,\n}\n", 1),
    "CA006": ("src/domain/value_objects/a.rs", "impl V {\n    fn set(&mut self) { g(); }\n}\n", 2),
    "CA007": ("src/infrastructure/a.rs", "use my_application::services::MailService;\n", 1),
    "CA008": ("src/application/a.rs", "use my_providers::ports::Mail;\n", 1),
    "CA009": ("src/infrastructure/a.rs", "use my_application::x;\n", 1),
    "CA010": ("src/providers/a.rs", "use my_server::x;\n", 1),
    "CA011": ("src/infrastructure/a.rs", "use my_server::x;\n", 1),
    "CA012": ("src/server/a.rs", "use my_validate::x;\n", 1),
    "CA014": ("src/validate/a.rs", "use my_domain::x;\n", 1),
    "CA015": ("src/utils/a.rs", "use my_domain::x;\n", 1),
    "CA016": ("src/domain/a.rs", "pub mod constants;\n", 1),
    "CA017": ("src/application/a.rs", "struct S {\n    s: Arc<MailService>,\n}\n", 2),
    "CA018": ("src/a.rs", "pub use my_utils::x;\n", 1),
    "CA019": ("src/server/a.rs", "use my_infrastructure::x;\n", 1),
    "LAYER001": ("src/domain/a.rs", "use my_application::x;\n", 1),
    "LAYER003": ("src/domain/a.rs", "use tokio::fs;\n", 1),
    "DEP002": ("src/domain/a.rs", "use my_providers::x;\n", 1),
    "DOC001": ("src/lib.rs", "fn f() { g(); }\n", 1),
    "DOC002": ("src/a.rs", "pub fn f() { g(); }\n", 1),
    "DOC003": ("src/a.rs", "/// Docs.\npub fn f() { g(); }\n", 2),
    "REF001": ("c/src/a.rs", "use crate::nowhere::X;\n", 1),
    "REF003": ("src/lonely.rs", "fn f() { g(); }\n", 0),
    "REF004": ("c/src/a.rs", "pub use crate::nowhere::X;\n", 1),
    "REF005": ("src/lib.rs", "mod gone;\n", 1),
    "REF006": ("src/a.rs", "struct Lonely {\n    x: u8,\n}\n", 1),
    "PMAT001": ("src/a.rs", "fn f() {\n" + "    if a { g(); }\n" * 16 + "}\n", 1),
    "PMAT002": ("src/a.rs", "fn nobody_calls() { g(); }\n", 1),
    "PMAT003": ("src/a.rs", "".join(f"fn dead{k}() {{ g(); }}\n" for k in range(6)), 0),
    "METRIC-cyclomatic": ("src/a.rs", "fn f() {\n" + "    if a { g(); }\n" * 10 + "}\n", 1),
    "METRIC-cognitive": ("src/a.rs", "fn f() {\n    if a { if b { if c { if d { if e { if f { g(); } } } } } }\n}\n", 1),
    "METRIC-length": ("src/a.rs", "fn f() {\n" + LONG + "}\n", 1),
    "METRIC-nesting": ("src/a.rs", "fn f() {\n    if a { if b { if c { if d { if e { g(); } } } } }\n}\n", 1),
    "TEST001": ("src/a.rs", "#[cfg(test)]\nmod tests {\n}\n", 2),
    "TEST002": ("tests/bad.rs", "fn f() { g(); }\n", 0),
    "TEST004": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    g();\n}\n", 2),
    "TEST005": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    assert!(true);\n}\n", 3),
    "TEST006": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    g().unwrap();\n}\n", 2),
    "TEST007": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    // later\n}\n", 2),
    "TEST008": ("tests/a_tests.rs", "let m = MockMail;\n", 1),
    "TEST009": ("tests/a_tests.rs", 'println!("skipping");\n', 1),
    "TEST010": ("tests/a_tests.rs", "todo!();\n", 1),
    "TST001": ("tests/a_tests.rs", "#[test]\n#[ignore]\nfn checks() {\n    assert!(x);\n}\n", 3),
    "TST002": ("tests/a_tests.rs", "fn fixture() {\n    todo!()\n}\n", 1),
    "TST003": ("tests/a_tests.rs", "#[test]\nfn checks() {}\n", 2),
    "TST004": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    assert!(x);\n}\n", 2),
    "TST005": ("tests/a_tests.rs", "#[test]\nfn checks() {\n    assert!(true);\n}\n", 3),
}
CLEAN = ("src/clean.rs", "/// Adds.\n///\n/// # Example\n/// add(1, 2)\npub fn add(a: u8, b: u8) -> u8 {\n    a + b\n}\n\nfn main() {\n    add(1, 2);\n}\n")


@pytest.fixture(scope="module")
def found(spark):
    """One project for each rule, in a folder of its own, and all checks run once."""
    rows = [(f"{rule.replace('-', '_').lower()}/{path}", text) for rule, (path, text, _) in BROKEN.items()]
    rows += [(f"ok/{CLEAN[0]}", CLEAN[1]), ("ok/tests/clean_tests.rs", "/// Adds.\n#[test]\nfn adds() {\n    assert_eq!(add(1, 2), 3);\n}\n"), ("null.rs", None), ("empty.rs", "")]
    rows += [("twice/domain/a.rs", "pub struct Same {\n    x: u8,\n}\npub trait SamePort: Send {\n    fn f();\n    fn g();\n}\n"), ("twice/server/b.rs", "pub struct Same {\n    x: u8,\n}\npub trait SamePort: Send {\n    fn f();\n    fn g();\n}\n")]
    rows += [("ring/providers/a.rs", "use my_server::x;\n"), ("ring/server/a.rs", "use my_providers::x;\n")]
    rows += [("ring/my-providers/Cargo.toml", '[dependencies]\nmy-server = "1"\n'), ("ring/my-server/Cargo.toml", '[dependencies]\nmy-providers = "1"\n')]
    rows += [(f"words/w{k}.rs", 'let x = "the same words again";\n') for k in range(4)]
    return [tuple(r) for r in checks.run(spark.createDataFrame(rows, "path string, text string")).select("path", "line_no", "rule", "severity", "message").collect()]


@pytest.mark.parametrize("rule", sorted(BROKEN))
def test_rule(found, rule):
    path, _, line = BROKEN[rule]
    assert (f"{rule.replace('-', '_').lower()}/{path}", line, rule) in {f[:3] for f in found}


def test_rules_across_files(found):
    got = {f[:3] for f in found}
    for rule in ("REF002", "ORG006", "ORG012", "SSOT001"):
        assert ("twice/domain/a.rs", 0, rule) in got
    assert any(f[2] == "LAYER002" for f in found) and any(f[2] == "ORG002" and "the same words again" in f[4] for f in found)
    assert {f[0] for f in found if f[2] == "DEP003"} == {"ring/my-providers/Cargo.toml", "ring/my-server/Cargo.toml"}


def test_clean_files(found):
    assert [f for f in found if f[0].startswith("ok/") or f[0] in ("null.rs", "empty.rs")] == []


def test_ids(found):
    assert {f[2] for f in found} == set(checks.rule_ids())
    assert all(f[3] in ("ERROR", "WARNING", "INFO") for f in found)


def test_items():
    text = 'impl Display for Foo<T> {\n    fn fmt(&self) { "fn no() {"; }\n}\nstruct T(u8);\n'
    rows = items.parse("a.rs", text)
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [("impl", "Foo", None, "Display", 1), ("fn", "fmt", "Foo", "Display", 2), ("struct", "T", None, None, 4)]
    assert rows[1][7] == '{ "fn no() {"; }' and '"' not in rows[1][8]


def test_metrics():
    python = "def f(a, b):\n    if a and b:\n        for x in a:\n            if x:\n                return 1\n    elif b:\n        pass\n    else:\n        pass\n"
    rust = "fn f(a: u8, b: u8) {\n    if a && b {\n        for x in a { if x { return 1; } }\n    } else if b { } else { }\n}\n"
    (p,), (r,) = metrics.python_functions("a.py", python), metrics.brace_functions("a.rs", rust)
    # if 1, and 1, for 2, inner if 3, elif 1, else 1
    assert p[3:6] == (6, 9, 3) and r[3:6] == (6, 9, 3) and p[12:14] == r[12:14] == (2, 1)
    assert metrics.halstead("a = b + c") == pytest.approx((5 * 2.321928, 1.0, 5 * 2.321928))
    assert metrics.python_functions("a.py", "def (:") == []


def test_chunkers(spark):
    samples = {
        "a.go": "func Foo(a int) int {\n\treturn a + 1 + 2 + 3\n}\n", "a.js": "const f = (a) => {\n  return a + 1 + 2 + 33333;\n}\n", "a.java": "public class A {\n  int f() { return 1; }\n  // long enough\n}\n",
        "a.c": "int add(int a, int b) {\n  return a + b + 1 + 2;\n}\n", "a.rb": "class A\n  def foo(a)\n    a + 1 + 2 + 3 + 4\n  end\nend\n", "a.py": "class A:\n    def f(self):\n        return 1 + 2 + 3 + 4\n",
        "a.rs": "fn f() {\n" + "    x();\n" * 9 + "}\nuse std::collections::HashMap;\nconst LIMIT: usize = 100_000;\n", "a.md": "plain words that no rule knows, in one line\n",
    }
    rows = chunkers.code_chunks(spark.createDataFrame(list(samples.items()), "path string, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.path, []).append((r.kind, r.priority))
    assert got["a.rs"] and sorted(got["a.rs"]) == [("const", 5), ("fn", 10), ("use", 1)]
    assert set(got) == set(samples) and got["a.md"] == [("block", 0)] and len(got["a.rb"]) == 2 and len(got["a.py"]) == 2
    many = spark.createDataFrame([("m.rs", "".join(f"const NAME_{k:03d}: usize = 100_000;\n" if k < 70 else f"fn f{k}() {{\n    call_something_long_enough();\n}}\n" for k in range(90)))], "path string, text string")
    kept = chunkers.code_chunks(many).collect()
    assert len(kept) == 50 and sum(r.priority == 10 for r in kept) == 5 and all(re.match("fn|const", r.content) for r in kept)
