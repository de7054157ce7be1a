"""Rules by required literals against every pattern on every line; ranges by a sweep."""

import random
import re

import pytest

from quernlight.functions.scalar import glob_to_regex
from quernlight.operators.checks import LINE_RULES, PENDING, TEST_FILE, _marks, line_checks, within_ranges
from quernlight.operators.patterns import required_literals


@pytest.mark.parametrize("pattern,literals", [
    (r"\.unwrap\(\)", (".unwrap()",)), (r"\b(panic|todo)!\s*\(", ("panic", "todo")), (r"\d{5,}", None), (r"(?i)secret", None), (r"ab?cd", ("cd",)),
    (r"(foo)?bar", ("bar",)), (r"(foo|b)\d", None), (r"(?:abc)+x", ("abc",)), (r"[ab]c", None), (r"a|", None), (r"(", None), (r"x{2}yz", ("yz",)),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals


def test_every_match_holds_a_literal():
    rnd = random.Random(5)
    pieces = ["pub ", "const ", "X", ": ", "12345", "unwrap()", ".", "Arc<Mutex<bool>>", "fn ", "Foo", "Mock", "use ", "legacy::", "=> {}", "_ ", "\"a\"", ".to_string()", " todo!(", "assert!(true)", "TODO"]
    for _ in range(3000):
        line = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 7)))
        for r in LINE_RULES:
            for p in r["patterns"]:
                needed = required_literals(p)
                assert needed is None or not re.search(p, line, re.A) or any(x in line for x in needed), (p, line)


def plain(path, text):
    out = []
    tests = [True] * (text.count("\n") + 1) if TEST_FILE.search(path) else _marks(path, text)
    for n, line in enumerate(text.split("\n"), 1):
        if re.search(PENDING, line, re.A):
            out.append((path, n, "QUAL005"))
        if re.search(r"^\s*(//|/\*|\*)", line, re.A):
            continue
        for r in LINE_RULES:
            yes = [g for g in r["files"] if g[0] != "!"]
            named = (not yes or any(re.search(glob_to_regex(g), path) for g in yes)) and not any(re.search(glob_to_regex(g[1:]), path) for g in r["files"] if g[0] == "!")
            if named and tests[n - 1] == r["tests"] and any(re.search(p, line, re.A) for p in r["patterns"]) and not any(re.search(p, line, re.A) for p in r.get("ignore", ())):
                out.append((path, n, r["id"]))
    return out


def test_line_checks_equal_every_pattern_on_every_line(spark):
    rnd = random.Random(11)
    lines = ["    let x = 123456;", "pub const A: u32 = 1;", "x.unwrap();", "// x.unwrap() TODO", "x.expect(\"lock()\");", "use legacy::a;", "fn Bad() {", "}", "struct bad {", "#[cfg(test)]", "mod tests {", "    #[test]",
             "    fn t() {", "        assert!(true);", "MockStore::new();", "panic!(\"a\");", "password = \"hunter22\"", "value: 5000,", "_ => {}", "tokio::spawn(a);", "// HACK", "pub fn x() {", "todo!();", "const Z: u8 = 99999;", ""]
    paths = ["crates/a/src/domain/x.rs", "crates/a/src/internal/y.rs", "crates/a/src/config/app.rs", "tests/z.rs", "a_test.rs", "conf/app.toml", "src/utils.rs", "admin/x.rs", "src/constants/c.rs"]
    files = [(f"{k}/{rnd.choice(paths)}", "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 60)))) for k in range(120)] + [("n.rs", None), ("e.rs", "")]
    got = line_checks(spark.createDataFrame(files, "path string, text string")).collect()
    want = sorted(h for p, t in files for h in plain(p, t or ""))
    assert sorted((r["path"], r["line_no"], r["rule"]) for r in got) == want and len({w[2] for w in want}) > 15
    assert all(r["category"] and r["severity"] and r["message"] for r in got)
    assert line_checks(spark.createDataFrame([], "path string, text string")).count() == 0


def test_ranges_of_one_file(spark):
    """Nested, equal and touching ranges, and 100,000 of them around one place."""
    rnd = random.Random(2)
    ranges = [(f"f{rnd.randint(0, 3)}", a := rnd.randint(0, 90), a + rnd.randint(0, 15)) for _ in range(40)]
    rows = [(f"f{k}", n, "x") for k in range(5) for n in range(100)]
    got = within_ranges(spark.createDataFrame(rows, "path string, line_no int, other string"), spark.createDataFrame(ranges, "path string, first int, last int"))
    assert got.columns == ["path", "line_no", "other", "inside"]
    assert {(r["path"], r["line_no"]): r["inside"] for r in got.collect()} == {(p, n): any(q == p and a <= n <= b for q, a, b in ranges) for p, n, _ in rows}
    many = spark.range(100_000).selectExpr("'big' as path", "cast(id as int) as first", "cast(300000 - id as int) as last")
    lines = spark.range(200_001).selectExpr("'big' as path", "cast(id * 2 as int) as line_no")
    assert within_ranges(lines, many).where("inside").count() == 150_001
