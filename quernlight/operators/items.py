"""Items of brace languages: functions, types, traits, implementations, modules and
blocks of control flow, with their bodies, in one pass over whole files."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame

#: kind: fn, struct, enum, trait, impl, mod, loop or match. owner: the type or trait
#: around a function; trait: the one that is implemented. code: the body with comments
#: and literals blanked. before: attribute and comment lines above. nesting: control
#: flow within control flow, at most.
ITEM = (
    "path string, kind string, name string, owner string, trait string, line_no int, head string, body string, code string, "
    "before string, is_test boolean, nesting int"
)
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", re.S)
_HEAD = re.compile(r"\b(fn|struct|enum|trait|mod)\s+(\w+)|\b(impl)\b(?:<[^>{]*>)?\s*([^{;]+)|\b(for|while|loop|match)\b")
_CONTROL = re.compile(r"\b(if|else|for|while|loop|match)\b[^{};]*$")


def blank(text: str) -> str:
    """The text with comments and literals as spaces; lines and places stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def braces(code: str) -> dict[int, int]:
    """Place of each opening brace -> behind its closing one (or the end)."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.end()
    return out | dict.fromkeys(stack, len(code))


def nesting(code: str) -> int:
    """Most blocks of control flow within each other."""
    depth = most = 0
    stack: list[bool] = []
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            stack.append(bool(_CONTROL.search(code[max(0, m.start() - 400) : m.start()])))
            depth += stack[-1]
            most = max(most, depth)
        elif stack:
            depth -= stack.pop()
    return most


def parse(path: str, text: str) -> list[tuple]:
    """Rows of ITEM."""
    code = blank(text)
    ends, starts = braces(code), [0, *(m.end() for m in re.finditer("\n", text))]
    lines = text.split("\n")
    tested = [(m.start(), ends.get(code.find("{", m.end()), len(code))) for m in re.finditer(r"#\[cfg\(test\)\]", code)]
    in_tests = bool(re.search(r"(^|/)tests?/|_tests?\.rs$", path))
    out: list[tuple] = []
    around: list[tuple[int, str, str | None]] = []  # end, type or trait, implemented trait
    at = 0
    for m in _HEAD.finditer(code):
        if m.start() < at:
            continue
        line = bisect_right(starts, m.start())
        open_, semi = code.find("{", m.end()), code.find(";", m.end())
        none = open_ < 0 or 0 <= semi < open_
        end = semi + 1 if none and semi >= 0 else len(code) if none else ends[open_]
        while around and around[-1][0] <= m.start():
            around.pop()
        kind, trait = m[1] or m[3] or ("match" if m[5] == "match" else "loop"), None
        if kind in ("loop", "match") and none:
            continue
        name = m[2] or ""
        if kind == "impl":
            at = m.end()
            sides = re.split(r"\bfor\b", re.split(r"\bwhere\b", m[4])[0])
            name = re.sub(r"<.*", "", sides[-1]).strip()
            trait = re.sub(r"<.*", "", sides[0]).strip() if len(sides) > 1 else None
        owner = around[-1][1] if around else None
        if kind == "fn" and around:
            trait = around[-1][2]
        above = []
        for x in range(line - 2, -1, -1):
            if not re.match(r"\s*(//|#\[|#!\[|\*|/\*)", lines[x]):
                break
            above.insert(0, lines[x].strip())
        before = "\n".join(above)
        test = in_tests or "#[test]" in before or "::test]" in before or any(a <= m.start() < b for a, b in tested)
        inner = "" if none else code[open_:end]
        out.append((path, kind, name, owner, trait, line, code[starts[line - 1] : open_ if not none else end].strip(), "" if none else text[open_:end], inner, before, test, nesting(inner) if kind == "fn" else 0))
        if kind in ("impl", "trait"):
            around.append((end, name, trait))
    return out


def items(files: DataFrame) -> DataFrame:
    """Rows of ITEM of all files (path, text); null texts give none."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) if t for r in parse(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM.split(", ")])

    return files.select("path", "text").mapInPandas(run, ITEM)
