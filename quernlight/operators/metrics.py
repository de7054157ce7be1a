"""Measures of functions: cyclomatic and cognitive complexity, nesting, line counts,
Halstead's measures, arguments, exits and maintainability.

Functions of brace languages come from items, Python's from its standard parser.
Cognitive complexity: each `if`, loop and `match` costs 1 and 1 more for each that it
stands in; each `else` and `else if`, and each run of one logical operator, costs 1."""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import DataFrame

from .items import blank, parse

METRICS = (
    "path string, name string, line_no int, cyclomatic int, cognitive int, nesting int, length int, sloc int, ploc int, lloc int, cloc int, blank int, "
    "arguments int, exits int, volume double, difficulty double, effort double, maintainability double"
)
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[-+*/%=<>!&|^~?:.]+|[(){}\[\],;]")
_WORDS = {
    "fn", "let", "mut", "if", "else", "for", "while", "loop", "match", "return", "break", "continue", "in", "as", "pub", "async", "await", "move", "ref", "impl",
    "def", "class", "and", "or", "not", "is", "lambda", "yield", "try", "except", "finally", "with", "raise", "import", "from", "pass", "case", "switch", "new",
}
_BRANCH = re.compile(r"\b(if|while|for|loop|match|case|catch)\b|&&|\|\|")


def halstead(text: str) -> tuple[float, float, float]:
    """(volume, difficulty, effort) of operators (signs and keywords) and operands."""
    tokens = _TOKEN.findall(text)
    operators = [t for t in tokens if not (t[0].isalnum() or t[0] in "_\"'") or t in _WORDS]
    operands = [t for t in tokens if (t[0].isalnum() or t[0] in "_\"'") and t not in _WORDS]
    n1, n2 = len(set(operators)), len(set(operands))
    size = len(operators) + len(operands)
    volume = size * math.log2(n1 + n2) if n1 + n2 > 1 else 0.0
    difficulty = n1 / 2 * len(operands) / n2 if n2 else 0.0
    return volume, difficulty, volume * difficulty


def brace_cognitive(code: str) -> int:
    """Cognitive complexity of a body without comments and literals."""
    cost, depth = 0, 0
    stack: list[bool] = []
    pending, last = False, None
    for m in re.finditer(r"\belse\s+if\b|\b(?:if|else|for|while|loop|match)\b|&&|\|\||[{};]", code):
        t = m.group()
        if t == "{":
            stack.append(pending)
            depth += pending
            pending, last = False, None
        elif t == "}":
            depth -= stack.pop() if stack else False
            last = None
        elif t == ";":
            last = None
        elif t in ("&&", "||"):
            cost += t != last
            last = t
        else:
            cost += 1 if t.startswith("else") else 1 + depth
            pending, last = True, None
    return cost


def _measures(text: str, bare: str, comment: str, cyclomatic: int, logical: int) -> tuple:
    """length, sloc, ploc, lloc, cloc, blank of a function's text, bare: without comments."""
    lines, plain = text.split("\n"), bare.split("\n")
    empty = sum(not x.strip() for x in lines)
    commented = sum(x.strip().startswith(comment) for x in lines)
    physical = sum(bool(x.strip()) for x in plain)
    volume, difficulty, effort = halstead(text)
    index = 171 - 5.2 * math.log(max(volume, 1)) - 0.23 * cyclomatic - 16.2 * math.log(max(physical, 1))
    return (len(lines), len(lines) - empty - commented, physical, logical, commented, empty), (volume, difficulty, effort, max(0.0, min(100.0, index * 100 / 171)))


def brace_functions(path: str, text: str) -> list[tuple]:
    out = []
    for _, kind, name, _, _, line, head, body, code, *_, nest in parse(path, text):
        if kind == "fn" and body:
            cyclomatic = 1 + len(_BRANCH.findall(code))
            counts, rest = _measures(body, code, "//", cyclomatic, code.count(";"))
            inside = re.search(r"\bfn\s+\w+[^(]*\(([^)]*)\)", head)
            arguments = sum(bool(a.strip()) and not re.fullmatch(r"&?\s*(mut\s+)?self", a.strip()) for a in inside[1].split(",")) if inside else 0
            exits = len(re.findall(r"\breturn\b|\?", code))
            out.append((path, name, line, cyclomatic, brace_cognitive(code), nest, *counts, arguments, exits, *rest))
    return out


_FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.Match)


def _python_cost(node: ast.AST, depth: int) -> tuple[int, int, int]:
    """(cognitive, cyclomatic, nesting) below a node."""
    cognitive = cyclomatic = 0
    most = depth
    for child in ast.iter_child_nodes(node):
        inner, chained = depth, isinstance(node, ast.If) and isinstance(child, ast.If) and child in node.orelse and len(node.orelse) == 1
        if isinstance(child, _FLOW):
            cognitive += 1 if chained else 1 + depth
            cyclomatic += len(child.handlers) if isinstance(child, ast.Try) else len(child.cases) if isinstance(child, ast.Match) else 1
            inner = depth if chained else depth + 1
            if isinstance(child, ast.If) and child.orelse and not (len(child.orelse) == 1 and isinstance(child.orelse[0], ast.If)):
                cognitive += 1
        elif isinstance(child, ast.BoolOp):
            cognitive += 1
            cyclomatic += len(child.values) - 1
        elif isinstance(child, (ast.IfExp, ast.comprehension)):
            cyclomatic += 1 if isinstance(child, ast.IfExp) else len(child.ifs)
            cognitive += isinstance(child, ast.IfExp)
        below = _python_cost(child, inner)
        cognitive, cyclomatic, most = cognitive + below[0], cyclomatic + below[1], max(most, below[2])
    return cognitive, cyclomatic, most


def python_functions(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = text.split("\n"), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            own = "\n".join(lines[node.lineno - 1 : node.end_lineno])
            cognitive, branches, nest = _python_cost(node, 0)
            bare = re.sub(r"#[^\n]*", "", own)
            counts, rest = _measures(own, bare, "#", 1 + branches, sum(isinstance(x, ast.stmt) for x in ast.walk(node)) - 1)
            a = node.args
            arguments = len([x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x and x.arg not in ("self", "cls")])
            exits = sum(isinstance(x, (ast.Return, ast.Raise)) for x in ast.walk(node))
            out.append((path, node.name, node.lineno, 1 + branches, cognitive, nest, *counts, arguments, exits, *rest))
    return out


def function_metrics(files: DataFrame) -> DataFrame:
    """Rows of METRICS for every function of files (path, text); Python files that
    don't parse, and null texts, give none."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) if t for r in (python_functions if p.endswith(".py") else brace_functions)(p, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METRICS.split(", ")])

    return files.select("path", "text").mapInPandas(run, METRICS)


__all__ = ["METRICS", "blank", "brace_cognitive", "function_metrics", "halstead"]
