"""Chunks of source files by language, with priorities and a cap for each file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import aggregates, code
from .items import blank, braces

#: Fixed limits: chunks looked at in a file, and kept of them.
EXTRACTED, KEPT = 75, 50
#: Fixed rules: (what opens a chunk, least characters, least lines, deepest nesting, priority).
RULES = {
    "rust": (
        (r"\b(?:fn|struct|enum|trait|impl|mod|union)\b[^;{]*\{", 40, 2, 4, 10),
        (r"\b(?:const|static|type|macro_rules!)\s+\w+[^;{]*[;{]", 25, 1, 3, 5),
        (r"\b(?:use|extern\s+crate)\s+[^;]+;", 15, 1, 2, 1),
    ),
    "javascript": ((r"\b(?:function\b|class\b|interface\s+\w+|enum\s+\w+|(?:const|let)\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^={]+)?=>)[^;{]*\{", 30, 2, 2, 5),),
    "go": ((r"\b(?:func|type)\s[^;{\n]*\{", 30, 2, 3, 5),),
    "java": ((r"\b(?:class|interface|enum)\s+\w+[^;{]*\{|\b(?:public|private|protected|static)\b[^;{=]*\([^)]*\)[^;{]*\{", 30, 2, 3, 5),),
    "c": ((r"(?m)^[A-Za-z_][\w\s*&:<>,]*\([^;{]*\)[^;{]*\{|\b(?:class|struct|enum|namespace|union)\s+\w*[^;{()]*\{", 30, 2, 3, 5),),
    "ruby": ((r"(?m)^\s*(?:def|class|module)\s+[^\n]+", 30, 2, 3, 5),),
    "python": ((r"", 30, 2, 3, 5),),
}
SAME = {"typescript": "javascript", "cpp": "c", "csharp": "java", "kotlin": "java", "swift": "java", "php": "java", "scala": "java"}
CHUNK = "path string, start_line int, end_line int, kind string, name string, content string, priority int"
_NAME = re.compile(r"\b(fn|struct|enum|trait|impl|mod|union|const|static|type|use|function|class|interface|func|def|module|namespace|let)\b\W*([\w:]+)?")


def _span(text: str, start: int, end: int) -> tuple[int, int, str]:
    return text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1, text[start:end]


def brace_chunks(language: str, text: str) -> list[tuple]:
    """(start, end, kind, name, content, priority) by RULES."""
    hidden = blank(text)
    ends, out = braces(hidden), []
    depths = {}
    stack = 0
    for m in re.finditer(r"[{}]", hidden):
        stack += 1 if m.group() == "{" else -1
        depths[m.start()] = stack
    marks = sorted(depths)
    from bisect import bisect_left

    for pattern, least, lines, deep, priority in RULES[language]:
        for m in re.finditer(pattern, hidden):
            k = bisect_left(marks, m.start())
            if (depths[marks[k - 1]] if k else 0) >= deep:
                continue
            end = ends.get(m.end() - 1, m.end())
            first, last, content = _span(text, m.start(), end)
            if len(content) >= least and last - first + 1 >= lines:
                named = _NAME.search(m.group())
                out.append((first, last, named[1] if named else "block", (named[2] or "") if named else "", content, priority))
    return out


def python_chunks(text: str) -> list[tuple]:
    import ast

    _, least, lines, deep, priority = RULES["python"][0]
    try:
        todo = [(ast.parse(text), 0)]
    except (SyntaxError, ValueError, RecursionError):
        return []
    parts, out = text.split("\n"), []
    while todo:
        node, depth = todo.pop()
        inner = depth
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            content = "\n".join(parts[node.lineno - 1 : node.end_lineno])
            inner += 1
            if depth < deep and len(content) >= least and node.end_lineno - node.lineno + 1 >= lines:
                out.append((node.lineno, node.end_lineno, "class" if isinstance(node, ast.ClassDef) else "def", node.name, content, priority))
        todo += [(c, inner) for c in ast.iter_child_nodes(node)]
    return out


def ruby_chunks(text: str) -> list[tuple]:
    """Definitions up to the `end` of their own indentation."""
    pattern, least, lines, _, priority = RULES["ruby"][0]
    out = []
    for m in re.finditer(pattern, text):
        indent = re.match(r"\s*", m.group().lstrip("\n"))[0]
        close = re.compile(rf"(?m)^{re.escape(indent)}end\b").search(text, m.end())
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        first, last, content = _span(text, start, close.end() if close else len(text))
        if len(content) >= least and last - first + 1 >= lines:
            kind, name = content.split(None, 2)[:2]
            out.append((first, last, kind, name, content, priority))
    return out


def chunks_of(language: str, text: str) -> list[tuple]:
    language = SAME.get(language, language)
    if language == "python":
        return python_chunks(text)
    if language == "ruby":
        return ruby_chunks(text)
    return brace_chunks(language, text) if language in RULES else []


def best_of_file(chunks: DataFrame, extracted: int = EXTRACTED, kept: int = KEPT) -> DataFrame:
    """Of each file's first `extracted` chunks by their lines the best `kept`, by
    priority, then by line."""
    first = aggregates.best_per_group(chunks, "path", extracted, F.col("start_line"), F.col("end_line").desc(), F.col("priority").desc()).drop("rank")
    return aggregates.best_per_group(first, "path", kept, F.col("priority").desc(), F.col("start_line"), F.col("end_line").desc()).drop("rank")


def code_chunks(files: DataFrame) -> DataFrame:
    """Rows of CHUNK for files (path, text): by their language's rules, and by blocks of
    lines (priority 0) where a language has none or no rule finds a chunk."""
    named = files.select("path", "text", S.language_of(F.col("path")).alias("language"))

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text, language in zip(pdf["path"], pdf["text"], pdf["language"]):
                rows += [(path, *c) for c in chunks_of(language, text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    found = named.mapInPandas(run, CHUNK)
    rest = files.join(found.select("path").distinct(), "path", "left_anti")
    plain = code.blocks(rest, "path", "text").select(
        "path", "start_line", "end_line", F.lit("block").alias("kind"), F.lit("").alias("name"), "content", F.lit(0).alias("priority")
    )
    return best_of_file(found).unionByName(plain)
