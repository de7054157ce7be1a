"""Many patterns over many texts in one pass.

Each pattern gives literals of which every match holds one. One automaton over the
literals of all rules goes through a file's text once and tells the lines on which a rule can
match at all; a rule's patterns run on these lines only, and its globs once for a
file. Rules without such a literal run on every line of the files that their globs name. Rows
are files; nothing is shuffled, and only hits leave a task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from re import _constants as R
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalar as S

COMMENT = re.compile(r"^\s*(//|/\*|\*)", re.ASCII)


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals of two characters or more of which every match of the pattern holds at least one; None if there
    are none to tell."""
    try:
        parsed = _parser.parse(pattern)
    except (re.PatternError, OverflowError, RecursionError):
        return None
    if parsed.state.flags & (R.SRE_FLAG_IGNORECASE | R.SRE_FLAG_VERBOSE):
        return None
    best = max(_needs(parsed), key=lambda needs: (min(map(len, needs)), -len(needs)), default=None)
    return tuple(sorted(best)) if best and min(map(len, best)) >= 2 else None


def _needs(parsed) -> list[frozenset[str]]:
    """Sets of literals, of each of which a match holds at least one."""
    out: list[frozenset[str]] = []
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is R.LITERAL:
            run += chr(value)
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is R.SUBPATTERN:
            _, add, _, inside = value
            if not add & R.SRE_FLAG_IGNORECASE:
                out += _needs(inside)
        elif op is R.ATOMIC_GROUP:
            out += _needs(value)
        elif op in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT) and value[0] > 0:
            out += _needs(value[2])
        elif op is R.BRANCH:
            branches = [max(_needs(b), key=lambda needs: min(map(len, needs)), default=None) for b in value[1]]
            if all(branches):
                out.append(frozenset().union(*branches))
    return out


class Matcher:
    """The rules over one file at a time. rules: id, patterns, ignore, files (globs), and tests (True: test code
    only, False: other code only, None: all lines, comments included)."""

    def __init__(self, rules: list[dict], marks: Callable[[str, str], list[bool]]):
        compiled = lambda ps: [re.compile(p, re.ASCII) for p in ps]
        self.rules = [(compiled(r["patterns"]), compiled(r.get("ignore", ())), r["tests"]) for r in rules]
        self.globs = [([re.compile(S.glob_to_regex(g)) for g in r.get("files", ()) if g[0] != "!"], [re.compile(S.glob_to_regex(g[1:])) for g in r.get("files", ()) if g[0] == "!"]) for r in rules]
        self.marks, self.always = marks, []
        literals: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            needed = [required_literals(p) for p in r["patterns"]]
            if all(needed):
                for x in {x for n in needed for x in n}:
                    literals.setdefault(x, []).append(k)
            else:
                self.always.append(k)
        self.automaton = ahocorasick.Automaton()
        for x, of in literals.items():
            self.automaton.add_word(x, of)
        self.automaton.make_automaton()

    def applies(self, k: int, path: str) -> bool:
        yes, no = self.globs[k]
        return (not yes or any(g.search(path) for g in yes)) and not any(g.search(path) for g in no)

    def hits(self, path: str, text: str) -> Iterator[tuple[int, int]]:
        """(line from 1, rule by its place) in order."""
        lines = text.split("\n")
        starts = [0, *accumulate(len(line) + 1 for line in lines)]
        wanted = {(bisect_right(starts, end), k) for end, of in (self.automaton.iter(text) if len(self.automaton) else ()) for k in of}
        chosen = {k for k in {k for _, k in wanted} | set(self.always) if self.applies(k, path)}
        wanted = {(n, k) for n, k in wanted if k in chosen} | {(n, k) for k in self.always if k in chosen for n in range(1, len(lines) + 1)}
        marks = None
        for n, k in sorted(wanted):
            patterns, ignored, tests = self.rules[k]
            line = lines[n - 1]
            if not any(p.search(line) for p in patterns) or any(p.search(line) for p in ignored):
                continue
            if tests is not None:
                if COMMENT.search(line):
                    continue
                if marks is None:
                    marks = self.marks(path, text)
                if marks[n - 1] != tests:
                    continue
            yield n, k


def rule_hits(files: DataFrame, rules: list[dict], marks: Callable[[str, str], list[bool]]) -> DataFrame:
    """(path, line_no, rule, category, severity, message): one row for each rule and line that one of the rule's
    patterns matches and none of its ignores. files: path, text; a null text has no lines."""
    fields = T.StructType([files.schema["path"], T.StructField("line_no", T.IntegerType()), T.StructField("k", T.IntegerType())])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, marks)
        for batch in batches:
            found = [(p, n, k) for p, t in zip(*(c.to_pylist() for c in batch.columns)) if t for n, k in matcher.hits(p or "", t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

    of = lambda name: F.get(F.array(*[F.lit(r[name]) for r in rules]), F.col("k"))
    found = files.select("path", "text").mapInArrow(run, fields)
    return found.select("path", "line_no", of("id").alias("rule"), *[of(c).alias(c) for c in ("category", "severity", "message")])
