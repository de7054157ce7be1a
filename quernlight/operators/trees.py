"""Syntax trees of brace languages as a table of nodes, numbered in pre-order.

A node's subtree is the range of ids from its own to `last`; its post-order number is
`last - depth`. So ancestors and descendants are range conditions, answered by one
ordered pass over each file's nodes (syntax.select_nodes) and not by a walk."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

NODE = "path string, id long, last long, depth long, parent long, kind string, name string, field string, start_line long, end_line long"


@dataclass(frozen=True)
class Grammar:
    """What words begin which nodes. items: with names, at the start of a statement.
    blocks: control flow, anywhere. values: up to the statement's end. data: items whose
    bodies declare and don't call. method: the kind of a call that a body follows.
    lines: a line's end may end a statement. headers: `;` may stand before a body."""

    root: str
    items: dict
    blocks: dict
    values: dict
    data: tuple = ()
    functions: tuple = ()
    method: str | None = None
    wrappers: tuple = ()
    continued: tuple = (("if", "else"), ("try", "catch"), ("try", "finally"), ("do", "while"))
    quotes: str = "\""
    lines: bool = False
    headers: bool = False


#: Kinds of nodes as the public grammars of these languages name them.
RUST = Grammar(
    "source_file",
    {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item", "impl": "impl_item", "mod": "mod_item",
     "use": "use_declaration", "const": "const_item", "static": "static_item", "type": "type_item", "let": "let_declaration"},
    {"if": "if_expression", "for": "for_expression", "while": "while_expression", "loop": "loop_expression", "match": "match_expression", "unsafe": "unsafe_block"},
    {"return": "return_expression", "break": "break_expression"}, ("struct_item", "enum_item", "union_item"), ("function_item",),
)
JAVASCRIPT = Grammar(
    "program",
    {"function": "function_declaration", "class": "class_declaration", "import": "import_statement", "export": "export_statement",
     "let": "lexical_declaration", "const": "lexical_declaration", "var": "variable_declaration"},
    {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "try": "try_statement", "catch": "catch_clause"},
    {"return": "return_statement", "throw": "throw_statement"}, (), ("function_declaration", "function_expression", "arrow_function"), "method_definition", ("export_statement",),
    quotes="\"'`", lines=True,
)
TYPESCRIPT = Grammar(
    **{**JAVASCRIPT.__dict__, "items": JAVASCRIPT.items | {"interface": "interface_declaration", "enum": "enum_declaration", "namespace": "internal_module"}, "data": ("interface_declaration", "enum_declaration")}
)
GO = Grammar(
    "source_file",
    {"func": "function_declaration", "type": "type_declaration", "import": "import_declaration", "package": "package_clause", "var": "var_declaration", "const": "const_declaration"},
    {"if": "if_statement", "for": "for_statement", "switch": "expression_switch_statement", "select": "select_statement"},
    {"return": "return_statement", "go": "go_statement", "defer": "defer_statement"}, (), ("function_declaration",), None, (), quotes="\"`", lines=True, headers=True,
)
JAVA = Grammar(
    "program",
    {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "import": "import_declaration", "package": "package_declaration"},
    {"if": "if_statement", "for": "for_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_expression", "try": "try_statement", "catch": "catch_clause"},
    {"return": "return_statement", "throw": "throw_statement"}, (), (), "method_declaration", (),
)
CPP = Grammar(
    "translation_unit",
    {"class": "class_specifier", "struct": "struct_specifier", "enum": "enum_specifier", "namespace": "namespace_definition", "using": "using_declaration"},
    {"if": "if_statement", "for": "for_range_loop", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "try": "try_statement", "catch": "catch_clause"},
    {"return": "return_statement", "throw": "throw_statement"}, ("enum_specifier",), (), "function_definition", (),
)
GRAMMARS = {"rs": RUST, "js": JAVASCRIPT, "jsx": JAVASCRIPT, "mjs": JAVASCRIPT, "ts": TYPESCRIPT, "tsx": TYPESCRIPT, "go": GO, "java": JAVA, "cpp": CPP, "cc": CPP, "cxx": CPP, "hpp": CPP, "h": CPP}

_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|=>|->|::|[^\s\w]")
_STATEMENT, _BODY = re.compile(r"[;\n]"), re.compile(r"[{;]")
_WORD = re.compile(r"[A-Za-z_$]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: What may stand between a method's parameters and its body.
_BETWEEN = re.compile(r"[A-Za-z_$0-9:,.<>|\[\]&*?]+$|->$|::$")


def blank(grammar: Grammar, text: str) -> str:
    """The text with comments as spaces and literals as zeros; lines and places stay."""
    literals = ["\"(?:\\\\.|[^\"\\\\])*\""]
    literals += [q for c, q in (("'", "'(?:\\\\.|[^'\\\\\n])*'"), ("`", "`(?:\\\\.|[^`\\\\])*`")) if c in grammar.quotes]
    if "'" not in grammar.quotes:
        literals += ["'(?:\\\\[^\n']+|\\\\'|[^'\\\\\n])'"]
    raw = ["r(#*)\".*?\"\\2"] if grammar is RUST else []
    comment = r"(//[^\n]*|/\*.*?(?:\*/|\Z))"
    return re.sub("|".join([comment, *raw, *literals]), lambda m: re.sub(r"[^\n]", " " if m[1] else "0", m.group()), text, flags=re.S)


def parse(grammar: Grammar, text: str) -> list[list]:
    """[parent, kind, name, field, start, end] of all nodes in pre-order; places are
    offsets. Brackets that don't match are passed over, open ones end with the text."""
    code = blank(grammar, text)
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(code)]
    bodies = set(grammar.blocks.values()) | {grammar.method} | {v for k, v in grammar.items.items() if k not in ("use", "import", "let", "const", "var", "static", "using", "package")} | set(grammar.functions)
    bodies -= set(grammar.wrappers)
    named, values = set(grammar.items.values()) | set(grammar.functions), set(grammar.values.values())
    words = set(grammar.items) | set(grammar.blocks) | set(grammar.values) | {"else", "in", "as", "where", "finally", "await", "new", "move", "mut", "pub", "async", "dyn", "ref"}
    goes_on = {}
    for word, then in grammar.continued:
        if word in grammar.blocks:
            goes_on.setdefault(grammar.blocks[word], set()).add(then)
    rows: list[list] = [[-1, grammar.root, None, "", 0, len(code)]]
    # bracket, its node, whether that node is its own, nodes that wait for their end, no calls
    frames: list[tuple] = [("", 0, False, [], False)]
    plain: set[int] = set()  # arrow functions without a body in braces
    called = (-1, -1)  # the last call and the token that ended it

    def begin(kind: str, name: str | None, field: str, at: int) -> int:
        waits = frames[-1][3]
        rows.append([waits[-1] if waits else frames[-1][1], kind, name, field, at, None])
        return len(rows) - 1

    def finish(waits: list, end: int, kinds: set | None = None) -> None:
        while waits and (kinds is None or rows[waits[-1]][1] in kinds):
            rows[waits.pop()][5] = end

    def leave(end: int) -> int | None:
        _, node, own, waits, _ = frames.pop()
        finish(waits, end)
        if own:
            rows[node][5] = end
        return node if own else None

    def enter(bracket: str, node: int | None, quiet: bool = False) -> None:
        bracket_, base, _, waits, still = frames[-1]
        frames.append((bracket, node if node is not None else waits[-1] if waits else base, node is not None, [], quiet or still))

    for k, (t, at) in enumerate(tokens):
        bracket, _, _, waits, quiet = frames[-1]
        before, behind = tokens[k - 1][0] if k else ";", tokens[k + 1][0] if k + 1 < len(tokens) else ""
        end_before = tokens[k - 1][1] + len(before) if k else 0
        word = bool(_WORD.match(t))
        if grammar.lines and waits and bracket in ("", "{") and (word or t == "}") and "\n" in code[end_before:at] and re.match(r"[\w$)\]}]", before) and before not in words:
            while waits and rows[waits[-1]][1] not in bodies:
                rows[waits.pop()][5] = end_before
        top = rows[waits[-1]] if waits else None
        head = top is not None and top[1] in bodies and waits[-1] not in plain
        if t in ("(", "["):
            node, still = None, False
            if before == "#" or (before == "!" and k > 1 and tokens[k - 2][0] == "#"):
                node, still = begin("attribute_item", behind or None, "", at), True
            elif before == "!" and k > 1 and _WORD.match(tokens[k - 2][0]):
                node = begin("macro_invocation", tokens[k - 2][0], "", tokens[k - 2][1])
            elif t == "(" and head and top[1] in grammar.functions and top[1] != "arrow_function":
                node = begin("parameters", None, "parameters", at)
            elif t == "(" and not quiet and not (head and top[1] in named) and _WORD.match(before) and before not in words:
                node = begin("call_expression", before, "", tokens[k - 1][1])
            enter(t, node, still)
        elif t == "{":
            if grammar.method and not head and bracket in ("", "{") and called[1] >= 0 and rows[called[0]][0] == (waits[-1] if waits else frames[-1][1]) and all(_BETWEEN.match(x) for x, _ in tokens[called[1] + 1 : k]):
                rows[called[0]][1:3] = [grammar.method, rows[called[0]][2]]
                waits.append(called[0])
                top, head = rows[called[0]], True
            if before == "!" and k > 1 and _WORD.match(tokens[k - 2][0]):
                enter(t, begin("macro_invocation", tokens[k - 2][0], "", tokens[k - 2][1]))
            elif head:
                enter(t, begin("block", None, "alternative" if before == "else" else "body", at), top[1] in grammar.data)
            else:
                enter(t, begin("block" if before in (";", "{", "}", "=>", "|", "else", "async", "move") else "braces", None, "", at))
        elif t in _CLOSES:
            if not any(f[0] == _CLOSES[t] for f in frames):
                continue
            while frames[-1][0] != _CLOSES[t]:
                leave(at)
            node = leave(at + 1)
            waits = frames[-1][3]
            if node is not None and rows[node][1] == "call_expression":
                called = (node, k)
            if t == "}" and waits and rows[waits[-1]][1] in bodies and node is not None and rows[node][3] in ("body", "alternative"):
                while waits and rows[waits[-1]][1] in bodies and behind not in goes_on.get(rows[waits[-1]][1], ()):
                    nested = rows[waits.pop()]
                    nested[5] = at + 1
                    if not (waits and nested[3] == "alternative"):
                        break
                finish(waits, at + 1, set(grammar.wrappers))
        elif t == ";":
            finish(waits, at + 1, set(named | values) if grammar.headers else None)
            called = (-1, -1)
        elif t in (",", "="):
            called = (-1, -1)
            if t == ",":
                finish(waits, at, values | {"arrow_function"})
        elif t == "->" and head and top[1] in grammar.functions:
            leaf = begin("type", behind or None, "return_type", at)
            rows[leaf][5] = at + 2
        elif t == "=>" and "arrow_function" in grammar.functions:
            waits.append(begin("arrow_function", None, "", at))
            if behind != "{":
                plain.add(waits[-1])
        elif word:
            if before in (".", "::") or (behind == ":" and grammar.lines):
                pass
            elif t in grammar.blocks and not (head and top[1] in named):
                if not (t == "unsafe" and behind != "{") and not (t == "for" and behind == "<") and not (t == "while" and top is not None and top[1] == grammar.blocks.get("do")):
                    waits.append(begin(grammar.blocks[t], None, "alternative" if before == "else" else "", at))
                continue
            elif t in grammar.values:
                waits.append(begin(grammar.values[t], None, "", at))
                continue
            elif t in grammar.items and bracket in ("", "{") and (top is None or top[1] in grammar.wrappers) and not (t == "const" and behind in ("fn", "unsafe", "async", "extern")):
                name = None
                if t in ("use", "import", "package", "using"):
                    stop = _STATEMENT.search(code, at)
                    name = " ".join(text[at + len(t) : stop.start() if stop else len(text)].split()) or None
                elif t == "impl":
                    stop = _BODY.search(code, at)
                    said = re.split(r"\bwhere\b", code[at + 4 : stop.start() if stop else len(code)])[0]
                    name = re.sub(r"<.*", "", re.sub(r"^\s*<[^{]*?>\s+", "", re.split(r"\bfor\b", said)[-1]), flags=re.S).strip() or None
                waits.append(begin(grammar.items[t], name, "", at))
                continue
            elif t in ("function", "class") and t in grammar.items and not (head and top[1] in named):
                waits.append(begin("function_expression" if t == "function" else "class", None, "", at))
                continue
            if top is not None and top[2] is None and top[1] in named and t not in words and top[1] not in ("arrow_function", *grammar.wrappers):
                top[2] = t
    while frames:
        leave(len(code))
    return rows


def numbered(parents: list[int]) -> tuple[list[int], list[int]]:
    """The last id of each subtree and the depth, from parents in pre-order."""
    last, depth = list(range(len(parents))), [0] * len(parents)
    for k in range(1, len(parents)):
        depth[k] = depth[parents[k]] + 1
    for k in range(len(parents) - 1, 0, -1):
        last[parents[k]] = max(last[parents[k]], last[k])
    return last, depth


def rows_of(path: str, text: str, nodes: list[list], kinds: frozenset | None = None) -> list[tuple]:
    """Rows of NODE from parents in pre-order and places; of some kinds only, if they are given."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    last, depth = numbered([n[0] for n in nodes])
    line = lambda at: bisect_right(starts, at)
    return [
        (path, k, last[k], depth[k], parent, kind, name, field, line(a), line(max(a, b - 1)))
        for k, (parent, kind, name, field, a, b) in enumerate(nodes)
        if kinds is None or kind in kinds
    ]


def nodes(files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Rows of NODE, of all kinds or only those given (numbers stay those of whole trees), of all files (path, text) in a language of GRAMMARS, told by the
    path's extension; null texts and other files give none. Calls begin at the name that
    is called, so the calls of a chain are siblings; expressions without words of their
    own are no nodes, and regular expressions of JavaScript aren't told from divisions."""

    chosen = None if kinds is None else frozenset(kinds)

    def run(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                grammar = GRAMMARS.get(path.rpartition(".")[2].lower()) if path else None
                if grammar is not None and text is not None:
                    out += rows_of(path, text, parse(grammar, text), chosen)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])

    return files.select("path", "text").mapInPandas(run, NODE)
