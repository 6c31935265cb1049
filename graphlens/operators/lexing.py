"""What is code in a source text: comments and texts in quotes set apart, and Python read by its own parser."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from functools import cache

# Per language: line comments, block comments, and texts in quotes as (opening,
# closing, escape, hole). A hole holds code inside a text; it ends with the
# bracket that matches its own.
C_COMMENTS = (("//",), (("/*", "*/"),))
HASH = (("#",), ())
DOUBLE, SINGLE = ('"', '"', "\\", ""), ("'", "'", "\\", "")
HOLES = {"{": "}", "(": ")"}
SYNTAX: dict[str, tuple] = {
    "python": (*HASH, (('"""', '"""', "\\", ""), ("'''", "'''", "\\", ""), DOUBLE, SINGLE)),
    "javascript": (*C_COMMENTS, (("`", "`", "\\", "${"), DOUBLE, SINGLE)),
    "rust": (*C_COMMENTS, (('r#"', '"#', "", ""), DOUBLE)),
    "go": (*C_COMMENTS, (("`", "`", "", ""), DOUBLE, SINGLE)),
    "java": (*C_COMMENTS, (('"""', '"""', "\\", ""), DOUBLE, SINGLE)),
    "csharp": (*C_COMMENTS, (('$"', '"', "\\", "{"), ('@"', '"', "", ""), DOUBLE, SINGLE)),
    "kotlin": (*C_COMMENTS, (('"""', '"""', "", "${"), ('"', '"', "\\", "${"), SINGLE)),
    "scala": (*C_COMMENTS, (('"""', '"""', "", "${"), ('"', '"', "\\", "${"))),
    "swift": (*C_COMMENTS, (('"""', '"""', "\\", "\\("), ('"', '"', "\\", "\\("))),
    "php": (("//", "#"), (("/*", "*/"),), (('"', '"', "\\", "{"), SINGLE)),
    "dart": (*C_COMMENTS, (("'''", "'''", "\\", "${"), ('"""', '"""', "\\", "${"), ('"', '"', "\\", "${"), ("'", "'", "\\", "${"))),
    "ruby": (("#",), (("\n=begin", "\n=end"),), (('"', '"', "\\", "#{"), ("`", "`", "\\", "#{"), SINGLE)),
    "perl": (("#",), (("\n=pod", "\n=cut"), ("\n=head", "\n=cut")), (DOUBLE, SINGLE)),
    "lua": (("--",), (("--[[", "]]"),), (("[[", "]]", "", ""), DOUBLE, SINGLE)),
    "powershell": (("#",), (("<#", "#>"),), (('"', '"', "`", "$("), ("'", "'", "", ""))),
    "julia": (("#",), (("#=", "=#"),), (('"""', '"""', "\\", "$("), ('"', '"', "\\", "$("))),
    "nix": (("#",), (("/*", "*/"),), (("''", "''", "", "${"), ('"', '"', "\\", "${"))),
    "r": (*HASH, (DOUBLE, SINGLE)),
    "zig": (("//",), (), (DOUBLE, SINGLE)),
}
DEFAULT = (*C_COMMENTS, (DOUBLE, SINGLE))
# Whole things that open no text although they hold a quote: characters in Rust, patterns in JavaScript.
WHOLE = {
    "rust": r"'(?:\\[^']+|[^'\\\n])'",
    "javascript": r"(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*",
}
ONE_LINE = ('"', "'", '$"')


@cache
def _openers(lang: str) -> re.Pattern:
    lines, blocks, texts = SYNTAX.get(lang, DEFAULT)
    plain = sorted({*lines, *(b[0] for b in blocks), *(t[0] for t in texts), "{", "}", "(", ")"}, key=lambda x: (-len(x), x))
    return re.compile("|".join([*([f"(?P<whole>{WHOLE[lang]})"] if lang in WHOLE else ["(?P<whole>(?!))"]), *map(re.escape, plain)]))


@cache
def _inside(text: tuple) -> re.Pattern:
    opening, closing, escape, hole = text
    parts = [re.escape(hole)] if hole else []
    if escape:
        parts.append(re.escape(escape) + r"[\s\S]")
    parts.append(re.escape(closing))
    return re.compile("|".join(parts) + (r"|\n" if opening in ONE_LINE else ""))


def spans(code: str, lang: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether a comment) of everything that is not code, in order."""
    lines, blocks, texts = SYNTAX.get(lang, DEFAULT)
    closing, kinds = dict(blocks), {t[0]: t for t in texts}
    openers, out = _openers(lang), []
    stack: list[list] = [[None, "", "", 0]]  # [text or None for code, bracket that nests, bracket that closes, depth]
    at, start = 0, 0
    while at < len(code):
        text, nests, closes, depth = stack[-1]
        if text is None:
            m = openers.search(code, at)
            if not m:
                break
            token, at = m[0], m.end()
            if m["whole"]:
                out.append((m.start(), at, False))
                continue
            if token in closing:
                end = code.find(closing[token], at)
                end = len(code) if end < 0 else end + len(closing[token])
                out.append((m.start(), end, True))
                at = end
            elif token in lines:
                end = code.find("\n", at)
                at = len(code) if end < 0 else end
                out.append((m.start(), at, True))
            elif token in kinds:
                stack.append([kinds[token], "", "", 0])
                start = at
            elif token == nests:
                stack[-1][3] += 1
            elif token == closes:
                if depth:
                    stack[-1][3] -= 1
                else:
                    stack.pop()
                    start = at
        else:
            m = _inside(text).search(code, at)
            if not m:
                out.append((start, len(code), False))
                break
            at = m.end()
            if m[0] == text[1] or m[0] == "\n":
                at -= m[0] == "\n"
                out.append((start, m.start(), False))
                stack.pop()
            elif text[3] and m[0] == text[3]:
                out.append((start, m.start(), False))
                bracket = text[3][-1]
                stack.append([None, bracket, HOLES[bracket], 0])
    return out


def apart(code: str, lang: str) -> tuple[str, str]:
    """The text without comments, and without what stands in quotes either; lines and columns stay."""
    bare, plain, at = [], [], 0
    for a, b, comment in spans(code, lang):
        blank = re.sub(r"[^\n]", " ", code[a:b])
        bare += [code[at:a], blank]
        plain += [code[at:a], blank if comment else code[a:b]]
        at = b
    return "".join([*plain, code[at:]]), "".join([*bare, code[at:]])


def segments(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, cut further after braces and semicolons outside of brackets, and the line each part is on.

    Parts after the first of a line are set in by a blank, as what they hold is
    inside of something.
    """
    parts, at, depth = [], [], 0
    for k, line in enumerate(text.split("\n")):
        last = 0
        for m in re.finditer(r"[(){};]", line):
            depth = max(0, depth + (m[0] == "(") - (m[0] == ")"))
            cut = m.start() if m[0] == "}" else m.end()
            if m[0] in "{};" and not depth and line[last:cut].strip():
                parts.append(" " * (last > 0) + line[last:cut])
                at.append(k)
                last = cut
        if last == 0 or line[last:].strip():
            parts.append(" " * (last > 0) + line[last:])
            at.append(k)
    return parts, at


def use_leaves(tree: str, before: str = "") -> list[dict]:
    """The leaves of a Rust use tree, groups in groups at any depth."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(tree):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(tree[last:i])
            last = i + 1
    out = []
    for part in (p.strip() for p in [*parts, tree[last:]]):
        if part.endswith("}") and "{" in part:
            head, _, inner = part.partition("{")
            out += use_leaves(inner[:-1], before + head.strip())
        elif part:
            name, _, alias = re.sub(r"\s+", " ", part).partition(" as ")
            full = before + name.strip()
            out.append({"module": full.removesuffix("::self"), "alias": alias.strip() or None, "is_relative": False})
    return out


def read_python(code: str, module: str) -> dict | None:
    """Functions, classes, calls and imports of a Python text, or None if it is none.

    Bodies of functions hold no definitions and imports of their own; all calls in
    them, those of inner functions too, are the outer function's.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = [x.encode() for x in re.split(r"\r\n|\r|\n", code)]
    out: dict[str, list] = {"functions": [], "classes": [], "calls": [], "imports": []}

    def body_of(node) -> bytes:
        rows = lines[node.lineno - 1 : node.end_lineno]
        rows[-1] = rows[-1][: node.end_col_offset]
        rows[0] = rows[0][node.col_offset :]
        return b"\n".join(rows)

    def doc(node) -> str | None:
        text = ast.get_docstring(node, clean=False)
        return text.strip("\"' \n") if text else None

    todo = [(n, ()) for n in reversed(tree.body)]
    while todo:
        node, parents = todo.pop()
        full = lambda name, parents=parents: ".".join((module, *parents, name))
        if isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "alias": a.asname, "is_relative": False} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            before = "." * node.level + (node.module or "")
            out["imports"] += [
                {"module": f"{before}.{a.name}", "alias": a.asname, "is_relative": node.level > 0} for a in node.names if a.name != "*"
            ]
        elif isinstance(node, ast.ClassDef):
            out["classes"].append({
                "name": node.name, "qualified_name": full(node.name), "start_line": node.lineno, "end_line": node.end_lineno, "doc": doc(node),
            })
            todo += [(n, (*parents, node.name)) for n in reversed(node.body)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            caller = full(node.name)
            out["functions"].append({
                "name": node.name, "qualified_name": caller, "start_line": node.lineno, "end_line": node.end_lineno, "is_method": bool(parents),
                "is_async": isinstance(node, ast.AsyncFunctionDef), "body_sha": hashlib.sha1(body_of(node)).hexdigest(),
                "class_qname": ".".join((module, *parents)) if parents else None, "doc": doc(node),
            })
            found: dict[tuple, int] = {}
            for call in (c for part in node.body for c in ast.walk(part) if isinstance(c, ast.Call)):
                name = getattr(call.func, "id", None) or getattr(call.func, "attr", None)
                if name:
                    key = (name, call.func.lineno)
                    at = len(lines[call.func.lineno - 1][: call.func.col_offset].decode(errors="replace"))
                    found[key] = max(found.get(key, 0), at)
            out["calls"] += [{"caller_qname": caller, "callee_name": n, "line": k, "character": at} for (n, k), at in found.items()]
        else:
            todo += [(n, parents) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, (ast.stmt, ast.excepthandler, ast.match_case))]
    return out


def block_ends(text: str, starts: list[int]) -> list[int]:
    """For every line a definition starts on, the line its braces end on; -1 where it has none.

    The braces of a definition are the first after it that open before a statement
    ends outside of brackets.
    """
    opened: list[int] = []
    ends: dict[int, int] = {}
    line_at = [0, *(m.end() for m in re.finditer("\n", text))]
    events: list[tuple[int, str]] = [(m.start(), m[0]) for m in re.finditer(r"[{}();]", text)]
    for at, c in events:
        if c == "{":
            opened.append(at)
        elif c == "}" and opened:
            ends[opened.pop()] = at
    k = 0
    order = sorted(range(len(starts)), key=lambda i: starts[i])
    result = [-1] * len(starts)
    for i in order:
        begin = line_at[starts[i]]
        while k < len(events) and events[k][0] < begin:
            k += 1
        round_, j = 0, k
        while j < len(events):
            at, c = events[j]
            if c == "(":
                round_ += 1
            elif c == ")":
                round_ -= 1
            elif c == "{" and round_ <= 0:
                end = ends.get(at, len(text) - 1)
                result[i] = bisect_right(line_at, end) - 1
                break
            elif c == "{":
                # a default value or type in the parameters
                j_end = ends.get(at)
                while j + 1 < len(events) and j_end is not None and events[j + 1][0] <= j_end:
                    j += 1
            elif c in ";}" and round_ <= 0:
                break
            j += 1
    return result
