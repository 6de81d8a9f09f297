"""Constructor syntax: a document tree as nested constructors, and back."""

from __future__ import annotations

import json
import re
from typing import Any

from folioflow.sources.ast import document

#: Nodes whose payload is a list of separate arguments.
PRODUCT = frozenset("Header CodeBlock RawBlock OrderedList Figure Div Quoted Cite Code Math RawInline Link Image Span".split())


def text(s: str) -> str:
    return json.dumps(s, ensure_ascii=True)


def attr(a: list[Any]) -> str:
    return f"( {text(a[0])} , {seq([text(c) for c in a[1]])} , {seq([f'( {text(k)} , {text(v)} )' for k, v in a[2]])} )"


def seq(xs: list[str]) -> str:
    return "[ " + " , ".join(xs) + " ]" if xs else "[]"


def nodes(xs: list[Any]) -> str:
    return seq([show(x) for x in xs])


def caption(c: list[Any]) -> str:
    short = "Nothing" if c[0] is None else f"(Just {nodes(c[0])})"
    return f"(Caption {short} {nodes(c[1])})"


def row(r: list[Any]) -> str:
    cells = [f"Cell {attr(c[0])} {c[1]['t']} (RowSpan {c[2]}) (ColSpan {c[3]}) {nodes(c[4])}" for c in r[1]]
    return f"Row {attr(r[0])} {seq(cells)}"


def show(n: dict[str, Any]) -> str:
    t, c = n["t"], n.get("c")
    if c is None:
        return t
    if t in ("Str",):
        return f"Str {text(c)}"
    if t == "Header":
        return f"Header {c[0]} {attr(c[1])} {nodes(c[2])}"
    if t in ("CodeBlock", "Code"):
        return f"{t} {attr(c[0])} {text(c[1])}"
    if t in ("RawBlock", "RawInline"):
        return f"{t} (Format {text(c[0])}) {text(c[1])}"
    if t == "Math":
        return f"Math {c[0]['t']} {text(c[1])}"
    if t in ("Div", "Span"):
        return f"{t} {attr(c[0])} {nodes(c[1])}"
    if t in ("Link", "Image"):
        return f"{t} {attr(c[0])} {nodes(c[1])} ( {text(c[2][0])} , {text(c[2][1])} )"
    if t == "Quoted":
        return f"Quoted {c[0]['t']} {nodes(c[1])}"
    if t == "OrderedList":
        return f"OrderedList ( {c[0][0]} , {c[0][1]['t']} , {c[0][2]['t']} ) {seq([nodes(i) for i in c[1]])}"
    if t in ("BulletList", "LineBlock"):
        return f"{t} {seq([nodes(i) for i in c])}"
    if t == "DefinitionList":
        return f"{t} " + seq([f"( {nodes(a)} , {seq([nodes(d) for d in ds])} )" for a, ds in c])
    if t == "Figure":
        return f"Figure {attr(c[0])} {caption(c[1])} {nodes(c[2])}"
    if t == "Table":
        specs = [f"( {a['t']} , {w['t'] if 'c' not in w else '(ColWidth ' + repr(float(w['c'])) + ')'} )" for a, w in c[2]]
        bodies = [f"TableBody {attr(b[0])} (RowHeadColumns {b[1]}) {seq([row(r) for r in b[2]])} {seq([row(r) for r in b[3]])}" for b in c[4]]
        return f"Table {attr(c[0])} {caption(c[1])} {seq(specs)} (TableHead {attr(c[3][0])} {seq([row(r) for r in c[3][1]])}) {seq(bodies)} (TableFoot {attr(c[5][0])} {seq([row(r) for r in c[5][1]])})"
    if t == "Cite":
        cites = [f"Citation {{ citationId = {text(x['citationId'])} , citationPrefix = {nodes(x['citationPrefix'])} , citationSuffix = {nodes(x['citationSuffix'])} , citationMode = {x['citationMode']['t']} , citationNoteNum = {x['citationNoteNum']} , citationHash = {x['citationHash']} }}" for x in c[0]]
        return f"Cite {seq(cites)} {nodes(c[1])}"
    return f"{t} {nodes(c)}"


def write(doc: dict[str, Any]) -> str:
    return "[ " + "\n, ".join(map(show, doc["blocks"])) + "\n]" if doc["blocks"] else "[]"


TOKEN = re.compile(r"\s+|(?P<str>\"(?:[^\"\\]|\\.)*\")|(?P<num>-?\d+(?:\.\d+)?(?:e-?\d+)?)|(?P<name>[A-Za-z]\w*)|(?P<mark>[\[\](){},=])", re.S)


def read(s: str) -> dict[str, Any]:
    """A block list in constructor syntax; anything else raises ValueError."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(s):
        m = TOKEN.match(s, at)
        if not m:
            raise ValueError(f"unexpected character at {at}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    pos = 0

    def take(mark: str | None = None) -> tuple[str, str]:
        nonlocal pos
        if pos >= len(tokens) or (mark and tokens[pos][1] != mark):
            raise ValueError(f"expected {mark or 'more'} at token {pos}")
        pos += 1
        return tokens[pos - 1]

    def items(end: str) -> list[Any]:
        out = []
        if tokens[pos : pos + 1] and tokens[pos][1] == end:
            take()
            return out
        while True:
            out.append(value(True))
            if take()[1] == end:
                return out

    def value(args: bool) -> Any:
        kind, t = take()
        if kind == "str":
            return json.loads(re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", t))
        if kind == "num":
            return float(t) if "." in t or "e" in t else int(t)
        if t == "[":
            return items("]")
        if t == "(":
            got = items(")")
            return got[0] if len(got) == 1 else got
        if kind != "name":
            raise ValueError(f"unexpected {t}")
        if tokens[pos : pos + 1] == [("mark", "{")]:
            take()
            rec: dict[str, Any] = {}
            while True:
                key = take()[1]
                take("=")
                rec[key] = value(True)
                if take()[1] == "}":
                    return rec
        given = []
        while args and pos < len(tokens) and (tokens[pos][0] in ("str", "num", "name") or tokens[pos][1] in "[("):
            given.append(value(False))
        if t == "Nothing":
            return None
        if t in ("Just", "Format", "RowSpan", "ColSpan", "RowHeadColumns"):
            return given[0]
        if t in ("Caption", "TableHead", "TableBody", "TableFoot", "Row", "Cell"):
            return given
        if not given:
            return {"t": t}
        return {"t": t, "c": given if t in PRODUCT or t == "Table" else given[0]}

    got = value(True)
    if pos != len(tokens) or not isinstance(got, list):
        raise ValueError("not a list of blocks")
    return document(got)
