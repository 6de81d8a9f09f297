"""The document tree as plain dicts: {"t": tag, "c": payload}. Builders, walks and projections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

Node = dict[str, Any]
API_VERSION = [1, 23, 1, 2]
NO_ATTR: list[Any] = ["", [], []]
BLOCKS = frozenset("Plain Para LineBlock CodeBlock RawBlock BlockQuote OrderedList BulletList DefinitionList Header HorizontalRule Table Figure Div".split())


def node(tag: str, c: Any = None) -> Node:
    return {"t": tag} if c is None else {"t": tag, "c": c}


def attr(ident: str = "", classes: list[str] | None = None, kv: list[list[str]] | None = None) -> list[Any]:
    return [ident, classes or [], kv or []]


def document(blocks: list[Node], meta: dict[str, Any] | None = None) -> dict[str, Any]:
    return {"pandoc-api-version": API_VERSION, "meta": meta or {}, "blocks": blocks}


_BLANKS = re.compile(r"([ \t\n]+)")
#: Shared nodes: nobody changes a blank in place.
SPACE, SOFT_BREAK = {"t": "Space"}, {"t": "SoftBreak"}


def text_inlines(s: str) -> list[Node]:
    """Words as Str, blanks as Space, line ends as SoftBreak."""
    if "\n" not in s and "\t" not in s and "  " not in s:
        words = s.split(" ")
        blanks = [SPACE] * (len(words) - 1)
    else:
        parts = _BLANKS.split(s)
        words = parts[::2]
        blanks = [SOFT_BREAK if "\n" in x else SPACE for x in parts[1::2]]
    out: list[Node] = [SPACE] * (2 * len(words) - 1)
    out[::2] = [{"t": "Str", "c": w} for w in words]
    out[1::2] = blanks
    if not words[-1]:
        out.pop()
    return out if words[0] else out[1:]


def trim(inlines: list[Node]) -> list[Node]:
    a, z = 0, len(inlines)
    while a < z and inlines[a]["t"] in ("Space", "SoftBreak"):
        a += 1
    while z > a and inlines[z - 1]["t"] in ("Space", "SoftBreak", "LineBreak"):
        z -= 1
    return inlines[a:z]


def merge(inlines: list[Node]) -> list[Node]:
    """Adjacent Str as one, adjacent blanks as one."""
    out: list[Node] = []
    last = ""
    for n in inlines:
        t = n["t"]
        if t == "Str":
            if last == "Str":
                out[-1] = {"t": "Str", "c": out[-1]["c"] + n["c"]}
                continue
        elif (t == "Space" or t == "SoftBreak") and (last == "Space" or last == "SoftBreak"):
            if t == "SoftBreak":
                out[-1], last = n, t
            continue
        out.append(n)
        last = t
    return out


def plain(inlines: list[Node]) -> str:
    """Texts, codes and formulas; breaks as blanks; raw passages and notes left out."""
    out = []
    for n in inlines:
        t, c = n["t"], n.get("c")
        if t == "Str":
            out.append(c)
        elif t in ("Code", "Math"):
            out.append(c[1])
        elif t in ("Space", "SoftBreak", "LineBreak"):
            out.append(" ")
        elif t in ("Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps"):
            out.append(plain(c))
        elif t in ("Quoted", "Cite", "Link", "Image", "Span"):
            inner = plain(c[1])
            out.append(("‘%s’" if c[0]["t"] == "SingleQuote" else "“%s”") % inner if t == "Quoted" else inner)
    return "".join(out)


def walk(x: Any) -> Iterator[Node]:
    """Every node below x, in document order."""
    if isinstance(x, dict):
        if "t" in x:
            yield x
            x = x.get("c")
            yield from walk(x)
        else:
            for v in x.values():
                yield from walk(v)
    elif isinstance(x, list):
        for v in x:
            yield from walk(v)


def change(x: Any, f: Callable[[Node], Node]) -> Any:
    """A copy of x with f applied to every node, children first."""
    if isinstance(x, dict):
        made = {k: change(v, f) for k, v in x.items()}
        return f(made) if "t" in made else made
    return [change(v, f) for v in x] if isinstance(x, list) else x


def table(head: list[list[Node]], rows: list[list[list[Node]]], aligns: list[str], caption: list[Node] | None = None) -> Node:
    """A table without spans; cells are block lists."""
    cell = lambda blocks: [NO_ATTR, node("AlignDefault"), 1, 1, blocks]
    row = lambda cells: [NO_ATTR, [cell(b) for b in cells]]
    specs = [[node(a), node("ColWidthDefault")] for a in aligns]
    return node("Table", [NO_ATTR, [None, caption or []], specs, [NO_ATTR, [row(head)] if head else []], [[NO_ATTR, 0, [], [row(r) for r in rows]]], [NO_ATTR, []]])
