"""Whole files: metadata layers merged, sections numbered, a table of contents, and the body put into a template."""

from __future__ import annotations

from typing import Any

from folioflow.operators import template
from folioflow.sources.ast import Node, attr, change, node, plain
from folioflow.writers import text

#: Default templates by format.
TEMPLATES = {
    "html": """<!DOCTYPE html>
<html$if(lang)$ lang="$lang$"$endif$>
<head>
<meta charset="utf-8" />
$for(author)$
<meta name="author" content="$author$" />
$endfor$
<title>$if(pagetitle)$$pagetitle$$else$$title$$endif$</title>
$if(highlighting-css)$
<style>
$highlighting-css$
</style>
$endif$
</head>
<body>
$if(title)$
<header>
<h1 class="title">$title$</h1>
$for(author)$
<p class="author">$author$</p>
$endfor$
$if(date)$
<p class="date">$date$</p>
$endif$
</header>
$endif$
$if(toc)$
<nav id="TOC" role="doc-toc">
$toc$
</nav>
$endif$
$body$
</body>
</html>
""",
    "latex": """\\documentclass{article}
\\usepackage{hyperref}
\\usepackage{longtable,booktabs}
\\usepackage{graphicx}
$if(title)$
\\title{$title$}
$endif$
$if(author)$
\\author{$for(author)$$author$$sep$ \\and $endfor$}
$endif$
$if(date)$
\\date{$date$}
$endif$
\\begin{document}
$if(title)$
\\maketitle
$endif$
$if(toc)$
\\tableofcontents
$endif$
$body$
\\end{document}
""",
    "plain": """$if(title)$
$title$

$endif$
$body$
""",
}


def merge_metadata(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers replace whole keys of earlier ones."""
    out: dict[str, Any] = {}
    for layer in layers:
        out |= layer
    return dict(sorted(out.items()))


def value(meta: Any, writer: text.Writer) -> Any:
    """A metadata value as the template sees it."""
    if not isinstance(meta, dict) or "t" not in meta:
        return meta if isinstance(meta, (str, bool, list, dict)) else str(meta)
    t, c = meta["t"], meta.get("c")
    if t == "MetaInlines":
        return writer.para(c, 10**6)
    if t == "MetaBlocks":
        return writer.blocks(c, 72)
    if t == "MetaList":
        return [value(x, writer) for x in c]
    if t == "MetaMap":
        return {k: value(v, writer) for k, v in c.items()}
    return c


class Counter:
    """Dotted section numbers from the shallowest level on; a skipped level reads 0."""

    def __init__(self, blocks: list[Node]):
        self.base = min([b["c"][0] for b in flat(blocks)] or [1])
        self.counts = [0] * 7

    def next(self, level: int, classes: list[str]) -> str | None:
        if "unnumbered" in classes:
            return None
        level = min(max(level, 1), 6)
        self.counts[level] += 1
        for k in range(level + 1, 7):
            self.counts[k] = 0
        return ".".join(map(str, self.counts[self.base : level + 1]))


def flat(blocks: list[Node]) -> list[Node]:
    """Headings at the top level and in Divs, in order."""
    out = []
    for b in blocks:
        if b["t"] == "Header":
            out.append(b)
        elif b["t"] == "Div":
            out += flat(b["c"][1])
    return out


def number_sections(doc: dict[str, Any]) -> dict[str, Any]:
    """Headings get their number as an attribute; an authored one stays, though it counts."""
    count = Counter(doc["blocks"])
    given = {}
    for h in flat(doc["blocks"]):
        given[id(h)] = count.next(h["c"][0], h["c"][1][1])

    def walk(blocks: list[Node]) -> list[Node]:
        out = []
        for b in blocks:
            if b["t"] == "Header" and given.get(id(b)):
                a = b["c"][1]
                kv = a[2] if any(k == "number" for k, _ in a[2]) else [["number", given[id(b)]], *a[2]]
                out.append(node("Header", [b["c"][0], [a[0], a[1], kv], b["c"][2]]))
            elif b["t"] == "Div":
                out.append(node("Div", [b["c"][0], walk(b["c"][1])]))
            else:
                out.append(b)
        return out

    return {**doc, "blocks": walk(doc["blocks"])}


def toc(doc: dict[str, Any], depth: int = 3) -> Node | None:
    """A nested list of links to the headings of at most `depth`; notes are dropped, links unwrapped."""
    drop = lambda n: node("Str", "") if n["t"] == "Note" else node("Span", [attr(), n["c"][1]]) if n["t"] == "Link" else n
    entries = [(h["c"][0], node("Plain", [node("Link", [attr(), change(h["c"][2], drop), ["#" + h["c"][1][0], ""]])] if h["c"][1][0] else change(h["c"][2], drop))) for h in flat(doc["blocks"]) if h["c"][0] <= depth]

    def nest(xs: list[tuple[int, Node]]) -> list[list[Node]]:
        out: list[list[Node]] = []
        k = 0
        while k < len(xs):
            j = k + 1
            while j < len(xs) and xs[j][0] > xs[k][0]:
                j += 1
            inner = nest(xs[k + 1 : j])
            out.append([xs[k][1], *([node("BulletList", inner)] if inner else [])])
            k = j
        return out

    return node("BulletList", nest(entries)) if entries else None


def wrap(doc: dict[str, Any], to: str = "html", source: str | None = None, with_toc: bool = False, depth: int = 3, numbered: bool = False, variables: dict[str, Any] | None = None, defaults: dict[str, Any] | None = None, overrides: dict[str, Any] | None = None) -> str:
    """The document as a whole file in the format, by its default template or `source`."""
    doc = {**doc, "meta": merge_metadata(defaults or {}, doc.get("meta", {}), overrides or {})}
    if numbered:
        doc = number_sections(doc)
    kind = "html" if to.startswith("html") else "latex" if to == "latex" else "plain"
    writer = text.CLASSES.get(to, text.Writer)()
    context = {k: value(v, writer) for k, v in doc["meta"].items()}
    context["body"] = text.write(doc, to)
    if "title" in context and isinstance(doc["meta"]["title"], dict) and doc["meta"]["title"].get("t") == "MetaInlines":
        context["pagetitle"] = plain(doc["meta"]["title"]["c"])
    if with_toc and (made := toc(doc, depth)):
        context["toc"] = writer.block(made, 72)
    context |= variables or {}
    return template.parse(source or TEMPLATES[kind]).render(context)
