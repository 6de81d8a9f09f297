"""Writers of text formats. One class walks the tree; each format says how its blocks and inlines look."""

from __future__ import annotations

import html
import json
import re
from typing import Any

from folioflow import deep
from folioflow.functions import text as T
from folioflow.operators import options
from folioflow.sources.ast import Node, plain, walk
from folioflow.writers.layout import BLANK, HARD, SOFT, fill, indent, marker, pad, width


def chain(s: str, pairs: T.Pairs) -> str:
    for a, b in pairs:
        s = s.replace(a, b)
    return s


def cells_of(c: list[Any]) -> tuple[list[list[Node]], list[list[list[Node]]], list[str], list[Node]]:
    """Head cells, rows, alignments and caption blocks of a table payload; spans are laid out as single cells."""
    rows = lambda part: [[cell[4] for cell in r[1]] for r in part]
    head = rows(c[3][1])
    body = [r for b in c[4] for r in [*rows(b[2]), *rows(b[3])]] + rows(c[5][1])
    n = len(c[2])
    full = lambda r: (r + [[]] * n)[:n]
    return full(head[0]) if head else [], [full(r) for r in head[1:] + body], [s[0]["t"] for s in c[2]], c[1][1]


class Writer:
    """The plain-text format, and the base of all others."""

    wrap = "auto"
    columns = 72
    escapes: T.Pairs = []
    hard_break = "\n"

    def __init__(self, wrap: str = "auto", columns: int = 72, ext: frozenset[str] = frozenset()):
        self.wrap, self.columns, self.ext = wrap, columns, ext
        self.notes: list[str] = []

    # ------------------------------------------------------------ documents

    def document(self, doc: dict[str, Any]) -> str:
        body = self.blocks(doc["blocks"], self.columns)
        return "\n\n".join(x for x in (body, self.note_section()) if x)

    def note_section(self) -> str:
        return "\n\n".join(indent(n, f"[{i}] ", "") for i, n in enumerate(self.notes, 1))

    def blocks(self, blocks: list[Node], w: int) -> str:
        return "\n\n".join(x for x in (self.block(b, w) for b in blocks) if x)

    def tight(self, items: list[list[Node]]) -> bool:
        return all(not i or i[0]["t"] == "Plain" for i in items)

    def items(self, items: list[list[Node]], heads: list[str], w: int) -> str:
        made = []
        for i, h in zip(items, heads, strict=True):
            tight = self.tight([i])
            inner = ("\n" if tight else "\n\n").join(x for x in (self.block(b, w - len(h)) for b in i) if x)
            made.append(indent(inner, h, " " * len(h)))
        return ("\n" if self.tight(items) else "\n\n").join(made)

    def block(self, b: Node, w: int) -> str:
        return getattr(self, "b_" + b["t"])(b.get("c"), w)

    def para(self, inlines: list[Node], w: int) -> str:
        return fill(self.inlines(inlines), w, self.wrap, self.hard_break)

    def b_Plain(self, c, w):
        return self.para(c, w)

    def b_Para(self, c, w):
        return self.para(c, w)

    def b_Header(self, c, w):
        return self.para(c[2], w)

    def b_LineBlock(self, c, w):
        return "\n".join(fill(self.inlines(x), w, "none") for x in c)

    def b_CodeBlock(self, c, w):
        return indent(c[1], "    ", "    ")

    def b_RawBlock(self, c, w):
        return ""

    def b_BlockQuote(self, c, w):
        return indent(self.blocks(c, w - 2), "  ", "  ")

    def b_BulletList(self, c, w):
        return self.items(c, ["- "] * len(c), w)

    def b_OrderedList(self, c, w):
        (start, style, delim), items = c
        heads = [marker(start + k, style["t"], delim["t"]) + " " for k in range(len(items))]
        n = max([len(h) for h in heads] + [4])
        return self.items(items, [h.ljust(n) for h in heads], w)

    def b_DefinitionList(self, c, w):
        out = []
        for term, defs in c:
            body = "\n\n".join(indent(self.blocks(d, w - 2), "  ", "  ") for d in defs)
            out.append(self.para(term, w) + "\n\n" + body)
        return "\n\n".join(out)

    def b_HorizontalRule(self, c, w):
        return "-" * w

    def b_Div(self, c, w):
        return self.blocks(c[1], w)

    def b_Figure(self, c, w):
        return self.blocks([*c[2], *c[1][1]], w)

    def cell(self, blocks: list[Node]) -> str:
        return " ".join(self.blocks(blocks, 10**6).split("\n"))

    def b_Table(self, c, w):
        head, rows, aligns, caption = cells_of(c)
        lines = [[self.cell(x) for x in r] for r in ([head] if head else []) + rows]
        n = [max([width(r[i]) for r in lines] + [1]) + (2 if head else 0) for i in range(len(aligns))]
        put = lambda r: " ".join(pad(x, k, a) for x, k, a in zip(r, n, aligns, strict=True)).rstrip()
        rule = " ".join("-" * k for k in n)
        out = [put(lines[0]), rule, *map(put, lines[1:])] if head else [rule, *map(put, lines), rule]
        note = "\n\n" + "  : " + self.blocks(caption, w) if caption else ""
        return "\n".join("  " + x for x in out) + note

    # ------------------------------------------------------------ inlines

    def inlines(self, xs: list[Node]) -> str:
        """Runs of words and blanks are escaped at once: escapes look at no character across a blank."""
        out, run = [], []
        for x in xs:
            t = x["t"]
            if t == "Str":
                run.append(x["c"])
            elif t == "Space":
                run.append(BLANK)
            elif t == "SoftBreak":
                run.append(SOFT)
            else:
                if run:
                    out.append(self.escape("".join(run)))
                    run = []
                out.append(getattr(self, "i_" + t)(x.get("c")))
        if run:
            out.append(self.escape("".join(run)))
        return "".join(out)

    def escape(self, s: str) -> str:
        return chain(s, self.escapes)

    def wrapped(self, a: str, c: list[Node], z: str | None = None) -> str:
        return a + self.inlines(c) + (a if z is None else z)

    def i_Str(self, c):
        return self.escape(c)

    def i_Space(self, c):
        return BLANK

    def i_SoftBreak(self, c):
        return SOFT

    def i_LineBreak(self, c):
        return HARD

    def i_Emph(self, c):
        return self.wrapped("_", c)

    def i_Strong(self, c):
        return self.inlines(c).upper()

    def i_Underline(self, c):
        return self.wrapped("_", c)

    def i_Strikeout(self, c):
        return self.wrapped("~~", c)

    def i_Superscript(self, c):
        return self.wrapped("^(", c, ")")

    def i_Subscript(self, c):
        return self.wrapped("_(", c, ")")

    def i_SmallCaps(self, c):
        return self.inlines(c).upper()

    def i_Quoted(self, c):
        return self.wrapped("‘", c[1], "’") if c[0]["t"] == "SingleQuote" else self.wrapped("“", c[1], "”")

    def i_Cite(self, c):
        return self.inlines(c[1])

    def i_Code(self, c):
        return c[1]

    def i_Math(self, c):
        return c[1]

    def i_RawInline(self, c):
        return ""

    def i_Link(self, c):
        return self.inlines(c[1])

    def i_Image(self, c):
        return "[" + self.inlines(c[1]) + "]"

    def i_Span(self, c):
        return self.inlines(c[1])

    def i_Note(self, c):
        n = len(self.notes)
        self.notes.append("")
        self.notes[n] = self.blocks(c, self.columns)
        return f"[{n + 1}]"


class Html(Writer):
    """HTML fragments; flavour 4 has no figure element."""

    five = True

    def attrs(self, a: list[Any], more: str = "") -> str:
        out = f' id="{html.escape(a[0])}"' if a[0] else ""
        if a[1]:
            out += f' class="{html.escape(" ".join(a[1]))}"'
        return out + "".join(f' {k if k in ("width", "height", "style", "lang", "title", "start", "type", "role", "dir") or k.startswith("data-") else "data-" + k}="{html.escape(v)}"' for k, v in a[2]) + more

    def document(self, doc):
        return "\n".join(x for x in (self.blocks(doc["blocks"], self.columns), self.note_section()) if x)

    def note_section(self):
        if not self.notes:
            return ""
        items = "\n".join(f'<li id="fn{i}">{self._back(n, i)}</li>' for i, n in enumerate(self.notes, 1))
        tag = "section" if self.five else "div"
        return f'<{tag} id="footnotes" class="footnotes footnotes-end-of-document" role="doc-endnotes">\n<hr />\n<ol>\n{items}\n</ol>\n</{tag}>'

    def _back(self, n: str, i: int) -> str:
        link = f'<a href="#fnref{i}" class="footnote-back" role="doc-backlink">↩︎</a>'
        return n[:-4] + link + "</p>" if n.endswith("</p>") else n + "\n" + link

    def blocks(self, blocks, w):
        return "\n".join(x for x in (self.block(b, w) for b in blocks) if x)

    def escape(self, s):
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def para(self, inlines, w):
        return fill(self.inlines(inlines), w, self.wrap, "<br />\n")

    def b_Para(self, c, w):
        return f"<p>{self.para(c, w)}</p>" if c else ""

    def b_Header(self, c, w):
        return f"<h{c[0]}{self.attrs(c[1])}>{self.para(c[2], w)}</h{c[0]}>" if 1 <= c[0] <= 6 else f'<p class="heading"{self.attrs(c[1])}>{self.para(c[2], w)}</p>'

    def b_LineBlock(self, c, w):
        return '<div class="line-block">' + "<br />\n".join(fill(self.inlines(x), w, "none") for x in c) + "</div>"

    def b_CodeBlock(self, c, w):
        return f"<pre{self.attrs(c[0])}><code>{self.escape(c[1])}</code></pre>"

    def b_RawBlock(self, c, w):
        return c[1] if c[0] in ("html", "html4", "html5") else ""

    def b_BlockQuote(self, c, w):
        return f"<blockquote>\n{self.blocks(c, w)}\n</blockquote>"

    def li(self, blocks, w):
        if blocks and blocks[0]["t"] in ("Plain", "Para") and blocks[0]["c"] and blocks[0]["c"][0].get("c") in ("☐", "☒"):
            box = '<input type="checkbox"' + (' checked=""' if blocks[0]["c"][0]["c"] == "☒" else "") + " />"
            text = self.para(blocks[0]["c"][2:], w)
            inner = f"<label>{box}{text}</label>" if blocks[0]["t"] == "Plain" else f"<p><label>{box}{text}</label></p>"
            rest = self.blocks(blocks[1:], w)
            return "<li>" + inner + ("\n" + rest if rest else "") + "</li>"
        return f"<li>{self.blocks(blocks, w)}</li>"

    def b_BulletList(self, c, w):
        task = all(i and i[0]["t"] in ("Plain", "Para") and i[0]["c"] and i[0]["c"][0].get("c") in ("☐", "☒") for i in c)
        return f"<ul{' class=' + chr(34) + 'task-list' + chr(34) if task else ''}>\n" + "\n".join(self.li(i, w) for i in c) + "\n</ul>"

    def b_OrderedList(self, c, w):
        (start, style, _), items = c
        kind = {"Decimal": "1", "LowerAlpha": "a", "UpperAlpha": "A", "LowerRoman": "i", "UpperRoman": "I"}.get(style["t"])
        return f"<ol{f' start={chr(34)}{start}{chr(34)}' if start != 1 else ''}{f' type={chr(34)}{kind}{chr(34)}' if kind else ''}>\n" + "\n".join(self.li(i, w) for i in items) + "\n</ol>"

    def b_DefinitionList(self, c, w):
        out = []
        for term, defs in c:
            out.append(f"<dt>{self.para(term, w)}</dt>")
            out += [f"<dd>\n{self.blocks(d, w)}\n</dd>" for d in defs]
        return "<dl>\n" + "\n".join(out) + "\n</dl>"

    def b_HorizontalRule(self, c, w):
        return "<hr />"

    def b_Div(self, c, w):
        tag = "section" if self.five and "section" in c[0][1] else "div"
        return f"<{tag}{self.attrs(c[0])}>\n{self.blocks(c[1], w)}\n</{tag}>"

    def b_Figure(self, c, w):
        cap = self.blocks(c[1][1], w)
        if not self.five:
            return f'<div class="figure"{self.attrs(c[0])}>\n{self.blocks(c[2], w)}\n' + (f'<p class="caption">{cap}</p>\n' if cap else "") + "</div>"
        return f"<figure{self.attrs(c[0])}>\n{self.blocks(c[2], w)}\n" + (f"<figcaption>{cap}</figcaption>\n" if cap else "") + "</figure>"

    def b_Table(self, c, w):
        aligns = [s[0]["t"] for s in c[2]]

        def row(r, tag, k):
            out = []
            for i, cell in enumerate(r[1]):
                a = cell[1]["t"] if cell[1]["t"] != "AlignDefault" else aligns[i] if i < len(aligns) else "AlignDefault"
                style = f' style="text-align: {a[5:].lower()};"' if a != "AlignDefault" else ""
                span = (f' rowspan="{cell[2]}"' if cell[2] != 1 else "") + (f' colspan="{cell[3]}"' if cell[3] != 1 else "")
                out.append(f"<{tag}{self.attrs(cell[0])}{span}{style}>{self.blocks(cell[4], w)}</{tag}>")
            kind = ' class="header"' if tag == "th" else f' class="{"odd" if k % 2 == 0 else "even"}"'
            return f"<tr{self.attrs(r[0]) or kind}>\n" + "\n".join(out) + "\n</tr>"

        parts = []
        if c[1][1]:
            parts.append(f"<caption>{self.blocks(c[1][1], w)}</caption>")
        if any(s[1]["t"] == "ColWidth" for s in c[2]):
            parts.append("<colgroup>\n" + "\n".join(f'<col style="width: {int(s[1].get("c", 0) * 100)}%" />' for s in c[2]) + "\n</colgroup>")
        if c[3][1]:
            parts.append("<thead>\n" + "\n".join(row(r, "th", i) for i, r in enumerate(c[3][1])) + "\n</thead>")
        for b in c[4]:
            parts.append("<tbody>\n" + "\n".join([*(row(r, "th", i) for i, r in enumerate(b[2])), *(row(r, "td", i) for i, r in enumerate(b[3]))]) + "\n</tbody>")
        if c[5][1]:
            parts.append("<tfoot>\n" + "\n".join(row(r, "td", i) for i, r in enumerate(c[5][1])) + "\n</tfoot>")
        return f"<table{self.attrs(c[0])}>\n" + "\n".join(parts) + "\n</table>"

    def tag(self, name, c):
        return f"<{name}>{self.inlines(c)}</{name}>"

    def i_Emph(self, c):
        return self.tag("em", c)

    def i_Strong(self, c):
        return self.tag("strong", c)

    def i_Underline(self, c):
        return self.tag("u", c)

    def i_Strikeout(self, c):
        return self.tag("del", c)

    def i_Superscript(self, c):
        return self.tag("sup", c)

    def i_Subscript(self, c):
        return self.tag("sub", c)

    def i_SmallCaps(self, c):
        return f'<span class="smallcaps">{self.inlines(c)}</span>'

    def i_Code(self, c):
        return f"<code{self.attrs(c[0])}>{self.escape(c[1])}</code>"

    def i_Math(self, c):
        a, z = ("\\[", "\\]") if c[0]["t"] == "DisplayMath" else ("\\(", "\\)")
        return f'<span class="math {"display" if a == chr(92) + "[" else "inline"}">{a}{self.escape(c[1])}{z}</span>'

    def i_RawInline(self, c):
        return c[1] if c[0] in ("html", "html4", "html5") else ""

    def i_Cite(self, c):
        keys = " ".join(x["citationId"] for x in c[0])
        return f'<span class="citation" data-cites="{html.escape(keys)}">{self.inlines(c[1])}</span>'

    def i_Link(self, c):
        title = f' title="{html.escape(c[2][1])}"' if c[2][1] else ""
        return f'<a href="{html.escape(c[2][0])}"{self.attrs(c[0])}{title}>{self.inlines(c[1])}</a>'

    def i_Image(self, c):
        size = "".join(f"{k}:{v};" for k, v in c[0][2] if k in ("width", "height"))
        a = [c[0][0], c[0][1], [kv for kv in c[0][2] if kv[0] not in ("width", "height")] + ([["style", size]] if size else [])]
        title = f' title="{html.escape(c[2][1])}"' if c[2][1] else ""
        alt = f' alt="{html.escape(plain(c[1]))}"' if c[1] else ""
        return f'<img src="{html.escape(c[2][0])}"{title}{self.attrs(a)}{alt} />'

    def i_Span(self, c):
        for cls, tag in (("underline", "u"), ("mark", "mark"), ("kbd", "kbd")):
            if c[0][1] == [cls]:
                return self.tag(tag, c[1])
        return f"<span{self.attrs(c[0])}>{self.inlines(c[1])}</span>"

    def i_Note(self, c):
        super().i_Note(c)
        n = len(self.notes)
        return f'<a href="#fn{n}" class="footnote-ref" id="fnref{n}" role="doc-noteref"><sup>{n}</sup></a>'


class Html4(Html):
    five = False


class Markdown(Writer):
    """Markdown; what a dialect's options do not allow falls back to HTML or to plain text."""

    hard_break = "\\\n"

    def has(self, x: str) -> bool:
        return x in self.ext

    def as_html(self, node: Node, block: bool, w: int) -> str:
        h = Html(self.wrap, w)
        return h.block(node, w) if block else h.inlines([node])

    def attrs(self, a: list[Any]) -> str:
        parts = ([f"#{a[0]}"] if a[0] else []) + [f".{x}" for x in a[1]] + [f'{k}="{v}"' for k, v in a[2]]
        return "{" + " ".join(parts) + "}" if parts else ""

    def escape(self, s):
        if self.has("smart"):
            s = chain(s, T.SMART_TO_ASCII)
        s = re.sub(r"([\\`*_\[\]<])", r"\\\1", s)
        if self.has("tex_math_dollars"):
            s = s.replace("$", "\\$")
        if self.has("strikeout") or self.has("subscript"):
            s = s.replace("~", "\\~")
        if self.has("superscript"):
            s = s.replace("^", "\\^")
        return re.sub(r"&(?=#?\w+;)", r"\\&", s)

    def para(self, inlines, w):
        s = super().para(inlines, w)
        s = re.sub(r"(?m)^(#{1,6}|[+-]|>)(?=\s|$)", r"\\\1", s)
        return re.sub(r"(?m)^(\d{1,9})([.)])(?=\s|$)", r"\1\\\2", s)

    def note_section(self):
        return "\n\n".join(indent(n, f"[^{i}]: ", "    ") for i, n in enumerate(self.notes, 1))

    def b_Header(self, c, w):
        ident = self.attrs(c[1]) if self.has("header_attributes") and (c[1][1] or c[1][2]) else ""
        return "#" * min(c[0], 6) + " " + fill(self.inlines(c[2]), w, "none", " ") + (" " + ident if ident else "")

    def b_LineBlock(self, c, w):
        return "\n".join("| " + fill(self.inlines(x), w, "none") for x in c) if self.has("line_blocks") else "\\\n".join(fill(self.inlines(x), w, "none") for x in c)

    def b_CodeBlock(self, c, w):
        if not c[0][1] and not c[0][0] and not self.has("backtick_code_blocks"):
            return indent(c[1], "    ", "    ")
        n = max([3, *(len(r) + 1 for r in re.findall("`+", c[1]))])
        info = (" " + self.attrs(c[0])) if self.has("fenced_code_attributes") and (c[0][0] or c[0][2] or len(c[0][1]) > 1) else (" " + c[0][1][0] if c[0][1] else "")
        return f"{'`' * n}{info}\n{c[1]}\n{'`' * n}"

    def b_RawBlock(self, c, w):
        if c[0] in ("html", "html5") or c[0] == "markdown":
            return c[1]
        return f"```{{={c[0]}}}\n{c[1]}\n```" if self.has("raw_attribute") else ""

    def b_BlockQuote(self, c, w):
        return "\n".join("> " + x if x else ">" for x in self.blocks(c, w - 2).split("\n"))

    def b_BulletList(self, c, w):
        return self.items(c, ["- "] * len(c), w)

    def b_OrderedList(self, c, w):
        (start, style, delim), items = c
        fancy = self.has("fancy_lists")
        heads = [marker(start + k, style["t"] if fancy else "Decimal", delim["t"] if fancy or delim["t"] == "OneParen" else "Period") + " " for k in range(len(items))]
        return self.items(items, [h.ljust(4) if self.has("four_space_rule") or fancy else h for h in heads], w)

    def b_DefinitionList(self, c, w):
        if not self.has("definition_lists"):
            return self.as_html({"t": "DefinitionList", "c": c}, True, w)
        out = []
        for term, defs in c:
            tight = self.tight(defs)
            gap = "\n" if tight else "\n\n"
            out.append(self.para(term, w) + gap + gap.join(indent(self.blocks(d, w - 4), ":   ", "    ") for d in defs))
        return "\n\n".join(out)

    def b_Div(self, c, w):
        if self.has("fenced_divs"):
            return f":::{' ' + (c[0][1][0] if len(c[0][1]) == 1 and not c[0][0] and not c[0][2] else self.attrs(c[0]))}\n{self.blocks(c[1], w)}\n:::"
        return f"<div{Html().attrs(c[0])}>\n\n{self.blocks(c[1], w)}\n\n</div>" if self.has("raw_html") else self.blocks(c[1], w)

    def b_Figure(self, c, w):
        images = [x for x in walk(c[2]) if x["t"] == "Image"]
        if self.has("implicit_figures") and len(images) == 1:
            i = images[0]["c"]
            return self.para([{"t": "Image", "c": [[c[0][0], *i[0][1:]], i[1], i[2]]}], w)
        return self.as_html({"t": "Figure", "c": c}, True, w)

    def b_Table(self, c, w):
        head, rows, aligns, caption = cells_of(c)
        spans = any(x[2] != 1 or x[3] != 1 for r in [*c[3][1], *(r for b in c[4] for r in [*b[2], *b[3]]), *c[5][1]] for x in r[1])
        simple = all(len(x) <= 1 and all(b["t"] in ("Plain", "Para") for b in x) for r in [head, *rows] for x in r)
        if spans or not simple or not self.has("pipe_tables"):
            return self.as_html({"t": "Table", "c": c}, True, w)
        lines = [[self.cell(x).replace("|", "\\|") for x in r] for r in [head or [[]] * len(aligns), *rows]]
        n = [max(3, *(width(r[i]) for r in lines)) for i in range(len(aligns))]
        put = lambda r: "| " + " | ".join(pad(x, k, a) for x, k, a in zip(r, n, aligns, strict=True)) + " |"
        rule = "|" + "|".join((":" if a in ("AlignLeft", "AlignCenter") else "-") + "-" * k + (":" if a in ("AlignRight", "AlignCenter") else "-") for k, a in zip(n, aligns, strict=True)) + "|"
        note = f"\n\n  : {self.blocks(caption, w)}" if caption and self.has("table_captions") else f"\n\n{self.blocks(caption, w)}" if caption else ""
        return "\n".join([put(lines[0]), rule, *map(put, lines[1:])]) + note

    def i_Emph(self, c):
        return self.wrapped("*", c)

    def i_Strong(self, c):
        return self.wrapped("**", c)

    def i_Underline(self, c):
        return self.wrapped("[", c, "]{.underline}") if self.has("bracketed_spans") else self.wrapped("<u>", c, "</u>")

    def i_Strikeout(self, c):
        return self.wrapped("~~", c) if self.has("strikeout") else self.wrapped("<s>", c, "</s>")

    def i_Superscript(self, c):
        return self.wrapped("^", c) if self.has("superscript") else self.wrapped("<sup>", c, "</sup>")

    def i_Subscript(self, c):
        return self.wrapped("~", c) if self.has("subscript") else self.wrapped("<sub>", c, "</sub>")

    def i_SmallCaps(self, c):
        return self.wrapped("[", c, "]{.smallcaps}") if self.has("bracketed_spans") else self.wrapped('<span class="smallcaps">', c, "</span>")

    def i_Cite(self, c):
        if not self.has("citations"):
            return self.inlines(c[1])
        one = lambda x: "".join((self.inlines(x["citationPrefix"]) + BLANK if x["citationPrefix"] else "", "-" if x["citationMode"]["t"] == "SuppressAuthor" else "", "@" + x["citationId"], self.inlines(x["citationSuffix"])))
        if len(c[0]) == 1 and c[0][0]["citationMode"]["t"] == "AuthorInText":
            return one(c[0][0])
        return "[" + (";" + BLANK).join(map(one, c[0])) + "]"

    def i_Quoted(self, c):
        if self.has("smart"):
            return self.wrapped("'" if c[0]["t"] == "SingleQuote" else '"', c[1])
        return super().i_Quoted(c)

    def i_Code(self, c):
        n = max([0, *(len(r) for r in re.findall("`+", c[1]))]) + 1
        gap = " " if c[1].startswith("`") or c[1].endswith("`") else ""
        return "`" * n + gap + c[1] + gap + "`" * n + (self.attrs(c[0]) if self.has("inline_code_attributes") else "")

    def i_Math(self, c):
        d = "$$" if c[0]["t"] == "DisplayMath" else "$"
        return d + c[1] + d if self.has("tex_math_dollars") else c[1]

    def i_RawInline(self, c):
        return c[1] if c[0] in ("html", "html5") and self.has("raw_html") else f"`{c[1]}`{{={c[0]}}}" if self.has("raw_attribute") else ""

    def i_Link(self, c):
        label = plain(c[1])
        if not c[2][1] and (label == c[2][0] or "mailto:" + label == c[2][0]) and re.match(r"[A-Za-z][\w+.-]+:|.*@", c[2][0]):
            return f"<{label}>"
        title = ' "' + c[2][1].replace('"', '\\"') + '"' if c[2][1] else ""
        return "[" + self.inlines(c[1]) + "](" + c[2][0] + title + ")" + (self.attrs(c[0]) if self.has("link_attributes") else "")

    def i_Image(self, c):
        return "!" + self.i_Link([c[0], c[1] or [{"t": "Str", "c": ""}], c[2]]) if plain(c[1]) != c[2][0] else f"![{self.inlines(c[1])}]({c[2][0]})"

    def i_Span(self, c):
        if c[0][1] == ["emoji"] and c[0][2] and self.has("emoji"):
            return f":{c[0][2][0][1]}:"
        a = self.attrs(c[0])
        return self.wrapped("[", c[1], "]" + a) if a and self.has("bracketed_spans") else self.wrapped(f"<span{Html().attrs(c[0])}>", c[1], "</span>") if a and self.has("raw_html") else self.inlines(c[1])

    def i_Note(self, c):
        super().i_Note(c)
        return f"[^{len(self.notes)}]"


class Latex(Writer):
    escapes = T.LATEX
    hard_break = "\\\\\n"
    levels = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")

    def env(self, name: str, body: str, option: str = "") -> str:
        return f"\\begin{{{name}}}{option}\n{body}\n\\end{{{name}}}"

    def note_section(self):
        return ""

    def b_Header(self, c, w):
        if not 1 <= c[0] <= 5:
            return self.para(c[2], w)
        star = "*" if "unnumbered" in c[1][1] else ""
        label = f"\\label{{{c[1][0]}}}" if c[1][0] else ""
        return f"\\{self.levels[c[0] - 1]}{star}{{{self.para(c[2], w)}}}{label}"

    def b_CodeBlock(self, c, w):
        return self.env("verbatim", c[1])

    def b_RawBlock(self, c, w):
        return c[1] if c[0] in ("latex", "tex") else ""

    def b_BlockQuote(self, c, w):
        return self.env("quote", self.blocks(c, w))

    def item_list(self, items, w):
        gap = "\\tightlist\n" if self.tight(items) else ""
        return gap + "\n".join("\\item\n" + indent(self.blocks(i, w - 2), "  ", "  ") for i in items)

    def b_BulletList(self, c, w):
        return self.env("itemize", self.item_list(c, w))

    def b_OrderedList(self, c, w):
        (start, style, delim), items = c
        head = ""
        if style["t"] not in ("DefaultStyle", "Decimal") or delim["t"] not in ("DefaultDelim", "Period"):
            kind = {"LowerAlpha": "\\alph", "UpperAlpha": "\\Alph", "LowerRoman": "\\roman", "UpperRoman": "\\Roman"}.get(style["t"], "\\arabic")
            head = f"\\def\\labelenumi{{{marker(0, 'Decimal', delim['t']).replace('0', kind + '{enumi}')}}}\n"
        if start != 1:
            head += f"\\setcounter{{enumi}}{{{start - 1}}}\n"
        return self.env("enumerate", head + self.item_list(items, w))

    def b_DefinitionList(self, c, w):
        return self.env("description", "\n".join(f"\\item[{self.para(t, w)}]\n" + "\n\n".join(self.blocks(d, w) for d in ds) for t, ds in c))

    def b_HorizontalRule(self, c, w):
        return "\\begin{center}\\rule{0.5\\linewidth}{0.5pt}\\end{center}"

    def b_Figure(self, c, w):
        cap = self.blocks(c[1][1], w)
        return self.env("figure", "\\centering\n" + self.blocks(c[2], w) + (f"\n\\caption{{{cap}}}" if cap else "") + (f"\\label{{{c[0][0]}}}" if c[0][0] else ""))

    def b_Table(self, c, w):
        head, rows, aligns, caption = cells_of(c)
        spec = "".join({"AlignRight": "r", "AlignCenter": "c"}.get(a, "l") for a in aligns)
        put = lambda r: " & ".join(self.cell(x) for x in r) + " \\\\"
        lines = ([f"\\caption{{{self.blocks(caption, w)}}}\\tabularnewline"] if caption else []) + ["\\toprule\\noalign{}"] + ([put(head), "\\midrule\\noalign{}", "\\endhead"] if head else []) + [*map(put, rows), "\\bottomrule\\noalign{}"]
        return self.env("longtable", "\n".join(lines), f"[]{{@{{}}{spec}@{{}}}}")

    def cmd(self, name, c):
        return f"\\{name}{{{self.inlines(c)}}}"

    def i_Emph(self, c):
        return self.cmd("emph", c)

    def i_Strong(self, c):
        return self.cmd("textbf", c)

    def i_Underline(self, c):
        return self.cmd("ul", c)

    def i_Strikeout(self, c):
        return self.cmd("st", c)

    def i_Superscript(self, c):
        return self.cmd("textsuperscript", c)

    def i_Subscript(self, c):
        return self.cmd("textsubscript", c)

    def i_SmallCaps(self, c):
        return self.cmd("textsc", c)

    def i_Quoted(self, c):
        return self.wrapped("`", c[1], "'") if c[0]["t"] == "SingleQuote" else self.wrapped("``", c[1], "''")

    def i_Code(self, c):
        return f"\\texttt{{{self.escape(c[1])}}}"

    def i_Math(self, c):
        return f"\\[{c[1]}\\]" if c[0]["t"] == "DisplayMath" else f"\\({c[1]}\\)"

    def i_RawInline(self, c):
        return c[1] if c[0] in ("latex", "tex") else ""

    def i_Link(self, c):
        if plain(c[1]) == c[2][0]:
            return f"\\url{{{c[2][0]}}}"
        url = chain(c[2][0], [("\\", "\\\\"), ("%", "\\%"), ("#", "\\#")])
        return f"\\hyperref[{c[2][0][1:]}]{{{self.inlines(c[1])}}}" if c[2][0].startswith("#") else f"\\href{{{url}}}{{{self.inlines(c[1])}}}"

    def i_Image(self, c):
        return f"\\includegraphics{{{c[2][0]}}}"

    def i_Note(self, c):
        return f"\\footnote{{{self.blocks(c, self.columns)}}}"


class Rst(Writer):
    escapes = T.RST
    rules = "=-~^'\""

    def note_section(self):
        return "\n\n".join(indent(n, f".. [{i}] ", "   ") for i, n in enumerate(self.notes, 1))

    def b_Header(self, c, w):
        s = fill(self.inlines(c[2]), w, "none")
        return f"{s}\n{self.rules[min(c[0], 6) - 1] * width(s)}"

    def b_LineBlock(self, c, w):
        return "\n".join("| " + fill(self.inlines(x), w, "none") for x in c)

    def b_CodeBlock(self, c, w):
        head = f".. code:: {c[0][1][0]}" if c[0][1] else "::"
        return head + "\n\n" + indent(c[1], "   ", "   ")

    def b_RawBlock(self, c, w):
        return c[1] if c[0] == "rst" else f".. raw:: {c[0]}\n\n" + indent(c[1], "   ", "   ")

    def b_BlockQuote(self, c, w):
        return indent(self.blocks(c, w - 3), "   ", "   ")

    def b_HorizontalRule(self, c, w):
        return "--------------"

    def b_Div(self, c, w):
        return f".. container:: {' '.join(c[0][1])}\n\n" + indent(self.blocks(c[1], w - 3), "   ", "   ") if c[0][1] else self.blocks(c[1], w)

    def b_Figure(self, c, w):
        images = [x["c"] for x in walk(c[2]) if x["t"] == "Image"]
        return "\n\n".join(f".. figure:: {i[2][0]}\n   :alt: {plain(i[1])}\n\n" + indent(self.blocks(c[1][1], w - 3), "   ", "   ") for i in images)

    def b_DefinitionList(self, c, w):
        return "\n\n".join(self.para(t, w) + "\n" + "\n\n".join(indent(self.blocks(d, w - 3), "   ", "   ") for d in ds) for t, ds in c)

    def b_Table(self, c, w):
        head, rows, aligns, caption = cells_of(c)
        lines = [[self.cell(x) for x in r] for r in ([head] if head else []) + rows]
        n = [max([width(r[i]) for r in lines] + [1]) for i in range(len(aligns))]
        put = lambda r: " ".join(pad(x or ("\\" if not i else ""), k, "AlignLeft") for i, (x, k) in enumerate(zip(r, n, strict=True))).rstrip()
        rule = " ".join("=" * k for k in n)
        out = [rule, *([put(lines[0]), rule] if head else []), *map(put, lines[1 if head else 0 :]), rule]
        if caption:
            return f".. table:: {self.blocks(caption, w)}\n\n" + indent("\n".join(out), "   ", "   ")
        return "\n".join(out)

    def i_Emph(self, c):
        return self.wrapped("*", c)

    def i_Strong(self, c):
        return self.wrapped("**", c)

    def role(self, name, c):
        return f":{name}:`{self.inlines(c)}`"

    def i_Superscript(self, c):
        return self.role("sup", c)

    def i_Subscript(self, c):
        return self.role("sub", c)

    def i_Strikeout(self, c):
        return self.wrapped("[STRIKEOUT:", c, "]")

    def i_Code(self, c):
        return f"``{c[1]}``"

    def i_Math(self, c):
        return f":math:`{c[1]}`"

    def i_RawInline(self, c):
        return c[1] if c[0] == "rst" else f":raw-{c[0]}:`{c[1]}`"

    def i_Link(self, c):
        return c[2][0] if plain(c[1]) == c[2][0] else f"`{self.inlines(c[1])} <{c[2][0]}>`__"

    def i_Image(self, c):
        return f"|{plain(c[1]) or 'image'}|"

    def i_Note(self, c):
        super().i_Note(c)
        return f" [{len(self.notes)}]_"


class Wiki(Writer):
    """The family of wiki notations: prefix headings, prefix lists, one line a paragraph."""

    wrap = "none"
    heading = "{bar} {text} {bar}"
    bar = "="
    bullets, numbers = "*", "#"
    emph, strong, strike, code = ("''", "''"), ("'''", "'''"), ("<s>", "</s>"), ("<code>", "</code>")
    sup, sub = ("<sup>", "</sup>"), ("<sub>", "</sub>")
    block_code = "<syntaxhighlight lang=\"{lang}\">\n{text}\n</syntaxhighlight>"
    plain_code = "<pre>{text}</pre>"
    quote = "<blockquote>{text}</blockquote>"
    rule = "-----"

    def __init__(self, wrap="none", columns=72, ext=frozenset()):
        super().__init__("none", columns, ext)
        self.prefix = ""

    def note_section(self):
        return ""

    def b_Header(self, c, w):
        return self.heading.format(bar=self.bar * c[0], text=self.para(c[2], w), level=c[0])

    def b_CodeBlock(self, c, w):
        return self.block_code.format(lang=c[0][1][0], text=c[1]) if c[0][1] else self.plain_code.format(text=c[1])

    def b_BlockQuote(self, c, w):
        return self.quote.format(text=self.blocks(c, w))

    def b_HorizontalRule(self, c, w):
        return self.rule

    def wiki_list(self, items, mark, w):
        old, self.prefix = self.prefix, self.prefix + mark
        out = []
        for i in items:
            first = True
            for b in i:
                if b["t"] in ("BulletList", "OrderedList"):
                    out.append(self.block(b, w))
                else:
                    out.append((self.prefix + " " if first else "") + self.block(b, w))
                first = False
        self.prefix = old
        return "\n".join(out)

    def b_BulletList(self, c, w):
        return self.wiki_list(c, self.bullets, w)

    def b_OrderedList(self, c, w):
        return self.wiki_list(c[1], self.numbers, w)

    def b_DefinitionList(self, c, w):
        return "\n".join(f"; {self.para(t, w)}\n" + "\n".join(f": {self.cell(d)}" for d in ds) for t, ds in c)

    def b_Table(self, c, w):
        head, rows, _, caption = cells_of(c)
        out = ['{| class="wikitable"'] + ([f"|+ {self.blocks(caption, w)}"] if caption else [])
        if head:
            out += ["|-", *(f"! {self.cell(x)}" for x in head)]
        for r in rows:
            out += ["|-", *(f"| {self.cell(x)}" for x in r)]
        return "\n".join([*out, "|}"])

    def pair(self, p, c):
        return p[0] + self.inlines(c) + p[1]

    def i_Emph(self, c):
        return self.pair(self.emph, c)

    def i_Strong(self, c):
        return self.pair(self.strong, c)

    def i_Strikeout(self, c):
        return self.pair(self.strike, c)

    def i_Superscript(self, c):
        return self.pair(self.sup, c)

    def i_Subscript(self, c):
        return self.pair(self.sub, c)

    def i_Underline(self, c):
        return self.wrapped("<u>", c, "</u>")

    def i_Code(self, c):
        return self.code[0] + c[1] + self.code[1]

    def i_Link(self, c):
        return c[2][0] if plain(c[1]) == c[2][0] else f"[{c[2][0]} {self.inlines(c[1])}]"

    def i_Image(self, c):
        return f"[[File:{c[2][0]}|{self.inlines(c[1])}]]"

    def i_Math(self, c):
        return f"<math>{c[1]}</math>"

    def i_Note(self, c):
        return f"<ref>{self.blocks(c, self.columns)}</ref>"


class MediaWiki(Wiki):
    escapes = T.XML


class DokuWiki(Wiki):
    heading = "{bar} {text} {bar}"
    emph, strong, strike, code = ("//", "//"), ("**", "**"), ("<del>", "</del>"), ("''%%", "%%''")
    block_code, plain_code, rule = "<code {lang}>\n{text}\n</code>", "<code>\n{text}\n</code>", "----"

    def b_Header(self, c, w):
        bar = "=" * max(1, 7 - c[0])
        return f"{bar} {self.para(c[2], w)} {bar}"

    def wiki_list(self, items, mark, w):
        old, self.prefix = self.prefix, self.prefix + "  "
        out = [x for i in items for x in [*(([self.prefix + mark + " " + self.block(i[0], w)]) if i else []), *(self.block(b, w) for b in i[1:])]]
        self.prefix = old
        return "\n".join(out)

    bullets, numbers = "*", "-"

    def b_Table(self, c, w):
        head, rows, _, _ = cells_of(c)
        return "\n".join((["^ " + " ^ ".join(map(self.cell, head)) + " ^"] if head else []) + ["| " + " | ".join(map(self.cell, r)) + " |" for r in rows])

    def i_Link(self, c):
        return c[2][0] if plain(c[1]) == c[2][0] else f"[[{c[2][0]}|{self.inlines(c[1])}]]"

    def i_Image(self, c):
        return f"{{{{{c[2][0]}|{self.inlines(c[1])}}}}}"

    def i_Note(self, c):
        return f"(({self.cell(c)}))"


class Jira(Wiki):
    emph, strong, strike, code, sup, sub = ("_", "_"), ("*", "*"), ("-", "-"), ("{{", "}}"), ("^", "^"), ("~", "~")
    block_code, plain_code, quote, rule = "{{code:{lang}}}\n{text}\n{{code}}", "{{noformat}}\n{text}\n{{noformat}}", "{{quote}}\n{text}\n{{quote}}", "----"

    def b_Header(self, c, w):
        return f"h{c[0]}. {self.para(c[2], w)}"

    def b_Table(self, c, w):
        head, rows, _, _ = cells_of(c)
        return "\n".join((["||" + "||".join(map(self.cell, head)) + "||"] if head else []) + ["|" + "|".join(map(self.cell, r)) + "|" for r in rows])

    def i_Link(self, c):
        return f"[{c[2][0]}]" if plain(c[1]) == c[2][0] else f"[{self.inlines(c[1])}|{c[2][0]}]"

    def i_Image(self, c):
        return f"!{c[2][0]}!"


class Org(Writer):
    def note_section(self):
        return "\n\n".join(indent(n, f"[fn:{i}] ", "") for i, n in enumerate(self.notes, 1))

    def b_Header(self, c, w):
        drawer = f"\n:PROPERTIES:\n:CUSTOM_ID: {c[1][0]}\n:END:" if c[1][0] else ""
        return "*" * c[0] + " " + fill(self.inlines(c[2]), w, "none") + drawer

    def b_CodeBlock(self, c, w):
        body = re.sub(r"(?m)^([ \t]*)(\*|#\+)", r"\1,\2", c[1])
        return f"#+begin_src {c[0][1][0]}\n{body}\n#+end_src" if c[0][1] else f"#+begin_example\n{body}\n#+end_example"

    def b_BlockQuote(self, c, w):
        return f"#+begin_quote\n{self.blocks(c, w)}\n#+end_quote"

    def b_HorizontalRule(self, c, w):
        return "-----"

    def b_OrderedList(self, c, w):
        heads = [f"{c[0][0] + k}. " for k in range(len(c[1]))]
        return self.items(c[1], heads, w)

    def b_DefinitionList(self, c, w):
        return "\n".join(f"- {self.para(t, w)} :: " + indent("\n\n".join(self.blocks(d, w) for d in ds), "", "  ") for t, ds in c)

    def b_Table(self, c, w):
        head, rows, aligns, _ = cells_of(c)
        lines = [[self.cell(x) for x in r] for r in ([head] if head else []) + rows]
        n = [max([width(r[i]) for r in lines] + [1]) for i in range(len(aligns))]
        put = lambda r: "| " + " | ".join(pad(x, k, a) for x, k, a in zip(r, n, aligns, strict=True)) + " |"
        rule = "|" + "+".join("-" * (k + 2) for k in n) + "|"
        return "\n".join([put(lines[0]), rule, *map(put, lines[1:])] if head else map(put, lines))

    def i_Emph(self, c):
        return self.wrapped("/", c)

    def i_Strong(self, c):
        return self.wrapped("*", c)

    def i_Strikeout(self, c):
        return self.wrapped("+", c)

    def i_Superscript(self, c):
        return self.wrapped("^{", c, "}")

    def i_Subscript(self, c):
        return self.wrapped("_{", c, "}")

    def i_Code(self, c):
        return f"={c[1]}="

    def i_Math(self, c):
        return f"\\[{c[1]}\\]" if c[0]["t"] == "DisplayMath" else f"\\({c[1]}\\)"

    def i_Link(self, c):
        return f"[[{c[2][0]}]]" if plain(c[1]) == c[2][0] else f"[[{c[2][0]}][{self.inlines(c[1])}]]"

    def i_Image(self, c):
        return f"[[{c[2][0]}]]"

    def i_Note(self, c):
        super().i_Note(c)
        return f"[fn:{len(self.notes)}]"


class AsciiDoc(Writer):
    hard_break = " +\n"

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        self.level = 0

    def note_section(self):
        return ""

    def b_Header(self, c, w):
        return (f"[[{c[1][0]}]]\n" if c[1][0] else "") + "=" * (c[0] + 1) + " " + fill(self.inlines(c[2]), w, "none")

    def b_CodeBlock(self, c, w):
        return (f"[source,{c[0][1][0]}]\n" if c[0][1] else "") + f"----\n{c[1]}\n----"

    def b_BlockQuote(self, c, w):
        return f"____\n{self.blocks(c, w)}\n____"

    def b_HorizontalRule(self, c, w):
        return "'''''"

    def nested(self, items, mark, w):
        self.level += 1
        out = []
        for i in items:
            first, *rest = [self.block(b, w) for b in i] or [""]
            out.append("\n".join([f"{mark * self.level} {first}", *(r if b["t"].endswith("List") else "+\n" + r for r, b in zip(rest, i[1:], strict=True))]))
        self.level -= 1
        return "\n".join(out)

    def b_BulletList(self, c, w):
        return self.nested(c, "*", w)

    def b_OrderedList(self, c, w):
        return (f"[start={c[0][0]}]\n" if c[0][0] != 1 else "") + self.nested(c[1], ".", w)

    def b_DefinitionList(self, c, w):
        return "\n".join(f"{self.para(t, w)}::\n" + "\n".join(indent(self.blocks(d, w - 2), "  ", "  ") for d in ds) for t, ds in c)

    def b_Table(self, c, w):
        head, rows, _, caption = cells_of(c)
        out = ([f".{self.blocks(caption, w)}"] if caption else []) + (['[options="header",]'] if head else []) + ["|==="]
        return "\n".join([*out, *("|" + " |".join(map(self.cell, r)) for r in ([head] if head else []) + rows), "|==="])

    def i_Strong(self, c):
        return self.wrapped("*", c)

    def i_Strikeout(self, c):
        return self.wrapped("[line-through]#", c, "#")

    def i_Superscript(self, c):
        return self.wrapped("^", c)

    def i_Subscript(self, c):
        return self.wrapped("~", c)

    def i_Code(self, c):
        return f"`{c[1]}`"

    def i_Math(self, c):
        return f"latexmath:[{c[1]}]"

    def i_Link(self, c):
        return c[2][0] if plain(c[1]) == c[2][0] else f"{'' if '://' in c[2][0] else 'link:'}{c[2][0]}[{self.inlines(c[1])}]"

    def i_Image(self, c):
        return f"image:{c[2][0]}[{self.inlines(c[1])}]"

    def i_Note(self, c):
        return f"footnote:[{self.cell(c)}]"


class Man(Writer):
    escapes = T.MAN
    hard_break = "\n.PD 0\n.P\n.PD\n"

    def blocks(self, blocks, w):
        return "\n".join(x for x in (self.block(b, w) for b in blocks) if x)

    def document(self, doc):
        body = self.blocks(doc["blocks"], self.columns)
        return body + ("\n.SH NOTES\n" + "\n".join(f".SS [{i}]\n{n}" for i, n in enumerate(self.notes, 1)) if self.notes else "")

    def para(self, inlines, w):
        return re.sub(r"(?m)^([.'])", r"\\&\1", super().para(inlines, w))

    def b_Para(self, c, w):
        return ".PP\n" + self.para(c, w)

    def b_Header(self, c, w):
        return (".SH " if c[0] == 1 else ".SS ") + fill(self.inlines(c[2]), w, "none")

    def b_CodeBlock(self, c, w):
        return ".IP\n.EX\n" + re.sub(r"(?m)^([.'])", r"\\&\1", self.escape(c[1])) + "\n.EE"

    def b_BlockQuote(self, c, w):
        return f".RS\n{self.blocks(c, w)}\n.RE"

    def b_BulletList(self, c, w):
        return "\n".join(".IP \\[bu] 2\n" + self.blocks(i, w) for i in c)

    def b_OrderedList(self, c, w):
        return "\n".join(f'.IP "{marker(c[0][0] + k, c[0][1]["t"], c[0][2]["t"])}" 3\n' + self.blocks(i, w) for k, i in enumerate(c[1]))

    def b_DefinitionList(self, c, w):
        return "\n".join(f".TP\n{self.para(t, w)}\n" + "\n".join(self.blocks(d, w) for d in ds) for t, ds in c)

    def b_HorizontalRule(self, c, w):
        return ".PP\n   *   *   *   *   *"

    def b_Table(self, c, w):
        head, rows, aligns, _ = cells_of(c)
        spec = " ".join({"AlignRight": "r", "AlignCenter": "c"}.get(a, "l") for a in aligns)
        return "\n".join([".TS", "tab(@);", spec + ".", *(["@".join(map(self.cell, head)), "_"] if head else []), *("@".join(map(self.cell, r)) for r in rows), ".TE"])

    def font(self, f, c):
        return f"\\f{f}{self.inlines(c)}\\fR"

    def i_Emph(self, c):
        return self.font("I", c)

    def i_Strong(self, c):
        return self.font("B", c)

    def i_Code(self, c):
        return f"\\f[CR]{self.escape(c[1])}\\fR"

    def i_Link(self, c):
        return self.inlines(c[1]) if plain(c[1]) == c[2][0] else f"{self.inlines(c[1])} (\\c\n.UR {c[2][0]}\n.UE \\c\n)" if c[2][0] else self.inlines(c[1])


class Typst(Writer):
    escapes = [(x, "\\" + x) for x in "\\#*_`$<@[]~"]
    hard_break = " \\\n"

    def note_section(self):
        return ""

    def b_Header(self, c, w):
        return "=" * c[0] + " " + fill(self.inlines(c[2]), w, "none") + (f"\n<{c[1][0]}>" if c[1][0] else "")

    def b_CodeBlock(self, c, w):
        return f"```{c[0][1][0] if c[0][1] else ''}\n{c[1]}\n```"

    def b_BlockQuote(self, c, w):
        return f"#quote(block: true)[\n{self.blocks(c, w)}\n]"

    def b_OrderedList(self, c, w):
        return self.items(c[1], ["+ "] * len(c[1]), w)

    def b_DefinitionList(self, c, w):
        return "\n".join(f"/ {self.para(t, w)}: #block[\n" + "\n".join(self.blocks(d, w) for d in ds) + "\n]" for t, ds in c)

    def b_HorizontalRule(self, c, w):
        return "#horizontalrule"

    def b_Table(self, c, w):
        head, rows, aligns, caption = cells_of(c)
        align = ",".join({"AlignRight": "right", "AlignCenter": "center", "AlignLeft": "left"}.get(a, "auto") for a in aligns)
        put = lambda r: ", ".join(f"[{self.cell(x)}]" for x in r)
        return "\n".join(["#figure(", f"  align(center)[#table(\n    columns: {len(aligns)},\n    align: ({align},),", *([f"    table.header({put(head)},),"] if head else []), *(f"    {put(r)}," for r in rows), "  )]", *([f"  , caption: [{self.blocks(caption, w)}]"] if caption else []), "  , kind: table\n  )"])

    def i_Emph(self, c):
        return self.wrapped("#emph[", c, "]")

    def i_Strong(self, c):
        return self.wrapped("#strong[", c, "]")

    def i_Strikeout(self, c):
        return self.wrapped("#strike[", c, "]")

    def i_Superscript(self, c):
        return self.wrapped("#super[", c, "]")

    def i_Subscript(self, c):
        return self.wrapped("#sub[", c, "]")

    def i_Code(self, c):
        return f"`{c[1]}`"

    def i_Math(self, c):
        return f"$ {c[1]} $" if c[0]["t"] == "DisplayMath" else f"${c[1]}$"

    def i_Link(self, c):
        return f'#link("{c[2][0]}")' + ("" if plain(c[1]) == c[2][0] else f"[{self.inlines(c[1])}]")

    def i_Image(self, c):
        return f'#box(image("{c[2][0]}"))'

    def i_Note(self, c):
        return f"#footnote[{self.blocks(c, self.columns)}]"


def opml(doc: dict[str, Any]) -> str:
    """The outline of headings; what stands under one becomes its Markdown note."""
    md = Markdown(ext=options.WRITE["markdown"])
    out, open_levels = ['<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', "<head></head>", "<body>"], []
    groups: list[tuple[Node, list[Node]]] = []
    for b in doc["blocks"]:
        if b["t"] == "Header":
            groups.append((b, []))
        elif groups:
            groups[-1][1].append(b)
    for h, own in groups:
        while open_levels and open_levels[-1] >= h["c"][0]:
            open_levels.pop()
            out.append("</outline>")
        note = md.blocks(own, 72)
        text = html.escape(plain(h["c"][2]))
        out.append(f'<outline text="{text}"' + (f' _note="{html.escape(note).replace(chr(10), "&#10;")}"' if note else "") + ">")
        open_levels.append(h["c"][0])
    return "\n".join([*out, *["</outline>"] * len(open_levels), "</body>", "</opml>"])


def ipynb(doc: dict[str, Any]) -> str:
    """Code blocks become code cells, everything between them Markdown cells."""
    cells: list[dict[str, Any]] = []
    run: list[Node] = []
    lines = lambda s: s.splitlines(keepends=True)

    def flush() -> None:
        if run:
            cells.append({"cell_type": "markdown", "id": f"cell-{len(cells)}", "metadata": {}, "source": lines(Markdown(ext=options.WRITE["markdown"]).blocks(run, 72))})
            run.clear()

    for b in doc["blocks"]:
        if b["t"] == "CodeBlock" and "code" in [*b["c"][0][1], "code"][-1:]:
            flush()
            cells.append({"cell_type": "code", "execution_count": None, "id": f"cell-{len(cells)}", "metadata": {}, "outputs": [], "source": lines(b["c"][1])})
        else:
            run.append(b)
    flush()
    return json.dumps({"cells": cells, "metadata": {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False, indent=1)


CLASSES: dict[str, type[Writer]] = {"plain": Writer, "html": Html, "html5": Html, "html4": Html4, "latex": Latex, "rst": Rst, "mediawiki": MediaWiki, "dokuwiki": DokuWiki, "jira": Jira, "org": Org, "asciidoc": AsciiDoc, "man": Man, "typst": Typst}
MARKDOWN = ("commonmark", "commonmark_x", "gfm", "markdown", "markdown_github", "markdown_phpextra", "markdown_mmd", "markdown_strict")
FORMATS = sorted([*CLASSES, *MARKDOWN, "json", "native", "opml", "ipynb", "beamer", "revealjs"])


def write(doc: dict[str, Any], to: str, wrap: str = "auto", columns: int = 72) -> str:
    """A document in the format `to` (with toggles: markdown-smart)."""
    base, ext = options.parse_spec(to, writing=True)
    if base == "json":
        return deep.dumps(doc)
    if base in ("opml", "ipynb"):
        return {"opml": opml, "ipynb": ipynb}[base](doc)
    if base in ("native", "beamer", "revealjs"):
        from folioflow.writers import native, slides

        return {"native": native.write, "beamer": slides.beamer, "revealjs": slides.revealjs}[base](doc)
    if base in MARKDOWN:
        return Markdown(wrap, columns, ext).document(doc)
    if base not in CLASSES:
        raise ValueError(f"unknown format {base!r}")
    return CLASSES[base](wrap, columns, ext).document(doc)


