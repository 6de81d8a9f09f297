"""HTML as a document: a tree with implied ends, then blocks and inlines. One text at a time, pure Python."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from typing import Any

from folioflow.sources.ast import BLOCKS, Node, attr, document, merge, node, text_inlines, trim

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAWTEXT = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
INLINE = {"em": "Emph", "i": "Emph", "strong": "Strong", "b": "Strong", "u": "Underline", "ins": "Underline", "s": "Strikeout", "strike": "Strikeout", "del": "Strikeout", "sup": "Superscript", "sub": "Subscript"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIP = frozenset("head script style template noscript".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*)>|<[!?][^>]*>""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass(slots=True)
class Element:
    tag: str
    at: dict[str, str] = field(default_factory=dict)
    kids: list[Any] = field(default_factory=list)


def tree(text: str) -> Element:
    """Elements and texts. A start tag ends what it implies; an end tag closes up to its element, a stray one is dropped."""
    root = Element("root")
    stack = [root]
    i, size = 0, len(text)
    search = TOKEN.search
    while i < size:
        m = search(text, i)
        start = m.start() if m else size
        if start > i:
            run = text[i:start]
            stack[-1].kids.append(entities.unescape(run) if "&" in run else run)
        if not m:
            break
        i = m.end()
        end_tag, tag, raw_at = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if end_tag:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            stack.pop()
        if tag in SAME:
            ended = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in STOP[tag]:
                    break
                if stack[k].tag in SAME[tag]:
                    ended = k
            del stack[ended:]
        at = {k.lower(): entities.unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in reversed(ATTR.findall(raw_at))} if raw_at else {}
        e = Element(tag, at)
        stack[-1].kids.append(e)
        if tag in VOID or raw_at and raw_at.rstrip().endswith("/"):
            continue
        if tag in RAWTEXT:
            end = re.compile(rf"</{tag}\s*>", re.I).search(text, i)
            raw = text[i : end.start() if end else len(text)]
            e.kids.append(entities.unescape(raw) if tag in ("title", "textarea") else raw)
            i = end.end() if end else len(text)
            continue
        stack.append(e)
    return root


_MORE_SPACES = re.compile(r"[ \t\r\n\f]{2,}|[\t\r\f]")


def _collapsed(m: re.Match) -> str:
    return "\n" if "\n" in m[0] else " "


class Reader:
    def attr_of(self, e: Element, drop: tuple[str, ...] = ()) -> list[Any]:
        kv = [[k.removeprefix("data-"), v] for k, v in e.at.items() if k not in ("id", "class", *drop)]
        return attr(e.at.get("id", ""), e.at.get("class", "").split(), kv)

    def inlines(self, e: Element) -> list[Node]:
        kids = e.kids
        if len(kids) == 1 and isinstance(kids[0], str):
            return self.inline(kids[0])
        out: list[Node] = []
        for k in kids:  # what a child makes is merged already
            made = self.inline(k)
            if out and made:
                ends = merge([out[-1], made[0]])
                if len(ends) == 1:
                    out[-1] = ends[0]
                    made = made[1:]
            out += made
        return out

    def words(self, e: Any) -> str:
        out, todo = [], [e]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.kids)
        return "".join(out)

    def blocks(self, kids: list[Any], tight: bool = False) -> list[Node]:
        """Block children in turn; runs of inline children are one Plain (in items and cells) or Para."""
        out: list[Node] = []
        run: list[Node] = []

        def flush() -> None:
            made = trim(merge(run))
            run.clear()
            if made:
                out.append(node("Plain", made))

        for k in kids:
            if isinstance(k, Element) and k.tag in BLOCK:
                flush()
                out.extend(self.block(k))
            elif isinstance(k, Element) and k.tag in SKIP:
                continue
            else:
                for x in self.inline(k):
                    if x["t"] in BLOCKS:
                        flush()
                        out.append(x)
                    else:
                        run.append(x)
        flush()
        return out

    def block(self, e: Element) -> list[Node]:
        t = e.tag
        if t in ("html", "body", "article", "nav", "footer", "main", "header", "aside", "form", "fieldset", "details", "address", "center"):
            return self.blocks(e.kids)
        if t == "p":
            made = trim(self.inlines(e))
            return [{"t": "Para", "c": made}] if made else []
        if t in HEADINGS:
            return [node("Header", [int(t[1]), self.attr_of(e), trim(self.inlines(e))])]
        if t == "hr":
            return [node("HorizontalRule")]
        if t == "blockquote":
            return [node("BlockQuote", [node("Para", b["c"]) if b["t"] == "Plain" else b for b in self.blocks(e.kids)])]
        if t == "pre":
            text = self.words(e).removeprefix("\n").removesuffix("\n")
            code = next((k for k in e.kids if isinstance(k, Element) and k.tag == "code"), None)
            a = self.attr_of(e)
            if code is not None and not a[1]:
                a[1] = [c.removeprefix("language-") for c in code.at.get("class", "").split()]
            return [node("CodeBlock", [a, text])]
        if t in ("ul", "ol"):
            items = [self.item(k) for k in e.kids if isinstance(k, Element) and k.tag == "li"]
            if t == "ul":
                return [node("BulletList", items)]
            style = {"1": "Decimal", "a": "LowerAlpha", "A": "UpperAlpha", "i": "LowerRoman", "I": "UpperRoman"}.get(e.at.get("type", ""), "DefaultStyle")
            start = int(e.at["start"]) if re.fullmatch(r"-?\d+", e.at.get("start", "")) else 1
            return [node("OrderedList", [[start, node(style), node("DefaultDelim")], items])]
        if t == "dl":
            out: list[Any] = []
            for k in e.kids:
                if isinstance(k, Element) and k.tag == "dt":
                    out.append([trim(merge([x for c in k.kids for x in self.inline(c)])), []])
                elif isinstance(k, Element) and k.tag == "dd":
                    if not out:
                        out.append([[], []])
                    out[-1][1].append(self.blocks(k.kids))
            return [node("DefinitionList", out)]
        if t == "table":
            return [self.table(e)]
        if t == "figure":
            cap = next((k for k in e.kids if isinstance(k, Element) and k.tag == "figcaption"), None)
            rest = self.blocks([k for k in e.kids if k is not cap])
            return [node("Figure", [self.attr_of(e), [None, self.blocks(cap.kids) if cap else []], rest])]
        if t in ("div", "section"):
            a = self.attr_of(e)
            if t == "section":
                a[1] = ["section", *a[1]]
            return [node("Div", [a, self.blocks(e.kids)])]
        return self.blocks(e.kids)

    def item(self, e: Element) -> list[Node]:
        box = next((k for k in e.kids if isinstance(k, Element)), None)
        made = self.blocks(e.kids)
        if box is not None and box.tag == "input" and box.at.get("type") == "checkbox" and made and made[0]["t"] in ("Plain", "Para"):
            made[0]["c"] = [node("Str", "☒" if "checked" in box.at else "☐"), node("Space"), *made[0]["c"]]
        return made

    def table(self, e: Element) -> Node:
        rows: dict[str, list[Element]] = {"thead": [], "tbody": [], "tfoot": []}
        caption: list[Node] = []

        def collect(x: Element, part: str) -> None:
            nonlocal caption
            for k in x.kids:
                if isinstance(k, Element):
                    if k.tag == "tr":
                        rows[part].append(k)
                    elif k.tag in rows:
                        collect(k, k.tag)
                    elif k.tag == "caption":
                        caption = self.blocks(k.kids)

        collect(e, "tbody")
        cells = lambda r: [k for k in r.kids if isinstance(k, Element) and k.tag in ("td", "th")]
        if not rows["thead"] and rows["tbody"] and cells(rows["tbody"][0]) and all(k.tag == "th" for k in cells(rows["tbody"][0])):
            rows["thead"] = [rows["tbody"].pop(0)]
        number = lambda v: int(v) if re.fullmatch(r"[1-9]\d{0,3}", v or "") else 1

        def align(k: Element) -> str:
            m = re.search(r"text-align:\s*(left|right|center)", k.at.get("style", "") + ";text-align:" + k.at.get("align", ""))
            return f"Align{m[1].capitalize()}" if m else "AlignDefault"

        row = lambda r: [self.attr_of(r), [[self.attr_of(k, ("colspan", "rowspan", "style", "align")), node(align(k)), number(k.at.get("rowspan")), number(k.at.get("colspan")), self.blocks(k.kids)] for k in cells(r)]]
        every = rows["thead"] + rows["tbody"] + rows["tfoot"]
        width = max([sum(number(k.at.get("colspan")) for k in cells(r)) for r in every] + [0])
        first = [align(k) for k in cells(every[0])] if every else []
        specs = [[node(first[i] if i < len(first) else "AlignDefault"), node("ColWidthDefault")] for i in range(width)]
        none = attr()
        return node("Table", [self.attr_of(e), [None, caption], specs, [none, [row(r) for r in rows["thead"]]], [[none, 0, [], [row(r) for r in rows["tbody"]]]], [none, [row(r) for r in rows["tfoot"]]]])

    def inline(self, k: Any) -> list[Node]:
        if isinstance(k, str):
            return text_inlines(_MORE_SPACES.sub(_collapsed, k) if "\r" in k or "\f" in k else k)
        t = k.tag
        if t in SKIP or t == "title":
            return []
        if t == "br":
            return [node("LineBreak")]
        if t == "img":
            alt = text_inlines(k.at.get("alt", ""))
            return [node("Image", [self.attr_of(k, ("src", "alt", "title")), alt, [k.at.get("src", ""), k.at.get("title", "")]])]
        if t in ("code", "tt", "samp", "kbd", "var"):
            return [node("Code", [self.attr_of(k), self.words(k)])]
        inner = self.inlines(k)
        if t in INLINE:
            return [node(INLINE[t], inner)] if inner else []
        if t == "q":
            return [node("Quoted", [node("DoubleQuote"), inner])]
        if t == "a":
            if "href" not in k.at:
                return [node("Span", [self.attr_of(k), inner])]
            return [node("Link", [self.attr_of(k, ("href", "title")), inner, [k.at["href"], k.at.get("title", "")]])]
        if t in ("span", "mark", "small", "bdo", "cite", "abbr"):
            a = self.attr_of(k)
            if t != "span":
                a[1] = [t, *a[1]]
            return [node("Span", [a, inner])]
        return inner

    def read(self, text: str) -> dict[str, Any]:
        root = tree(text.replace("\r\n", "\n"))
        meta: dict[str, Any] = {}

        def head(e: Element) -> None:
            for k in e.kids:
                if isinstance(k, Element):
                    if k.tag == "title" and "title" not in meta:
                        meta["title"] = node("MetaInlines", trim(merge(text_inlines(" ".join(self.words(k).split())))))
                    elif k.tag == "meta" and k.at.get("name"):
                        meta[k.at["name"]] = node("MetaInlines", text_inlines(k.at.get("content", "")))
                    elif k.tag == "html" and k.at.get("lang"):
                        meta["lang"] = node("MetaInlines", [node("Str", k.at["lang"])])
                    if k.tag in ("html", "head"):
                        head(k)

        head(root)
        return document(self.blocks(root.kids), meta)


def read(text: str) -> dict[str, Any]:
    return Reader().read(text or "")
