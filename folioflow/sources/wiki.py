"""Readers of line-oriented notations: MediaWiki, DokuWiki, Jira, Org, LaTeX and man.

Each notation is a table of patterns (headings, lists, fences, rules, inline spans); one pass over lines applies it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from folioflow.sources import rst
from folioflow.sources.ast import NO_ATTR, Node, attr, document, merge, node, table, text_inlines, trim

Make = Callable[["Notation", re.Match], Node | list[Node]]


def span(tag: str, group: int = 1) -> Make:
    return lambda n, m: node(tag, n.inlines(m[group]))


def code(group: int = 1) -> Make:
    return lambda n, m: node("Code", [NO_ATTR, m[group]])


def math(group: int = 1, kind: str = "InlineMath") -> Make:
    return lambda n, m: node("Math", [node(kind), m[group]])


def link(url: int, label: int | None = None) -> Make:
    def made(n: Notation, m: re.Match) -> Node:
        text = m[label] if label and m[label] else None
        return node("Link", [NO_ATTR, n.inlines(text) if text else [node("Str", m[url])], [m[url].strip(), ""]])

    return made


def image(url: int, label: int | None = None) -> Make:
    return lambda n, m: node("Image", [NO_ATTR, text_inlines((m[label] or "") if label else ""), [m[url].strip(), ""]])


@dataclass
class Notation:
    heading: re.Pattern  # groups: mark, text
    level: Callable[[str], int]
    lists: re.Pattern  # groups: prefix, text
    ordered: Callable[[str], bool]
    depth: Callable[[str], int]
    fences: list[tuple[re.Pattern, re.Pattern, str]] = field(default_factory=list)  # begin (group 1: language), end, kind
    rule: re.Pattern = re.compile(r"-{4,}\s*$")
    row: re.Pattern | None = None
    head: Callable[[str], bool] = lambda s: False
    cells: Callable[[str], list[str]] = lambda s: []
    inline: list[tuple[re.Pattern, Make]] = field(default_factory=list)
    skip: re.Pattern | None = None
    clean: Callable[[str], str] = lambda s: s
    special: list[tuple[re.Pattern, Callable]] = field(default_factory=list)  # begin; reads blocks and where they end

    def inlines(self, s: str) -> list[Node]:
        out: list[Node] = []
        i = at = 0
        while i < len(s):
            for p, make in self.inline:
                m = p.match(s, i)
                if m and m.end() > i:
                    out += text_inlines(self.clean(s[at:i]))
                    made = make(self, m)
                    out += made if isinstance(made, list) else [made]
                    i = at = m.end()
                    break
            else:
                i += 1
        return merge(out + text_inlines(self.clean(s[at:])))

    def blocks(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip() or (self.skip and self.skip.match(line)):
                i += 1
                continue
            if taken := next((f for b, f in self.special if b.match(line)), None):
                made, i = taken(self, lines, i)
                out += made
                continue
            if m := self.heading.match(line):
                out.append(node("Header", [self.level(m[1]), NO_ATTR, trim(self.inlines(m[2].strip()))]))
                i += 1
                continue
            if self.rule.match(line):
                out.append(node("HorizontalRule"))
                i += 1
                continue
            fence = next(((m, e, k) for b, e, k in self.fences if (m := b.match(line))), None)
            if fence:
                m, end, kind = fence
                j = i + 1
                body = [line[m.end() :]] if line[m.end() :] else []
                if body and (z := end.search(body[0])):
                    body, j = [body[0][: z.start()]], i
                else:
                    while j < len(lines) and not end.search(lines[j]):
                        body.append(lines[j])
                        j += 1
                    if j < len(lines) and (rest := lines[j][: end.search(lines[j]).start()]):
                        body.append(rest)
                if kind == "quote":
                    out.append(node("BlockQuote", self.blocks(body)))
                else:
                    lang = (m[1] or "").strip() if m.re.groups else ""
                    out.append(node("CodeBlock", [attr(classes=[lang] if lang else []), "\n".join(body)]))
                i = j + 1
                continue
            if self.row and self.row.match(line):
                rows = []
                while i < len(lines) and self.row.match(lines[i]):
                    rows.append(lines[i])
                    i += 1
                cell = lambda s: [node("Plain", trim(self.inlines(s.strip())))] if s.strip() else []
                made = [[cell(c) for c in self.cells(r)] for r in rows if self.cells(r)]
                head = made.pop(0) if made and self.head(rows[0]) else []
                width = max(map(len, [head, *made]), default=0)
                full = lambda r: r + [[]] * (width - len(r))
                out.append(table(full(head) if head else [], [full(r) for r in made], ["AlignDefault"] * width))
                continue
            if self.lists.match(line):
                items = []
                while i < len(lines) and lines[i].strip() and (m := self.lists.match(lines[i])):
                    items.append((self.depth(m[1]), self.ordered(m[1]), m[2]))
                    i += 1
                    while i < len(lines) and lines[i].startswith("  ") and lines[i].strip() and not self.lists.match(lines[i]):
                        items[-1] = (*items[-1][:2], items[-1][2] + "\n" + lines[i].strip())
                        i += 1
                out += self.nest(items)
                continue
            j = i
            while j < len(lines) and lines[j].strip() and (j == i or not (self.heading.match(lines[j]) or self.lists.match(lines[j]) or self.rule.match(lines[j]) or any(b.match(lines[j]) for b, _, _ in self.fences) or any(b.match(lines[j]) for b, _ in self.special) or (self.row and self.row.match(lines[j])))):
                j += 1
            made = trim(self.inlines("\n".join(lines[i:j])))
            if made:
                out.append(node("Para", made))
            i = j
        return out

    def nest(self, items: list[tuple[int, bool, str]]) -> list[Node]:
        out: list[Node] = []
        k = 0
        while k < len(items):
            level, numbered, _ = items[k]
            made: list[list[Node]] = []
            while k < len(items) and (items[k][0] > level or items[k][:2] == (level, numbered)):
                if items[k][0] > level:
                    j = k
                    while j < len(items) and items[j][0] > level:
                        j += 1
                    made[-1] += self.nest(items[k:j])
                    k = j
                else:
                    made.append([node("Plain", trim(self.inlines(items[k][2])))])
                    k += 1
            out.append(node("OrderedList", [[1, node("DefaultStyle"), node("DefaultDelim")], made]) if numbered else node("BulletList", made))
        return out

    def read(self, text: str) -> dict[str, Any]:
        return document(self.blocks(text.replace("\r\n", "\n").split("\n")))


R = re.compile
URL = R(r"(https?://[^\s\]|<>]+)")

MEDIAWIKI = Notation(
    heading=R(r"(={1,6})\s*(.+?)\s*\1\s*$"), level=len, lists=R(r"([*#]+)\s*(.*)$"), ordered=lambda p: p[-1] == "#", depth=len,
    fences=[(R(r"<(?:syntaxhighlight|source)(?:[^>]*?lang=\"?(\w+)\"?)?[^>]*>"), R(r"</(?:syntaxhighlight|source)>"), "code"), (R(r"<pre()>"), R(r"</pre>"), "code"), (R(r"<blockquote()>"), R(r"</blockquote>"), "quote")],
    inline=[(R(r"'''(.+?)'''", re.S), span("Strong")), (R(r"''(.+?)''", re.S), span("Emph")), (R(r"<nowiki>(.*?)</nowiki>", re.S), lambda n, m: text_inlines(m[1])), (R(r"<code>(.*?)</code>", re.S), code()), (R(r"<math>(.*?)</math>", re.S), math()), (R(r"<(?:s|del)>(.*?)</(?:s|del)>", re.S), span("Strikeout")), (R(r"<sup>(.*?)</sup>"), span("Superscript")), (R(r"<sub>(.*?)</sub>"), span("Subscript")), (R(r"<ref>(.*?)</ref>", re.S), lambda n, m: node("Note", [node("Para", n.inlines(m[1]))])), (R(r"<br\s*/?>"), lambda n, m: node("LineBreak")), (R(r"\[\[(?:File|Image):([^|\]]+)(?:\|([^\]]*))?\]\]"), image(1, 2)), (R(r"\[\[([^|\]]+)(?:\|([^\]]*))?\]\]"), link(1, 2)), (R(r"\[(https?://[^\s\]]+)(?:\s+([^\]]*))?\]"), link(1, 2)), (URL, link(1))],
    clean=html.unescape,
)
DOKUWIKI = Notation(
    heading=R(r"\s*(={2,6})\s*(.+?)\s*=+\s*$"), level=lambda m: 7 - len(m), lists=R(r"((?:  )+[*-])\s*(.*)$"), ordered=lambda p: p[-1] == "-", depth=len,
    fences=[(R(r"<code(?:\s+(\w+))?[^>]*>"), R(r"</code>"), "code"), (R(r"<file(?:\s+(\w+))?[^>]*>"), R(r"</file>"), "code")],
    row=R(r"[|^]"), head=lambda s: s.startswith("^"), cells=lambda s: re.split(r"[|^]", s.strip())[1:-1],
    inline=[(R(r"\*\*(.+?)\*\*", re.S), span("Strong")), (R(r"(?<!:)//(.+?)(?<!:)//", re.S), span("Emph")), (R(r"__(.+?)__", re.S), span("Underline")), (R(r"''(?:%%)?(.+?)(?:%%)?''"), code()), (R(r"%%(.*?)%%"), lambda n, m: text_inlines(m[1])), (R(r"<del>(.*?)</del>"), span("Strikeout")), (R(r"<sup>(.*?)</sup>"), span("Superscript")), (R(r"<sub>(.*?)</sub>"), span("Subscript")), (R(r"\(\((.*?)\)\)"), lambda n, m: node("Note", [node("Para", n.inlines(m[1]))])), (R(r"\[\[([^|\]]+)(?:\|([^\]]*))?\]\]"), link(1, 2)), (R(r"\{\{([^|}]+)(?:\|([^}]*))?\}\}"), image(1, 2)), (R(r"\\\\(?:\s|$)"), lambda n, m: node("LineBreak")), (URL, link(1))],
)
JIRA = Notation(
    heading=R(r"h([1-6])\.\s+(.*)$"), level=int, lists=R(r"([*#-]+)\s+(.*)$"), ordered=lambda p: p[-1] == "#", depth=len,
    fences=[(R(r"\{code(?::(\w+))?[^}]*\}"), R(r"\{code\}"), "code"), (R(r"\{noformat()\}"), R(r"\{noformat\}"), "code"), (R(r"\{quote()\}"), R(r"\{quote\}"), "quote")],
    row=R(r"\|"), head=lambda s: s.startswith("||"), cells=lambda s: re.split(r"\|\|?", s.strip())[1:-1],
    inline=[(R(r"\*(\S(?:.*?\S)??)\*(?!\w)"), span("Strong")), (R(r"(?<!\w)_(\S(?:.*?\S)??)_(?!\w)"), span("Emph")), (R(r"\{\{(.+?)\}\}"), code()), (R(r"(?<!\w)-(\S(?:.*?\S)??)-(?!\w)"), span("Strikeout")), (R(r"\+(\S(?:.*?\S)??)\+(?!\w)"), span("Underline")), (R(r"\^(.+?)\^"), span("Superscript")), (R(r"~(.+?)~"), span("Subscript")), (R(r"\[([^|\]]+)\|([^\]]+)\]"), lambda n, m: node("Link", [NO_ATTR, n.inlines(m[1]), [m[2], ""]])), (R(r"\[(\w+:[^\]]+)\]"), link(1)), (R(r"!([^!\s|]+)(?:\|[^!]*)?!"), image(1)), (R(r"\\\\"), lambda n, m: node("LineBreak")), (URL, link(1))],
)
ORG = Notation(
    heading=R(r"(\*+)\s+(.*)$"), level=len, lists=R(r"(\s*(?:[-+]|\d+[.)]))\s+(.*)$"), ordered=lambda p: p.strip()[0].isdigit(), depth=lambda p: len(p) - len(p.lstrip()),
    fences=[(R(r"#\+begin_src\s*(\S*).*$", re.I), R(r"(?i)^\s*#\+end_src"), "code"), (R(r"#\+begin_example()", re.I), R(r"(?i)^\s*#\+end_example"), "code"), (R(r"#\+begin_quote()", re.I), R(r"(?i)^\s*#\+end_quote"), "quote")],
    rule=R(r"-{5,}\s*$"), row=R(r"\s*\|"), head=lambda s: True, cells=lambda s: [] if re.match(r"\s*\|-", s) else s.strip().strip("|").split("|"), skip=R(r"\s*(?:#\+\w+:|:\w+:|# )"),
    inline=[(R(r"\[\[([^\]]+)\](?:\[([^\]]*)\])?\]"), link(1, 2)), (R(r"(?<!\w)\*(\S(?:.*?\S)??)\*(?!\w)", re.S), span("Strong")), (R(r"(?<!\w)/(\S(?:.*?\S)??)/(?!\w)", re.S), span("Emph")), (R(r"(?<!\w)_(\S(?:.*?\S)??)_(?!\w)"), span("Underline")), (R(r"(?<!\w)\+(\S(?:.*?\S)??)\+(?!\w)"), span("Strikeout")), (R(r"(?<!\w)[=~](\S(?:.*?\S)??)[=~](?!\w)"), code()), (R(r"\\\((.*?)\\\)"), math()), (R(r"\\\[(.*?)\\\]", re.S), math(1, "DisplayMath")), (R(r"\^\{(.*?)\}"), span("Superscript")), (R(r"_\{(.*?)\}"), span("Subscript")), (URL, link(1))],
)


def mediawiki_table(n: Notation, lines: list[str], i: int) -> tuple[list[Node], int]:
    """A table between {| and |}: rows by |-, cells by | or !, several in a line by || or !!, attributes before a bar."""
    depth, j = 0, i
    while j < len(lines):
        depth += lines[j].lstrip().startswith("{|")
        depth -= lines[j].lstrip().startswith("|}")
        j += 1
        if not depth:
            break
    caption: list[Node] = []
    rows: list[list[tuple[bool, dict[str, str], list[str]]]] = [[]]
    inner = 0
    for line in lines[i + 1 : j - 1 if not depth else j]:
        s = line.strip()
        if inner or s.startswith("{|"):
            inner += s.startswith("{|") - s.startswith("|}")
            if rows[-1]:
                rows[-1][-1][2].append(line)
        elif s.startswith("|+"):
            caption = [node("Plain", trim(n.inlines(s[2:].strip())))]
        elif s.startswith("|-"):
            rows.append([])
        elif s[:1] in ("|", "!"):
            head = s[0] == "!"
            for part in re.split(r"\|\||!!" if head else r"\|\|", s[1:]):
                m = re.match(r"([^|\[\]{}]*?)\|(?!\|)(.*)$", part, re.S)
                options = dict(re.findall(r"([\w-]+)\s*=\s*\"?([^\"]*?)\"?(?=\s+[\w-]+\s*=|\s*$)", m[1])) if m else {}
                rows[-1].append((head, options, [(m[2] if m else part).strip()]))
        elif rows[-1]:
            rows[-1][-1][2].append(line)

    def cell(options: dict[str, str], body: list[str]) -> list[Any]:
        made = n.blocks(body)
        if len(made) == 1 and made[0]["t"] == "Para":
            made = [node("Plain", made[0]["c"])]
        align = re.search(r"(left|right|center)", options.get("align", "") + options.get("style", "").partition("text-align")[2])
        number = lambda k: int(options[k]) if options.get(k, "").isdigit() else 1
        return [NO_ATTR, node(f"Align{align[1].capitalize()}" if align else "AlignDefault"), number("rowspan"), number("colspan"), made]

    rows = [r for r in rows if r]
    made = [[NO_ATTR, [cell(o, b) for _, o, b in r]] for r in rows]
    heads = 1 if rows and all(h for h, _, _ in rows[0]) else 0
    width = max((sum(c[3] for c in r[1]) for r in made), default=0)
    specs = [[node("AlignDefault"), node("ColWidthDefault")] for _ in range(width)]
    return [node("Table", [NO_ATTR, [None, caption], specs, [NO_ATTR, made[:heads]], [[NO_ATTR, 0, [], made[heads:]]], [NO_ATTR, []]])], j


MEDIAWIKI.special = [(R(r"\s*\{\|"), mediawiki_table)]


def org_drawer(n: Notation, lines: list[str], i: int) -> tuple[list[Node], int]:
    """Properties and logs are no text."""
    j = i + 1
    while j < len(lines) and lines[j].strip().upper() != ":END:":
        j += 1
    return [], j + 1


def read_org(text: str) -> dict[str, Any]:
    """Org: keywords become metadata, footnote definitions move to their references, states and tags of headlines stay marked."""
    lines, notes, meta, kept = text.replace("\r\n", "\n").split("\n"), {}, {}, []
    i = 0
    while i < len(lines):
        if m := re.match(r"\[fn:([\w-]+)\]\s*(.*)$", lines[i]):
            body = [m[2]]
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r"\*+ |\[fn:", lines[i]):
                body.append(lines[i])
                i += 1
            notes[m[1]] = body
            continue
        if m := re.match(r"#\+(title|author|date|subtitle|email|language):\s*(.*)$", lines[i], re.I):
            meta[m[1].lower()] = node("MetaInlines", trim(ORG.inlines(m[2].strip())))
        else:
            kept.append(lines[i])
        i += 1

    def note(n: Notation, m: re.Match) -> Node | list[Node]:
        if m[2] is not None:
            return node("Note", [node("Para", n.inlines(m[2]))])
        return node("Note", n.blocks(notes[m[1]])) if m[1] in notes else node("Str", m[0])

    def cite(n: Notation, m: re.Match) -> Node:
        keys = re.findall(r"@([\w:.#$%&+?<>~/-]+)", m[1])
        made = [{"citationId": k, "citationPrefix": [], "citationSuffix": [], "citationMode": node("NormalCitation"), "citationNoteNum": 0, "citationHash": 0} for k in keys]
        return node("Cite", [made, text_inlines(m[0])])

    own = Notation(**{**vars(ORG), "inline": [(R(r"\[fn:([\w-]*)(?::([^\]]*))?\]"), note), (R(r"\[cite(?:/[\w/-]+)?:([^\]]+)\]"), cite), *ORG.inline]})
    blocks = own.blocks(kept)
    for b in blocks:
        if b["t"] != "Header":
            continue
        words = b["c"][2]
        if words and words[0].get("c") in ("TODO", "DONE"):
            state = words[0]["c"]
            b["c"][2] = [node("Span", [attr(classes=[state.lower(), state]), [node("Str", state)]]), *words[1:]]
        if words and words[-1]["t"] == "Str" and (m := re.fullmatch(r":((?:[\w@#%]+:)+)", words[-1]["c"])):
            tags = m[1].strip(":").split(":")
            spans = [node("Span", [attr(classes=["tag"], kv=[["tag-name", t]]), [node("SmallCaps", [node("Str", t)])]]) for t in tags]
            b["c"][2] = trim(b["c"][2][:-1]) + [x for sp in spans for x in (node("Space"), sp)]
    return document(blocks, meta)


ORG.special = [(R(r"\s*:(?:PROPERTIES|LOGBOOK|DRAWER):\s*$", re.I), org_drawer)]


LATEX_SECTIONS = {"part": 0, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
LATEX_SPANS = {"emph": "Emph", "textit": "Emph", "textbf": "Strong", "underline": "Underline", "textsc": "SmallCaps", "textsuperscript": "Superscript", "textsubscript": "Subscript", "sout": "Strikeout"}


class LatexReader:
    """Sections, lists, quotes, verbatim, tables, spans, links, notes and formulas of a LaTeX body; simple macros expand."""

    BUDGET = 1 << 20

    def __init__(self) -> None:
        self.macros: dict[str, tuple[int, str]] = {}

    def group(self, s: str, i: int) -> tuple[str, int]:
        """The braced group at i (or one character) and where it ends."""
        while i < len(s) and s[i] == " ":
            i += 1
        if i >= len(s) or s[i] != "{":
            return s[i : i + 1], i + 1
        depth, k = 0, i
        while k < len(s):
            if s[k] == "\\":
                k += 1
            elif s[k] == "{":
                depth += 1
            elif s[k] == "}":
                depth -= 1
                if not depth:
                    return s[i + 1 : k], k + 1
            k += 1
        return s[i + 1 :], len(s)

    def expand(self, s: str) -> str:
        for m in list(re.finditer(r"\\(?:re)?newcommand\*?\{?\\(\w+)\}?(?:\[(\d)\])?", s)):
            body, _ = self.group(s, m.end())
            self.macros[m[1]] = (int(m[2] or 0), body)
        spent = 0
        for _ in range(20):
            hit = next((m for m in re.finditer(r"\\(\w+)", s) if m[1] in self.macros and not s[: m.start()].endswith(("newcommand", "newcommand{"))), None)
            if hit is None or spent > self.BUDGET:
                break
            n, body = self.macros[hit[1]]
            end, args = hit.end(), []
            for _ in range(n):
                a, end = self.group(s, end)
                args.append(a)
            made = re.sub(r"#(\d)", lambda m: args[int(m[1]) - 1] if int(m[1]) <= len(args) else "", body)
            spent += len(made)
            s = s[: hit.start()] + made + s[end:]
        return s

    def inlines(self, s: str) -> list[Node]:
        out: list[Node] = []
        i, at = 0, 0

        def flush(to: int) -> None:
            raw = s[at:to].replace("~", "\u00a0").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”").replace("`", "‘").replace("'", "’")
            out.extend(text_inlines(raw.replace("{", "").replace("}", "")))

        while i < len(s):
            c = s[i]
            if c == "$":
                d = "$$" if s.startswith("$$", i) else "$"
                end = s.find(d, i + len(d))
                if end > 0:
                    flush(i)
                    out.append(node("Math", [node("DisplayMath" if len(d) == 2 else "InlineMath"), s[i + len(d) : end]]))
                    i = at = end + len(d)
                    continue
            if c == "\\":
                flush(i)
                m = re.compile(r"\\([a-zA-Z]+)\*?|\\(.)", re.S).match(s, i)
                if not m:
                    i = at = i + 1
                    continue
                name, end = m[1], m.end()
                if m[2] is not None:
                    if m[2] in "([":
                        z = s.find("\\)" if m[2] == "(" else "\\]", end)
                        z = len(s) if z < 0 else z
                        out.append(node("Math", [node("InlineMath" if m[2] == "(" else "DisplayMath"), s[end:z]]))
                        end = z + 2
                    else:
                        out.append(node("LineBreak") if m[2] == "\\" else node("Str", m[2]) if not m[2].isspace() else node("Space"))
                elif name in LATEX_SPANS:
                    body, end = self.group(s, end)
                    out.append(node(LATEX_SPANS[name], self.inlines(body)))
                elif name in ("texttt", "verb"):
                    if name == "verb" and end < len(s):
                        z = s.find(s[end], end + 1)
                        body, end = s[end + 1 : z], z + 1
                    else:
                        body, end = self.group(s, end)
                    out.append(node("Code", [NO_ATTR, re.sub(r"\\([_%#&{}$])", r"\1", body)]))
                elif name in ("href", "url"):
                    url, end = self.group(s, end)
                    label = [node("Str", url)]
                    if name == "href":
                        body, end = self.group(s, end)
                        label = self.inlines(body)
                    out.append(node("Link", [NO_ATTR, label, [url, ""]]))
                elif name == "footnote":
                    body, end = self.group(s, end)
                    out.append(node("Note", self.blocks(body)))
                elif name == "includegraphics":
                    m2 = re.compile(r"\[[^\]]*\]").match(s, end)
                    body, end = self.group(s, m2.end() if m2 else end)
                    out.append(node("Image", [NO_ATTR, [], [body, ""]]))
                elif name in ("ldots", "dots"):
                    out.append(node("Str", "…"))
                elif name in ("LaTeX", "TeX"):
                    out.append(node("Str", name))
                elif name in ("textbackslash", "textasciitilde", "textasciicircum"):
                    out.append(node("Str", {"textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^"}[name]))
                    end += 2 if s.startswith("{}", end) else 0
                elif name in ("label", "index", "cite", "ref", "vspace", "hspace"):
                    _, end = self.group(s, end)
                i = at = end
                continue
            i += 1
        flush(len(s))
        return trim(merge(out))

    def blocks(self, s: str) -> list[Node]:
        out: list[Node] = []
        i = 0
        stop = re.compile(r"\\begin\{(\w+\*?)\}|\\(" + "|".join(LATEX_SECTIONS) + r")(\*?)(?=[\s{\[])|\n\s*\n|\\(?:newcommand|renewcommand)\*?|\\item\b")
        start = 0

        def flush(to: int) -> None:
            made = self.inlines(s[start:to].strip())
            if made:
                out.append(node("Para", made))

        while m := stop.search(s, i):
            flush(m.start())
            i = m.end()
            if m[2]:
                i = s.find("{", i) if s[i : i + 1] == "[" else i
                body, i = self.group(s, i)
                label = re.compile(r"\s*\\label\{([^}]*)\}").match(s, i)
                i = label.end() if label else i
                out.append(node("Header", [max(1, LATEX_SECTIONS[m[2]]), attr(label[1] if label else "", ["unnumbered"] if m[3] else []), self.inlines(body)]))
            elif m[1]:
                depth, k = 1, i
                for e in re.compile(r"\\(begin|end)\{" + re.escape(m[1]) + r"\}").finditer(s, i):
                    depth += 1 if e[1] == "begin" else -1
                    k = e.start()
                    if not depth:
                        break
                body, i = s[i:k], k + len(m[1]) + 6
                out += self.environment(m[1].rstrip("*"), body)
            elif m[0].startswith(("\\new", "\\renew")):
                i = re.compile(r"\{?\\\w+\}?(?:\[\d\])?").match(s, i).end()
                _, i = self.group(s, i)
            start = i
        flush(len(s))
        return out

    def environment(self, name: str, body: str) -> list[Node]:
        if name in ("itemize", "enumerate", "description"):
            parts, depth, cur = [], 0, ""
            for t in re.split(r"(\\begin\{\w+\*?\}|\\end\{\w+\*?\}|\\item\b)", body):
                depth += t.startswith("\\begin") - t.startswith("\\end")
                if t == "\\item" and not depth:
                    parts.append(cur)
                    cur = ""
                else:
                    cur += t
            parts.append(cur)
            items = [p.removeprefix("\\tightlist") for p in parts[1:]]
            if name == "description":
                pairs = [re.match(r"\s*\[(.*?)\](.*)$", p, re.S) for p in items]
                return [node("DefinitionList", [[self.inlines(p[1]), [self.blocks(p[2])]] for p in pairs if p])]
            made = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in self.blocks(p)] for p in items]
            return [node("BulletList", made) if name == "itemize" else node("OrderedList", [[1, node("DefaultStyle"), node("DefaultDelim")], made])]
        if name in ("quote", "quotation", "verse"):
            return [node("BlockQuote", self.blocks(body))]
        if name in ("verbatim", "lstlisting", "Verbatim", "Highlighting"):
            return [node("CodeBlock", [NO_ATTR, body.strip("\n")])]
        if name in ("equation", "align", "displaymath", "gather", "multline"):
            return [node("Para", [node("Math", [node("DisplayMath"), f"\\begin{{{name}}}{body}\\end{{{name}}}" if name in ("align", "gather") else body.strip()])])]
        if name in ("tabular", "longtable"):
            spec = re.match(r"\s*(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", body)
            kinds = re.findall(r"[lcrp]", re.sub(r"\{[^{}]*\}|@\{[^}]*\}", "", spec[1])) if spec else []
            rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule|endhead|noalign\{\}|tabularnewline)", "", r) for r in re.split(r"\\\\", body[spec.end() if spec else 0 :])]
            cell = lambda c: [node("Plain", self.inlines(c.strip()))] if c.strip() else []
            made = [[cell(c) for c in re.split(r"(?<!\\)&", r)] for r in rows if r.strip()]
            n = max([len(kinds), *map(len, made)])
            aligns = [{"l": "AlignLeft", "c": "AlignCenter", "r": "AlignRight"}.get(k, "AlignDefault") for k in kinds] + ["AlignDefault"] * (n - len(kinds))
            made = [r + [[]] * (n - len(r)) for r in made]
            return [table(made[0] if made else [], made[1:], aligns)]
        return self.blocks(body)

    def read(self, text: str) -> dict[str, Any]:
        s = self.expand(re.sub(r"(?<!\\)%.*\n?", "", text))
        meta = {}
        for key in ("title", "author", "date"):
            if m := re.search(rf"\\{key}\s*(?=\{{)", s):
                meta[key] = node("MetaInlines", self.inlines(self.group(s, m.end())[0]))
        if m := re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|$)", s, re.S):
            s = m[1]
        return document(self.blocks(re.sub(r"\\maketitle\b", "", s)), meta)


def man_table(lines: list[str], words: Callable[[str], list[Node]]) -> Node:
    """A tbl: options up to a semicolon, formats up to a full stop, then rows; T{ ... T} holds a cell of several lines."""
    tab = "\t"
    i = 0
    if lines and lines[0].rstrip().endswith(";"):
        if m := re.search(r"tab\s*\((.)\)", lines[0]):
            tab = m[1]
        i = 1
    formats: list[str] = []
    while i < len(lines):
        formats.append(lines[i].rstrip(". \t"))
        i += 1
        if lines[i - 1].rstrip().endswith("."):
            break
    kinds = re.findall(r"[lrcnaLRCNA]", re.sub(r"\([^)]*\)|[wfFvp]\S*", "", formats[-1] if formats else ""))
    bold = bool(formats) and len(formats) > 1 and bool(re.search(r"(?i)[lrcna]\s*f?b", formats[0]))
    body = "\n".join(x for x in lines[i:] if not re.fullmatch(r"[_=]|\.\w+.*|", x.strip()))
    body = re.sub(r"T\{\n?(.*?)\n?T\}", lambda m: m[1].replace("\n", " "), body, flags=re.S)
    rows = [[[node("Plain", w)] if (w := words(c.strip())) else [] for c in x.split(tab)] for x in body.split("\n") if x.strip()]
    width = max([len(kinds), *map(len, rows)], default=0)
    rows = [r + [[]] * (width - len(r)) for r in rows]
    aligns = [{"l": "AlignLeft", "r": "AlignRight", "n": "AlignRight", "c": "AlignCenter"}.get(k.lower(), "AlignDefault") for k in kinds] + ["AlignDefault"] * (width - len(kinds))
    ruled = any(x.strip() in ("_", "=") for x in lines[i + 1 : i + 2])
    return table(rows[0] if rows and (bold or ruled) else [], rows[1 if bold or ruled else 0 :], aligns)


def read_man(text: str) -> dict[str, Any]:
    """Headings, paragraphs, tagged and bulleted items, examples and fonts of a manual page."""
    glyphs = {"\\-": "-", "\\(bu": "•", "\\[bu]": "•", "\\[rs]": "\\", "\\[aq]": "'", "\\[ga]": "`", "\\[ha]": "^", "\\[ti]": "~", "\\&": "", "\\e": "\\", "\\ ": " "}

    def clean(s: str) -> str:
        return re.sub(r"\\(?:-|\(bu|\[\w+\]|&|e| )", lambda m: glyphs.get(m[0], ""), s)

    def inlines(s: str) -> list[Node]:
        out: list[Node] = []
        font = "R"
        for part in re.split(r"(\\f(?:\[\w*\]|.))", s):
            if part.startswith("\\f"):
                font = part[2:].strip("[]")
                continue
            words = text_inlines(clean(part))
            if "\x00" in part:
                for k, piece in enumerate(part.split("\x00")):
                    if k % 2:
                        url, label = links[int(piece)]
                        out.append(node("Link", [NO_ATTR, text_inlines(clean(label)), [url, ""]]))
                    else:
                        out += text_inlines(clean(piece))
            elif words:
                out += [node("Strong", words)] if font == "B" else [node("Emph", words)] if font == "I" else [node("Code", [NO_ATTR, clean(part)])] if font.startswith("C") else words
        return trim(merge(out))

    out: list[Node] = []
    links: list[tuple[str, str]] = []
    para: list[str] = []
    meta: dict[str, Any] = {}
    item: tuple[str, list[Any]] | None = None

    def flush() -> None:
        nonlocal item
        made = inlines("\n".join(para))
        para.clear()
        if made and item:
            kind, label = item
            if kind == "bullet":
                if not (out and out[-1]["t"] == "BulletList"):
                    out.append(node("BulletList", []))
                out[-1]["c"].append([node("Para", made)])
            else:
                if not (out and out[-1]["t"] == "DefinitionList"):
                    out.append(node("DefinitionList", []))
                out[-1]["c"].append([label, [[node("Para", made)]]])
            item = None
        elif made:
            out.append(node("Para", made))

    lines, i = text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        i += 1
        m = re.match(r"[.']\s*([A-Za-z]+|\\\")\s*(.*)$", line)
        if not m:
            if line.strip():
                para.append(line)
            else:
                flush()
            continue
        name, rest = m[1], m[2].strip()
        args = [a.strip('"') for a in re.findall(r'"[^"]*"|\S+', rest)]
        if name in ("SH", "SS"):
            flush()
            out.append(node("Header", [1 if name == "SH" else 2, NO_ATTR, inlines(" ".join(args))]))
        elif name == "TH" and args:
            meta["title"] = node("MetaInlines", text_inlines(args[0]))
        elif name in ("PP", "P", "LP"):
            flush()
        elif name == "TP" and i < len(lines):
            flush()
            item = ("term", inlines(re.sub(r"^\.[BI]+\s+", lambda b: "\\fB" if "B" in b[0] else "\\fI", lines[i])))
            i += 1
        elif name == "IP":
            flush()
            item = ("bullet", []) if not args or clean(args[0]) in ("•", "*", "-") else ("term", inlines(args[0]))
        elif name in ("EX", "nf"):
            flush()
            body = []
            while i < len(lines) and not re.match(r"\.(EE|fi)\b", lines[i]):
                body.append(clean(lines[i]))
                i += 1
            i += 1
            out.append(node("CodeBlock", [NO_ATTR, "\n".join(body)]))
        elif name == "TS":
            flush()
            body = []
            while i < len(lines) and not lines[i].startswith(".TE"):
                body.append(lines[i])
                i += 1
            i += 1
            out.append(man_table(body, lambda x: inlines(x)))
        elif name == "de":  # a macro's definition is no text
            while i < len(lines) and not re.match(r"\.\.\s*$", lines[i]):
                i += 1
            i += 1
        elif name in ("UR", "MT") and args:
            words = []
            while i < len(lines) and not re.match(r"\.(UE|ME)\b", lines[i]):
                words.append(lines[i])
                i += 1
            rest = lines[i][3:].strip() if i < len(lines) else ""
            i += 1
            links.append((("mailto:" if name == "MT" else "") + clean(args[0]), " ".join(words) or clean(args[0])))
            para.append(f"\x00{len(links) - 1}\x00{clean(rest)}")
        elif name in ("B", "I", "BR", "IR", "RB", "RI", "BI", "IB"):
            para.append("".join(f"\\f{name[k % len(name)]}{a}\\fR" for k, a in enumerate(args)) if len(name) == 2 else f"\\f{name}{' '.join(args)}\\fR")
    flush()
    return document(out, meta)


READERS: dict[str, Callable[[str], dict[str, Any]]] = {"mediawiki": MEDIAWIKI.read, "dokuwiki": DOKUWIKI.read, "jira": JIRA.read, "org": read_org, "rst": rst.read, "latex": lambda s: LatexReader().read(s), "man": read_man}
