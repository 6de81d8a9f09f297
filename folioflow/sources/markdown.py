"""Markdown in eight dialects: a block pass over lines, then an inline pass with delimiter runs. Pure Python, one text at a time."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from typing import Any

from folioflow.operators import options
from folioflow.sources import metadata
from folioflow.sources.ast import NO_ATTR, Node, attr, document, merge, node, plain, table, text_inlines, trim

PUNCT = frozenset(string.punctuation)
HTML_BLOCK = frozenset("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split())
TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
RAW = re.compile(rf"{TAG}|<!---->|<!--(?:-?[^>-])(?:-?[^-])*-->|<\?.*?\?>|<![A-Z]+\s+[^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
BARE = re.compile(r"(?:https?://|www\.)[^\s<]+")
THEMATIC = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*)$")
ATX_TIGHT = re.compile(r" {0,3}(#{1,6})[ \t]*(.*)$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
BULLET = re.compile(r"( {0,3})([*+-])([ \t]+|$)(.*)$")
ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])([ \t]+|$)(.*)$")
FANCY = re.compile(r"( {0,3})(\()?([ivxlcdm]+|[IVXLCDM]+|[a-z]|[A-Z]|#|\d{1,9})([.)])([ \t]+|$)(.*)$")
REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
ATTRS = re.compile(r"\{([^{}]*)\}")


CITE = re.compile(r"(-?)@(\{[^}]+\}|[A-Za-z0-9_](?:[\w]|[:.#$%&+?<>~/-](?=\w))*)")


def cite(key: str, prefix: list[Node], suffix: list[Node], mode: str) -> dict[str, Any]:
    return {"citationId": key.strip("{}"), "citationPrefix": prefix, "citationSuffix": suffix, "citationMode": {"t": mode}, "citationNoteNum": 0, "citationHash": 0}


def label_key(s: str) -> str:
    return " ".join(s.split()).casefold().upper()


def unescape(s: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])|(" + ENTITY.pattern + ")", lambda m: m[1] if m[1] else html.unescape(m[2]), s)


def escape_url(s: str) -> str:
    return re.sub(r'[\s"<>\\^`{|}]', lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), s)


def parse_attr(s: str) -> list[Any]:
    ident, classes, kv = "", [], []
    for m in re.finditer(r"#([^\s}]+)|\.([^\s}]+)|([\w:-]+)=(\"[^\"]*\"|'[^']*'|[^\s}]*)|(-)(?=\s|$)", s):
        if m[1]:
            ident = m[1]
        elif m[2]:
            classes.append(m[2])
        elif m[3]:
            kv.append([m[3], m[4].strip("\"'")])
        else:
            classes.append("unnumbered")
    return attr(ident, classes, kv)


def columns(line: str) -> int:
    n = 0
    for c in line:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def dedent(line: str, n: int) -> str:
    """Removes up to n columns of indentation; a tab that is cut leaves blanks."""
    have = i = 0
    while i < len(line) and have < n and line[i] in " \t":
        have += 1 if line[i] == " " else 4 - have % 4
        i += 1
    return " " * max(0, have - n) + line[i:]


class Reader:
    def __init__(self, ext: frozenset[str], greedy: bool):
        self.ext, self.greedy = ext, greedy
        self.refs: dict[str, tuple[str, str]] = {}
        self.notes: dict[str, list[str]] = {}
        self.ids: dict[str, int] = {}
        self.headings: dict[str, str] = {}
        self.open_notes: set[str] = set()
        self.item_depth = 0
        self.fenced = "fenced_code_blocks" in ext or "backtick_code_blocks" in ext or not greedy

    def has(self, name: str) -> bool:
        return name in self.ext

    # ------------------------------------------------------------ blocks

    def read(self, text: str) -> dict[str, Any]:
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
        meta: dict[str, Any] = {}
        if self.has("yaml_metadata_block"):
            m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S)
            if m:
                text = text[m.end() :]
                meta = metadata.read(m[1], self.inlines)
        if self.has("pandoc_title_block") and (m := re.match(r"%(.*(?:\n[ \t]+\S.*)*)(?:\n%(.*(?:\n[ \t]+\S.*)*))?(?:\n%(.*))?(?:\n|$)", text)):
            text = text[m.end() :]
            for key, v in zip(("title", "author", "date"), m.groups(), strict=True):
                if v and v.strip():
                    people = [node("MetaInlines", self.inlines(x)) for x in re.split(r";|\n", v) if x.strip()]
                    meta.setdefault(key, node("MetaList", people) if key == "author" else node("MetaInlines", self.inlines(v)))
        if self.has("mmd_title_block") and (m := re.match(r"(?:[A-Za-z][\w ]*:[ \t]*\S.*\n)+(?:\n|$)", text)):
            text = text[m.end() :]
            for line in m[0].strip().split("\n"):
                k, _, v = line.partition(":")
                meta[k.strip().lower().replace(" ", "")] = node("MetaInlines", self.inlines(v.strip()))
        tree = self.blocks(text.split("\n"))
        return document(self.finish(tree), meta)

    def finish(self, tree: list[Any]) -> list[Node]:
        """Inline texts are parsed once all definitions are known."""
        self._headings(tree)
        return self._resolve(tree)

    def _headings(self, tree: Any) -> None:
        if isinstance(tree, list):
            for x in tree:
                self._headings(x)
        elif isinstance(tree, dict):
            if tree["t"] == "Header" and not tree["c"][1][0] and (self.has("auto_identifiers") or self.has("gfm_auto_identifiers")):
                words = plain(self.inlines(tree["c"][2]))
                if self.has("gfm_auto_identifiers"):
                    base = re.sub(r"\s", "-", "".join(c for c in words.strip().lower() if c.isalnum() or c in "-_ " or unicodedata.category(c)[0] == "M"))
                else:
                    base = re.sub(r"^[^a-zA-Z\u0080-\U0010ffff]+", "", "-".join("".join(c for c in "".join(x.lower() for x in words) if c.isalnum() or c in "-_. \n").split())) or "section"
                n = self.ids.get(base, 0)
                self.ids[base] = n + 1
                tree["c"][1] = [f"{base}-{n}" if n else base, *tree["c"][1][1:]]
                if self.has("implicit_header_references"):
                    self.headings.setdefault(label_key(words), "#" + tree["c"][1][0])
            elif "c" in tree and tree["t"] not in ("CodeBlock", "RawBlock"):
                self._headings(tree["c"])

    def _resolve(self, x: Any) -> Any:
        if isinstance(x, list):
            return [self._resolve(v) for v in x]
        if isinstance(x, dict) and "t" in x:
            t, c = x["t"], x.get("c")
            if t in ("Para", "Plain"):
                made = self.inlines(c)
                if self.has("implicit_figures") and t == "Para" and len(made) == 1 and made[0]["t"] == "Image" and made[0]["c"][1]:
                    image = made[0]["c"]
                    return node("Figure", [attr(image[0][0]), [None, [node("Plain", image[1])]], [node("Plain", [node("Image", [["", *image[0][1:]], image[1], image[2]])])]])
                return node(t, made)
            if t == "Header":
                return node(t, [c[0], c[1], self.inlines(c[2])])
            if t == "RawTerm":
                return self.inlines(c)
            if t == "LineBlock":
                return node(t, [self.inlines(v) for v in c])
            if t == "MdTable":
                cell = lambda s: [node("Plain", self.inlines(s))] if s else []
                note = [node("Plain", self.inlines(c[3]))] if len(c) > 3 and c[3] else []
                return table([cell(s) for s in c[0]], [[cell(s) for s in r] for r in c[1]], c[2], note)
            return node(t, self._resolve(c)) if c is not None else x
        return x

    def blocks(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            if not line.strip():
                i += 1
                continue
            if columns(line) >= 4:
                j, code = i, []
                while j < n and (columns(lines[j]) >= 4 or not lines[j].strip()):
                    code.append(dedent(lines[j], 4))
                    j += 1
                while code and not code[-1].strip():
                    code.pop()
                out.append(node("CodeBlock", [NO_ATTR, "\n".join(code)]))
                i = j
                continue
            for rule in (self._fence, self._atx, self._simple, self._thematic, self._div, self._quote, self._table, self._grid, self._line_block, self._list, self._footnote, self._reference, self._html):
                made = rule(lines, i)
                if made is not None:
                    blocks, i = made
                    out += blocks
                    break
            else:
                blocks, i = self._paragraph(lines, i)
                out += blocks
        return out

    def _fence(self, lines, i):
        m = FENCE.match(lines[i]) if self.fenced else None
        if not m or (m[2][0] == "`" and "`" in m[3]) or (m[2][0] == "~" and self.greedy and not self.has("fenced_code_blocks")):
            return None
        code, j = [], i + 1
        close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
        while j < len(lines) and not close.match(lines[j]):
            code.append(dedent(lines[j], len(m[1])))
            j += 1
        if j == len(lines) and self.greedy:
            return None
        info = unescape(m[3].strip())
        if raw := re.fullmatch(r"\{=([\w-]+)\}", info):
            if self.has("raw_attribute"):
                return [node("RawBlock", [raw[1], "\n".join(code)])], j + 1
        if info.startswith("{") and info.endswith("}") and (self.has("fenced_code_attributes") or self.has("attributes")):
            at = parse_attr(info[1:-1])
        else:
            at = attr(classes=[info.split()[0]]) if info else NO_ATTR
        return [node("CodeBlock", [at, "\n".join(code)])], j + 1

    def _atx(self, lines, i):
        m = (ATX if self.has("space_in_atx_header") or not self.greedy else ATX_TIGHT).match(lines[i])
        if not m:
            return None
        text = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2]).strip()
        at = NO_ATTR
        if (self.has("header_attributes") or self.has("attributes")) and (a := re.search(r"[ \t]*\{([^{}]*)\}$", text)):
            at, text = parse_attr(a[1]), text[: a.start()]
        return [node("Header", [len(m[1]), at, text])], i + 1

    def _thematic(self, lines, i):
        return ([node("HorizontalRule")], i + 1) if THEMATIC.match(lines[i]) else None

    def _div(self, lines, i):
        m = re.match(r" {0,3}(:{3,})[ \t]*(?:\{([^{}]*)\}|([^\s:{}]+))[ \t:]*$", lines[i]) if self.has("fenced_divs") else None
        if not m:
            return None
        depth, j = 1, i + 1
        while j < len(lines):
            if re.match(r" {0,3}:{3,}[ \t]*(?:\{[^{}]*\}|[^\s:{}]+)[ \t:]*$", lines[j]):
                depth += 1
            elif re.match(r" {0,3}:{3,}[ \t]*$", lines[j]):
                depth -= 1
                if not depth:
                    break
            j += 1
        if depth:
            return None
        at = parse_attr(m[2]) if m[2] is not None else attr(classes=[m[3]])
        return [node("Div", [at, self.blocks(lines[i + 1 : j])])], j + 1

    def _starts_block(self, lines, i, para: bool = True) -> bool:
        line = lines[i]
        if columns(line) >= 4:
            return False
        if THEMATIC.match(line) or (FENCE.match(line) and self._fence(lines, i) is not None):
            return True
        if not (para and self.has("blank_before_header")) and self._atx([line], 0) is not None:
            return True
        if re.match(r" {0,3}>", line) and not (para and self.has("blank_before_blockquote")):
            return True
        if self.greedy and para and not self.item_depth and not self.has("lists_without_preceding_blankline"):
            return False
        b = BULLET.match(line)
        if b and (b[4].strip() or not para):
            return True
        o = ORDERED.match(line)
        if o and (not para or (o[2] == "1" and o[5].strip())):
            return True
        h = re.match(r" {0,3}</?([A-Za-z][A-Za-z0-9-]*)(?=[\s/>]|$)", line)
        return bool(h and h[1].lower() in HTML_BLOCK)

    def _quote(self, lines, i):
        if not re.match(r" {0,3}>", lines[i]):
            return None
        inner, j, lazy = [], i, False
        while j < len(lines):
            m = re.match(r" {0,3}> ?(.*)$", lines[j])
            if m:
                inner.append(m[1])
                lazy = bool(m[1].strip()) and not FENCE.match(m[1]) and columns(m[1]) < 4 and not THEMATIC.match(m[1]) and not m[1].startswith("#")
            elif lazy and lines[j].strip() and not self._starts_block(lines, j):
                inner.append(lines[j])
            else:
                break
            j += 1
        if self.has("alerts") and (a := re.fullmatch(r"\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]\s*", inner[0])):
            title = node("Div", [attr(classes=["title"]), [node("Para", a[1].capitalize())]])
            return [node("Div", [attr(classes=[a[1].lower()]), [title, *self.blocks(inner[1:])]])], j
        return [node("BlockQuote", self.blocks(inner))], j

    def _line_block(self, lines, i):
        if not self.has("line_blocks") or not re.match(r"\|( |$)", lines[i]):
            return None
        out, j = [], i
        while j < len(lines) and (m := re.match(r"\|(?: (.*))?$", lines[j])):
            text = m[1] or ""
            out.append("\u00a0" * (len(text) - len(text.lstrip(" "))) + text.strip())
            j += 1
            while j < len(lines) and lines[j].startswith(" ") and lines[j].strip():
                out[-1] += " " + lines[j].strip()
                j += 1
        return [node("LineBlock", out)], j

    def _marker(self, line: str):
        """Kind of list, number, delimiter, columns of the content, and the content of an item's first line."""
        if THEMATIC.match(line):
            return None
        if m := BULLET.match(line):
            gap = columns(m[3]) if m[4].strip() else 1
            width = len(m[1]) + 1 + (gap if 1 <= gap <= 4 else 1)
            return ("bullet", m[2], None), width, dedent(line[len(m[1]) + 1 :], width - len(m[1]) - 1)
        if m := ORDERED.match(line):
            head = len(m[1]) + len(m[2]) + 1
            gap = columns(m[4]) if m[5].strip() else 1
            width = head + (gap if 1 <= gap <= 4 else 1)
            return ("Decimal", m[3], int(m[2])), width, dedent(line[head:], width - head)
        if self.has("fancy_lists") and (m := FANCY.match(line)) and not m[3].isdigit():
            one = m[3]
            if len(one) == 1 and one.isupper() and m[4] == "." and len(m[5]) < 2:
                return None
            roman = re.fullmatch(r"[ivxlcdm]+|[IVXLCDM]+", one) and (len(one) > 1 or one in "iI")
            kind = "DefaultStyle" if one == "#" else ("LowerRoman" if one.islower() else "UpperRoman") if roman else ("LowerAlpha" if one.islower() else "UpperAlpha")
            number = 1 if one == "#" else _roman_value(one.lower()) if roman else ord(one.lower()) - 96
            head = len(m[1]) + (1 if m[2] else 0) + len(one) + 1
            gap = columns(m[5]) if m[6].strip() else 1
            width = head + (gap if 1 <= gap <= 4 else 1)
            return (kind, (m[2] or "") + m[4], number), width, dedent(line[head:], width - head)
        return None

    def _list(self, lines, i):
        first = self._marker(lines[i])
        if first is None:
            return None
        kind, delim, start = first[0]
        items: list[list[str]] = []
        loose, j, blank = False, i, False
        while j < len(lines):
            m = self._marker(lines[j]) if columns(lines[j]) < 4 else None
            if m is None or m[0][0] != kind or m[0][1] != delim:
                break
            if blank:
                loose = True
            item, width = [m[2]], m[1]
            j += 1
            blank, lazy = not item[0].strip(), True
            empty = blank
            while j < len(lines):
                line = lines[j]
                if not line.strip():
                    if empty and len(item) == 1:
                        break
                    item.append("")
                    blank = True
                elif columns(line) >= width:
                    item.append(dedent(line, width))
                    blank = False
                elif not blank and lazy and self._marker(line) is None and not self._starts_block(lines, j):
                    item.append(line.strip())
                else:
                    break
                j += 1
            blank = bool(item) and len(item) > 1 and item[-1] == ""
            while len(item) > 1 and item[-1] == "":
                item.pop()
            items.append(item)
            while j < len(lines) and not lines[j].strip():
                blank = True
                j += 1
        parsed = []
        for item in items:
            self.item_depth += 1
            blocks = self.blocks(item)
            self.item_depth -= 1
            if len(blocks) > 1 and self._loose(item):
                loose = True
            parsed.append(blocks)
        if not loose:
            parsed = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in bs] for bs in parsed]
        if self.has("task_lists"):
            for bs in parsed:
                if bs and bs[0]["t"] in ("Para", "Plain") and (t := re.match(r"\[([ xX])\]\s+", bs[0]["c"])):
                    bs[0]["c"] = ("☐ " if t[1] == " " else "☒ ") + bs[0]["c"][t.end() :]
        if kind == "bullet":
            return [node("BulletList", parsed)], j
        kinds = {".": "Period", ")": "OneParen", "()": "TwoParens", "(.": "Period"}
        named = self.has("fancy_lists") or not self.greedy
        style = kind if named else "DefaultStyle"
        number = start if not self.greedy or self.has("startnum") else 1
        return [node("OrderedList", [[number, node(style), node(kinds[delim] if named else "DefaultDelim")], parsed])], j

    def _loose(self, item: list[str]) -> bool:
        """Whether a blank line lies between two direct children of an item."""
        fence = None
        for k, line in enumerate(item[1:], 1):
            f = FENCE.match(line)
            if f and fence is None:
                fence = f[2][0]
            elif f and fence == f[2][0]:
                fence = None
            if not line and fence is None and k + 1 < len(item) and columns(item[k + 1]) < 2:
                return True
        return False

    def _footnote(self, lines, i):
        m = FOOTNOTE.match(lines[i]) if self.has("footnotes") else None
        if not m:
            return None
        body, j = [m[2]], i + 1
        while j < len(lines):
            if not lines[j].strip():
                if j + 1 < len(lines) and columns(lines[j + 1]) >= 4:
                    body.append("")
                else:
                    break
            elif columns(lines[j]) >= 4:
                body.append(dedent(lines[j], 4))
            elif lines[j - 1].strip() and not self._starts_block(lines, j) and not FOOTNOTE.match(lines[j]):
                body.append(lines[j])
            else:
                break
            j += 1
        self.notes.setdefault(label_key(m[1]), body)
        return [], j

    def _reference(self, lines, i):
        m = REFERENCE.match("\n".join(lines[i : i + 4]))
        if not m:
            return None
        url = m[2][1:-1] if m[2].startswith("<") else m[2]
        self.refs.setdefault(label_key(m[1]), (escape_url(unescape(url)), unescape(m[3][1:-1]) if m[3] else ""))
        return [], i + m[0].rstrip("\n").count("\n") + 1

    def _html(self, lines, i):
        m = re.match(r" {0,3}(?:<(script|pre|style|textarea)(?=[\s>]|$)|(<!--)|(<\?)|(<![A-Za-z])|(<!\[CDATA\[)|</?([A-Za-z][A-Za-z0-9-]*)(?=[\s/>]|$))", lines[i], re.I)
        if not m:
            return None
        j = i
        ends = [(m[1], r"</(?:script|pre|style|textarea)>"), (m[2], "-->"), (m[3], r"\?>"), (m[4], ">"), (m[5], r"\]\]>")]
        for have, end in ends:
            if have:
                while j < len(lines) and not re.search(end, lines[j], re.I):
                    j += 1
                j = min(j + 1, len(lines))
                break
        else:
            if m[6].lower() not in HTML_BLOCK and not re.fullmatch(rf" {{0,3}}(?:{TAG})[ \t]*", lines[i]):
                return None
            while j < len(lines) and lines[j].strip():
                j += 1
        raw = "\n".join(lines[i:j])
        return ([node("RawBlock", ["html", raw])] if self.has("raw_html") else []), j

    def _table(self, lines, i):
        if not self.has("pipe_tables") or i + 1 >= len(lines) or "|" not in lines[i]:
            return None
        rule = lines[i + 1].strip()
        if not re.fullmatch(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?", rule) or "-" not in rule:
            return None
        split = lambda s: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", s.strip()))]
        head, marks = split(lines[i]), split(rule)
        if len(head) != len(marks):
            return None
        aligns = [{(1, 1): "AlignCenter", (1, 0): "AlignLeft", (0, 1): "AlignRight", (0, 0): "AlignDefault"}[(a.startswith(":"), a.endswith(":"))] for a in marks]
        rows, j = [], i + 2
        while j < len(lines) and lines[j].strip() and not self._starts_block(lines, j):
            row = split(lines[j])[: len(head)]
            rows.append(row + [""] * (len(head) - len(row)))
            j += 1
        return [node("MdTable", [head if any(head) else [], rows, aligns])], j

    def _caption(self, lines, j) -> tuple[str, int]:
        """A caption line after a table (`Table: ...` or `: ...`), past one blank line."""
        k = j
        while k < len(lines) and not lines[k].strip():
            k += 1
        m = re.match(r" {0,3}(?:[Tt]able)?:[ \t]+(.*)$", lines[k]) if self.has("table_captions") and k < len(lines) and k - j <= 1 else None
        if not m:
            return "", j
        text = [m[1]]
        k += 1
        while k < len(lines) and lines[k].strip():
            text.append(lines[k].strip())
            k += 1
        return " ".join(text), k

    def _grid(self, lines, i):
        """Cells drawn with plus, minus and bar signs; a rule of equals signs ends the head. Cells hold blocks."""
        edge = re.compile(r"\+(?:[-=:]+\+)+\s*$")
        if not self.has("grid_tables") or not edge.match(lines[i]) or "=" in lines[i]:
            return None
        cuts = [k for k, c in enumerate(lines[i].rstrip()) if c == "+"]
        rows, heads, cur, aligns, j = [], 0, [], lines[i], i + 1
        while j < len(lines) and (lines[j].startswith("|") or edge.match(lines[j])):
            if edge.match(lines[j]):
                if cur:
                    rows.append([[line[a + 1 : z].rstrip() for line in cur] for a, z in zip(cuts, cuts[1:], strict=False)])
                cur = []
                if "=" in lines[j]:
                    heads, aligns = len(rows), lines[j]
            else:
                cur.append(lines[j].ljust(cuts[-1] + 1))
            j += 1
        if cur or not rows:
            return None
        kinds = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            mark = aligns[a + 1 : z]
            kinds.append({(1, 1): "AlignCenter", (1, 0): "AlignLeft", (0, 1): "AlignRight", (0, 0): "AlignDefault"}[(mark.startswith(":"), mark.endswith(":"))])

        def cell(raw: list[str]) -> list[Node]:
            made = self.blocks([x[1:] if x.startswith(" ") else x for x in raw])
            return [node("Plain", b["c"]) if b["t"] == "Para" else b for b in made]

        made = [[cell(c) for c in r] for r in rows]
        caption, j = self._caption(lines, j)
        head = made[:heads][0] if heads else []
        return [table(head, made[min(heads, 1) :], kinds, [node("Plain", caption)] if caption else [])], j

    def _simple(self, lines, i):
        """Columns under runs of hyphens; where a heading stands against its run says how the column is aligned."""
        if not self.has("simple_tables"):
            return None
        rule = re.compile(r" {0,3}-+(?: +-+)+ *$|-{3,} *$")
        bare = bool(rule.match(lines[i])) and " -" in lines[i].strip()
        at = i if bare else i + 1
        if at >= len(lines) or not rule.match(lines[at]) or " -" not in lines[at].strip() or (not bare and not lines[i].strip()):
            return None
        spans = [(m.start(), m.end()) for m in re.finditer(r"-+", lines[at])]
        j, body = at + 1, []
        while j < len(lines) and lines[j].strip() and not rule.match(lines[j]):
            body.append(lines[j])
            j += 1
        if bare and (j >= len(lines) or not rule.match(lines[j])):
            return None
        if j < len(lines) and rule.match(lines[j]):
            j += 1
        part = lambda line: [line[a : (spans[k + 1][0] if k + 1 < len(spans) else None)].strip() for k, (a, _) in enumerate(spans)]
        probe = (body[0] if bare and body else lines[i]).ljust(spans[-1][1])
        kinds = []
        for a, z in spans:
            left, right = probe[a] != " ", probe[z - 1] != " "
            kinds.append("AlignDefault" if left and right else "AlignLeft" if left else "AlignRight" if right else "AlignCenter")
        caption, j = self._caption(lines, j)
        made = node("MdTable", [[] if bare else part(lines[i]), [part(x) for x in body], kinds, caption])
        return [made], j

    def _paragraph(self, lines, i):
        text, j = [lines[i].lstrip(" \t")], i + 1
        while j < len(lines) and lines[j].strip():
            line = lines[j]
            if columns(line) < 4 and (m := re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line)):
                body = "\n".join(text).rstrip()
                at = NO_ATTR
                if (self.has("header_attributes") or self.has("attributes")) and (a := re.search(r"[ \t]*\{([^{}]*)\}$", body)):
                    at, body = parse_attr(a[1]), body[: a.start()]
                return [node("Header", [1 if m[1][0] == "=" else 2, at, body])], j + 1
            if self._starts_block(lines, j):
                break
            text.append(line.lstrip(" \t"))
            j += 1
        if self.has("definition_lists") and (made := self._definitions(lines, i, j, text)):
            return made
        return [node("Para", "\n".join(text).rstrip(" \t"))], j

    def _definitions(self, lines, i, j, text):
        k = j
        while k < len(lines) and not lines[k].strip():
            k += 1
        at = next((x for x in range(i + 1, j) if re.match(r" {0,3}[:~][ \t]", lines[x])), k if k < len(lines) and k - j <= 1 and re.match(r" {0,3}[:~][ \t]", lines[k]) else None)
        if at is None or at - i > 1 and at < j or (at == k and len(text) != 1):
            return None
        items, pos = [], i
        while pos < len(lines):
            term, p = lines[pos], pos + 1
            while p < len(lines) and not lines[p].strip():
                p += 1
            if not term.strip() or p >= len(lines) or not re.match(r" {0,3}[:~][ \t]", lines[p]):
                break
            loose = p > pos + 1
            defs = []
            while p < len(lines) and (m := re.match(r" {0,3}[:~]([ \t]+)(.*)$", lines[p])):
                body = [m[2]]
                p += 1
                while p < len(lines) and (columns(lines[p]) >= 4 or not lines[p].strip() or (lines[p - 1].strip() and not re.match(r" {0,3}[:~][ \t]", lines[p]))):
                    if not lines[p].strip() and not (p + 1 < len(lines) and columns(lines[p + 1]) >= 4):
                        break
                    body.append(dedent(lines[p], 4))
                    p += 1
                bs = self.blocks(body)
                defs.append(bs if loose else [node("Plain", b["c"]) if b["t"] == "Para" else b for b in bs])
                q = p
                while q < len(lines) and not lines[q].strip():
                    q += 1
                if q < len(lines) and re.match(r" {0,3}[:~][ \t]", lines[q]):
                    p = q
            items.append([node("RawTerm", term.strip()), defs])
            pos = p
            while pos < len(lines) and not lines[pos].strip():
                pos += 1
        return ([node("DefinitionList", items)], pos) if items else None

    # ------------------------------------------------------------ inlines

    def inlines(self, s: str) -> list[Node]:
        return trim(merge(self._inlines(s.strip(" \t\n"), True)))

    def _inlines(self, s: str, links: bool) -> list[Node]:
        out: list[Any] = []  # nodes and delimiter runs [char, count, opens, closes, run length]
        i, n = 0, len(s)
        word = ""

        def flush() -> None:
            nonlocal word
            if word:
                out.extend(text_inlines(word))
                word = ""

        def put(x: Node, to: int) -> int:
            flush()
            out.append(x)
            return to

        special = set("\\`*_[]!<&~^$\n'\".-:@=")
        while i < n:
            c = s[i]
            if c not in special:
                word += c
                i += 1
                continue
            if c == "\\":
                if i + 1 < n and s[i + 1] == "\n" and (not self.greedy or self.has("escaped_line_breaks")):
                    i = put(node("LineBreak"), i + 2)
                    while i < n and s[i] in " \t":
                        i += 1
                elif i + 1 < n and s[i + 1] == " " and self.has("all_symbols_escapable"):
                    word += "\u00a0"
                    i += 2
                elif i + 1 < n and s[i + 1] in PUNCT:
                    word += s[i + 1]
                    i += 2
                else:
                    word += c
                    i += 1
                continue
            if c == "\n":
                hard = word.endswith("  ")
                word = word.rstrip(" ")
                kind = "LineBreak" if hard or self.has("hard_line_breaks") else "Space" if self.has("ignore_line_breaks") else "SoftBreak"
                flush()
                while out and isinstance(out[-1], dict) and out[-1]["t"] == "Space":
                    out.pop()
                out.append(node(kind))
                i += 1
                while i < n and s[i] in " \t":
                    i += 1
                continue
            if c == "`":
                run = len(s[i:]) - len(s[i:].lstrip("`"))
                m = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(s, i + run)
                if m:
                    code = s[i + run : m.start()].replace("\n", " ")
                    if self.greedy:
                        code = code.strip()
                    elif code.startswith(" ") and code.endswith(" ") and code.strip():
                        code = code[1:-1]
                    end = m.end()
                    at, a = NO_ATTR, ATTRS.match(s, end)
                    if a and self.has("raw_attribute") and re.fullmatch(r"=[\w-]+", a[1].strip()):
                        i = put(node("RawInline", [a[1].strip()[1:], code]), a.end())
                        continue
                    if a and (self.has("inline_code_attributes") or self.has("attributes")):
                        at, end = parse_attr(a[1]), a.end()
                    i = put(node("Code", [at, code]), end)
                else:
                    word += "`" * run
                    i += run
                continue
            if c == "<":
                if m := AUTOLINK.match(s, i):
                    i = put(node("Link", [attr(classes=["uri"]), [node("Str", m[1])], [escape_url(m[1]), ""]]), m.end())
                    continue
                if m := EMAIL.match(s, i):
                    i = put(node("Link", [attr(classes=["email"]), [node("Str", m[1])], ["mailto:" + m[1], ""]]), m.end())
                    continue
                if m := RAW.match(s, i):
                    i = put(node("RawInline", ["html", m[0]]), m.end()) if self.has("raw_html") else put(node("Str", ""), m.end())
                    continue
            if c == "&" and (m := ENTITY.match(s, i)):
                word += html.unescape(m[0])
                i = m.end()
                continue
            if c == "$" and self.has("tex_math_dollars"):
                if m := re.compile(r"\$\$(.+?)\$\$", re.S).match(s, i):
                    i = put(node("Math", [node("DisplayMath"), m[1]]), m.end())
                    continue
                if m := re.compile(r"\$(?!\s)((?:[^$\\]|\\.)+?)(?<!\s)\$(?!\d)", re.S).match(s, i):
                    i = put(node("Math", [node("InlineMath"), m[1]]), m.end())
                    continue
            if c == ":" and self.has("emoji") and (m := re.compile(r":([a-z0-9_+-]+):").match(s, i)) and m[1] in EMOJI:
                i = put(node("Span", [attr(classes=["emoji"], kv=[["data-emoji", m[1]]]), [node("Str", EMOJI[m[1]])]]), m.end())
                continue
            if c == "^" and self.has("inline_notes") and s.startswith("^[", i) and (end := self._bracket(s, i + 1)):
                i = put(node("Note", [node("Para", trim(merge(self._inlines(s[i + 2 : end], links))))]), end + 1)
                continue
            if c == "[" and self.has("footnotes") and (m := re.compile(r"\[\^([^\]\s]+)\]").match(s, i)) and label_key(m[1]) in self.notes and label_key(m[1]) not in self.open_notes:
                key = label_key(m[1])
                self.open_notes.add(key)
                body = self._resolve(self.blocks(self.notes[key]))
                self.open_notes.discard(key)
                i = put(node("Note", body), m.end())
                continue
            if c == "[" and s.startswith("[[", i) and (self.has("wikilinks_title_after_pipe") or self.has("wikilinks_title_before_pipe")) and (m := re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]").match(s, i)):
                url, label = (m[1], m[2] or m[1]) if self.has("wikilinks_title_after_pipe") else (m[2] or m[1], m[1])
                i = put(node("Link", [attr(classes=["wikilink"]), text_inlines(label.strip()), [url.strip(), ""]]), m.end())
                continue
            if c == "[" and self.has("citations") and (made := self._citation(s, i, links)):
                i = put(made[0], made[1])
                continue
            if c == "@" and self.has("citations") and (not word or not word[-1].isalnum()) and (m := CITE.match(s, i)):
                i = put(node("Cite", [[cite(m[2], [], [], "AuthorInText")], [node("Str", m[0])]]), m.end())
                continue
            if c == "[" or (c == "!" and s.startswith("![", i)):
                made = self._link(s, i, links)
                if made:
                    i = put(made[0], made[1])
                    continue
            if c in "*_" or (c == "~" and (self.has("strikeout") or self.has("subscript"))) or (c == "^" and self.has("superscript")) or (c == "=" and self.has("mark") and s.startswith("==", i)) or (c in "'\"" and self.has("smart")):
                j = i
                while j < n and s[j] == c and not (c in "'\"" and j > i):
                    j += 1
                before, after = (s[i - 1] if i else " "), (s[j] if j < n else " ")
                sp = lambda x: x.isspace()
                pu = lambda x: x in PUNCT or unicodedata.category(x)[0] in "PS"
                left = not sp(after) and (not pu(after) or sp(before) or pu(before))
                right = not sp(before) and (not pu(before) or sp(after) or pu(after))
                opens, closes = left, right
                if c == "_" and (not self.greedy or self.has("intraword_underscores")):
                    opens, closes = left and (not right or pu(before)), right and (not left or pu(after))
                if c in "~^":
                    opens, closes = not sp(after), not sp(before)
                flush()
                out.append([c, j - i, opens, closes, j - i])
                i = j
                continue
            if self.has("smart") and c == "." and s.startswith("...", i):
                word += "…"
                i += 3
                continue
            if self.has("smart") and c == "-" and (m := re.compile(r"-{2,}").match(s, i)):
                k = len(m[0])
                word += "—" * (k // 3) + ("–" if k % 3 == 2 else "-" if k % 3 == 1 else "")
                i = m.end()
                continue
            word += c
            i += 1
        flush()
        made = self._emphasis(out)
        return self._bare(made) if links and self.has("autolink_bare_uris") else made

    def _bracket(self, s: str, i: int) -> int | None:
        """The end of the bracket that opens at i; escapes, code spans and inner brackets are skipped."""
        depth, k = 0, i
        while k < len(s):
            c = s[k]
            if c == "\\":
                k += 1
            elif c == "`":
                run = len(s[k:]) - len(s[k:].lstrip("`"))
                m = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(s, k + run)
                k = m.end() - 1 if m else k + run - 1
            elif c == "<" and (m := RAW.match(s, k) or AUTOLINK.match(s, k)):
                k = m.end() - 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    return k
            k += 1
        return None

    def _citation(self, s: str, i: int, links: bool):
        """A bracket of citations: prefix, optional minus sign, key, suffix; semicolons part them."""
        end = self._bracket(s, i)
        if end is None or not CITE.search(s, i, end) or s[end + 1 : end + 2] in ("(", "["):
            return None
        made = []
        for part in s[i + 1 : end].split(";"):
            m = CITE.search(part)
            if not m:
                return None
            inner = lambda x: trim(merge(self._inlines(x, links)))
            made.append(cite(m[2], inner(part[: m.start()].strip()), merge(self._inlines(part[m.end() :].rstrip(), links)), "SuppressAuthor" if m[1] else "NormalCitation"))
        return node("Cite", [made, text_inlines(s[i : end + 1])]), end + 1

    def _link(self, s: str, i: int, links: bool):
        image = s[i] == "!"
        a = i + 1 if image else i
        end = self._bracket(s, a)
        if end is None or (not image and not links):
            return None
        label = s[a + 1 : end]
        target, stop = None, end + 1
        m = re.compile(r"\(\s*(<(?:[^<>\n\\]|\\.)*>|(?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*)?(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S).match(s, end + 1)
        if m:
            url = m[1] or ""
            target, stop = [escape_url(unescape(url[1:-1] if url.startswith("<") else url)), unescape(m[2][1:-1]) if m[2] else ""], m.end()
        else:
            r = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, end + 1)
            key = label_key(r[1]) if r and r[1].strip() else label_key(label)
            if (r or not self.greedy or self.has("shortcut_reference_links")) and key in self.refs:
                target, stop = list(self.refs[key]), r.end() if r else end + 1
            elif (r is None or not r[1].strip()) and key in self.headings:
                target, stop = [self.headings[key], ""], r.end() if r else end + 1
            elif self.has("bracketed_spans") and (b := ATTRS.match(s, end + 1)) and not image:
                return node("Span", [parse_attr(b[1]), trim(merge(self._inlines(label, links)))]), b.end()
        if target is None:
            return None
        inner = merge(self._inlines(label, image and links))
        if not image and any(x["t"] == "Link" for x in inner):
            return None
        at = NO_ATTR
        if (self.has("link_attributes") or self.has("attributes")) and (b := ATTRS.match(s, stop)):
            at, stop = parse_attr(b[1]), b.end()
        return node("Image" if image else "Link", [at, trim(inner), target]), stop

    def _emphasis(self, items: list[Any]) -> list[Node]:
        """Delimiter runs become emphasis: each closer takes the nearest opener of its kind; what is left over is text."""
        kinds = {"*": ("Emph", "Strong"), "_": ("Emph", "Strong"), "~": ("Subscript", "Strikeout"), "^": ("Superscript", None), "=": (None, "Mark"), "'": ("SingleQuote", None), '"': ("DoubleQuote", None)}
        k = 0
        while k < len(items):
            d = items[k]
            if isinstance(d, dict) or not d[3] or not d[1]:
                k += 1
                continue
            found = None
            for o in range(k - 1, -1, -1):
                p = items[o]
                if isinstance(p, dict) or p[0] != d[0] or not p[2] or not p[1]:
                    continue
                if d[0] in "*_" and (p[3] or d[2]) and (p[4] + d[4]) % 3 == 0 and (p[4] % 3 or d[4] % 3):
                    continue
                use = 2 if min(p[1], d[1]) >= 2 and kinds[d[0]][1] else 1
                if d[0] == "~" and (use == 2 and not self.has("strikeout") or use == 1 and not self.has("subscript")):
                    continue
                if kinds[d[0]][use - 1] is None:
                    continue
                if d[0] in "~^" and use == 1 and any(isinstance(x, dict) and x["t"] in ("Space", "SoftBreak") for x in items[o + 1 : k]):
                    continue
                found = o, use
                break
            if found is None:
                k += 1
                continue
            o, use = found
            inner = merge([x for d2 in items[o + 1 : k] for x in self._literal(d2)])
            kind = kinds[d[0]][use - 1]
            made = node("Span", [attr(classes=["mark"]), inner]) if kind == "Mark" else node("Quoted", [node(kind), inner]) if kind.endswith("Quote") else node(kind, inner)
            items[o][1] -= use
            d[1] -= use
            items[o + 1 : k] = [made]
            k = o + 2
            if not items[o][1]:
                del items[o]
                k -= 1
            if not d[1]:
                del items[k]
        return merge([x for d in items for x in self._literal(d)])

    def _literal(self, d: Any) -> list[Node]:
        if isinstance(d, dict):
            return [d] if d.get("c") != "" else []
        c = {"'": "’", '"': "”"}.get(d[0], d[0]) if self.has("smart") else d[0]
        if d[0] == '"' and d[2] and not d[3]:
            c = "“"
        return [node("Str", c * d[1])] if d[1] else []

    def _bare(self, inlines: list[Node]) -> list[Node]:
        out: list[Node] = []
        for x in inlines:
            m = BARE.search(x["c"]) if x["t"] == "Str" else None
            if not m:
                out.append(x)
                continue
            url = re.sub(r"[?!.,:*_~'\"]+$", "", m[0])
            while url.endswith(")") and url.count(")") > url.count("("):
                url = url[:-1]
            target = url if url.startswith("http") else "http://" + url
            rest = x["c"][m.start() + len(url) :]
            out += [y for y in (node("Str", x["c"][: m.start()]), node("Link", [attr(classes=["uri"]), [node("Str", url)], [target, ""]]), node("Str", rest)) if y.get("c") != ""]
        return out


# A few common emoji names.
EMOJI = {"smile": "😄", "heart": "❤️", "thumbsup": "👍", "+1": "👍", "tada": "🎉", "rocket": "🚀", "warning": "⚠️", "fire": "🔥", "star": "⭐", "bug": "🐛", "sparkles": "✨", "eyes": "👀", "x": "❌", "white_check_mark": "✅"}


def _roman_value(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    total = 0
    for a, b in zip(s, [*s[1:], None], strict=True):
        total += -values[a] if b and values[a] < values[b] else values[a]
    return total


def read(text: str, dialect: str = "markdown") -> dict[str, Any]:
    """A text in the dialect (with toggles: gfm+smart) as a document."""
    base, ext = options.parse_spec(dialect)
    return Reader(ext, options.greedy_paragraphs(base)).read(text or "")
