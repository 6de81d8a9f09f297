"""reStructuredText: two passes. The first collects what explicit markup defines (targets, notes, substitutions), the second
builds blocks; references meet their definitions by name, wherever these stand.
"""

from __future__ import annotations

import csv
import io
import re
from typing import Any

from folioflow.sources.ast import NO_ATTR, Node, attr, document, merge, node, table, text_inlines, trim

ADORN = re.compile(r"([!-/:-@\[-`{-~])\1*\s*$")
BULLET = re.compile(r"(\s*)([*+•‣-])(\s+|$)")
NUMBER = re.compile(r"(\s*)(\(?)(\d+|#|[a-zA-Z]|[ivxlcdmIVXLCDM]+)([.)])(\s+|$)")
EXPLICIT = re.compile(r"\.\.(?:\s+|$)")
DIRECTIVE = re.compile(r"\.\.\s+(?:\|([^|]+)\|\s+)?([\w:-]+?)::(?:\s+(.*))?$")
TARGET = re.compile(r"\.\.\s+_(?:`([^`]+)`|((?:[^:\\]|\\.)+)):(?:\s+(.*))?$")
ANONYMOUS = re.compile(r"(?:\.\. __:|__)\s+(.*)$")
NOTE = re.compile(r"\.\.\s+\[([#*]?[\w.-]*)\](?:\s+(.*))?$")
FIELD = re.compile(r":((?:[^:\\]|\\.)+):(?:\s+(.*))?$")
GRID = re.compile(r"\+(?:[-=]+\+)+\s*$")
SIMPLE = re.compile(r"=+(?:\s+=+)+\s*$")
#: Directives that make a Div of their name (fixed values).
ADMONITIONS = frozenset("attention caution danger error hint important note tip warning admonition topic sidebar".split())
ROLES = {"sup": "Superscript", "superscript": "Superscript", "sub": "Subscript", "subscript": "Subscript", "emphasis": "Emph", "strong": "Strong", "title-reference": "Emph", "title": "Emph", "t": "Emph"}
INLINE = re.compile(
    r"""\\(?P<escape>.)|(?<![\w*])\*\*(?P<strong>\S(?:.*?\S)??)\*\*(?!\w)|(?<![\w*])\*(?P<emph>[^\s*](?:.*?[^\s\\])??)\*(?!\w)|``(?P<code>.+?)``(?!\w)|:(?P<role>[\w-]+):`(?P<roled>[^`]+)`|`(?P<label>[^`<]*?)\s*<(?P<url>[^>`]+)>`(?P<one>__?)|`(?P<phrase>[^`]+)`(?P<ref>__?)?|\|(?P<subst>[^|\s](?:[^|]*[^|\s])?)\|_{0,2}|\[(?P<note>[#*]?[\w.-]*)\]_(?!\w)|(?<![\w`])(?P<word>[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?)(?P<bare>__?)(?!\w)|(?P<uri>(?:https?|ftp)://[^\s<>]*[^\s<>.,;:!?)'"\]]|mailto:[^\s<>]+[\w])""",
    re.S | re.X,
)


def plain_key(s: str) -> str:
    return " ".join(s.split()).lower()


def indent_of(s: str) -> int:
    return len(s) - len(s.lstrip(" "))


def dedented(lines: list[str]) -> list[str]:
    """Without blank ends and without what all lines have as indentation."""
    a, z = 0, len(lines)
    while a < z and not lines[a].strip():
        a += 1
    while z > a and not lines[z - 1].strip():
        z -= 1
    n = min((indent_of(x) for x in lines[a:z] if x.strip()), default=0)
    return [x[n:] for x in lines[a:z]]


def body_of(lines: list[str], i: int) -> int:
    """Where the indented body after line i ends."""
    j = i + 1
    while j < len(lines) and (not lines[j].strip() or lines[j].startswith(" ")):
        j += 1
    while j > i + 1 and not lines[j - 1].strip():
        j -= 1
    return j


class Reader:
    def __init__(self) -> None:
        self.targets: dict[str, str] = {}
        self.anonymous: list[str] = []
        self.notes: dict[str, list[str]] = {}
        self.auto: list[str] = []
        self.symbols: list[str] = []
        self.substitutions: dict[str, list[Node]] = {}
        self.styles: list[str] = []
        self.used = {"anonymous": 0, "auto": 0, "symbols": 0}

    # ------------------------------------------------------------ definitions

    def collect(self, lines: list[str]) -> None:
        waiting: list[str] = []
        for i, line in enumerate(lines):
            s = line.strip()
            if m := TARGET.match(s):
                name, url = plain_key(m[1] or m[2].replace("\\", "")), "".join((m[3] or "").split())
                more = [x.strip() for x in lines[i + 1 : body_of(lines, i)]] if indent_of(line) == 0 else []
                url += "".join(more)
                if name == "_":
                    self.anonymous.append(url)
                elif url:
                    self.targets.update(dict.fromkeys([*waiting, name], url))
                    waiting = []
                else:
                    waiting.append(name)
            elif (m := ANONYMOUS.match(s)) and not waiting:
                self.anonymous.append(m[1].strip())
            elif m := NOTE.match(s):
                body = dedented([m[2] or ""]) + dedented(lines[i + 1 : body_of(lines, i)])
                label = m[1]
                if label == "#":
                    label = f"#{len(self.auto)}"
                    self.auto.append(label)
                elif label == "*":
                    label = f"*{len(self.symbols)}"
                    self.symbols.append(label)
                elif label.startswith("#"):
                    self.auto.append(label)
                self.notes[label] = body
            elif (m := DIRECTIVE.match(s)) and m[1]:
                if m[2] == "replace":
                    self.substitutions[plain_key(m[1])] = self.inlines(m[3] or "")
                elif m[2] == "image":
                    options, _ = self.options(dedented(lines[i + 1 : body_of(lines, i)]))
                    self.substitutions[plain_key(m[1])] = [self.image((m[3] or "").strip(), options)]
                elif m[2] == "unicode":
                    self.substitutions[plain_key(m[1])] = text_inlines("".join(chr(int(x[2:], 16)) if re.fullmatch("(?i)(0x|u\\+)[0-9a-f]+", x) else x for x in (m[3] or "").split()))
            elif s and waiting and indent_of(line) == 0:
                follows = i + 1 < len(lines) and ADORN.fullmatch(lines[i + 1])
                for w in waiting:
                    self.targets.setdefault(w, "#" + (slug(s) if follows else slug(w)))
                waiting = []

    def resolve(self, name: str, text: list[Node], anonymous: bool) -> Node | list[Node]:
        if anonymous:
            k = self.used["anonymous"]
            self.used["anonymous"] += 1
            url = self.anonymous[k] if k < len(self.anonymous) else ""
        else:
            url = self.targets.get(plain_key(name), "")
        seen = set()
        while url.endswith("_") and plain_key(url[:-1].strip("`")) in self.targets and url not in seen:
            seen.add(url)
            url = self.targets[plain_key(url[:-1].strip("`"))]
        return node("Link", [NO_ATTR, text, [url or "#" + slug(name), ""]])

    # ------------------------------------------------------------ inlines

    def inlines(self, s: str) -> list[Node]:
        out: list[Node] = []
        at = 0
        for m in INLINE.finditer(s):
            made = self.one(m)
            if made is None:
                continue
            out += text_inlines(s[at : m.start()])
            out += made if isinstance(made, list) else [made]
            at = m.end()
        return merge(out + text_inlines(s[at:]))

    def one(self, m: re.Match) -> Node | list[Node] | None:
        if m["escape"] is not None:
            return [] if m["escape"].isspace() else node("Str", m["escape"])
        if m["strong"] is not None:
            return node("Strong", text_inlines(re.sub(r"\\(.)", r"\1", m["strong"])))
        if m["emph"] is not None:
            return node("Emph", text_inlines(re.sub(r"\\(.)", r"\1", m["emph"])))
        if m["code"] is not None:
            return node("Code", [NO_ATTR, " ".join(m["code"].split())])
        if m["role"] is not None:
            role, text = m["role"], m["roled"]
            if role == "math":
                return node("Math", [node("InlineMath"), text])
            if role in ROLES:
                return node(ROLES[role], text_inlines(text))
            if role in ("code", "literal"):
                return node("Code", [NO_ATTR, text])
            return node("Code", [attr(classes=["interpreted-text"], kv=[["role", role]]), text])
        if m["url"] is not None:
            url = "".join(m["url"].split())
            text = m["label"].strip()
            if text and m["one"] == "_":
                self.targets.setdefault(plain_key(text), url)
            if url.endswith("_") and plain_key(url[:-1]) in self.targets:
                url = self.targets[plain_key(url[:-1])]
            return node("Link", [NO_ATTR, text_inlines(text or url), [url, ""]])
        if m["phrase"] is not None:
            if not m["ref"]:
                return node("Emph", text_inlines(m["phrase"]))
            return self.resolve(m["phrase"], text_inlines(m["phrase"]), m["ref"] == "__")
        if m["subst"] is not None:
            return self.substitutions.get(plain_key(m["subst"]))
        if m["note"] is not None:
            return self.note(m["note"])
        if m["word"] is not None:
            if m["bare"] == "_" and plain_key(m["word"]) not in self.targets:
                return None
            return self.resolve(m["word"], text_inlines(m["word"]), m["bare"] == "__")
        return node("Link", [NO_ATTR, [node("Str", m["uri"])], [m["uri"], ""]])

    def note(self, label: str) -> Node | None:
        for mark, kind, names in (("#", "auto", self.auto), ("*", "symbols", self.symbols)):
            if label == mark:
                k = self.used[kind]
                self.used[kind] += 1
                label = names[k] if k < len(names) else label
        body = self.notes.get(label)
        if body is None:
            return None
        self.notes[label] = []  # a note that cites itself ends here
        made = node("Note", self.blocks(body))
        self.notes[label] = body
        return made

    def image(self, url: str, options: dict[str, str]) -> Node:
        kv = [[k, options[k]] for k in ("width", "height") if k in options]
        made = node("Image", [attr(classes=options.get("class", "").split(), kv=kv), text_inlines(options.get("alt", "")), [url, ""]])
        return node("Link", [NO_ATTR, [made], [options["target"], ""]]) if options.get("target") else made

    # ------------------------------------------------------------ blocks

    def options(self, lines: list[str]) -> tuple[dict[str, str], list[str]]:
        out: dict[str, str] = {}
        i = 0
        while i < len(lines) and (m := FIELD.match(lines[i])):
            out[m[1]] = (m[2] or "").strip()
            i += 1
        return out, dedented(lines[i:])

    def para(self, s: str) -> list[Node]:
        made = trim(self.inlines(s))
        return [node("Para", made)] if made else []

    def blocks(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = lines[i].rstrip()
            if not line:
                i += 1
                continue
            nxt = lines[i + 1].rstrip() if i + 1 < len(lines) else ""
            if indent_of(line):
                j = i
                while j < len(lines) and (not lines[j].strip() or indent_of(lines[j])):
                    j += 1
                out.append(node("BlockQuote", self.blocks(dedented(lines[i:j]))))
                i = j
            elif GRID.fullmatch(line) or SIMPLE.fullmatch(line):
                made, i = (grid if GRID.fullmatch(line) else simple)(self, lines, i)
                out.append(made)
            elif ADORN.fullmatch(line) and i + 2 < len(lines) and nxt and lines[i + 2].rstrip() == line and not indent_of(lines[i + 2]):
                out.append(self.heading(line[0] * 2, nxt.strip()))
                i += 3
            elif ADORN.fullmatch(line) and len(line) >= 4 and not nxt:
                out.append(node("HorizontalRule"))
                i += 1
            elif nxt and ADORN.fullmatch(nxt) and len(nxt) >= len(line) and not ADORN.fullmatch(line):
                out.append(self.heading(nxt[0], line.strip()))
                i += 2
            elif EXPLICIT.match(line):
                j = body_of(lines, i)
                out += self.explicit(line, lines[i + 1 : j])
                i = j
            elif ANONYMOUS.match(line):
                i += 1
            elif BULLET.match(line) or self.starts_number(line, nxt):
                made, i = self.listing(lines, i)
                out.append(made)
            elif FIELD.match(line):
                made, i = self.fields(lines, i)
                out += made
            elif line.startswith("| ") or line == "|":
                rows = []
                while i < len(lines) and (lines[i].startswith("| ") or lines[i].rstrip() == "|" or rows and lines[i].startswith(" ") and lines[i].strip()):
                    if lines[i].startswith("|"):
                        rows.append(lines[i][2:])
                    else:
                        rows[-1] += " " + lines[i].strip()
                    i += 1
                out.append(node("LineBlock", [trim(self.inlines(x)) for x in rows]))
            elif line.startswith(">>> "):
                j = i
                while j < len(lines) and lines[j].strip():
                    j += 1
                out.append(node("CodeBlock", [attr(classes=["python", "doctest"]), "\n".join(lines[i:j])]))
                i = j
            elif nxt and indent_of(nxt) and not line.endswith("::"):
                made, i = self.definitions(lines, i)
                out.append(made)
            else:
                j = i
                while j < len(lines) and lines[j].strip() and (j == i or not indent_of(lines[j])):
                    j += 1
                text = "\n".join(x.rstrip() for x in lines[i:j])
                literal = text.endswith("::")
                if literal:
                    text = text[:-2].rstrip() if text[:-2] == "" or text[-3:-2].isspace() else text[:-1]
                out += self.para(text)
                i = j
                if literal:
                    while i < len(lines) and not lines[i].strip():
                        i += 1
                    k = body_of(lines, i - 1)
                    if k > i:
                        out.append(node("CodeBlock", [NO_ATTR, "\n".join(dedented(lines[i:k]))]))
                        i = k
        return out

    def heading(self, style: str, text: str) -> Node:
        if style not in self.styles:
            self.styles.append(style)
        return node("Header", [min(self.styles.index(style) + 1, 6), attr(slug(text)), trim(self.inlines(text))])

    def starts_number(self, line: str, nxt: str) -> bool:
        m = NUMBER.match(line)
        return bool(m) and not (m[2] and m[4] != ")") and (not nxt.strip() or indent_of(nxt) >= 2 or bool(NUMBER.match(nxt)))

    def listing(self, lines: list[str], i: int) -> tuple[Node, int]:
        kind = BULLET if BULLET.match(lines[i]) else NUMBER
        first = kind.match(lines[i])
        items: list[list[str]] = []
        loose = False
        while i < len(lines) and (m := kind.match(lines[i])) and (m[2] == first[2] if kind is BULLET else m[4] == first[4] and m[2] == first[2]):
            j = i + 1
            while j < len(lines) and (not lines[j].strip() or lines[j].startswith(" ")):
                j += 1
            more = dedented(lines[i + 1 : j])
            gap = [""] if more and not lines[i + 1].strip() else []
            items.append([lines[i][m.end() :], *gap, *more])
            i = j
        made = [self.blocks(x) for x in items]
        loose = any(len([b for b in x if b["t"] == "Para"]) > 1 for x in made)
        if not loose:
            made = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in x] for x in made]
        if kind is BULLET:
            return node("BulletList", made), i
        mark = first[3]
        style = "Decimal" if mark.isdigit() else "DefaultStyle" if mark == "#" else ("LowerRoman" if re.fullmatch("[ivx]+", mark) else "UpperRoman" if re.fullmatch("[IVX]+", mark) else "LowerAlpha" if mark.islower() else "UpperAlpha")
        delim = "DefaultDelim" if mark == "#" else "TwoParens" if first[2] else "OneParen" if first[4] == ")" else "Period"
        start = int(mark) if mark.isdigit() else 1
        return node("OrderedList", [[start, node(style), node(delim)], made]), i

    def definitions(self, lines: list[str], i: int) -> tuple[Node, int]:
        out = []
        while i + 1 < len(lines) and lines[i].strip() and not indent_of(lines[i]) and indent_of(lines[i + 1]) and not EXPLICIT.match(lines[i]):
            j = body_of(lines, i)
            term, *kinds = re.split(r"\s+:\s+", lines[i].strip())
            words = trim(self.inlines(term)) + [x for k in kinds for x in (node("Space"), node("Emph", text_inlines(k)))]
            out.append([words, [self.blocks(dedented(lines[i + 1 : j]))]])
            i = j
            while i < len(lines) and not lines[i].strip():
                i += 1
        return node("DefinitionList", out), i

    def fields(self, lines: list[str], i: int) -> tuple[list[Node], int]:
        out = []
        while i < len(lines) and (m := FIELD.match(lines[i])):
            j = body_of(lines, i)
            out.append([[node("Strong", text_inlines(m[1]))], [self.blocks(dedented([m[2] or "", *dedented(lines[i + 1 : j])]))]])
            i = j
            while i < len(lines) and not lines[i].strip() and i + 1 < len(lines) and FIELD.match(lines[i + 1]):
                i += 1
        return [node("DefinitionList", out)], i

    def explicit(self, line: str, body: list[str]) -> list[Node]:
        m = DIRECTIVE.match(line)
        if TARGET.match(line) or NOTE.match(line) or line.startswith(".. __:") or m and m[1]:
            return []
        if not m:
            return []  # a comment
        name, argument = m[2].lower(), (m[3] or "").strip()
        options, rest = self.options(dedented(body))
        if name in ("code", "code-block", "sourcecode", "highlight", "parsed-literal"):
            kv = [["startFrom", options["lineno-start"]]] if "lineno-start" in options else []
            classes = ([argument] if argument else []) + (["numberLines"] if "linenos" in options or "number-lines" in options else [])
            return [node("CodeBlock", [attr(options.get("name", ""), classes, kv), "\n".join(rest)])]
        if name == "math":
            parts = "\n".join([argument, *rest]).strip().split("\n\n")
            return [node("Para", [node("Math", [node("DisplayMath"), p.strip()]) for p in parts if p.strip()])]
        if name == "image":
            return [node("Para", [self.image(argument, options)])]
        if name == "figure":
            made = self.blocks(rest)
            caption = [node("Plain", made[0]["c"]) if made[0]["t"] == "Para" else made[0], *made[1:]] if made else []
            return [node("Figure", [attr(options.get("name", ""), options.get("figclass", "").split()), [None, caption], [node("Plain", [self.image(argument, options)])]])]
        if name == "raw":
            return [node("RawBlock", [argument.split()[0] if argument else "html", "\n".join(rest)])]
        if name in ("csv-table", "list-table", "table"):
            return [self.table_of(name, argument, options, rest)]
        if name in ADMONITIONS:
            title = argument if name in ("admonition", "topic", "sidebar") else name.capitalize()
            gap = [""] if body and not body[0].strip() else []
            text = rest if name in ("admonition", "topic", "sidebar") or not argument else [argument, *gap, *rest]
            head = [node("Div", [attr(classes=["title"]), self.para(title)])] if title else []
            return [node("Div", [attr(classes=[name, *options.get("class", "").split()]), [*head, *self.blocks(text)]])]
        if name in ("epigraph", "highlights", "pull-quote"):
            return [node("BlockQuote", self.blocks(rest))]
        if name in ("container", "class", "compound"):
            return [node("Div", [attr(classes=argument.split()), self.blocks(rest)])]
        if name == "rubric":
            return [node("Para", [node("Strong", self.inlines(argument))])]
        if name in ("contents", "sectnum", "include", "meta", "default-role", "role", "target-notes", "header", "footer", "title"):
            return []
        return [node("Div", [attr(classes=[name]), [*self.para(argument), *self.blocks(rest)]])]

    def table_of(self, name: str, title: str, options: dict[str, str], rest: list[str]) -> Node:
        caption = [node("Plain", trim(self.inlines(title)))] if title else []
        if name == "table":
            made = next((b for b in self.blocks(rest) if b["t"] == "Table"), table([], [], []))
            made["c"][1] = [None, caption]
            return made
        number = lambda k: int(options[k]) if options.get(k, "").isdigit() else 0
        if name == "csv-table":
            mark = {"tab": "\t", "space": " "}.get(options.get("delim", ","), options.get("delim", ","))
            rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO("\n".join(rest)), delimiter=mark, skipinitialspace=True)]
            top = next(csv.reader([options["header"]], skipinitialspace=True), []) if options.get("header") else None
            cells = [[self.cell([c]) for c in r] for r in ([top] if top else []) + rows]
            heads = number("header-rows") + (1 if top else 0)
        else:
            outer = next((b for b in self.blocks(rest) if b["t"] == "BulletList"), node("BulletList", []))["c"]
            cells = [item[0]["c"] if item and item[0]["t"] == "BulletList" else [item] for item in outer]
            heads = number("header-rows")
        width = max(map(len, cells), default=0)
        cells = [r + [[]] * (width - len(r)) for r in cells]
        made = table(cells[0] if heads else [], cells[1 if heads else 0 :], ["AlignDefault"] * width, caption)
        shares = [int(x) for x in re.findall(r"\d+", options.get("widths", ""))]
        if len(shares) == width and sum(shares):
            for spec, share in zip(made["c"][2], shares, strict=True):
                spec[1] = node("ColWidth", share / sum(shares))
        return made

    def cell(self, lines: list[str]) -> list[Node]:
        made = self.blocks(dedented(lines))
        return [node("Plain", made[0]["c"])] if len(made) == 1 and made[0]["t"] == "Para" else made

    def read(self, text: str) -> dict[str, Any]:
        lines = [x.expandtabs(8).rstrip() for x in text.replace("\r\n", "\n").split("\n")]
        self.collect(lines)
        return document(self.blocks(lines))


def slug(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-")


def grid(reader: Reader, lines: list[str], i: int) -> tuple[Node, int]:
    """A grid table; borders that are missing between two cells join them (row and column spans)."""
    j = i
    while j < len(lines) and lines[j][:1] in ("+", "|"):
        j += 1
    rows = lines[i:j]
    wide = max(map(len, rows))
    rows = [r.ljust(wide) for r in rows]
    rules = [k for k, r in enumerate(rows) if re.fullmatch(r"[+|].*", r) and re.search(r"\+[-=]+\+", r)]
    columns = sorted({c for k in rules for c, ch in enumerate(rows[k]) if ch == "+"})
    head = next((n for n, k in enumerate(rules) if n and "=" in rows[k] and set(rows[k].strip()) <= set("+=")), 0)
    taken: set[tuple[int, int]] = set()
    made: list[list[Any]] = []
    for r in range(len(rules) - 1):
        line = []
        for c in range(len(columns) - 1):
            if (r, c) in taken:
                continue
            across = c + 1
            while across < len(columns) - 1 and rows[rules[r] + 1][columns[across]] not in "|+":
                across += 1
            down = r + 1
            while down < len(rules) - 1 and not re.fullmatch(r"[-=+]+", rows[rules[down]][columns[c] + 1 : columns[across]]):
                down += 1
            taken |= {(y, x) for y in range(r, down) for x in range(c, across)}
            text = [x[columns[c] + 1 : columns[across]].rstrip() for x in rows[rules[r] + 1 : rules[down]]]
            line.append([NO_ATTR, node("AlignDefault"), down - r, across - c, reader.cell(text)])
        made.append([NO_ATTR, line])
    total = max(columns[-1] - columns[0], 1)
    specs = [[node("AlignDefault"), node("ColWidth", round((b - a) / max(total, 72), 4))] for a, b in zip(columns, columns[1:], strict=False)]
    return node("Table", [NO_ATTR, [None, []], specs, [NO_ATTR, made[:head]], [[NO_ATTR, 0, [], made[head:]]], [NO_ATTR, []]]), j


def simple(reader: Reader, lines: list[str], i: int) -> tuple[Node, int]:
    """A simple table: rules of equals signs; a row goes on where its first column is blank."""
    spans = [m.span() for m in re.finditer("=+", lines[i])]
    j, marks = i + 1, [i]
    while j < len(lines):
        if SIMPLE.fullmatch(lines[j].rstrip()):
            marks.append(j)
            if len(marks) == 3 or j + 1 >= len(lines) or not lines[j + 1].strip():
                break
        j += 1
    end = marks[-1]

    def rows(a: int, z: int) -> list[list[list[Node]]]:
        out: list[list[list[str]]] = []
        for line in lines[a:z]:
            if not line.strip() or re.fullmatch(r"-+(\s+-+)*", line.strip()):
                continue
            cut = [line[x : (spans[k + 1][0] if k + 1 < len(spans) else None)].strip() for k, (x, _) in enumerate(spans)]
            if cut[0] or not out:
                out.append([[c] for c in cut])
            else:
                for have, c in zip(out[-1], cut, strict=True):
                    have.append(c)
        return [[reader.cell(c) for c in r] for r in out]

    head = rows(marks[0] + 1, marks[1]) if len(marks) == 3 else []
    body = rows(marks[-2] + 1, end)
    return table(head[0] if head else [], head[1:] + body, ["AlignDefault"] * len(spans)), end + 1


def read(text: str) -> dict[str, Any]:
    return Reader().read(text or "")
