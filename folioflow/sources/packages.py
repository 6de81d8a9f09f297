"""Packaged documents: deterministic zip archives, EPUB, word-processor files (OOXML and OpenDocument), RTF; bytes in, bytes out."""

from __future__ import annotations

import html as entities
import io
import re
import xml.etree.ElementTree as xml
import zipfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.sources import html
from folioflow.sources.ast import NO_ATTR, Node, document, merge, node, plain, table, text_inlines, trim
from folioflow.writers import text as writers

#: The earliest time that zip can say: archives depend on their contents only.
STAMP = (1980, 1, 1, 0, 0, 0)
#: What a part may unpack to, as a guard against bombs.
MOST = 256 << 20


def zip_write(parts: list[tuple[str, bytes]]) -> bytes:
    """An archive of the parts in order; a part that deflating does not shrink is stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            info = zipfile.ZipInfo(name, STAMP)
            packed = name != "mimetype" and len(data) > 16
            probe = io.BytesIO()
            if packed:
                with zipfile.ZipFile(probe, "w", zipfile.ZIP_DEFLATED) as p:
                    p.writestr(zipfile.ZipInfo("x", STAMP), data, zipfile.ZIP_DEFLATED)
                packed = zipfile.ZipFile(probe).infolist()[0].compress_size < len(data)
            z.writestr(info, data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def zip_read(data: bytes) -> dict[str, bytes]:
    """Parts by name; checksums and sizes are enforced."""
    out: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.file_size > MOST or sum(map(len, out.values())) > MOST:
                raise ValueError("archive unpacks to too much")
            if not info.is_dir():
                out[info.filename] = z.read(info)
    return out


def esc(s: str) -> str:
    return entities.escape("".join(c for c in s if c in "\t\n\r" or ord(c) >= 32), quote=True)


def title_of(doc: dict[str, Any]) -> str:
    t = doc["meta"].get("title")
    return plain(t["c"]) if t and t["t"] == "MetaInlines" else "Untitled"


# ---------------------------------------------------------------- EPUB


def chapters(doc: dict[str, Any], level: int = 1) -> list[list[Node]]:
    """Runs of blocks; a heading of at most `level` begins one."""
    out: list[list[Node]] = [[]]
    for b in doc["blocks"]:
        if b["t"] == "Header" and b["c"][0] <= level and out[-1]:
            out.append([])
        out[-1].append(b)
    return [c for c in out if c] or [[]]


def epub_write(doc: dict[str, Any], media: dict[str, bytes] | None = None) -> bytes:
    title = esc(title_of(doc))
    parts: list[tuple[str, bytes]] = [("mimetype", b"application/epub+zip"), ("META-INF/container.xml", b'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')]
    items, spine, nav = [], [], []
    for k, blocks in enumerate(chapters(doc), 1):
        name = f"ch{k:03d}.xhtml"
        head = next((plain(b["c"][2]) for b in blocks if b["t"] == "Header"), title)
        body = writers.Html(wrap="none").document({"blocks": blocks})
        parts.append((f"EPUB/text/{name}", f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(head)}</title></head><body>\n{body}\n</body></html>'.encode()))
        items.append(f'<item id="ch{k}" href="text/{name}" media-type="application/xhtml+xml"/>')
        spine.append(f'<itemref idref="ch{k}"/>')
        nav.append(f'<li><a href="text/{name}">{esc(head)}</a></li>')
    for k, (name, data) in enumerate(sorted((media or {}).items())):
        parts.append((f"EPUB/media/{name}", data))
        items.append(f'<item id="m{k}" href="media/{esc(name)}" media-type="{writers.T.IMAGE_MIME.get(name.rsplit(".", 1)[-1].lower(), "application/octet-stream")}"/>')
    items.append('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
    parts.append(("EPUB/nav.xhtml", f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol>{"".join(nav)}</ol></nav></body></html>'.encode()))
    parts.append(("EPUB/content.opf", f'<?xml version="1.0" encoding="UTF-8"?>\n<package version="3.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">folioflow</dc:identifier><dc:title>{title}</dc:title><dc:language>en</dc:language></metadata><manifest>{"".join(items)}</manifest><spine>{"".join(spine)}</spine></package>'.encode()))
    return zip_write(parts)


def epub_read(data: bytes) -> dict[str, Any]:
    parts = zip_read(data)
    root = xml.fromstring(parts["META-INF/container.xml"])
    opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    package = xml.fromstring(parts[opf])
    by = {e.get("id"): e.get("href") for e in package.iter() if e.tag.endswith("}item")}
    blocks: list[Node] = []
    for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
        if ref in by and base + by[ref] in parts:
            blocks += html.read(parts[base + by[ref]].decode("utf-8", "replace"))["blocks"]
    title = next((e.text for e in package.iter() if e.tag.endswith("}title")), None)
    return document(blocks, {"title": node("MetaInlines", text_inlines(title))} if title else {})


# ---------------------------------------------------------------- OOXML

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Docx:
    def __init__(self) -> None:
        self.rels: list[str] = []
        self.notes: list[str] = []

    def runs(self, xs: list[Node], props: str = "") -> str:
        out = []
        wrap = {"Emph": "<w:i/>", "Strong": "<w:b/>", "Underline": '<w:u w:val="single"/>', "Strikeout": "<w:strike/>", "Superscript": '<w:vertAlign w:val="superscript"/>', "Subscript": '<w:vertAlign w:val="subscript"/>', "SmallCaps": "<w:smallCaps/>"}
        say = lambda s, p=props: f'<w:r>{f"<w:rPr>{p}</w:rPr>" if p else ""}<w:t xml:space="preserve">{esc(s)}</w:t></w:r>'
        for x in xs:
            t, c = x["t"], x.get("c")
            if t == "Str":
                out.append(say(c))
            elif t in ("Space", "SoftBreak"):
                out.append(say(" "))
            elif t == "LineBreak":
                out.append("<w:r><w:br/></w:r>")
            elif t in wrap:
                out.append(self.runs(c, props + wrap[t]))
            elif t == "Code":
                out.append(say(c[1], props + '<w:rStyle w:val="VerbatimChar"/>'))
            elif t == "Math":
                out.append(say(c[1]))
            elif t == "Link":
                self.rels.append(c[2][0])
                out.append(f'<w:hyperlink r:id="rId{len(self.rels) + 10}">{self.runs(c[1], props)}</w:hyperlink>')
            elif t == "Note":
                self.notes.append("".join(self.block(b) for b in c))
                out.append(f'<w:r><w:footnoteReference w:id="{len(self.notes) + 1}"/></w:r>')
            elif t == "Quoted":
                out.append(say("“") + self.runs(c[1], props) + say("”"))
            elif t in ("Span", "Cite", "Image"):
                out.append(self.runs(c[1], props))
        return "".join(out)

    def para(self, xs: list[Node], style: str = "", more: str = "") -> str:
        p = (f'<w:pStyle w:val="{style}"/>' if style else "") + more
        return f"<w:p>{f'<w:pPr>{p}</w:pPr>' if p else ''}{self.runs(xs)}</w:p>"

    def block(self, b: Node, level: int = 0, numbering: str = "") -> str:
        t, c = b["t"], b.get("c")
        if t in ("Para", "Plain"):
            return self.para(c, "" if not numbering else "Compact", numbering)
        if t == "Header":
            return self.para(c[2], f"Heading{c[0]}")
        if t == "CodeBlock":
            lines = [x for line in c[1].split("\n") for x in (node("Str", line), node("LineBreak"))][:-1]
            return self.para(lines, "SourceCode")
        if t == "BlockQuote":
            return "".join(self.para(x["c"], "BlockText") if x["t"] in ("Para", "Plain") else self.block(x) for x in c)
        if t in ("BulletList", "OrderedList"):
            out = []
            for item in c if t == "BulletList" else c[1]:
                mark = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{1 if t == "BulletList" else 2}"/></w:numPr>'
                for k, x in enumerate(item):
                    out.append(self.block(x, level + 1, mark if k == 0 else ""))
            return "".join(out)
        if t == "HorizontalRule":
            return '<w:p><w:pPr><w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr></w:pPr></w:p>'
        if t == "Table":
            head, rows, _, caption = writers.cells_of(c)
            row = lambda r: "<w:tr>" + "".join(f"<w:tc>{''.join(map(self.block, x)) or '<w:p/>'}</w:tc>" for x in r) + "</w:tr>"
            return "".join(map(self.block, caption)) + "<w:tbl>" + "".join(map(row, ([head] if head else []) + rows)) + "</w:tbl>"
        if t == "Div":
            return "".join(map(self.block, c[1]))
        if t == "Figure":
            return "".join(map(self.block, [*c[2], *c[1][1]]))
        if t == "DefinitionList":
            return "".join(self.para(term, "DefinitionTerm") + "".join(self.para(x["c"], "Definition") if x["t"] in ("Para", "Plain") else self.block(x) for d in ds for x in d) for term, ds in c)
        if t == "LineBlock":
            return self.para([x for line in c for x in (*line, node("LineBreak"))][:-1])
        return ""

    def write(self, doc: dict[str, Any]) -> bytes:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        body = "".join(map(self.block, doc["blocks"]))
        if "title" in doc["meta"]:
            body = self.para(text_inlines(title_of(doc)), "Title") + body
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        rels = f'<Relationship Id="rId1" Type="{rel}/footnotes" Target="footnotes.xml"/><Relationship Id="rId2" Type="{rel}/numbering" Target="numbering.xml"/>' + "".join(f'<Relationship Id="rId{k + 11}" Type="{rel}/hyperlink" Target="{esc(u)}" TargetMode="External"/>' for k, u in enumerate(self.rels))
        notes = "".join(f'<w:footnote w:id="{k + 2}">{n}</w:footnote>' for k, n in enumerate(self.notes))
        levels = lambda kind, text: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text.replace("N", str(k + 1))}"/></w:lvl>' for k in range(9))
        numbering = f'<w:abstractNum w:abstractNumId="1">{levels("bullet", "•")}</w:abstractNum><w:abstractNum w:abstractNumId="2">{levels("decimal", "%N.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num>'
        kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
        parts = {
            "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/footnotes.xml" ContentType="{kind}.footnotes+xml"/><Override PartName="/word/numbering.xml" ContentType="{kind}.numbering+xml"/></Types>',
            "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f"<w:document {ns}><w:body>{body}<w:sectPr/></w:body></w:document>",
            "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
            "word/footnotes.xml": f"<w:footnotes {ns}>{notes}</w:footnotes>",
            "word/numbering.xml": f"<w:numbering {ns}>{numbering}</w:numbering>",
        }
        return zip_write([(k, (head + v).encode()) for k, v in parts.items()])

    def read(self, data: bytes) -> dict[str, Any]:
        parts = zip_read(data)
        rels = {e.get("Id"): e.get("Target") for e in xml.fromstring(parts.get("word/_rels/document.xml.rels", b"<x/>"))}
        kinds: dict[str, dict[str, str]] = {}
        if "word/numbering.xml" in parts:
            root = xml.fromstring(parts["word/numbering.xml"])
            shape = {a.get(W + "abstractNumId"): {lv.get(W + "ilvl"): (lv.find(W + "numFmt").get(W + "val") if lv.find(W + "numFmt") is not None else "bullet") for lv in a.findall(W + "lvl")} for a in root.findall(W + "abstractNum")}
            kinds = {n.get(W + "numId"): shape.get(n.find(W + "abstractNumId").get(W + "val"), {}) for n in root.findall(W + "num")}
        notes = {n.get(W + "id"): n for n in xml.fromstring(parts["word/footnotes.xml"])} if "word/footnotes.xml" in parts else {}

        def inlines(p: Any) -> list[Node]:
            out: list[Node] = []
            for e in p:
                if e.tag == W + "hyperlink":
                    out.append(node("Link", [NO_ATTR, inlines(e), [rels.get(e.get(REL + "id"), "#" + e.get(W + "anchor", "")), ""]]))
                elif e.tag == W + "r":
                    made: list[Node] = []
                    for k in e:
                        if k.tag == W + "t":
                            made += text_inlines(k.text or "")
                        elif k.tag == W + "tab":
                            made.append(node("Space"))
                        elif k.tag == W + "br":
                            made.append(node("LineBreak"))
                        elif k.tag == W + "footnoteReference" and k.get(W + "id") in notes:
                            made.append(node("Note", blocks(notes[k.get(W + "id")])))
                    pr = e.find(W + "rPr")
                    if pr is not None and made:
                        style = pr.find(W + "rStyle")
                        if style is not None and style.get(W + "val") == "VerbatimChar":
                            made = [node("Code", [NO_ATTR, plain(made)])]
                        on = lambda n: (x := pr.find(W + n)) is not None and x.get(W + "val") not in ("0", "false", "none")
                        for n, tag in (("i", "Emph"), ("b", "Strong"), ("strike", "Strikeout"), ("u", "Underline"), ("smallCaps", "SmallCaps")):
                            if on(n):
                                made = [node(tag, made)]
                        v = pr.find(W + "vertAlign")
                        if v is not None:
                            made = [node("Superscript" if v.get(W + "val") == "superscript" else "Subscript", made)]
                    if made and out and made[0]["t"] == out[-1]["t"] and made[0]["t"] in ("Emph", "Strong", "Strikeout", "Underline", "Superscript", "Subscript"):
                        out[-1]["c"] = merge(out[-1]["c"] + made[0]["c"])
                        made = made[1:]
                    out += made
                elif e.tag in (W + "ins", W + "smartTag", W + "sdt", W + "sdtContent"):
                    out += inlines(e)
            return merge(out)

        def blocks(body: Any) -> list[Node]:
            out: list[Node] = []
            items: list[tuple[int, bool, list[Node]]] = []

            def flush() -> None:
                def nest(k: int, level: int) -> tuple[list[Node], int]:
                    made: list[Node] = []
                    while k < len(items) and items[k][0] >= level:
                        if items[k][0] > level and made:
                            inner, k = nest(k, items[k][0])
                            last = made[-1]["c"] if made[-1]["t"] == "BulletList" else made[-1]["c"][1]
                            last[-1] += inner
                            continue
                        tag = "OrderedList" if items[k][1] else "BulletList"
                        if not made or made[-1]["t"] != tag:
                            made.append(node(tag, [[1, node("Decimal"), node("Period")], []] if items[k][1] else []))
                        (made[-1]["c"][1] if items[k][1] else made[-1]["c"]).append(list(items[k][2]))
                        k += 1
                    return made, k

                if items:
                    out.extend(nest(0, min(i[0] for i in items))[0])
                    items.clear()

            for e in body:
                if e.tag == W + "p":
                    pr = e.find(W + "pPr")
                    style = pr.find(W + "pStyle") if pr is not None else None
                    name = style.get(W + "val") if style is not None else ""
                    num = pr.find(W + "numPr") if pr is not None else None
                    xs = trim(inlines(e))
                    if num is not None and num.find(W + "numId") is not None:
                        level = num.find(W + "ilvl").get(W + "val") if num.find(W + "ilvl") is not None else "0"
                        kind = kinds.get(num.find(W + "numId").get(W + "val"), {}).get(level, "bullet")
                        items.append((int(level), kind != "bullet", [node("Plain", xs)]))
                        continue
                    flush()
                    if m := re.fullmatch(r"Heading ?([1-9])", name or ""):
                        out.append(node("Header", [int(m[1]), NO_ATTR, xs]))
                    elif name == "Title":
                        meta["title"] = node("MetaInlines", xs)
                    elif name == "SourceCode":
                        out.append(node("CodeBlock", [NO_ATTR, "".join("\n" if x["t"] == "LineBreak" else plain([x]) for x in inlines(e))]))
                    elif name in ("BlockText", "Quote", "IntenseQuote"):
                        if out and out[-1]["t"] == "BlockQuote":
                            out[-1]["c"].append(node("Para", xs))
                        else:
                            out.append(node("BlockQuote", [node("Para", xs)]))
                    elif pr is not None and pr.find(W + "pBdr") is not None and not xs:
                        out.append(node("HorizontalRule"))
                    elif xs:
                        out.append(node("Para", xs))
                elif e.tag == W + "tbl":
                    flush()
                    rows = [[[node("Plain", b["c"]) if b["t"] == "Para" else b for b in blocks(c)] for c in r.findall(W + "tc")] for r in e.findall(W + "tr")]
                    n = max(map(len, rows), default=0)
                    rows = [r + [[]] * (n - len(r)) for r in rows]
                    out.append(table(rows[0] if rows else [], rows[1:], ["AlignDefault"] * n))
                elif e.tag in (W + "sdt", W + "sdtContent"):
                    flush()
                    out.extend(blocks(e))
            flush()
            return out

        meta: dict[str, Any] = {}
        return document(blocks(xml.fromstring(parts["word/document.xml"]).find(W + "body")), meta)


# ---------------------------------------------------------------- OpenDocument

ODT_NS = {"office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0", "table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "style": "urn:oasis:names:tc:opendocument:xmlns:style:1.0", "fo": "urn:oasis:names:tc:opendocument:xmlns:xsl-fo-compatible:1.0", "xlink": "http://www.w3.org/1999/xlink"}


def odt_write(doc: dict[str, Any]) -> bytes:
    def inl(xs: list[Node]) -> str:
        out = []
        for x in xs:
            t, c = x["t"], x.get("c")
            if t == "Str":
                out.append(esc(c))
            elif t in ("Space", "SoftBreak"):
                out.append(" ")
            elif t == "LineBreak":
                out.append("<text:line-break/>")
            elif t in ("Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps"):
                out.append(f'<text:span text:style-name="{t}">{inl(c)}</text:span>')
            elif t == "Code":
                out.append(f'<text:span text:style-name="Code">{esc(c[1])}</text:span>')
            elif t == "Math":
                out.append(esc(c[1]))
            elif t == "Link":
                out.append(f'<text:a xlink:type="simple" xlink:href="{esc(c[2][0])}">{inl(c[1])}</text:a>')
            elif t == "Note":
                out.append(f'<text:note text:note-class="footnote"><text:note-citation>*</text:note-citation><text:note-body>{"".join(map(blk, c))}</text:note-body></text:note>')
            elif t in ("Quoted", "Span", "Cite", "Image"):
                out.append(inl(c[1]))
        return "".join(out)

    def blk(b: Node) -> str:
        t, c = b["t"], b.get("c")
        p = lambda xs, s: f'<text:p text:style-name="{s}">{inl(xs)}</text:p>'
        if t in ("Para", "Plain"):
            return p(c, "Text")
        if t == "Header":
            return f'<text:h text:outline-level="{c[0]}">{inl(c[2])}</text:h>'
        if t == "CodeBlock":
            return "".join(p([node("Str", x)], "Preformatted") for x in c[1].split("\n"))
        if t == "BlockQuote":
            return "".join(p(x["c"], "Quotations") if x["t"] in ("Para", "Plain") else blk(x) for x in c)
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            return f'<text:list text:style-name="{t}">' + "".join(f"<text:list-item>{''.join(map(blk, i))}</text:list-item>" for i in items) + "</text:list>"
        if t == "Table":
            head, rows, aligns, _ = writers.cells_of(c)
            row = lambda r: "<table:table-row>" + "".join(f"<table:table-cell>{''.join(map(blk, x))}</table:table-cell>" for x in r) + "</table:table-row>"
            top = f"<table:table-header-rows>{row(head)}</table:table-header-rows>" if head else ""
            return f'<table:table><table:table-column table:number-columns-repeated="{len(aligns)}"/>{top}{"".join(map(row, rows))}</table:table>'
        if t in ("Div", "Figure"):
            return "".join(map(blk, c[1] if t == "Div" else [*c[2], *c[1][1]]))
        if t == "DefinitionList":
            return "".join(p(term, "Term") + "".join(blk(x) for d in ds for x in d) for term, ds in c)
        if t == "LineBlock":
            return p([x for line in c for x in (*line, node("LineBreak"))][:-1], "Text")
        return ""

    ns = " ".join(f'xmlns:{k}="{v}"' for k, v in ODT_NS.items())
    content = f'<?xml version="1.0" encoding="UTF-8"?>\n<office:document-content {ns} office:version="1.3"><office:body><office:text>{"".join(map(blk, doc["blocks"]))}</office:text></office:body></office:document-content>'
    kind = "application/vnd.oasis.opendocument.text"
    manifest = f'<?xml version="1.0" encoding="UTF-8"?>\n<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    return zip_write([("mimetype", kind.encode()), ("content.xml", content.encode()), ("META-INF/manifest.xml", manifest.encode())])


def odt_read(data: bytes) -> dict[str, Any]:
    root = xml.fromstring(zip_read(data)["content.xml"])
    q = lambda p, n: f"{{{ODT_NS[p]}}}{n}"
    styles = {}
    for s in root.iter(q("style", "style")):
        t = s.find(q("style", "text-properties"))
        if t is not None:
            styles[s.get(q("style", "name"))] = "Emph" if t.get(q("fo", "font-style")) == "italic" else "Strong" if t.get(q("fo", "font-weight")) == "bold" else ""

    def inl(e: Any) -> list[Node]:
        out = text_inlines(e.text or "")
        for k in e:
            if k.tag == q("text", "span"):
                name = k.get(q("text", "style-name"), "")
                tag = styles.get(name, name)
                inner = inl(k)
                out += [node("Code", [NO_ATTR, plain(inner)])] if tag == "Code" else [node(tag, inner)] if tag in ("Emph", "Strong", "Underline", "Strikeout", "Superscript", "Subscript", "SmallCaps") else inner
            elif k.tag == q("text", "a"):
                out.append(node("Link", [NO_ATTR, inl(k), [k.get(q("xlink", "href"), ""), ""]]))
            elif k.tag == q("text", "line-break"):
                out.append(node("LineBreak"))
            elif k.tag in (q("text", "s"), q("text", "tab")):
                out.append(node("Space"))
            elif k.tag == q("text", "note"):
                body = k.find(q("text", "note-body"))
                out.append(node("Note", blks(body) if body is not None else []))
            out += text_inlines(k.tail or "")
        return merge(out)

    def blks(e: Any) -> list[Node]:
        out: list[Node] = []
        for k in e:
            if k.tag == q("text", "h"):
                out.append(node("Header", [int(k.get(q("text", "outline-level"), "1")), NO_ATTR, trim(inl(k))]))
            elif k.tag == q("text", "p"):
                style, xs = k.get(q("text", "style-name"), ""), trim(inl(k))
                if style == "Preformatted":
                    if out and out[-1]["t"] == "CodeBlock":
                        out[-1]["c"][1] += "\n" + plain(xs)
                    else:
                        out.append(node("CodeBlock", [NO_ATTR, plain(xs)]))
                elif style == "Quotations":
                    out.append(node("BlockQuote", [node("Para", xs)]))
                elif xs:
                    out.append(node("Para", xs))
            elif k.tag == q("text", "list"):
                items = [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in blks(i)] for i in k.findall(q("text", "list-item"))]
                out.append(node("OrderedList", [[1, node("Decimal"), node("Period")], items]) if k.get(q("text", "style-name")) == "OrderedList" else node("BulletList", items))
            elif k.tag == q("table", "table"):
                cells = lambda r: [[node("Plain", b["c"]) if b["t"] == "Para" else b for b in blks(c)] for c in r.findall(q("table", "table-cell"))]
                top = k.find(q("table", "table-header-rows"))
                head = cells(top.find(q("table", "table-row"))) if top is not None else []
                rows = [cells(r) for r in k.findall(q("table", "table-row"))]
                n = max(map(len, [head, *rows]), default=0)
                out.append(table(head, [r + [[]] * (n - len(r)) for r in rows], ["AlignDefault"] * n))
            elif k.tag == q("text", "section"):
                out += blks(k)
        return out

    return document(blks(root.find(q("office", "body")).find(q("office", "text"))))


# ---------------------------------------------------------------- RTF


def rtf_write(doc: dict[str, Any]) -> bytes:
    def say(s: str) -> str:
        s = re.sub(r"([\\{}])", r"\\\1", s)
        return "".join(c if ord(c) < 128 else "".join(f"\\u{int.from_bytes(u, 'little', signed=True)}?" for u in (c.encode("utf-16-le")[k : k + 2] for k in range(0, len(c.encode("utf-16-le")), 2))) for c in s)

    def inl(xs: list[Node]) -> str:
        out = []
        marks = {"Emph": "\\i ", "Strong": "\\b ", "Underline": "\\ul ", "Strikeout": "\\strike ", "Superscript": "\\super ", "Subscript": "\\sub ", "SmallCaps": "\\scaps "}
        for x in xs:
            t, c = x["t"], x.get("c")
            out.append(say(c) if t == "Str" else " " if t in ("Space", "SoftBreak") else "\\line " if t == "LineBreak" else f"{{{marks[t]}{inl(c)}}}" if t in marks else f"{{\\f1 {say(c[1])}}}" if t in ("Code", "Math") else f'{{\\field{{\\*\\fldinst{{HYPERLINK "{say(c[2][0])}"}}}}{{\\fldrslt{{{inl(c[1])}}}}}}}' if t == "Link" else f"{{\\footnote {''.join(map(blk, c))}}}" if t == "Note" else inl(c[1]) if t in ("Quoted", "Span", "Cite", "Image") else "")
        return "".join(out)

    def blk(b: Node, left: int = 0, mark: str = "") -> str:
        t, c = b["t"], b.get("c")
        p = lambda s, more="": f"{{\\pard \\li{left}{more} {mark}{s}\\par}}\n"
        if t in ("Para", "Plain"):
            return p(inl(c))
        if t == "Header":
            return p(f"\\b {inl(c[2])}", f"\\outlinelevel{c[0] - 1}")
        if t == "CodeBlock":
            return p("\\f1 " + "\\line\n".join(map(say, c[1].split("\n"))))
        if t in ("BulletList", "OrderedList"):
            items = c if t == "BulletList" else c[1]
            return "".join(blk(x, left + 360, ("\\bullet \\tab " if t == "BulletList" else f"{n}.\\tab ") if k == 0 else "") for n, i in enumerate(items, 1) for k, x in enumerate(i))
        if t == "BlockQuote":
            return "".join(blk(x, left + 720) for x in c)
        if t == "Table":
            head, rows, aligns, _ = writers.cells_of(c)
            row = lambda r: "\\trowd " + "".join(f"\\cellx{(k + 1) * 2000}" for k in range(len(aligns))) + " " + "".join(inl(x[0]["c"]) + "\\cell " if x and x[0]["t"] in ("Para", "Plain") else "\\cell " for x in r) + "\\row\n"
            return "".join(map(row, ([head] if head else []) + rows))
        return "".join(blk(x, left) for x in (c[1] if t == "Div" else [*c[2], *c[1][1]] if t == "Figure" else []))

    return ("{\\rtf1\\ansi\\deff0{\\fonttbl{\\f0 Serif;}{\\f1 Mono;}}\n" + "".join(map(blk, doc["blocks"])) + "}").encode("ascii")


def rtf_read(data: bytes) -> dict[str, Any]:
    """Paragraphs with emphasis, headings by outline level, links and rows; unknown destinations are skipped."""
    s = data.decode("latin-1")
    out: list[Node] = []
    run: list[Node] = []
    rows: list[list[list[Node]]] = []
    cells: list[list[Node]] = []
    state: dict[str, Any] = {"skip": False}
    stack: list[dict[str, Any]] = []
    level = None
    high = ""
    skip = 0

    def put(t: str) -> None:
        xs = text_inlines(t)
        for flag, tag in (("f1", "Code"), ("i", "Emph"), ("b", "Strong"), ("ul", "Underline"), ("strike", "Strikeout"), ("super", "Superscript"), ("sub", "Subscript")):
            if state.get(flag) and xs:
                xs = [node("Code", [NO_ATTR, plain(xs)])] if tag == "Code" else [node(tag, xs)]
        for x in xs:
            if run and x["t"] == run[-1]["t"] and x["t"] in ("Emph", "Strong", "Underline"):
                run[-1]["c"] = merge(run[-1]["c"] + x["c"])
            elif run and x["t"] == "Code" == run[-1]["t"]:
                run[-1]["c"][1] += x["c"][1]
            else:
                run.append(x)

    def end() -> None:
        nonlocal level
        xs = trim(merge(run))
        run.clear()
        if rows:
            n = max(map(len, rows))
            out.append(table([], [r + [[]] * (n - len(r)) for r in rows], ["AlignDefault"] * n))
            rows.clear()
        if xs:
            out.append(node("Header", [level + 1, NO_ATTR, xs[0]["c"] if len(xs) == 1 and xs[0]["t"] == "Strong" else xs]) if level is not None else node("Para", xs))
        level = None

    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-z]+)(-?\d*) ?|\\(.)|([{}])|([^\\{}\r\n]+)", s, re.S):
        hexa, uni, word, number, symbol, brace, text = m.groups()
        if brace == "{":
            stack.append(dict(state))
        elif brace:
            state = stack.pop() if stack else {"skip": False}
        elif state["skip"]:
            continue
        elif hexa:
            if skip:
                skip -= 1
            else:
                put(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif uni:
            unit = int(uni) & 0xFFFF
            if 0xD800 <= unit < 0xDC00:
                high = chr(unit)
            else:
                put((high + chr(unit)).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
                high = ""
            skip = 1
        elif word:
            if word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "fldinst", "listtable", "generator"):
                state["skip"] = True
            elif word in ("par", "sect"):
                end()
            elif word == "line":
                run.append(node("LineBreak"))
            elif word == "tab":
                put(" ")
            elif word == "bullet":
                put("•")
            elif word == "pard":
                state = {"skip": False}
            elif word == "plain":
                state = {"skip": False}
            elif word == "outlinelevel":
                level = int(number or 0)
            elif word == "f":
                state["f1"] = number == "1"
            elif word == "cell":
                cells.append([node("Plain", trim(merge(run)))] if run else [])
                run.clear()
            elif word == "row":
                rows.append(list(cells))
                cells.clear()
            elif word in ("i", "b", "ul", "strike", "super", "sub"):
                state[word] = number != "0"
            elif word == "emdash":
                put("—")
            elif word == "endash":
                put("–")
        elif symbol:
            if symbol == "*":
                state["skip"] = True
            elif symbol in "\\{}":
                put(symbol)
            elif symbol == "~":
                put("\u00a0")
        elif text:
            if skip:
                text, skip = text[1:], 0
            put(text)
    end()
    return document(out)


READERS = {"epub": epub_read, "docx": lambda b: Docx().read(b), "odt": odt_read, "rtf": rtf_read}
WRITERS = {"epub": epub_write, "docx": lambda d: Docx().write(d), "odt": odt_write, "rtf": rtf_write}


def pack(docs: DataFrame, target: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes, error of docs (key, text = interchange JSON)."""
    import json

    write = WRITERS[target]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for s in b.column(1).to_pylist():
                try:
                    out.append(write(json.loads(s)))
                    errors.append(None)
                except (ValueError, KeyError, TypeError, IndexError) as e:
                    out.append(None)
                    errors.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], [key, "bytes", "error"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, bytes binary, error string")


def unpack(files: DataFrame, source: str, key: str = "doc_id", content: str = "bytes") -> DataFrame:
    """key, text (interchange JSON), error of files, such as rows of Spark's binaryFile source."""
    import json

    read = READERS[source]
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for s in b.column(1).to_pylist():
                try:
                    out.append(json.dumps(read(s or b""), ensure_ascii=False))
                    errors.append(None)
                except (ValueError, KeyError, TypeError, IndexError, AttributeError, StopIteration, zipfile.BadZipFile, xml.ParseError) as e:
                    out.append(None)
                    errors.append(str(e)[:300])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], [key, "text", "error"])

    return files.select(key, content).mapInArrow(run, f"{key} {kind}, text string, error string")


