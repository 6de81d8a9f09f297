"""Reading, writing and converting columns of texts: documents are the parallel dimension, one task converts many."""

from __future__ import annotations

import gc
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow import deep
from folioflow.batches import slices
from folioflow.operators import options
from folioflow.sources import ast, delimited, html, markdown, packages, wiki
from folioflow.writers import native
from folioflow.writers import text as writers


def _delimited(delimiter: str, quoting: bool) -> Callable[[str], dict[str, Any]]:
    def read(s: str) -> dict[str, Any]:
        rows = delimited.records(s, delimiter, quoting)
        if not rows:
            return ast.document([])
        width = len(rows[0])
        cell = lambda x: [ast.node("Plain", ast.trim(ast.text_inlines(x)))] if x.strip() else []
        full = [[cell(x) for x in (r + [""] * width)[:width]] for r in rows]
        return ast.document([ast.table(full[0], full[1:], ["AlignDefault"] * width)])

    return read


def _plain(s: str) -> dict[str, Any]:
    """Paragraphs between blank lines, nothing else."""
    parts = [p for p in s.replace("\r\n", "\n").split("\n\n") if p.strip()]
    return ast.document([ast.node("Para", ast.trim(ast.text_inlines(p.strip("\n")))) for p in parts])


def _json(s: str) -> dict[str, Any]:
    doc = deep.loads(s)
    if not isinstance(doc, dict) or not isinstance(doc.get("blocks"), list):
        raise ValueError("no document")
    return doc


def _opml(s: str) -> dict[str, Any]:
    import xml.etree.ElementTree as xml

    out: list[dict[str, Any]] = []

    def walk(e: Any, level: int) -> None:
        for o in e.findall("outline"):
            words = ast.text_inlines(o.get("text", ""))
            if o.get("type") == "link":
                words = [ast.node("Link", [ast.attr(), words, [o.get("url", ""), ""]])]
            out.append(ast.node("Header", [level, ast.attr(), words]))
            if o.get("_note"):
                out.extend(markdown.read(o.get("_note"))["blocks"])
            walk(o, level + 1)

    root = xml.fromstring(s)
    walk(root.find("body"), 1)
    title = root.findtext("head/title")
    return ast.document(out, {"title": ast.node("MetaInlines", ast.text_inlines(title))} if title else {})


#: What of a notebook's output is shown, best first, and the format of a raw passage of it.
_MIMES = {"text/markdown": "markdown", "text/html": "html", "text/latex": "latex", "image/svg+xml": "html", "text/plain": ""}
_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")


def _ipynb_output(o: dict[str, Any]) -> list[ast.Node]:
    join = lambda x: "".join(x) if isinstance(x, list) else str(x)
    kind = o.get("output_type", "")
    classes = ["output", kind]
    if kind == "stream":
        return [ast.node("Div", [ast.attr(classes=[*classes, o.get("name", "stdout")]), [ast.node("CodeBlock", [ast.attr(), _ANSI.sub("", join(o.get("text", "")))])]])]
    if kind in ("error", "pyerr"):
        lines = "\n".join(_ANSI.sub("", x) for x in o.get("traceback", []))
        return [ast.node("Div", [ast.attr(classes=classes, kv=[["ename", str(o.get("ename", ""))], ["evalue", str(o.get("evalue", ""))]]), [ast.node("CodeBlock", [ast.attr(), lines])]])]
    data = o.get("data", {})
    image = next((m for m in ("image/png", "image/jpeg", "image/gif", "application/pdf") if m in data), None)
    kv = [["execution_count", str(o["execution_count"])]] if o.get("execution_count") is not None else []
    if image:
        source = f"data:{image};base64," + re.sub(r"\s+", "", join(data[image]))
        made = [ast.node("Para", [ast.node("Image", [ast.attr(), [], [source, ""]])])]
    else:
        mime = next((m for m in _MIMES if m in data), None)
        if mime is None:
            made = []
        elif mime == "text/markdown":
            made = markdown.read(join(data[mime]))["blocks"]
        elif mime == "text/plain":
            made = [ast.node("CodeBlock", [ast.attr(), join(data[mime])])]
        else:
            made = [ast.node("RawBlock", [_MIMES[mime], join(data[mime])])]
    return [ast.node("Div", [ast.attr(classes=classes, kv=kv), made])]


def _ipynb(s: str) -> dict[str, Any]:
    out = []
    book = json.loads(s)
    language = book.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    for c in book.get("cells", []):
        source = "".join(c["source"]) if isinstance(c["source"], list) else c["source"]
        if c["cell_type"] == "markdown":
            out.append(ast.node("Div", [ast.attr(c.get("id", ""), ["cell", "markdown"]), markdown.read(source)["blocks"]]))
        elif c["cell_type"] == "code":
            kv = [["execution_count", str(c["execution_count"])]] if c.get("execution_count") is not None else []
            shown = [x for o in c.get("outputs", []) for x in _ipynb_output(o)]
            out.append(ast.node("Div", [ast.attr(c.get("id", ""), ["cell", "code"], kv), [ast.node("CodeBlock", [ast.attr(classes=[language]), source]), *shown]]))
        else:
            kind = c.get("metadata", {}).get("raw_mimetype", c.get("metadata", {}).get("format", "ipynb"))
            out.append(ast.node("Div", [ast.attr(c.get("id", ""), ["cell", "raw"]), [ast.node("RawBlock", [kind.removeprefix("text/"), source])]]))
    return ast.document(out)


READERS: dict[str, Callable[[str], dict[str, Any]]] = {"html": html.read, "csv": _delimited(",", True), "tsv": _delimited("\t", False), "json": _json, "plain": _plain, "opml": _opml, "ipynb": _ipynb, "native": native.read, **wiki.READERS}


def reader(spec: str) -> Callable[[Any], dict[str, Any]]:
    """The reader of a format: of texts, or of bytes for the package formats. Markdown dialects take option toggles."""
    base, _ = options.parse_spec(spec)
    if base in writers.MARKDOWN:
        return lambda s: markdown.read(s, spec)
    if base in packages.READERS:
        return packages.READERS[base]
    if base not in READERS:
        raise ValueError(f"unknown format {base!r}")
    return READERS[base]


def writer(spec: str, **how: Any) -> Callable[[dict[str, Any]], Any]:
    """The writer of a format: to a text, or to bytes for the package formats."""
    base, _ = options.parse_spec(spec, writing=True)
    if base in packages.WRITERS:
        return packages.WRITERS[base]
    writers.write(ast.document([]), spec)  # an unknown target fails now, not in a task
    return lambda doc: writers.write(doc, spec, **how)


def convert_text(text: str, source: str, target: str, **how: Any) -> str:
    return writer(target, **how)(reader(source)(text or ""))


def convert(docs: DataFrame, source: str, target: str, key: str = "doc_id", text: str = "text", filters: list[Callable[[dict], dict]] | None = None, **how: Any) -> DataFrame:
    """key, output, error of every row of docs; a text that cannot be read has no output but an error. No shuffle.

    Package formats (epub, docx, odt, rtf) are read from a binary column and written to one. filters: functions from
    document to document, applied in turn between reader and writer. Works on streams too.
    """
    read, write = reader(source), writer(target, **how)
    kind = docs.schema[key].dataType.simpleString()
    binary = options.parse_spec(source)[0] in packages.READERS
    packed = options.parse_spec(target, writing=True)[0] in packages.WRITERS

    def made(s: Any) -> Any:
        doc = read(s)
        for f in filters or []:
            doc = f(doc)
        return write(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            out, errors = [], []
            gc.disable()  # trees hold no cycles: what a document needed is freed with it
            try:
                for s in b.column(1).to_pylist():
                    try:
                        try:
                            out.append(made(s or empty))
                        except RecursionError:
                            out.append(deep.on_deep_stack(lambda: made(s), len(s)))
                        errors.append(None)
                    except (ValueError, KeyError, TypeError, IndexError, AttributeError, RecursionError, SyntaxError, StopIteration, zipfile.BadZipFile) as e:
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:300])
            finally:
                gc.enable()  # readers and writers leave a few cycles (functions that call themselves); the worker serves other stages too
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary() if packed else pa.string()), pa.array(errors, pa.string())], [key, "output", "error"])
            del out, errors
            gc.collect()

    empty = b"" if binary else ""
    return docs.select(key, docs[text].cast("binary" if binary else "string").alias(text)).mapInArrow(run, f"{key} {kind}, output {'binary' if packed else 'string'}, error string")
