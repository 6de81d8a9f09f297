"""Interchange JSON as node rows, and back. A node row: doc_id, nid (pre-order), last (end of its subtree), parent, depth, tag, text; level of a header, items of a list."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow import deep
from folioflow.batches import slices

NODES = "doc_id long, nid int, last int, parent int, depth int, tag string, text string, level int, id string, url string, items int"
#: Node rows of a batch that goes back to the JVM.
NODE_ROWS = 1 << 15
#: Tags with a text of their own beside their attributes, with an identifier, with an address.
_TEXTS, _NAMED, _LINKS = frozenset("Code CodeBlock RawBlock RawInline Math".split()), frozenset("Div Span CodeBlock Code Link Image".split()), frozenset(("Link", "Image"))
_WORDS = frozenset("Str Space SoftBreak LineBreak".split())


def _below(x: Any, doc_id: int | None, parent: int | None, depth: int, out: list[list[Any]]) -> None:
    """Appends the rows of all nodes in x. No nested function: one that calls itself would keep `out` until the next collection."""
    if isinstance(x, list):
        for v in x:
            if isinstance(v, dict):
                tag, c = v.get("t"), v.get("c")
                if tag in _WORDS and (c is None or isinstance(c, str)):  # most nodes: no call of their own
                    me = len(out)
                    out.append([doc_id, me, me, parent, depth, tag, c, None, None, None, None])
                else:
                    _below(v, doc_id, parent, depth, out)
            elif isinstance(v, list):
                _below(v, doc_id, parent, depth, out)
        return
    if "t" not in x:
        for v in x.values():
            if isinstance(v, (dict, list)):
                _below(v, doc_id, parent, depth, out)
        return
    tag, c = x["t"], x.get("c")
    if not tag[:1].isupper():
        raise ValueError(f"unknown tag {tag!r}")
    me = len(out)
    if c is None or isinstance(c, str):
        out.append([doc_id, me, me, parent, depth, tag, c, c[0] if tag == "Header" else None, None, c[2][0] if tag in _LINKS else None, None])
        return
    listed = isinstance(c, list)
    text = c[1] if tag in _TEXTS and listed else None
    level = c[0] if tag == "Header" else None
    ident = (c[1][0] if tag == "Header" else c[0][0] if tag in _NAMED else None) if listed and c else None
    items = (len(c) if tag == "BulletList" else len(c[1]) if tag == "OrderedList" else None) if listed else None
    row = [doc_id, me, me, parent, depth, tag, text, level, ident or None, c[2][0] if tag in _LINKS else None, items]
    out.append(row)
    if isinstance(c, (dict, list)):
        _below(c, doc_id, me, depth + 1, out)
    row[2] = len(out) - 1


def rows_of(doc_id: int | None, blocks: list[dict[str, Any]]) -> list[list[Any]]:
    """Pre-order rows of a block list."""
    out: list[list[Any]] = []
    if isinstance(blocks, (dict, list)):
        _below(blocks, doc_id, None, 0, out)
    return out


def flatten_json(docs: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """NODES rows of docs (doc_id, text = interchange JSON), or some of their columns. A text that is no such JSON is one node with tag Error."""

    kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    names = [x.split()[0] for x in NODES.split(", ")]
    kept = [names.index(x) for x in columns or names]

    def part(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        rows: list[list[Any]] = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            try:
                try:
                    rows += rows_of(d, deep.loads(t or "{}").get("blocks", []))
                except RecursionError:
                    rows += deep.on_deep_stack(lambda: rows_of(d, deep.loads(t).get("blocks", [])), len(t))
            except (ValueError, AttributeError, TypeError, IndexError, KeyError, RecursionError) as e:
                rows.append([d, 0, 0, None, 0, "Error", str(e)[:200], None, None, None, None])
        # a text may have many nodes to a byte: what goes back at once is bounded by rows
        cut = [rows[a : a + NODE_ROWS] for a in range(0, len(rows), NODE_ROWS)]
        return [pa.RecordBatch.from_arrays([pa.array([r[k] for r in c], kinds[k]) for k in kept], [names[k] for k in kept]) for c in cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            gc.disable()  # trees and rows hold no cycles
            try:
                made = part(b)
            finally:
                gc.enable()
            yield from made

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, ", ".join(NODES.split(", ")[k] for k in kept))
