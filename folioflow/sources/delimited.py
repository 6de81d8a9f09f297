"""CSV and TSV texts as cells. Record 1 is the head and fixes the number of columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def records(text: str, delimiter: str, quoting: bool) -> list[list[str]]:
    """A quote opens only an empty field, blanks after a delimiter are skipped, CR, LF and CRLF end a record."""
    text = text.removeprefix("﻿")
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    i, n, quoted = 0, len(text), False
    while i < n:
        c = text[i]
        if quoting and c == '"' and not cell and not quoted:
            i += 1
            quoted = True
            while i < n:
                j = text.find('"', i)
                if j < 0:
                    cell.append(text[i:])
                    i = n
                elif text[j + 1 : j + 2] == '"':
                    cell.append(text[i:j] + '"')
                    i = j + 2
                else:
                    cell.append(text[i:j])
                    i = j + 1
                    break
            continue
        if c == delimiter or c in "\r\n":
            row.append("".join(cell))
            cell, quoted = [], False
            i += 1
            if c == delimiter:
                while delimiter != "\t" and i < n and text[i] in " \t":
                    i += 1
            else:
                if c == "\r" and text[i : i + 1] == "\n":
                    i += 1
                rows.append(row)
                row = []
            continue
        cell.append(c)
        i += 1
    if row or cell or quoted:
        row.append("".join(cell))
        rows.append(row)
    return rows


def read_cells(docs: DataFrame, delimiter: str = ",", quoting: bool = True) -> DataFrame:
    """doc_id, row (0 is the head), col, cell of docs (doc_id, text); short records are padded, long ones cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = records(t or "", delimiter, quoting)
                width = len(rows[0]) if rows else 0
                for r, row in enumerate(rows):
                    for c in range(width):
                        for o, v in zip(out, (d, r, c, row[c] if c < len(row) else ""), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "row", "col", "cell"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(run, "doc_id long, row int, col int, cell string")
