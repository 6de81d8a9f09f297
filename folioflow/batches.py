"""Arrow batches in slices of bounded text: a batch of Spark's has up to 10,000 rows, whatever their size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker turns into trees, texts or rows at a time (a longer text is a slice of its own).
TEXT_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose texts have `limit` bytes at most; a longer text is alone."""
    a, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if total + n > limit and i > a:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += n
    if batch.num_rows > a:
        yield batch.slice(a)
