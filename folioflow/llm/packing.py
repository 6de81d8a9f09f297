"""Hierarchical packing into several window lengths.

A task packs its documents in buckets of a bounded number of tokens; what does not fill a window of the longest tier goes on to
the next bucket, and from the last one a task hands on less than the shortest tier holds:
1. whole windows of the longest tier are cut from long documents;
2. what remains of each document is routed to the shortest tier that holds it;
3. tiers are packed from long to short: an item opens a window of its tier, the gap takes the largest items of this and
   shorter tiers that fit, and a last item is cut to end exactly at the window's end;
4. at a task's end what is left fills windows of shorter tiers;
5. the rests of REST_TASKS tasks are packed together in a second pass: one window of each such group stays short and is padded;
6. windows are dealt to step groups, longest first to the group with the fewest tokens so far.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common, tokens

TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens of a bucket: little enough for any worker's memory.
BUCKET_TOKENS = 1 << 21
#: Windows of a step group; tasks whose rests (fewer tokens than the shortest tier each) are packed together.
GROUP, REST_TASKS = 32, 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64()] * 7 + [pa.int32(), pa.int64()]


class Pool:
    """Items (length, document, start) by length; equal lengths in order of arrival."""

    def __init__(self) -> None:
        self.items: list[tuple[int, int, int]] = []

    def put(self, item: tuple[int, int, int]) -> None:
        bisect.insort(self.items, item)

    def best(self, most: int) -> tuple[int, int, int] | None:
        """Takes the longest item of at most `most` tokens."""
        i = bisect.bisect_right(self.items, (most + 1, -1, -1))
        return self.items.pop(i - 1) if i else None

    def longest(self) -> tuple[int, int, int]:
        return self.items.pop()


def pack_bucket(lengths: list[int], tiers: tuple[int, ...] = TIERS, starts: list[int] | None = None, least: int = 0) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int]]]:
    """Windows as (tier, pieces), and what is left of documents as (document, start).

    A piece is (document, start, length). Of each document the tokens from its start on are packed, each in exactly one
    piece. When fewer than `least` tokens are left they are handed back; with least 0 they make a short window.
    """
    top = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    pool = Pool()
    for d, n in enumerate(lengths):
        first = starts[d] if starts else 0
        full = first + (n - first) // top * top
        out += [(top, [(d, s, top)]) for s in range(first, full, top)]
        if n > full:
            pool.items.append((n - full, d, full))
    pool.items.sort()
    left = sum(x[0] for x in pool.items)
    while pool.items and left >= least:
        n, d, s = pool.longest()
        tier = next(t for t in tiers if t >= n)
        if left < tier:  # the end: windows of the longest tier that what is left fills whole, then one short window
            tier = next((t for t in reversed(tiers) if t <= left), 0)
        room, pieces = tier or left, []
        item: tuple[int, int, int] | None = (n, d, s)
        filled = 0
        while filled < room:
            if item is None:
                item = pool.best(room - filled) or pool.longest()
            n, d, s = item
            take = min(n, room - filled)
            pieces.append((d, s, take))
            filled += take
            if take < n:
                pool.put((n - take, d, s + take))
            item = None
        left -= filled
        out.append((tier or top, pieces))
    return out, [(d, s) for _, d, s in pool.items]


def balance(sizes: list[int], group: int = GROUP) -> list[int]:
    """The step group of each window: at most `group` windows each, tokens as even as longest-first dealing makes them."""
    n = -(-len(sizes) // group)
    heap = [(0, g, 0) for g in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g, held = heapq.heappop(heap)
        out[i] = g
        if held + 1 < group:
            heapq.heappush(heap, (load + sizes[i], g, held + 1))
    return out


def rows_of(windows: list, base: int, dtype: np.dtype, docs: list[tuple[int | None, bytes, int, int]]) -> list[tuple]:
    """SCHEMA's rows of windows over docs: (doc_id, ids, number of the first of these ids in the document, its tokens)."""
    w = dtype.itemsize
    groups = balance([sum(p[2] for p in pieces) for _, pieces in windows])
    out = []
    for k, (tier, pieces) in enumerate(windows):
        offset = 0
        for d, s, n in pieces:
            key, ids, first, total = docs[d]
            crc = zlib.crc32(np.frombuffer(ids, dtype, n, s * w).astype("<u4").tobytes())
            out.append((key, first + s, n, crc, total, base + k, offset, tier, base + groups[k]))
            offset += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = TIERS, cache: int | None = None) -> DataFrame:
    """Pieces of all documents (see SCHEMA); sequence_id is unique over all partitions.

    Null text counts as empty (its end id alone is packed); a null doc_id is kept as null; repeated rows are packed as
    often as they occur; a text of any length is cut into windows; an empty table gives no rows; any other columns are
    ignored. Padding: a window whose pieces do not add up to its tier is padded to the longest tier; there is at most one
    such among the rests of REST_TASKS tasks, however the documents lie in partitions. cache: see tokens.CACHE.
    """
    tokenizer = tokenizer or tokens.default_path()
    rest = [("part", pa.int64()), ("ids", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        none = [pa.nulls(len(rows), t) for _, t in rest]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)), *none], [*_NAMES, *(n for n, _ in rest)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer)
        w = enc.dtype.itemsize
        held: list[tuple[int | None, bytes, int, int]] = []
        size = bucket = 0

        def emit(least: int) -> list[tuple]:
            nonlocal held, size, bucket
            windows, left = pack_bucket([len(x[1]) // w for x in held], tiers, least=least)
            rows = rows_of(windows, (part << 36) + (bucket << 22), enc.dtype, held)
            held = [(k, ids[s * w :], first + s, n) for d, s in left for k, ids, first, n in held[d : d + 1]]
            size, bucket = sum(len(x[1]) // w for x in held), bucket + 1
            return rows

        for b in batches:
            for part_rows, texts in common.text_chunks(b, limit=tokens.CHUNK, keep=tokens.KEEP):
                for key, ids in zip(part_rows.column(0).to_pylist(), enc.ids(texts, end_id, cache), strict=True):
                    held.append((key, ids, 0, len(ids) // w))
                    size += len(ids) // w
                if size >= BUCKET_TOKENS:
                    yield batch(emit(tiers[-1]))
        if held:
            yield batch(emit(tiers[0]))
        if held:  # what the second pass packs
            cols = [[k for k, *_ in held], [x[2] for x in held], [len(x[1]) // w for x in held], None, [x[3] for x in held], None, None, None, None]
            made = [pa.nulls(len(held), t) if c is None else pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, pa.array([part] * len(held), pa.int64()), pa.array([x[1] for x in held], pa.binary())], [*_NAMES, *(n for n, _ in rest)])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple]] = {}
        for b in batches:
            for key, first, n, total, part, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "part", "ids")), strict=True):
                groups.setdefault(part // REST_TASKS, []).append((part, first, key, ids, n, total))
        for g, items in sorted(groups.items()):
            items.sort(key=lambda x: (x[0], x[1], x[3]))
            dtype = np.dtype(f"<u{len(items[0][3]) // items[0][4]}")
            windows, _ = pack_bucket([x[4] for x in items], tiers)
            rows = rows_of(windows, (1 << 62) + (g << 22), dtype, [(key, ids, first, total) for _, first, key, ids, _, total in items])
            yield batch(rows).select(_NAMES)

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", part long, ids binary")
    made = common.materialise(made, "packed")
    group = F.floor(F.col("part") / REST_TASKS)
    left = made.filter(F.col("part").isNotNull()).repartition(common.partitions(docs.sparkSession), group).mapInArrow(second, SCHEMA)
    return made.filter(F.col("part").isNull()).select(_NAMES).unionByName(left)
