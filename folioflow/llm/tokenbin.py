"""Token-id files: each id in the fewest bits that the vocabulary needs, in blocks with offsets for random access.

File format (little-endian): magic ``FBP1``; packed blocks of BLOCK ids each (the last may be shorter), id i of a block in
bits [i*b, (i+1)*b) of it, least significant bit first; a footer (JSON header line, then arrays: byte offset of each
block, first token of each document, the documents' ids and null flags); 8 bytes footer length; magic again.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm import common, tokens

MAGIC = b"FBP1"
#: Ids of a block; a multiple of 8, so that blocks end on whole bytes at every width.
BLOCK = 1 << 16
#: Ids after which a partition goes on in another file.
FILE_TOKENS = 1 << 27


def width(vocabulary: int) -> int:
    """Bits that ids 0 .. vocabulary-1 need."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Bit-packs ids, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32; vectorised."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return flags @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class FileWriter:
    """Appends documents; finish() writes the footer. Holds one block and the documents' table."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.at, self.held, self.pending = len(MAGIC), [], 0
        self.blocks: list[int] = []
        self.first, self.ids, self.nulls = [0], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.first.append(self.first[-1] + len(ids))
        self.held.append(ids)
        self.pending += len(ids)
        if self.pending >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(every) if last else len(every) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            raw = pack(every[a : min(a + BLOCK, stop)], self.bits)
            self.blocks.append(self.at)
            self.at += len(raw)
            self.out.write(raw)
        self.held, self.pending = [every[stop:]], len(every) - stop

    def finish(self) -> None:
        self.flush(True)
        head = {"bits": self.bits, "block": BLOCK, "blocks": len(self.blocks), "docs": len(self.ids), "tokens": self.first[-1]}
        foot = json.dumps(head).encode() + b"\n" + b"".join(np.array(x, t).tobytes() for x, t in ((self.blocks, "<i8"), (self.first, "<i8"), (self.ids, "<i8"), (self.nulls, "u1")))
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)


class FileReader:
    """Random access: document(i) reads only the blocks that hold it; documents() streams them all."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 12)
        n, magic = struct.unpack("<Q4s", f.read(12))
        if magic != MAGIC:
            raise ValueError("not a token file")
        f.seek(size - 12 - n)
        line, _, rest = f.read(n).partition(b"\n")
        self.head = json.loads(line)
        b, d = self.head["blocks"], self.head["docs"]
        self.blocks = np.frombuffer(rest, "<i8", b)
        self.first = np.frombuffer(rest, "<i8", d + 1, 8 * b)
        self.ids = np.frombuffer(rest, "<i8", d, 8 * (b + d + 1))
        self.nulls = np.frombuffer(rest, "u1", d, 8 * (b + 2 * d + 1)).astype(bool)
        self.cached: dict[int, np.ndarray] = {}

    def block(self, k: int) -> np.ndarray:
        if k not in self.cached:
            n = min(BLOCK, self.head["tokens"] - k * BLOCK)
            self.f.seek(int(self.blocks[k]))
            if len(self.cached) > 4:
                self.cached.pop(next(iter(self.cached)))
            self.cached[k] = unpack(self.f.read((n * self.head["bits"] + 7) // 8), self.head["bits"], n)
        return self.cached[k]

    def document(self, i: int) -> np.ndarray:
        a, z = int(self.first[i]), int(self.first[i + 1])
        parts = [self.block(k)[max(a - k * BLOCK, 0) : z - k * BLOCK] for k in range(a // BLOCK, (z - 1) // BLOCK + 1)] if z > a else []
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list[float] | None = None, nulls: int = 0) -> DataFrame:
    """doc_id, ids (binary, the vocabulary's narrowest type), n_tokens and, with bounds, the range `pid` of the doc_id.

    Rows without doc_id come first, in the ranges below `nulls`, dealt by their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        cut = np.array(bounds or [], float)
        for batch in batches:
            for part, texts in common.text_chunks(batch, limit=tokens.CHUNK, keep=tokens.KEEP):
                ids = enc.ids(texts, end_id)
                key = part.column(0)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // enc.dtype.itemsize
                at = [zlib.crc32(x) % max(nulls, 1) if k is None else nulls + int(np.searchsorted(cut, k, "right")) for k, x in zip(key.to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), pa.array(n), pa.array(at, pa.int32())], ["doc_id", "ids", "n_tokens", "pid"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, pid int")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order (nulls first) and returns the list of files.

    Files: path, pid, part (their order), n_docs, n_tokens, base (ids in all files before). Range bounds come from a
    quantile sketch of the doc_id column alone; the ids, not the texts, are shuffled. Null text: as empty. Rows that
    repeat a doc_id lie next to each other, shorter first, then by their ids; rows without one are spread over ranges of
    their own. A text of any length is one document. Any other columns are ignored; an empty table gives no files. Files
    that are not listed are of attempts that were given up.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_path()
    n = common.partitions(spark)
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).na.drop().approxQuantile("d", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []

    nulls = n if docs.filter(F.col("doc_id").isNull()).limit(1).count() else 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        enc = tokens.encoder(tokenizer)
        bits = width(enc.size)
        files, part, rows = [], 0, iter_rows(batches)
        row = next(rows, None)
        while row is not None:
            pid, path = row[3], f"{folder}/part-{row[3]:06d}-{attempt:08d}-{part:04d}.fbp"

            def body(out, first=row):
                nonlocal row
                w = FileWriter(out, bits)
                while row is not None and row[3] == first[3] and w.first[-1] < FILE_TOKENS:
                    w.add(row[0], np.frombuffer(row[1], enc.dtype))
                    row = next(rows, None)
                w.finish()
                files.append((path, first[3], part, len(w.ids), w.first[-1]))

            common.publish(path, body)
            part += 1
            if row is not None and row[3] != pid:
                part = 0
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "pid", "part", "n_docs", "n_tokens"), f, strict=True)) for f in files], pa.schema([("path", pa.string()), ("pid", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    packed = tokenised(docs, tokenizer, end_id, bounds, nulls).repartitionById(nulls + len(bounds) + 1, F.col("pid"))
    ordered = packed.sortWithinPartitions("pid", F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    files = common.materialise(ordered.mapInArrow(write, "path string, pid int, part int, n_docs long, n_tokens long"), "token-files")
    before = Window.orderBy("pid", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not document
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def iter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def read_tokens(files: DataFrame) -> DataFrame:
    """A row for each document of the files, read block by block: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, base in iter_rows(batches):
            fs, at = common.open_fs(path)
            with fs.open_input_file(at) as f:
                r = FileReader(f)
                for a in range(0, r.head["docs"], 5000):
                    z = min(a + 5000, r.head["docs"])
                    crc = [zlib.crc32(r.document(i).astype("<u4").tobytes()) for i in range(a, z)]
                    yield pa.RecordBatch.from_arrays([pa.array(r.ids[a:z], mask=r.nulls[a:z]), pa.array(r.first[a:z] + base), pa.array(np.diff(r.first[a : z + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "base").repartition(common.partitions(files.sparkSession))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
