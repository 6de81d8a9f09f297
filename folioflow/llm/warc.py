"""WARC archives with an embedded Zstandard dictionary: writer, reader, and revisit records for equal payloads.

An archive (``.warc.zst``) is one skippable frame (magic 0x184D2A5D) that holds the dictionary, then a frame for each
record. The dictionary is trained in the writing task from the first records of the archive itself (TRAIN_BYTES of them).
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common

SKIPPABLE = 0x184D2A5D
#: Records that are held back to train an archive's dictionary; records larger than TRAIN_RECORD are not trained on.
TRAIN_BYTES, TRAIN_RECORD, DICTIONARY = 4 << 20, 128 << 10, 64 << 10
#: Uncompressed bytes after which a partition goes on in another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"  # no clock: the same pages make the same archive


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record. A revisit has no payload; its headers name the response and the payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from an archive's own records; where they are too few to train on, the end of what there is."""
    small = [r for r in records if len(r) <= TRAIN_RECORD] or [r[:TRAIN_RECORD] for r in records]
    total = sum(map(len, small))
    if len(small) >= 16 and total > 10 * 4096:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, max(4096, total // 20)), small).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(small)[-min(DICTIONARY, 8192) :]


def write_archive(out, records: Iterator[bytes]) -> int:
    """Writes one archive from a stream of records; returns how many."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    raw = train(held)
    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    n = 0
    for group in (held, records):
        for r in group:
            out.write(c.compress(r))
            n += 1
    return n


def read_archive(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of an open archive, one at a time."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(n)))
    with d.stream_reader(f, read_across_frames=True, closefd=False) as raw:
        r = io.BufferedReader(raw, 1 << 20)
        while line := r.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head = {}
            while (line := r.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                head[k] = v
            body = r.read(int(head["Content-Length"]))
            if r.read(4) != b"\r\n\r\n":
                raise ValueError("record cut short")
            yield head, body


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hex: every five hex digits are four base32 digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):
        v = F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(alphabet, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_record_types(pages: DataFrame, html: str = "html", least: int = 0) -> DataFrame:
    """pages with payload_sha1 (hex) and refers_to: null for a response, else the page whose equal payload is archived.

    Only (page_id, digest) is grouped and joined; a digest that many pages share is joined by broadcast (see skew_join),
    and the types come back to the pages by page_id, which no group makes hot.
    """
    sha = F.sha1(F.coalesce(F.col(html), F.lit("")).cast("binary"))
    big = F.octet_length(F.coalesce(F.col(html), F.lit(""))) >= least
    narrow = pages.filter(big & F.col("page_id").isNotNull()).select("page_id", sha.alias("payload_sha1"))
    total = pages.count()
    groups = narrow.groupBy("payload_sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1")
    groups = common.materialise(groups, "warc-groups")
    refs = common.skew_join(narrow, groups, ["payload_sha1"], "_n", total).filter(F.col("page_id") != F.col("refers_to"))
    refs = refs.select("page_id", "payload_sha1", "refers_to").distinct()
    return pages.withColumn("payload_sha1", sha).join(refs.hint("shuffle_hash"), ["page_id", "payload_sha1"], "left")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives every row of pages (page_id, url, html) and returns the list of files: path, records.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id is a response, the others are
    revisits of it (rows that repeat this page_id are responses too). A row without page_id is a response. Null html is
    an empty payload, null url leaves out the target; a payload of any length is one record. Other columns are ignored. An
    empty table gives empty archives or none. Files that are not listed are of attempts that were given up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # rows of a shuffled partition come in any order: another attempt may cut archives elsewhere, so it names its own
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        files, row = [], next(rows, None)
        while row is not None:

            def records() -> Iterator[bytes]:
                nonlocal row
                size = 0
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, html, sha, ref = row
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    made = record("response" if ref is None else "revisit", page_id, url, payload, digest, ref)
                    size += len(made)
                    row = next(rows, None)
                    yield made

            path, n = f"{folder}/part-{part:06d}-{attempt:08d}-{len(files):04d}.warc.zst", []
            common.publish(path, lambda out: n.append(write_archive(out, records())))
            files.append((path, n[0]))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], ["path", "records"])

    typed = with_record_types(pages.select("page_id", "url", "html"), least=least)
    made = typed.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "payload_sha1", F.col("refers_to").cast("long"))
    return common.materialise(made.mapInArrow(run, "path string, records long"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null in revisits).

    Digest and length of a response come from the payload as read; a digest that differs from the header's raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda s: int(s[10:-1]) if len(s) > 11 else None
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = common.open_fs(path)
                with fs.open_input_stream(at, compression=None) as f:
                    rows, size = [], 0
                    for head, body in read_archive(f):
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        n = int(head["WARC-Payload-Length"]) if payload is None else len(payload)
                        if payload is not None and digest32(payload) != digest:
                            raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                        rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, n, digest, payload))
                        size += len(body)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    spread = files.select("path").repartition(common.partitions(files.sparkSession))
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
