"""Helpers that the training-data operators share: the shared folder, skew-safe joins, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in HOT_SHARE; so there are at most HOT_SHARE hot keys, at any size.
HOT_SHARE = 1000
#: Bytes of text that one numpy pass takes at a time (a longer text is a pass of its own).
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder serves a session whose driver and executors are one machine's; on a cluster this
    raises, as every executor would write to a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: the operators need a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/folioflow-{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs (it acts when the driver's garbage is collected)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, what: str, clean: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors, frees shuffle files."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    if clean:
        release(spark)
    back = spark.read.schema(df.schema).parquet(path)
    back._folioflow_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes the files of a materialised table that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_folioflow_path", None)
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, key: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """left JOIN right on key, where right has one row a key and `rows` counts the key's rows in left.

    Keys with at least max(64, total / HOT_SHARE) rows are hot: at most HOT_SHARE of them exist, so that part of
    right is broadcast and hot rows of left stay where they are. All others meet by an ordinary shuffle.
    """
    limit = max(64, total // HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(rows) >= limit).withColumn("_hot", F.lit(True)))
    cold = right.filter(F.col(rows) < limit)
    value = [c for c in right.columns if c not in key]
    marked = left.join(hot, key, "left")
    done = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).select(left.columns).join(cold, key, how)
    return done.select(*left.columns, *value).unionByName(rest.select(*left.columns, *value))


#: Bits of the map that thins a table before it is shuffled for a join.
THIN_BITS = 1 << 23


def marked(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """left with _may: whether its (long) key may be among keys; a bitmap of THIN_BITS bits at most is broadcast."""
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(THIN_BITS))
    bits = keys.select(F.bitmap_bucket_number(h).alias("_b"), F.bitmap_bit_position(h).alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_map"))
    at = left.withColumn("_b", F.bitmap_bucket_number(h)).withColumn("_p", F.bitmap_bit_position(h))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright("_p", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = byte.bitwiseAND(F.pow(F.lit(2), F.col("_p") % 8).cast("int")) != 0
    return at.join(F.broadcast(bits), "_b", "left").select(*left.columns, F.coalesce(one, F.lit(False)).alias("_may"))


def thin(left: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of left whose (long) key may be among keys.

    A saver of shuffled bytes only: rows whose key is not there may pass, so a join or semi join has to follow.
    """
    return marked(left, keys, key).filter("_may").select(left.columns)


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, as columns k1 and k2 (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(0x5EED), t).alias("k2")]


# ---------------------------------------------------------------- words of many texts at once

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def separators(spec: str) -> np.ndarray:
    """A table of 256 flags; spec 'space' is \\x20 and \\x09-\\x0D, 'alnum' is every ASCII byte but letters and digits."""
    out = np.zeros(256, bool)
    if spec == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    else:
        out[:128] = True
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            out[a:b] = False
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


class Words:
    """The words of some texts: byte range and hash of each, and where each text's words begin."""

    def __init__(self, texts: list[str | None], sep: np.ndarray, lower: bool, hashed: bool = True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = b" ".join(raw) + b" "
        buf = np.frombuffer(self.bytes, np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)])
        word = np.zeros(len(buf) + 1, np.int8)
        word[1:] = ~sep[buf]
        edge = np.flatnonzero(np.diff(word))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_at)
        if hashed:
            x = (lower_table()[buf] if lower else buf).astype(np.uint64)
            x += _U(1)
            x *= powers(_BASE, len(buf))
            np.cumsum(x, out=x)
            h = x[self.end - 1]
            back = self.start > 0
            h[back] -= x[self.start[back] - 1]
            self.hash = mix(h * powers(_BASE_INV, len(buf))[self.start])

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]]


def windows(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive words (of one text: the caller drops windows that cross an end)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = _U((0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B97F4A7C15) & (2**64 - 1) | 1)
    if n <= 8:
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * base + h[j : len(h) - n + 1 + j]
        return mix(out)
    inv = _U(pow(int(base), -1, 1 << 64))
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)))])
    return mix((c[n:] - c[:-n]) * powers(inv, len(h))[: len(h) - n + 1])


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to limit at most (a larger row is a range of its own)."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > a:
            yield a, i
            a, total = i, 0
        total += int(n)
    if len(sizes) > a:
        yield a, len(sizes)


#: What operators remember in a worker from task to task: a name, and the call that forgets it.
_remembered: dict[str, Callable[[], None]] = {}


def remember(what: str, let_go: Callable[[], None]) -> None:
    """Names a memory that a worker keeps only as long as text_chunks is called with keep=what."""
    _remembered[what] = let_go


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, keep: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with at most `limit` bytes of text each (a longer text is alone), and their texts.

    A worker serves the tasks of all operators in turn: what others than `keep` remember in it is forgotten first.
    """
    for what, let_go in _remembered.items():
        if what != keep:
            let_go()
    col = batch.column(batch.schema.get_field_index(column))
    import pyarrow.compute as pc

    for a, b in chunks(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), limit):
        yield batch.slice(a, b - a), col.slice(a, b - a).to_pylist()


# ---------------------------------------------------------------- files in the shared folder, from executors


def open_fs(uri: str):
    """A pyarrow file system and the path in it; works for local, hdfs, s3 and gcs addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data_writer) -> None:
    """Writes a file under a private name and moves it to its own, which no other attempt of the task may use."""
    from pyarrow import fs as pafs

    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        raise FileExistsError(uri)
    mine = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(mine, compression=None) as out:
        data_writer(out)
    fs.move(mine, path)
