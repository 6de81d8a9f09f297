"""Nearest neighbours by additive quantisation.

Every vector is coded as a sum of one full-dimensional codeword from each of several residual codebooks, found by beam
search. The index keeps codes, the norm of the coded vector and the original. A query scores all rows by table lookups
(|x|^2 - 2 q.x, with q.codeword computed once). Its shortlist is global: the rows that score at most what its last row scores
among all different codes of the index. That score is found by counting the scores of all codes in bins, so it depends neither
on a sample nor on how rows lie in partitions. The shortlist is reranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm import common

#: Codebooks, codewords of each, beam width.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors (those with the smallest hashes), about, that the codebooks are fitted on; every row is coded and indexed.
FIT_ROWS = 8192
#: A shortlist has at least SHORT rows (different codes) and one in SHARE of the index.
SHORT, SHARE = 100, 100
#: Bins that a pass over the codes counts scores in. A bin that makes a shortlist longer than SLACK times its rows is divided again.
BINS, SLACK = 512, 1.25
#: Rows of the index, and queries, that are scored at a time; queries that are broadcast for one pass over the index.
BLOCK_ROWS, QUERY_ROWS, QUERY_BLOCK = 8192, 128, 1 << 14


def usable(v: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


class Quantiser:
    """Residual codebooks: fitted in turn, each on what the beam search so far leaves over."""

    def __init__(self, x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 6):
        rng = np.random.default_rng(7)
        self.beam = beam
        self.books: list[np.ndarray] = []
        rests, codes = self.begin(x)
        for _ in range(books):
            rest = rests[:, 0]
            k = min(words, len(rest))
            c = rest[rng.permutation(len(rest))[:k]].copy()
            for _ in range(rounds):
                near = (np.einsum("ij,ij->i", c, c)[None] - 2 * rest @ c.T).argmin(1)
                n = np.bincount(near, minlength=k)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.integers(0, len(rest), k)])
            self.books.append(c.astype(np.float32))
            rests, codes = self.extend(rests, codes, self.books[-1])

    def begin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, None, :].astype(np.float32), np.zeros((len(x), 1, 0), np.uint8)

    def extend(self, rests: np.ndarray, codes: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One book more: of all partial sums and its words the BEAM that leave least."""
        n, _, d = rests.shape
        flat = rests.reshape(-1, d)
        cost = (np.einsum("ij,ij->i", flat, flat)[:, None] - 2 * flat @ c.T + np.einsum("ij,ij->i", c, c)).reshape(n, -1)
        keep = min(self.beam, cost.shape[1])
        best = np.argpartition(cost, keep - 1, 1)[:, :keep]
        best = np.take_along_axis(best, np.take_along_axis(cost, best, 1).argsort(1, kind="stable"), 1)
        parent, word = best // len(c), best % len(c)
        rests = np.take_along_axis(rests, parent[:, :, None], 1) - c[word]
        return rests, np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and coded vectors; BEAM partial sums of each vector are kept from book to book."""
        rests, codes = self.begin(x)
        for c in self.books:
            rests, codes = self.extend(rests, codes, c)
        return codes[:, 0], (x - rests[:, 0]).astype(np.float32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Dot products of each query with each codeword: queries x books x words."""
        width = max(map(len, self.books))
        out = np.zeros((len(q), len(self.books), width), np.float32)
        for m, c in enumerate(self.books):
            out[:, m, : len(c)] = q.astype(np.float32) @ c.T
        return out


def scores(codes: np.ndarray, norm: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Squared distances, less |q|^2, of coded rows (codes by book) from one query, by lookups in its tables."""
    out = norm.astype(np.float32)
    for m, words in enumerate(codes):
        out -= 2 * tables[m].take(words)
    return out


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def sampled(rows: DataFrame, vec: str, n: int, most: int) -> DataFrame:
    """About `most` of n rows, by the hashes of their vectors: for fitting the codebooks, nothing else."""
    return rows if n <= most else rows.filter(F.pmod(F.xxhash64(vec), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(vectors: DataFrame, vec: str = "embedding") -> tuple[Quantiser | None, int, int]:
    """The quantiser, fitted on about FIT_ROWS vectors, the dimension (that of most vectors; smaller one on a tie), the rows."""
    sizes = vectors.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None, 0, 0
    own = vectors.filter(F.size(vec) == sizes.d).select(F.col(vec).cast("array<double>").alias("v"))
    rows = sampled(own, "v", sizes["count"], FIT_ROWS).dropDuplicates(["v"]).collect()
    if not rows:  # a few large groups of equal vectors may all have large hashes
        rows = own.limit(1).collect()
    x = np.array(sorted(r.v for r in rows), np.float64)
    return Quantiser(x), sizes.d, sizes["count"]


def build(vectors: DataFrame, quantiser: Quantiser, d: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The index: a row for each vector with its codes, the coded vector's squared norm and the original."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                codes, coded = shared.value.encode(matrix(part.column(1), d))
                norm = np.einsum("ij,ij->i", coded.astype(np.float64), coded.astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), part.column(1)], ["vec_id", "codes", "norm", "vector"])

    rows = vectors.filter(F.size(vec) == d).select(F.col(key).cast("long"), F.col(vec).cast("array<double>"))
    spread = rows.repartition(common.partitions(vectors.sparkSession))
    return common.materialise(spread.mapInArrow(run, "vec_id long, codes binary, norm double, vector array<double>"), "ann-index")


def different(index: DataFrame) -> DataFrame:
    """codes, norm of every code of the index, once: copies of a vector are one row of a shortlist."""
    codes = index.groupBy("codes").agg(F.min("norm").alias("norm"))
    return common.materialise(codes.repartition(common.partitions(index.sparkSession)), "ann-codes")


def place(score: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bins 1 to BINS of scores between low and high; 0 is what is lower or no number, BINS + 1 what is higher."""
    x = (score.astype(np.float64) - low) * (BINS / (high - low))
    return np.nan_to_num(np.clip(np.floor(x) + 1, 0, BINS + 1), nan=0).astype(np.int64)


def counted(codes: DataFrame, q: np.ndarray, low: np.ndarray, high: np.ndarray, quantiser: Quantiser, rank: int) -> DataFrame:
    """The bin between low and high where the rank-th score of each query lies: at (its row in q), bin, n (scores up to its end).

    Every code is scored. A task holds BINS + 2 counts a query and returns them once.
    """
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast((q, low, high, quantiser))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, low, high, quant = shared.value
        n = np.zeros((len(q), BINS + 2), np.int64)
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                p = b.slice(a, BLOCK_ROWS)
                c = np.frombuffer(b"".join(p.column(0).to_pylist()), np.uint8).reshape(p.num_rows, -1)
                c, norm = np.ascontiguousarray(c.T.astype(np.int64)), p.column(1).to_numpy()
                for start in range(0, len(q), QUERY_ROWS):
                    for i, table in enumerate(quant.tables(q[start : start + QUERY_ROWS]), start):
                        n[i] += np.bincount(place(scores(c, norm, table), low[i], high[i]), minlength=BINS + 2)
        for a in range(0, len(q) if n.any() else 0, QUERY_ROWS):
            part = n[a : a + QUERY_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array([x.tobytes() for x in part], pa.binary())], ["at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(n, np.int64)
        found = [(i, int(np.searchsorted(up, rank)), up) for i, up in ((i, np.cumsum(n)) for i, n in total.items())]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([int(up[k]) for _, k, up in found], pa.int64())], ["at", "bin", "n"])

    # no more tasks than cores: each returns counts of all queries
    few = codes.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(count, "at long, n binary")
    return few.repartition(common.partitions(spark), "at").mapInArrow(merge, "at long, bin int, n long")


def thresholds(codes: DataFrame, q: np.ndarray, quantiser: Quantiser, rank: int) -> np.ndarray:
    """The score that a row of each query's shortlist has at most: that of the rank-th of all codes, or a little more.

    Scores lie between those of the nearest and the farthest point that a coded vector can be. A pass counts all of them in
    bins; where the bin of the rank-th makes a shortlist longer than SLACK times its rows, another pass divides that bin.
    """
    m, far = codes.agg(F.count("*"), F.max("norm")).first()
    most = np.full(len(q), np.inf)
    if m <= rank:
        return most
    length, far = np.sqrt(np.einsum("ij,ij->i", q, q)), np.sqrt(far)
    pad = 1e-4 * (length + far) ** 2  # scores are in single precision
    low, high = np.maximum(length - far, 0) ** 2 - length**2 - pad, (length + far) ** 2 - length**2 + pad
    todo = np.arange(len(q))
    while len(todo):
        again = []
        for at, k, n in counted(codes, q[todo], low[todo], high[todo], quantiser, rank).collect():
            i, step = todo[at], (high[todo[at]] - low[todo[at]]) / BINS
            below, end = low[i] + (k - 1) * step, low[i] + k * step
            most[i] = np.inf if k > BINS else end + 1e-6 * step
            if 0 < k <= BINS and n > SLACK * rank and np.nextafter(np.float32(below), np.float32(np.inf)) < np.float32(end):
                low[i], high[i] = below, end
                again.append(i)
        todo = np.array(sorted(again), np.int64)
    return most


class Search:
    """The best rows so far of each query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, most: np.ndarray, quantiser: Quantiser, k: int):
        self.ids, self.q, self.most, self.k, self.quantiser = ids, q, most, k, quantiser
        self.score: list[np.ndarray] = [np.zeros(0)] * len(ids)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)

    def block(self, ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, x: np.ndarray) -> None:
        # equal vectors are one candidate with its k + 1 smallest ids: no more can be among the nearest k
        same = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in x], np.uint64)
        order = np.lexsort((ids, same))
        ids, codes, norm, x, same = ids[order], codes[order], norm[order], x[order], same[order]
        first = np.concatenate([[True], (same[1:] != same[:-1]) | (x[1:] != x[:-1]).any(1)])
        at = np.flatnonzero(first)
        nth = np.arange(len(ids)) - at[np.cumsum(first) - 1]
        size = np.minimum(np.diff(np.append(at, len(ids))), self.k + 1)
        ids = ids[nth <= self.k]
        start = np.cumsum(size) - size
        codes, norm, x = np.ascontiguousarray(codes[at].T.astype(np.int64)), norm[at], x[at]
        for a in range(0, len(self.ids), QUERY_ROWS):
            for i, table in enumerate(self.quantiser.tables(self.q[a : a + QUERY_ROWS]), a):
                near = np.flatnonzero(~(scores(codes, norm, table) > self.most[i]))
                diff = x[near] - self.q[i]
                exact = np.sqrt(np.einsum("ij,ij->i", diff, diff))
                n = size[near]
                which = np.repeat(start[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cand, exact = ids[which], np.repeat(exact, n)
                ok = cand != self.ids[i]
                found, score = np.concatenate([self.found[i], cand[ok]]), np.concatenate([self.score[i], exact[ok]])
                best = np.lexsort((found, score))[: self.k]
                self.found[i], self.score[i] = found[best], score[best]


def search(index: DataFrame, queries: DataFrame, quantiser: Quantiser, d: int, n: int, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found; queries: rows vec_id, vector of the index of n rows.

    Queries go to the workers in blocks of QUERY_BLOCK, each against all rows; with several blocks the result of each is
    written before the next begins. A task returns k rows a query at most.
    """
    spark = index.sparkSession
    results: list[DataFrame] = []
    codes, rank = different(index), SHORT + n // SHARE + k

    def one(rows: list, last: bool) -> None:
        ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(-1, d)
        most = thresholds(codes, q, quantiser, rank)
        shared = spark.sparkContext.broadcast((ids, q, most, quantiser))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Search(*shared.value, k)
            for b in batches:
                for a in range(0, b.num_rows, BLOCK_ROWS):
                    p = b.slice(a, BLOCK_ROWS)
                    codes = np.frombuffer(b"".join(p.column(1).to_pylist()), np.uint8).reshape(p.num_rows, -1)
                    s.block(p.column(0).to_numpy(), codes, p.column(2).to_numpy(), matrix(p.column(3), d))
            n = [len(f) for f in s.found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate(s.found)), pa.array(np.concatenate(s.score))], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(run, "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(best if last and not results else common.materialise(best, "ann-found"))

    rows: list = []
    ready = common.materialise(queries.select("vec_id", "vector"), "ann-queries", clean=False)
    for r in ready.toLocalIterator():
        if len(rows) == QUERY_BLOCK:
            one(rows, False)
            rows = []
        rows.append(r)
    one(rows, True)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def nearest(vectors: DataFrame, every: int, k: int = 10, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows of each row whose key is divisible by `every`: query_id, rank, vec_id, score.

    Euclidean distance in double precision; ties go to the smaller key; the query's own row is no candidate (rows that
    repeat its key are not either). Rows without key, and vectors that are null, empty, zero, not finite, or of another
    length than most, take no part. A table without such rows gives none. Repeated rows and equal vectors are candidates
    each. Other columns are ignored.
    """
    good = vectors.filter(F.col(key).isNotNull() & usable(F.col(vec)))
    quantiser, d, n = fit(good, vec)
    if quantiser is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(good, quantiser, d, vec, key)
    queries = index.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    return search(index, queries, quantiser, d, n, k)
