"""Exact Jaccard self-join of word-shingle sets by vertical partitioning.

Equal sets are one class. All shingles stand in one global order; vertical cuts divide every set into the same fragments,
what a fragment says is counted on its own, and the partial counts are summed.
1. Sifting (order: hash): in each fragment a shingle that only one row has is found; a class needs 75 per cent of its set
   shared, so the sums over fragments drop most documents before anything else is shuffled. Repeated among the classes left.
2. Leader rounds (order: frequency level from a sketch, then hash): of the classes that share a prefix shingle the one with
   the largest shared part leads; each class is verified against the leader with which it shares most. These links join near
   copies without listing all their pairs.
3. The rest: pairs that share a prefix shingle and are not joined yet, thinned by exact bounds on size and difference.
The prefix (first 30 per cent of a set in the global order) is long enough that linked classes share a shingle in it.
Verification: FRAGMENTS vertical cuts at quantiles of the order; each fragment of each pair yields its partial overlap, and
the sum over a pair's fragments decides. A fragment's size is bounded, so a pair of very long sets is no task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm import common, graph

WORDS, THRESHOLD = 5, 75  # shingle length, similarity in hundredths
#: Counters of the frequency sketch (one byte each is broadcast) and the counters of one shuffled row.
SLOTS, ROW_SLOTS = 1 << 21, 1 << 12
#: The global order is cut into this many fragments for counting the overlaps of pairs.
FRAGMENTS = 8
#: Shingles of a fragment of the sieve, about (a task holds one); slots of the sieve's sketch, and how many times the mean
#: a slot has to be met (and at least how often) to count as shared without being shuffled.
SIEVE_ROWS, HOT_SLOTS, HOT_TIMES, HOT_LEAST = 1 << 22, 1 << 18, 16, 1 << 12
LEADER_ROUNDS = 2
#: Times that the sieve is repeated among the classes left.
SIFT_ROUNDS = 2


def shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles in order, repeats included; a shorter text's whole sequence is one."""
    w = common.Words(texts, common.separators("space"), True)
    every = common.windows(w.hash, WORDS, WORDS)
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if z - a >= WORDS:
            yield every[a : z - WORDS + 1]
        elif z > a:
            yield common.windows(w.hash[a:z], z - a, z - a)
        else:
            yield np.zeros(0, np.uint64)


def frequency_levels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each slot of the sketch how many times (log2) it exceeds the mean, over all shingles of all documents; and the
    keys at which the order is cut, so that fragments hold equal shares of the shingles."""
    chunk_type = np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, texts in common.text_chunks(b):
                h = np.concatenate([*shingles(texts), np.zeros(0, np.uint64)])
                table += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        rows = np.minimum(table, 2**32 - 1).astype(chunk_type).reshape(-1, ROW_SLOTS)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in rows[some]], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, chunk_type).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(chunk_type).tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary")
    summed = parts.repartition(common.partitions(docs.sparkSession), "part").mapInArrow(add, "part int, counts binary").collect()
    table = np.zeros((SLOTS // ROW_SLOTS, ROW_SLOTS))
    for r in summed:
        table[r.part] = np.frombuffer(r.counts, chunk_type)
    table = table.ravel()
    levels = np.clip(np.log2(np.maximum(table / max(table.mean(), 1.0), 1.0)), 0, 7).astype(np.uint8)
    mass = np.cumsum(np.bincount(levels, table, 8)) / max(table.sum(), 1.0)
    at = np.arange(1, FRAGMENTS) / FRAGMENTS
    level = np.minimum(np.searchsorted(mass, at), 7)  # within a level keys are spread evenly
    before = np.concatenate([[0.0], mass])[level]
    part = (at - before) / np.maximum(mass[level] - before, 1e-12)
    return levels, (level.astype(np.int64) << 60) + (np.clip(part, 0, 0.999999) * 2.0**60).astype(np.int64)


def ordered_sets(texts: list[str | None], levels: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles as signed 64-bit keys in the global order (level, then hash)."""
    out = []
    for h in shingles(texts):
        level = levels[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
        out.append(np.unique((level << np.uint64(60)) | (h >> np.uint64(4))).view(np.int64))
    return out


def class_id(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit name of a set."""
    x = s.view(np.uint64)
    size = np.uint64(len(s))
    parts = [np.sum(common.mix(x)), np.sum(common.mix(x ^ np.uint64(0xA0761D6478BD642F)))]
    name = common.mix(np.array(parts, np.uint64) + size * np.array([0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB], np.uint64))
    return tuple(name.view(np.int64).tolist())


def prefix_length(n: int) -> int:
    """Longer than n - ceil(0.75 n) + 1, which linked sets need to share one; the excess makes counts of shared ones telling."""
    return n - (70 * n + 99) // 100 + 1 if n else 0


def raw_sets(texts: list[str | None]) -> list[np.ndarray]:
    return [np.unique(h) for h in shingles(texts)]


def name_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, c1 and c2 of every document; besides, rows with part and counts: a task's sketch of all its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(HOT_SLOTS, np.int64)
        for b in batches:
            for part, texts in common.text_chunks(b):
                sets = raw_sets(texts)
                table += np.bincount((np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(HOT_SLOTS - 1)).astype(np.int64), minlength=HOT_SLOTS)
                names = np.array([class_id(s) for s in sets], np.int64).reshape(-1, 2)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "c1", "c2", "part", "counts"])
        rows = np.minimum(table, 2**32 - 1).astype(np.uint32).reshape(-1, ROW_SLOTS)
        some = np.flatnonzero(rows.any(1))
        none = [pa.nulls(len(some), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array([r.tobytes() for r in rows[some]], pa.binary())], ["doc_id", "n", "c1", "c2", "part", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, c1 long, c2 long, part int, counts binary")


def hot_slots(named: DataFrame) -> tuple[np.ndarray, int]:
    """Slots of the sketch that are met far more often than others, and how many shingles there are in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    parts = named.filter(F.col("part").isNotNull()).select("part", "counts").repartition(common.partitions(named.sparkSession), "part")
    table = np.zeros((HOT_SLOTS // ROW_SLOTS, ROW_SLOTS), np.int64)
    for r in parts.mapInArrow(add, "part int, counts binary").collect():
        table[r.part] = np.frombuffer(r.counts, np.int64)
    table = table.ravel()
    return table > max(HOT_LEAST, HOT_TIMES * table.mean()), int(table.sum())


def shared_counts(texts: DataFrame, hot: np.ndarray, total: int, named: bool) -> DataFrame:
    """c1, c2, n, s of texts (c1, c2, text): size of each set, and how many of its shingles another row has too.

    Without names (named is False) a row is called by its set's name. Shingles travel as 32-bit prints in one blob for each
    chunk of texts and fragment; two that agree in print and fragment by chance only make s larger, which keeps the sieve
    exact, and so do shingles of hot slots, which count as shared and stay at home. Equal rows count as two. A task holds
    one fragment; the number of fragments grows with the number of shingles (total).
    """
    spark = texts.sparkSession
    parts = max(common.partitions(spark), -(-total // SIEVE_ROWS))
    hot_at = spark.sparkContext.broadcast(hot)
    four = (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), four, strict=True)], ["chunk", "frag", "x", "y"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for part, some in common.text_chunks(b):
                sets = raw_sets(some)
                n = np.array([len(s) for s in sets], np.int64)
                h = np.concatenate([*sets, np.zeros(0, np.uint64)])
                doc = np.repeat(np.arange(len(sets)), n)
                sure = hot_at.value[(h & np.uint64(HOT_SLOTS - 1)).astype(np.int64)]
                names = np.stack([part.column(c).to_numpy() for c in (0, 1)], 1) if named else np.array([class_id(s) for s in sets], np.int64).reshape(-1, 2)
                rows = [(chunk, -1, names.tobytes(), np.concatenate([n, np.bincount(doc[sure], minlength=len(sets))]).tobytes())]
                h, doc = h[~sure], doc[~sure]
                frag = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(frag, kind="stable")
                cuts = np.searchsorted(frag[order], np.arange(parts + 1))
                prints, doc = ((h >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], doc.astype(np.uint32)[order]
                rows += [(chunk, f, prints[i:j].tobytes(), np.diff(doc[i:j], prepend=np.uint32(0)).astype(np.uint32).tobytes()) for f, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                chunk += 1
                yield table(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for b in batches:
            heads = []
            for chunk, frag, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if frag < 0:
                    heads.append((chunk, frag, x, y))
                else:
                    held.setdefault(frag, []).append((chunk, x, y))
            if heads:
                yield table(heads)
        for frag in list(held):
            blobs = held.pop(frag)
            every = np.concatenate([np.frombuffer(x, np.uint32) for _, x, _ in blobs])
            order = np.argsort(every, kind="stable")
            same = np.diff(every[order]) == 0
            shared = np.zeros(len(every), bool)
            shared[order[1:][same]] = True
            shared[order[:-1][same]] = True
            rows, at = [], 0
            for chunk, x, y in blobs:
                m = len(x) // 4
                doc = np.cumsum(np.frombuffer(y, np.uint32).astype(np.int64))
                rows.append((chunk, frag, np.bincount(doc[shared[at : at + m]]).astype(np.uint32).tobytes(), b""))
                at += m
            yield table(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, a chunk's names first: one chunk is held at a time."""
        names, n, s, at = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        done = lambda: pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(n), pa.array(s)], ["c1", "c2", "n", "s"])
        for b in batches:
            for chunk, frag, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if frag < 0:
                    if at is not None:
                        yield done()
                    names, both, at = np.frombuffer(x, np.int64).reshape(-1, 2), np.frombuffer(y, np.int64), chunk
                    n, s = both[: len(names)], both[len(names) :].copy()
                else:
                    v = np.frombuffer(x, np.uint32)
                    s[: len(v)] += v
        if at is not None:
            yield done()

    kinds = "chunk long, frag int, x binary, y binary"
    to = F.when(F.col("frag") < 0, F.pmod(F.col("chunk"), F.lit(parts)).cast("int")).otherwise(F.col("frag"))
    fragments = texts.select("c1", "c2", "text").mapInArrow(cut, kinds).repartitionById(parts, to)
    by_chunk = fragments.mapInArrow(count, kinds).repartition(common.partitions(spark), "chunk").sortWithinPartitions("chunk", "frag")
    return by_chunk.mapInArrow(add, "c1 long, c2 long, n long, s long")


def profile(texts: DataFrame, shared) -> DataFrame:
    """cid, n, s and prefix of each class of texts (cid, s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, some in common.text_chunks(b):
                sets = ordered_sets(some, shared.value[0])
                prefix = pa.array([s[: prefix_length(len(s))] for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), part.column(1), prefix], ["cid", "n", "s", "prefix"])

    return texts.select("cid", "s", "text").mapInArrow(run, "cid long, n long, s long, prefix array<long>")


def verified(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Of pairs (a, na, b, nb) of classes those that link: partial overlaps by fragment, summed."""
    need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, some in common.text_chunks(b):
                cids, frags, keys = [], [], []
                levels, cuts = shared.value
                for cid, s in zip(part.column(0).to_pylist(), ordered_sets(some, levels), strict=True):
                    for k, x in enumerate(np.split(s, np.searchsorted(s, cuts))):
                        if len(x):
                            cids.append(cid)
                            frags.append(k)
                            keys.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(frags, pa.int32()), pa.array(keys, pa.binary())], ["cid", "frag", "keys"])

    segments = texts.select("cid", "text").join(need, "cid", "left_semi").mapInArrow(cut, "cid long, frag int, keys binary")
    segments = common.materialise(segments, "join-segments")
    side = lambda c: segments.select(F.col("cid").alias(c), "frag", F.col("keys").alias(f"k{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "frag"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(hits, pa.int64())], ["a", "na", "b", "nb", "hits"])

    partial = both.select("a", "na", "b", "nb", "ka", "kb").mapInArrow(overlap, "a long, na long, b long, nb long, hits long")
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("hits").alias("both"))
    links = total.filter(100 * F.col("both") >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")
    out = common.materialise(links, "join-links")
    common.forget(segments)
    return out


def plausible(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Pairs (a, na, b, nb) less those whose prefixes already differ by more than linked sets of their sizes can.

    Up to the end of the prefix that ends first both sets are known, so what differs there differs for good.
    """
    need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    known = common.materialise(profile(texts.join(need, "cid", "left_semi"), shared).select("cid", "prefix"), "join-prefixes")
    both = pairs.join(known.select(F.col("cid").alias("a"), F.col("prefix").alias("pa")), "a").join(known.select(F.col("cid").alias("b"), F.col("prefix").alias("pb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(1).to_numpy(), b.column(3).to_numpy()
            most = na + nb - 2 * -(-(na + nb) * THRESHOLD // (100 + THRESHOLD))
            keep = []
            for k, (x, y) in enumerate(zip(b.column(4), b.column(5), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                end = min(x[-1], y[-1])
                i, j = np.searchsorted(x, end, "right"), np.searchsorted(y, end, "right")
                keep.append(i + j - 2 * len(np.intersect1d(x[:i], y[:j], assume_unique=True)) <= most[k])
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "na", "b", "nb"]).filter(pa.array(keep, pa.bool_()))

    out = common.materialise(both.select("a", "na", "b", "nb", "pa", "pb").mapInArrow(run, "a long, na long, b long, nb long"), "join-plausible")
    common.forget(known)
    return out


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (h, cid, n, s, pos, comp) of shingles whose classes are of two components or more, and may have a partner.

    A partner of a class has at most 7/3 s - n shingles, as no more than s can be common to both.
    """
    room = F.floor(F.col("s") * 7 / 3 + 1e-9) - F.col("n")
    most = F.max(room).alias("_room")
    many = tokens.groupBy("h").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.min("n").alias("_least"), most).filter("_x <> _y").select("h", "_least", "_room")
    found = tokens.join(many.hint("merge"), "h")
    return found.filter((F.col("_least") <= room) & (F.col("_room") >= F.col("n"))).select(tokens.columns)


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): the documents (doc_id, n, c1, c2), numbers (cid) of classes (c1, c2), and links (a, b) of cids.

    The links suffice for the components; pairs that are already joined are not all listed. Classes without a number have
    no links.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    name = ["c1", "c2"]
    known = common.materialise(name_sets(docs), "join-names")
    hot, total = hot_slots(known)
    known = known.filter(F.col("part").isNull()).select("doc_id", "n", *name)
    enough = (F.col("n") > 0) & (100 * F.col("s") >= THRESHOLD * F.col("n"))
    nobody = [F.lit(0).cast("long").alias(c) for c in name]
    left = common.materialise(shared_counts(docs.select(*nobody, "text"), hot, total, False).filter(enough).select(name).distinct(), "join-sieve")
    reps = known.groupBy(name).agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")).join(left, name, "left_semi")
    reps = common.materialise(reps, "join-reps")
    texts = common.thin(docs.filter(F.col("doc_id").isNotNull()), reps.filter(F.col("doc_id").isNotNull()), "doc_id").join(reps, "doc_id").select(*name, "text")
    nameless = docs.filter(F.col("doc_id").isNull()).select(*(F.lit(None).cast("long").alias(c) for c in name), "text")
    wanted = reps.filter(F.col("doc_id").isNull()).select(name)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, some in common.text_chunks(b):
                own = [class_id(s) for s in raw_sets(some)]
                keep = pa.array([x is None or (x, y) == o for x, y, o in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), own, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int64()), pa.array([o[1] for o in own], pa.int64()), part.column(2)], ["c1", "c2", "text"]).filter(keep)

    kinds = "c1 long, c2 long, text string"  # a doc_id that repeats may bring other texts: only those of the class stay
    texts = texts.mapInArrow(check, kinds).unionByName(nameless.mapInArrow(check, kinds).join(wanted, name, "left_semi"))
    texts = common.materialise(texts.dropDuplicates(name).withColumn("cid", F.monotonically_increasing_id()), "join-texts")
    ids = common.materialise(texts.select("cid", *name), "join-ids", clean=False)
    for _ in range(SIFT_ROUNDS):
        again = shared_counts(texts.select(F.col("cid").alias("c1"), F.lit(0).cast("long").alias("c2"), "text"), hot, total, True)
        again = common.materialise(again.filter(enough).select(F.col("c1").alias("cid"), "s"), "join-sieve")
        old, texts = texts, common.materialise(texts.select("cid", "text").join(again, "cid"), "join-texts")
        common.forget(old)
        common.forget(again)
    shared = spark.sparkContext.broadcast(frequency_levels(texts))
    tokens = profile(texts, shared).select("cid", "n", "s", F.explode("prefix").alias("h")).withColumn("comp", F.col("cid"))
    before = Window.partitionBy("cid").orderBy("h")
    tokens = shared_tokens(tokens).withColumn("rank", F.row_number().over(before) - 1)
    tokens = common.materialise(tokens, "join-tokens")
    near = lambda x, y: 100 * F.least(x, y) >= THRESHOLD * F.greatest(x, y)
    # two sets with s shared shingles each have no more in common than the smaller s
    fits = lambda sa, na, sb, nb: 7 * F.least(sa, sb) >= 3 * (na + nb)
    links = None
    comps = None

    def relabelled() -> DataFrame:
        if comps is None:
            return tokens
        own = comps.select(F.col("node").alias("cid"), "component")
        return tokens.join(own, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")

    for k in range(LEADER_ROUNDS):
        live = common.materialise(shared_tokens(relabelled()), "join-live") if k else tokens
        order = F.struct(F.floor(F.col("s") * 200 / F.col("n")).alias("f"), F.xxhash64("cid", F.lit(k)).alias("o"), F.col("cid").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), F.col("comp").alias("ca"))
        lead = live.groupBy("h").agg(F.max(order).alias("l"), F.count("*").alias("_n")).select("h", "_n", "l.a", "l.na", "l.sa", "l.ca")
        lead = common.materialise(lead, "join-lead")
        pairs = common.skew_join(live, lead, ["h"], "_n", live.count()).filter((F.col("comp") != F.col("ca")) & near(F.col("n"), F.col("na")) & fits(F.col("s"), F.col("n"), F.col("sa"), F.col("na")))
        strong = pairs.groupBy("cid", "n", "a", "na").agg(F.count("*").alias("c")).filter(20 * F.col("c") >= F.least("n", "na") * 0.3)
        best = strong.groupBy("cid", "n").agg(F.max(F.struct("c", "a", "na")).alias("l")).select(F.col("l.a").alias("a"), F.col("l.na").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb"))
        best = common.materialise(best, "join-pairs")
        new = verified(best, texts, shared)
        links = new if links is None else links.unionByName(new)
        comps = graph.components(links)
        if k:
            common.forget(live)
    live = common.materialise(shared_tokens(relabelled()), "join-rest")
    # the first shingle that two sets share: what they share with others before it they do not share with each other, so
    # they have no more in common than the smaller rest; linked pairs therefore pass the bound at that shingle
    rest = F.col("s") - F.col("rank")
    x = live.select("h", F.col("cid").alias("a"), F.col("n").alias("na"), rest.alias("sa"), F.col("comp").alias("ca"))
    y = live.select("h", F.col("cid").alias("b"), F.col("n").alias("nb"), rest.alias("sb"), F.col("comp").alias("cb"))
    cross = x.join(y, ["h"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near(F.col("na"), F.col("nb")) & fits(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb")))
    pairs = common.materialise(cross.select("a", "na", "b", "nb").distinct(), "join-pairs")
    rest = plausible(pairs, texts, shared)
    new = verified(rest, texts, shared)
    for df in (tokens, live, texts):
        common.forget(df)
    return known, ids, links.unionByName(new)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of each document.

    Null texts and texts without words have no shingles and no links; their component is themselves. Equal sets link.
    Rows that repeat are in one component. Texts of any length are compared whole. A null doc_id takes the smallest id of its component, if any. Other columns
    are ignored; an empty table gives no rows.
    """
    known, ids, links = similar_sets(docs)
    comps = graph.components(links).withColumnRenamed("node", "cid")
    name = ["c1", "c2"]
    classes = common.materialise(known.filter("n > 0").groupBy(name).agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "join-known")
    linked = classes.join(ids.join(comps, "cid"), name)
    of = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = common.materialise(linked.join(of, "component").select(*name, "component_id", "_n"), "join-linked")
    # classes of one document that link to nothing need no join
    alone = classes.filter("_n > 1").join(linked.select(name), name, "left_anti").select(*name, F.col("least").alias("component_id"), "_n")
    joined = common.materialise(linked.unionByName(alone), "join-classes")
    out = common.skew_join(known, joined, name, "_n", known.count(), "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
