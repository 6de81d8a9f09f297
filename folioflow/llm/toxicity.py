"""Toxicity by two class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of words with four orders:
* a word after the word before it: in how many texts the two stand together;
* a word: its continuation count, the number of different words that it follows;
* the words that begin like it, in 7 and in 5 bytes: the sums of their continuation counts;
* below these, the continuation counts of both classes together, which so smooth the rare expressions of either.
At each order counts are discounted by DISCOUNTS and exactly the mass that this frees goes to the order below.
Words before a word are told apart by a print of CONTEXT_BITS bits, so the contexts' tables have a fixed size (continuation
counts are corrected for prints that fall together).

A toxic text is mostly ordinary words with toxic ones strewn in, so its likelihood is that of the mixture (1 - SHARE) ordinary
+ SHARE toxic. A text's score is the difference of the length-normalised log-likelihoods, the mixture's less the ordinary
model's, through a logistic curve that is fitted on labelled texts which the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common

#: Bytes of a word at each order, coarse to fine (the last is longer than any word).
LEVELS = (5, 7, 1 << 30)
#: Keeps the orders' hashes apart (a small step would be met by a word whose first letter is the next one).
LEVEL_STEP = 0xD6E8FEB86659FD93
#: Discounts of counts of 1, 2, and 3 or more: for continuation counts, and for pairs of words.
DISCOUNTS, PAIR_DISCOUNTS = (1.0, 1.5, 2.0), (1.0, 2.0, 3.0)
CONTEXT_BITS = 14
#: Share of toxic words in a toxic text; a short text counts as if it had USUAL words of the usual score besides.
SHARE, USUAL = 0.02, 8
#: Expressions of a block of the model (12 bytes each), about; slices of a batch that are looked up in one pass over several blocks.
BLOCK, GROUP = 1 << 21, 8
#: Flags that tell a block's expressions from most others.
FLAGS = 1 << 22
#: Pairs that a task holds before it merges them, and passes them on where that does not halve them.
HELD = 1 << 19
#: Labelled texts that the two numbers of the logistic curve are fitted on, about, at most (those with the smallest hashes).
CURVE_ROWS = 8000
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out, 3 fits the curve, 0 and 1 the models. Null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def expressions(texts: list[str | None]) -> tuple[common.Words, list[np.ndarray]]:
    """The words of some texts and the hash of each at every level."""
    w = common.Words(texts, common.separators("alnum"), True, hashed=False)
    buf = common.lower_table()[np.frombuffer(w.bytes, np.uint8)].astype(np.uint64)
    buf += np.uint64(1)
    buf *= common.powers(common._BASE, len(buf))
    np.cumsum(buf, out=buf)
    base = np.where(w.start > 0, buf[w.start - 1], np.uint64(0))
    back = common.powers(common._BASE_INV, len(buf))[w.start]
    out = []
    for k, n in enumerate(LEVELS):
        end = np.minimum(w.end, w.start + n)
        out.append(common.mix((buf[end - 1] - base) * back + np.uint64(LEVEL_STEP * k % 2**64)))
    return w, out


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic (0/1) and fold of the labelled rows outside the held-out fold; a bitmap of label ids thins the join."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != 2)
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    return common.thin(at, known, "doc_id").join(known, "doc_id").select("text", "toxic", fold(F.col("doc_id")).alias("fold"))


def pair_keys(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of words after contexts."""
    return common.mix(words * np.uint64(0x9FB21C651E98DF25) + before + np.uint64(1))


def contexts(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The print of the word before each word (0 before a text's first)."""
    out = np.zeros(len(words), np.uint64)
    out[1:] = np.where(doc[1:] == doc[:-1], words[:-1] >> np.uint64(64 - CONTEXT_BITS), np.uint64(0))
    return out


def merged(h: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (word, context and class, count) in order, one for each word, context and class."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[starts], k[starts], np.add.reduceat(n[order], starts) if len(h) else n


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary values: the bytes of values between cuts."""
    w = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * w).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def pairs(train: DataFrame) -> DataFrame:
    """h, p7, p5, keys, counts: of each word its contexts (times 4, plus class) and in how many texts each stands before it.

    Classes: 0 toxic, 1 ordinary, 2 and 3 the same of the curve's fold. A task merges its texts before it passes rows on.
    """
    names = ["h", "p7", "p5", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        known: list[np.ndarray] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            h, k, n = held[0]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            _, at = np.unique(known[0][0], return_index=True)
            up = known[0][:, at]  # in the order of h: both hold the same words
            for a in range(0, len(cuts) - 1, 1 << 18):
                c = cuts[a : a + (1 << 18) + 1]
                i, z = c[0], c[-1]
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + len(c) - 1].view(np.int64)) for x in up] + [blobs(k[i:z], c - i), blobs(n[i:z].astype(np.uint32), c - i)], names)

        def gather() -> None:
            nonlocal held, known, size
            held = [merged(*map(np.concatenate, zip(*held, strict=True)))]
            every = np.concatenate(known, 1)
            known = [every[:, np.unique(every[0], return_index=True)[1]]]
            size = len(held[0][0])

        for b in batches:
            for part, texts in common.text_chunks(b):
                y, late = part.column(1).to_numpy() == 1, part.column(2).to_numpy() == 3
                kind = np.where(y, 0, 1) + np.where(late, 2, 0)
                w, (p5, p7, h) = expressions(texts)
                if not len(h):
                    continue
                doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
                word, first, number = np.unique(h, return_index=True, return_inverse=True)
                key = (contexts(h, doc).astype(np.int64) << 2) + kind[doc]
                once = np.unique((((number << (CONTEXT_BITS + 2)) + key) << 22) + doc) >> 22  # a text counts once
                starts = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]]))
                pair = once[starts]
                held.append((word[pair >> (CONTEXT_BITS + 2)], (pair & ((1 << (CONTEXT_BITS + 2)) - 1)).astype(np.uint32), np.diff(np.append(starts, len(once)))))
                known.append(np.stack([word, p7[first], p5[first]]))
                size += len(pair)
                if size > HELD:
                    gather()
                    if size > HELD // 2:
                        yield from emit()
                        held, known, size = [], [], 0
        if held:
            gather()
            yield from emit()

    raw = train.select("text", F.col("toxic").cast("int"), "fold").mapInArrow(run, "h long, p7 long, p5 long, keys binary, counts binary")
    return raw.repartition(common.partitions(train.sparkSession), "h").sortWithinPartitions("h")


#: Rows of the counts: a word with its continuation counts (u: whether a pair of it is listed), a pair of words with its
#: texts, a context with its pairs.
WORD, PAIR, CONTEXT = 0, 1, 2
COUNTS = "kind int, h long, p7 long, p5 long, u int, toxic long, ordinary long, toxic_all long, ordinary_all long"


def counts(train: DataFrame) -> DataFrame:
    """See COUNTS; the last two columns include the curve's fold.

    Rows of a word arrive together and are merged as they come: a task holds one batch and one word's contexts. Pairs in
    so few texts that discounting leaves nothing are not listed; what they weigh stays in their contexts' sums.
    """
    names = [x.split()[0] for x in COUNTS.split(", ")]
    width = 1 << CONTEXT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width), np.int64)
        carry: tuple | None = None

        def table(kind: int, h, p7, p5, u, n) -> pa.RecordBatch:
            columns = [np.full(len(h), kind, np.int32), h, p7, p5, u.astype(np.int32), *n]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        def emit(h, k, n, words, p7, p5) -> Iterator[pa.RecordBatch]:
            u = k >> 2
            starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (u[1:] != u[:-1])]))
            index = np.cumsum(np.concatenate([[0], ((h[1:] != h[:-1]) | (u[1:] != u[:-1])).astype(np.int64)]))
            four = np.zeros((4, len(starts)), np.int64)
            np.add.at(four, ((k & 3).astype(np.int64), index), n)
            ph, pu = h[starts], u[starts].astype(np.int64)
            four[2:] += four[:2]
            for c in range(4):
                total[c] += np.bincount(pu, four[c], width).astype(np.int64)
            at = np.searchsorted(words, ph)
            some = [np.bincount(at, four[c] > 0, len(words)) for c in range(4)]
            # words that follow many contexts: how many they are, from how many prints they have
            some = [np.rint(-width * np.log1p(-np.minimum(x, width - 1) / width)).astype(np.int64) for x in some]
            keep = (four > max(PAIR_DISCOUNTS)).any(0)
            yield table(WORD, words, p7, p5, np.bincount(at[keep], minlength=len(words)) > 0, some)
            if keep.any():
                key = pair_keys(ph[keep].view(np.uint64), pu[keep].astype(np.uint64)).view(np.int64)
                yield table(PAIR, ph[keep], key, key, pu[keep], four[:, keep])

        def unpack(b: pa.RecordBatch) -> tuple:
            h, p7, p5 = (b.column(c).to_numpy() for c in range(3))
            keys, n = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32) for c in (3, 4))
            size = np.diff(np.frombuffer(b.column(3).buffers()[1], np.int32)[b.column(3).offset :][: len(h) + 1]) // 4
            return np.repeat(h, size), keys, n.astype(np.int64), h, p7, p5

        for b in batches:
            if not b.num_rows:
                continue
            h, k, n, words, p7, p5 = unpack(b)
            if carry is not None:
                h, k, n, words, p7, p5 = (np.concatenate(x) for x in zip(carry, (h, k, n, words, p7, p5), strict=True))
            h, k, n = merged(h, k, n)
            words, at = np.unique(words, return_index=True)
            p7, p5 = p7[at], p5[at]
            last = int(np.searchsorted(h, words[-1]))
            if last:
                yield from emit(h[:last], k[:last], n[:last], words[:-1], p7[:-1], p5[:-1])
            carry = h[last:], k[last:], n[last:], words[-1:], p7[-1:], p5[-1:]
        if carry is not None:
            yield from emit(*carry)
            u = np.flatnonzero(total.any(0))
            none = np.zeros(len(u), np.int64)
            yield table(CONTEXT, none, none, none, u, total[:, u])

    return pairs(train).mapInArrow(run, COUNTS)


class Model:
    """Log-likelihood ratios of all counted expressions, dealt by hash over blocks that are broadcast each on its own.

    The number of blocks grows with the corpus, their size does not: driver and tasks hold one at a time. unknown is the
    ratio of words of which nothing is known, context what the word before adds where the pair is not listed.
    """

    def __init__(self, blocks: list[Broadcast], unknown: float, context: np.ndarray):
        self.blocks, self.unknown, self.context = blocks, unknown, context

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes, their ratios, and flags. Of several blocks none is kept (Broadcast.value alone would keep all)."""
        b = self.blocks[i]
        out = b.value
        if len(self.blocks) > 1 and getattr(b, "_path", None):
            b.__dict__.pop("_value", None)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The ratio of each hash, NaN where it is not known."""
        out = np.full(len(keys), np.nan, np.float32)
        at = keys.view(np.int64) % len(self.blocks) if len(self.blocks) > 1 else None
        for i in range(len(self.blocks)):
            h, ratio, seen = self.block(i)
            if not len(h):
                continue
            mine = np.flatnonzero(at == i) if at is not None else np.arange(len(keys))
            mine = mine[seen[(keys[mine] >> np.uint64(20)).astype(np.int64) & (FLAGS - 1)]]
            slot = np.minimum(np.searchsorted(h, keys[mine]), len(h) - 1)
            out[mine] = np.where(h[slot] == keys[mine], ratio[slot], np.nan)
        return out

    def ratios(self, levels: list[np.ndarray], words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each token (its word's number in levels, its context): the ratio at the highest order that is known."""
        own = np.full(len(levels[0]), self.unknown, np.float32)
        found = self.find(np.concatenate([*levels, pair_keys(levels[-1][words], before)]))
        for k in range(len(levels)):
            v = found[k * len(own) : (k + 1) * len(own)]
            own = np.where(np.isnan(v), own, v)
        pair = found[len(levels) * len(own) :]
        return np.where(np.isnan(pair), own[words] + self.context[before.astype(np.int64)], pair)

    def features(self, group: list[list[str | None]]) -> list[np.ndarray]:
        """For each list of texts: the sum over the words of a text of log(mixture / ordinary), and the number of words."""
        held, levels, at = [], [], 0
        for texts in group:  # each list's distinct words are looked up, all lists' in one pass over the blocks
            w, own = expressions(texts)
            n = np.diff(w.first)
            _, first, back = np.unique(own[-1], return_index=True, return_inverse=True)
            held.append((n, back + at, contexts(own[-1], np.repeat(np.arange(len(n)), n))))
            levels.append(np.stack([h[first] for h in own]))
            at += len(first)
        if not held:
            return []
        value = self.ratios(list(np.concatenate(levels, 1)), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]))
        value = np.log1p(SHARE * np.expm1(np.minimum(value.astype(float), 30)))
        out, at = [], 0
        for n, words, _ in held:
            doc = np.repeat(np.arange(len(n)), n)
            out.append(np.stack([np.bincount(doc, value[at : at + len(words)], len(n)), n.astype(float)], 1))
            at += len(words)
        return out

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Slices of a batch with the features of their texts; with several blocks GROUP slices are looked up together."""
        parts = common.text_chunks(batch)
        while group := list(islice(parts, GROUP if len(self.blocks) > 1 else 1)):
            yield from zip((p for p, _ in group), self.features([t for _, t in group]), strict=True)

    def unpersist(self) -> None:
        for b in self.blocks:
            b.unpersist()


def discounted(n: Column, by: tuple[float, float, float]) -> Column:
    """What discounting leaves of a count."""
    return F.greatest(n - F.when(n >= 3, by[2]).when(n == 2, by[1]).otherwise(by[0]), F.lit(0.0))


def ratios_table(words: DataFrame, listed: DataFrame, context: DataFrame) -> tuple[DataFrame, float, np.ndarray]:
    """h and ratio of what is known, the ratio of unknown words, and what each context adds.

    words: h, p7, p5, u, toxic, ordinary; listed: key, h, u and context: u with the same counts. An expression of whose
    counts nothing is left takes the ratio of the order below and the two classes' freed masses.
    """
    both = ("toxic", "ordinary")
    left = {c: discounted(F.col(c), DISCOUNTS) for c in both}
    sums = [F.max("u").alias("u"), *(F.sum(c).alias(c) for c in both)]
    orders = [words.groupBy(F.col("p5").alias("h")).agg(*sums), words.groupBy(F.col("p7").alias("h")).agg(F.min("p5").alias("up"), *sums), words.select("h", F.col("p7").alias("up"), "u", *both)]
    rows, over, up = [], (F.greatest(*left.values()) > 0) | (F.col("u") > 0), None
    masses = []
    for own in orders:
        got = own.agg(*(F.sum(c).alias(c) for c in both), *(F.sum(left[c]).alias(f"{c}_left") for c in both)).first()
        total = {c: float(got[c] or 0) for c in both}
        masses.append({c: (1 - float(got[f"{c}_left"]) / total[c] if total[c] else 1.0) or 1e-9 for c in both} | {"total": total})
    constant = [float(np.log(x["toxic"] / x["ordinary"])) for x in masses]
    for k, own in enumerate(orders):
        mass, total = masses[k], masses[k]["total"]
        own = own.filter(over)
        count = F.col("toxic") + F.col("ordinary")
        if up is None:
            share = (count + 0.5) / (sum(total.values()) + 1)
            base = {c: share for c in both}
        else:  # what the order below says, shared out by the counts of both classes
            own = own.join(up, "up")
            base = {c: F.col(f"up_{c}") * (count + 0.05) / (F.col("up_n") + 0.05) for c in both}
        p = {c: (left[c] / total[c] if total[c] else F.lit(0.0)) + mass[c] * base[c] for c in both}
        made = own.select("h", count.alias("n"), p["toxic"].alias("pt"), p["ordinary"].alias("po"))
        rows.append(made.select("h", (F.log("pt") - F.log("po") + sum(constant[k + 1 :])).cast("float").alias("ratio")))
        up = made.select(F.col("h").alias("up"), F.col("pt").alias("up_toxic"), F.col("po").alias("up_ordinary"), F.col("n").alias("up_n"))
    # pairs of words: what discounting leaves, and the freed mass times the word's own estimate
    rest = {c: discounted(F.col(c), PAIR_DISCOUNTS) for c in both}
    freed = listed.groupBy("u").agg(*(F.sum(rest[c]).alias(f"{c}_left") for c in both))
    own = context.join(freed, "u").select("u", *(F.col(c).alias(f"all_{c}") for c in both), *(F.when(F.col(c) > 0, F.greatest(1 - F.col(f"{c}_left") / F.col(c), F.lit(1e-9))).otherwise(1.0).alias(f"mass_{c}") for c in both))
    adds = np.zeros(1 << CONTEXT_BITS, np.float32)
    own = common.materialise(own, "toxic-contexts")
    for r in own.collect():  # as many as there are prints at most
        adds[r.u] = np.log(r.mass_toxic / r.mass_ordinary)
    at = listed.filter(F.greatest(*rest.values()) > 0).join(F.broadcast(own), "u").join(up.withColumnRenamed("up", "h"), "h")
    q = {c: F.when(F.col(f"all_{c}") > 0, rest[c] / F.col(f"all_{c}")).otherwise(0.0) + F.col(f"mass_{c}") * F.col(f"up_{c}") for c in both}
    pair = at.select(F.col("key").alias("h"), (F.log(q["toxic"]) - F.log(q["ordinary"])).cast("float").alias("ratio"))
    rows.append(pair)
    return reduce(DataFrame.unionByName, rows), sum(constant), adds


def fit_model(every: DataFrame, whole: bool) -> Model:
    """From the counts (see COUNTS), with the curve's fold or without; about BLOCK rows are fetched at a time."""
    sc = every.sparkSession.sparkContext
    both = [F.col("toxic_all" if whole else "toxic").alias("toxic"), F.col("ordinary_all" if whole else "ordinary").alias("ordinary")]
    of = lambda kind, *c: every.filter(F.col("kind") == kind).select(*c, *both)
    context = of(CONTEXT, "u").groupBy("u").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    rows, unknown, adds = ratios_table(of(WORD, "h", "p7", "p5", "u"), of(PAIR, F.col("p7").alias("key"), "h", "u"), context)
    rows = common.materialise(rows, "toxic-ratios")
    blocks, most = [], -(-rows.count() // BLOCK) or 1
    for i in range(most):
        got = rows.filter(F.pmod("h", F.lit(most)) == i).toArrow()
        h, ratio = (got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "ratio"))
        h = h.astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        seen = np.zeros(FLAGS, bool)
        seen[(h >> np.uint64(20)).astype(np.int64) & (FLAGS - 1)] = True
        blocks.append(sc.broadcast((h[order], ratio[order].astype(np.float32), seen)))
    common.forget(rows)
    return Model(blocks, unknown, adds)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a weak pull to zero; without both classes the base rate alone."""
    a = np.column_stack([np.ones(len(x)), x])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(a.shape[1])
    w[0] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.diag([1e-6] + [1e-2] * x.shape[1])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those in carry) with held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    Labels of rows whose crc32(doc_id as text) mod 4 is 2 are never used; only texts enter a score. A null text is scored
    as empty (the usual score); texts of any length are scored whole; null labels count as none; of several labels of a
    doc_id the largest counts; repeated rows count and are scored each; without labels every score is the base rate 0.5 or
    less; an empty table gives no rows. The new columns replace columns of docs with their names.
    """
    known = common.materialise(labelled(docs, labels), "toxic-labelled")
    every = common.materialise(counts(known), "toxic-counts")
    early = fit_model(every, False)

    def curve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, f in early.scored(b):
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), part.column(1)], ["total", "n", "toxic"])

    late = known.filter("fold = 3")
    held = late.count()
    if held > CURVE_ROWS:  # a share of all hashes that holds about so many texts
        late = late.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(CURVE_ROWS / held * (1 << 30)))
    seen = late.select("text", "toxic").mapInArrow(curve_rows, "total double, n double, toxic int").collect()
    total, n, y = (np.array([r[c] for r in seen], float) for c in range(3))
    usual = float((total / np.maximum(n, 1)).mean()) if len(seen) else 0.0
    means = lambda total, n: 100 * (total + USUAL * usual) / (n + USUAL)
    w = logistic(means(total, n).reshape(-1, 1), (y == 1).astype(float))
    # the curve's texts join the counts once the curve is known
    shared = fit_model(every, True)
    early.unpersist()
    common.forget(every)
    common.forget(known)
    names = [c for c in (docs.columns if carry is None else carry) if c not in ("held_out", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, f in shared.scored(b):
                p = 1 / (1 + np.exp(-np.clip(w[0] + means(f[:, 0], f[:, 1]) * w[1], -30, 30)))
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in names), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    need = list(dict.fromkeys([*names, "text"]))
    out = docs.select(*need).mapInArrow(run, schema)
    return out.withColumn("held_out", fold(F.col("doc_id")) == 2)
