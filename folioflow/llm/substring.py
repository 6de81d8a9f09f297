"""Exact removal of long repeated word sequences by recompression.

Every text is parsed bottom-up: runs of one word get a name, then in each of ROUNDS rounds every name falls on a left or
right side (by a bit of its hash) and each left-right pair gets a name. Names are fingerprints of what they stand for, so
they are global without a table: equal substrings get equal interior symbols in all documents. Each symbol knows its
context, the words that fixed it; a window of words that holds a symbol's context has that symbol wherever it occurs. So
the highest symbol of a window (of several, the one with the smallest name) is a sign that all its occurrences share.
1. Signs are counted over all documents; only windows with a sign that occurs twice can repeat.
2. Those windows are fingerprinted (128 bits) and counted; the ones that start twice are removed.
Equal texts are one text with a count; none of the groups is collected in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common

#: Words of a window.
WINDOW = 35
#: Pair rounds after the run round: symbols of some three words that need some ten words of context.
ROUNDS = 4
_U = np.uint64


class Level:
    """Symbols of a chunk in order: name, first word, context [lo, hi) and document."""

    def __init__(self, name: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
        self.name, self.at, self.lo, self.hi, self.doc = name, at, lo, hi, doc


#: Context that reaches over a text's end: no window holds it.
_NEVER = 1 << 40


def neighbours(lv: Level) -> tuple[np.ndarray, np.ndarray]:
    """Of each symbol: where the context of the one before begins, and where that of the one after ends."""
    same = lv.doc[1:] == lv.doc[:-1]
    before = np.full(len(lv.lo), -_NEVER)
    before[1:][same] = lv.lo[:-1][same]
    after = np.full(len(lv.hi), _NEVER)
    after[:-1][same] = lv.hi[1:][same]
    return before, after


def name_runs(lv: Level) -> Level:
    """Runs of one name become one symbol; the names on both sides bound it."""
    n = len(lv.name)
    first = np.ones(n, bool)
    first[1:] = (lv.name[1:] != lv.name[:-1]) | (lv.doc[1:] != lv.doc[:-1])
    a = np.flatnonzero(first)
    z = np.append(a[1:], n) - 1
    before, after = neighbours(lv)
    length = (z - a + 1).astype(np.uint64)
    name = common.mix(lv.name[a] + length * _U(0x9FB21C651E98DF25))
    return Level(name, lv.at[a], np.minimum(lv.lo[a], before[a]), np.maximum(lv.hi[z], after[z]), lv.doc[a])


def name_pairs(lv: Level, k: int) -> Level:
    """Left-right pairs become one symbol; a symbol left alone depends on the one that it did not pair with."""
    right = (common.mix(lv.name + _U(k + 1)) >> _U(63)).astype(bool)
    n = len(right)
    pair = np.zeros(n, bool)
    pair[:-1] = ~right[:-1] & right[1:] & (lv.doc[1:] == lv.doc[:-1])
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    before, after = neighbours(lv)
    lo = np.where(right & ~second, np.minimum(lv.lo, before), lv.lo)
    hi = np.where(~right, np.maximum(lv.hi, after), lv.hi)  # a pair's left one ends where its right one ends
    name = lv.name.copy()
    i = np.flatnonzero(pair)
    name[i] = common.mix(lv.name[i] * _U(0xD6E8FEB86659FD93) + lv.name[i + 1])
    keep = ~second
    return Level(name[keep], lv.at[keep], lo[keep], hi[keep], lv.doc[keep])


def signs(w: common.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of a chunk: its document and first word (in the chunk), its sign, and the symbol the sign is of."""
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(doc))
    start = word[word + WINDOW <= w.first[1:][doc]]
    h = w.hash
    levels = [Level(h, word, word, word + 1, doc)]
    if len(start):
        levels.append(name_runs(levels[0]))
        for k in range(ROUNDS):
            levels.append(name_pairs(levels[-1], k))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * common.powers(common._BASE, len(h)))])
    back = common.powers(common._BASE_INV, max(len(h), 1))
    sign = np.zeros(len(start), np.uint64)
    symbol = np.zeros(len(start), np.int64)
    todo = np.arange(len(start))
    for k in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        lv = levels[k]
        ok = (lv.hi - lv.lo <= WINDOW) & (lv.lo >= 0)
        lo, hi, at, name = lv.lo[ok], lv.hi[ok], lv.at[ok], lv.name[ok]
        p = start[todo]
        i = np.searchsorted(lo, p)
        z = np.searchsorted(hi, p + WINDOW, "right")
        some = i < z
        i, z, mine = i[some], z[some], todo[some]
        if len(i):
            best, least = i.copy(), name[i]
            for s in range(1, int((z - i).max())):
                j = np.minimum(i + s, z - 1)
                less = name[j] < least
                best[less] = j[less]
                least = np.minimum(least, name[j])
            a, e = lo[best], hi[best]
            key = (total[e] - total[a]) * back[a] + (e - a).astype(np.uint64) * _U(0x9FB21C651E98DF25) + (at[best] - a).astype(np.uint64) * _U(0xA0761D6478BD642F) + _U(k)
            sign[mine] = common.mix(key)
            symbol[mine] = at[best] * 16 + k
        todo = todo[~some]
    return doc[start], start, sign, symbol


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the text's name), n_words, sha (of all words joined), signs, twice (those of two places in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in common.text_chunks(b, "text"):
                w = common.Words(texts, common.separators("space"), False)
                doc, _, sign, symbol = signs(w)
                order = np.lexsort((symbol, sign, doc))
                doc, sign, symbol = doc[order], sign[order], symbol[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) != 0) | (sign[1:] != sign[:-1]) | (np.diff(symbol) != 0)
                doc, sign = doc[new], sign[new]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) != 0) | (sign[1:] != sign[:-1])
                repeat, again = doc[~new], sign[~new]
                d1, s1 = doc[new], sign[new].view(np.int64)
                cut = np.searchsorted(d1, np.arange(len(texts) + 1))
                cut2 = np.searchsorted(repeat, np.arange(len(texts) + 1))
                sha = [hashlib.sha256(b" ".join((t or "").encode("utf-8", "surrogatepass").split())).hexdigest() for t in texts]
                cols = [*part.columns[:3], pa.array(np.diff(w.first)), pa.array(sha), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(s1)), pa.ListArray.from_arrays(pa.array(cut2, pa.int32()), pa.array(again.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k1", "k2", "n_words", "sha", "signs", "twice"])

    named = docs.select(F.col("doc_id").cast("long"), *common.text_key(F.col("text")), F.col("text").cast("string"))
    return named.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, sha string, signs array<long>, twice array<long>")


def window_prints(texts: DataFrame) -> DataFrame:
    """w1, w2, k1, k2, at: fingerprint and place of every window of texts (k1, k2, text, shared) whose sign is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, some in common.text_chunks(b, "text"):
                w = common.Words(some, common.separators("space"), False)
                doc, start, sign, _ = signs(w)
                keep = np.zeros(len(doc), bool)
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                for i, s in enumerate(part.column(3)):
                    keep[cut[i] : cut[i + 1]] = np.isin(sign[cut[i] : cut[i + 1]], s.values.to_numpy(zero_copy_only=False).view(np.uint64))
                doc, start = doc[keep], start[keep]
                p1, p2 = (common.windows(w.hash, WINDOW, seed)[start].view(np.int64) if len(start) else np.zeros(0, np.int64) for seed in (1, 2))
                k1, k2 = (part.column(c).to_numpy()[doc] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(p1), pa.array(p2), pa.array(k1), pa.array(k2), pa.array((start - w.first[doc]).astype(np.int32))], ["w1", "w2", "k1", "k2", "at"])

    return texts.select("k1", "k2", "text", "shared").mapInArrow(run, "w1 long, w2 long, k1 long, k2 long, at int")


def cut_out(texts: DataFrame) -> DataFrame:
    """k1, k2, n_removed, kept (text of the words left, one space between) of texts (k1, k2, text, ats: window starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in common.chunks(np.array([len(t or "") for t in b.column(2).to_pylist()])):
                part = b.slice(a, z - a)
                removed, kept = [], []
                for t, ats in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    hit = np.zeros(len(words) + 1, np.int32)
                    s = ats.values.to_numpy(zero_copy_only=False)
                    np.add.at(hit, s, 1)
                    np.add.at(hit, s + WINDOW, -1)
                    gone = np.cumsum(hit[:-1]) > 0
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_removed", "kept"])

    return texts.select("k1", "k2", "text", "ats").mapInArrow(run, "k1 long, k2 long, n_removed long, kept string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of docs (doc_id, text); kept is null where nothing was removed.

    A word goes when a window of WINDOW words over it starts anywhere else too, in this or another document; windows are
    judged on the input. Null texts have no words; texts under WINDOW words lose none; rows with equal texts lose all
    words if they have a window. Rows that repeat count as places of their own. Other columns are ignored.
    """
    known = common.materialise(profile(docs), "repeat-profile")
    key = ["k1", "k2"]
    texts = known.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n"), F.max("n_words").alias("n_words"))
    texts = common.materialise(texts.filter((F.col("n_words") >= WINDOW)), "repeat-texts")
    # a sign is shared when two texts have it or one text has it at two places
    rows = known.select("k1", "k2", F.explode("signs").alias("sign")).distinct()
    rows = common.materialise(rows, "repeat-signs")
    two = rows.groupBy("sign").agg(F.count("*").alias("n")).filter("n > 1").select("sign")
    inside = known.select(F.explode("twice").alias("sign"))
    shared = two.unionByName(inside).distinct()
    by_text = rows.join(shared.hint("merge"), "sign", "left_semi").groupBy(key).agg(F.collect_list("sign").alias("shared"))
    wanted = common.materialise(by_text.join(texts, key), "repeat-wanted")
    common.forget(rows)
    source = docs.select(F.col("doc_id").cast("long"), *common.text_key(F.col("text")), F.col("text").cast("string"))
    some = common.thin(source.filter(F.col("doc_id").isNotNull()), wanted.filter(F.col("doc_id").isNotNull()), "doc_id")
    found = some.join(wanted.select("doc_id", "k1", "k2", "shared"), ["doc_id", *key]).select(*key, "text", "shared")
    nameless = source.filter(F.col("doc_id").isNull()).join(wanted.filter(F.col("doc_id").isNull()).select(*key, "shared"), key)
    found = found.unionByName(nameless.select(*key, "text", "shared")).dropDuplicates(key)
    found = common.materialise(found.select(*key, "text", "shared"), "repeat-candidates")
    prints = common.materialise(window_prints(found), "repeat-windows")
    twice = prints.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2")
    hits = prints.join(twice.hint("merge"), ["w1", "w2"], "left_semi").groupBy(key).agg(F.collect_list("at").alias("ats"))
    hits = common.materialise(hits, "repeat-hits")
    common.forget(prints)
    cut = common.materialise(cut_out(found.join(hits, key)), "repeat-cut")
    # texts that occur more than once lose all words; their windows were in the count for the sake of the other texts
    whole = texts.filter("_n > 1").select(*key, "_n", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    single = cut.join(texts.filter("_n = 1").select(*key, "_n"), key)
    result = whole.unionByName(single.select(*key, "_n", "n_removed", "kept"))
    result = common.materialise(result, "repeat-result")
    out = common.skew_join(known.select("doc_id", *key, "n_words", "sha"), result, key, "_n", known.count(), "left")
    sha = F.when(F.col("n_removed").isNull(), F.col("sha")).otherwise(F.sha2("kept", 256))
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), sha.alias("kept_sha256"), "kept")
