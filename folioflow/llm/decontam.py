"""Benchmark decontamination by an FM-index of each training shard.

A shard is one Arrow batch of documents. Its index holds every word that an occurrence of a test phrase could cover: the
maximal runs of benchmark words that are long enough for a phrase with those words (all other words cannot be hit, so
leaving them out loses nothing). Test phrases are searched backwards, all at once, through wavelet-matrix ranks;
occurrences are located by walking to sampled suffix positions; overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import common

#: Words of a window; an item with fewer words is one window.
WINDOW = 13
#: Text bytes of test items that are searched in one pass over the documents; more items take more passes.
BLOCK_BYTES = 32 << 20
#: Every SAMPLE-th position of the shard keeps its place in the suffix order.
SAMPLE = 16


class Phrases:
    """The distinct windows of some items as word numbers, with the items of each. Bounded by BLOCK_BYTES of text."""

    def __init__(self, items: list[tuple[object, str | None]]):
        w = common.Words([t for _, t in items], common.separators("alnum"), True)
        self.vocab, number = np.unique(w.hash, return_inverse=True)
        number = number.astype(np.int64) + 1  # 0 stands for the ends of runs
        found: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = number[w.first[k] : w.first[k + 1]].tolist()
            n = min(WINDOW, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found.setdefault(tuple(own[i : i + n]), set()).add("" if item is None else str(item))
        keys = sorted(found)
        self.items = [sorted(found[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), WINDOW), np.int64)  # right-aligned, so that all start at their last word
        for i, k in enumerate(keys):
            self.words[i, WINDOW - len(k) :] = k
        self.shortest = np.full(len(self.vocab) + 1, WINDOW + 1, np.int64)  # the shortest phrase that has the word
        for k in keys:
            for x in k:
                self.shortest[x] = min(self.shortest[x], len(k))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word in the benchmark's vocabulary, 0 for all other words."""
        out = np.zeros(len(h), np.int64)
        if not len(self.vocab):
            return out
        may = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocab, h[may])
        at[at == len(self.vocab)] = 0
        hit = self.vocab[at] == h[may]
        out[may[hit]] = at[hit] + 1
        return out

    def candidates(self, number: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Flags of words that lie in a run long enough for a phrase with them; two rounds of shrinking."""
        keep = number > 0
        for _ in range(2):
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(keep, text, -1), [-1]])) != 0)
            length = np.zeros(len(keep), np.int64)
            size = np.diff(cut)
            length[: cut[-1] if len(cut) else 0] = np.repeat(np.concatenate([cut[:1], size]), np.concatenate([cut[:1], size])) if len(cut) else 0
            keep = keep & (length >= self.shortest[number])
        return keep


class FMIndex:
    """Of symbols 1..alphabet in runs; each run ends with a 0 of its own rank."""

    def __init__(self, s: np.ndarray, alphabet: int):
        n = len(s)
        ends = s == 0
        runs = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, s + runs - 1)
        k = 1
        while True:  # prefix doubling; run ends are all different, so it stops at the longest run
            nxt = np.zeros(n, np.int64)
            nxt[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (int(rank.max()) + 2) + nxt
            sa = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            rank = np.empty(n, np.int64)
            rank[sa] = step
            if step[-1] == n - 1 or k >= n:
                break
            k *= 2
        bwt = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=alphabet + 1))])
        start = np.concatenate([[True], ends[:-1]])
        sampled = start | (np.arange(n) % SAMPLE == 0)
        self.sampled = sampled[sa]
        self.place = sa[self.sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.bwt = bwt
        self.levels = []
        x = bwt
        for b in reversed(range(max(1, int(alphabet).bit_length()))):
            bit = (x >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((b, ones, n - int(ones[-1])))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs among the first i[k] symbols of the transform."""
        a, z = np.zeros_like(i), i
        for b, ones, zeros in self.levels:
            up = ((c >> b) & 1).astype(bool)
            oa, oz = ones[a], ones[z]
            a, z = np.where(up, zeros + oa, a - oa), np.where(up, zeros + oz, z - oz)
        return z - a

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned phrases: numbers of those that occur, and their suffix ranges."""
        live = np.arange(len(words))
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(self.bwt), np.int64)
        for j in range(words.shape[1] - 1, -1, -1):
            on = length[live] >= words.shape[1] - j
            c = words[live[on], j]
            lo[on] = self.before[c] + self.rank(c, lo[on])
            hi[on] = self.before[c] + self.rank(c, hi[on])
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
        return live, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back until a sampled one; starts of runs are sampled, so none walks past an end."""
        row, out, steps = row.copy(), np.zeros(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            done = self.sampled[row[todo]]
            out[todo[done]] = self.place[self.sample_rank[row[todo[done]]]] + steps
            todo = todo[~done]
            c = self.bwt[row[todo]]
            row[todo] = self.before[c] + self.rank(c, row[todo])
            steps += 1
        return out


def search_shard(texts: pa.Array, ph: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Of each text: words, merged hit spans (flat pairs of word numbers, end exclusive), sorted item ids."""
    n = len(texts)
    counts = np.zeros(n, np.int64)
    spans: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    items: list[list[str]] = [[] for _ in range(n)]
    sep = common.separators("alnum")
    kept, kept_text, kept_at, row0 = [], [], [], 0
    for _, some in common.text_chunks(pa.RecordBatch.from_arrays([texts], ["text"])):
        w = common.Words(some, sep, True)
        per = np.diff(w.first)
        counts[row0 : row0 + len(some)] = per
        number = ph.numbers(w.hash)
        text = np.repeat(np.arange(len(some)), per)
        if number.any():
            keep = np.flatnonzero(ph.candidates(number, text))
            kept.append(number[keep])
            kept_text.append(text[keep] + row0)
            kept_at.append(keep - w.first[text[keep]])
        row0 += len(some)
    if not kept or not sum(map(len, kept)):
        return counts, spans, items
    number, text, at = map(np.concatenate, (kept, kept_text, kept_at))
    new = np.flatnonzero((np.diff(text) != 0) | (np.diff(at) != 1)) + 1
    s = np.insert(number, np.append(new, len(number)), 0)
    origin = np.insert(np.arange(len(number)), np.append(new, len(number)), -1)
    index = FMIndex(s, len(ph.vocab))
    which, lo, hi = index.search(ph.words, ph.length)
    if not len(which):
        return counts, spans, items
    many = hi - lo
    phrase = np.repeat(which, many)
    row = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = origin[index.locate(row)]
    t, a = text[first], at[first]
    z = a + ph.length[phrase]
    order = np.lexsort((a, t))
    t, a, z, phrase = t[order], a[order], z[order], phrase[order]
    for g in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t)) + 1):
        end = np.maximum.accumulate(z[g])
        cut = np.concatenate([[True], a[g][1:] > end[:-1]])
        begin = a[g][cut]
        stop = end[np.append(np.flatnonzero(cut)[1:] - 1, len(g) - 1)]
        spans[t[g[0]]] = np.stack([begin, stop], 1).ravel()
        items[t[g[0]]] = sorted({x for p in np.unique(phrase[g]) for x in ph.items[p]})
    return counts, spans, items


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The test items in blocks of BLOCK_BYTES of text; only one block is on the driver at a time."""
    block, held = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string")).toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1] or "") * 4 + 64
        if held >= BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, removal_spans (flat pairs of word numbers, end exclusive, merged) and items (ids as strings).

    Null text has no words; null or empty items have no windows; an item without id counts as one named ''; items with
    equal ids count once; an empty benchmark hits nothing; a document row that repeats is judged each time. Columns of
    docs (those in carry, if given) pass through; the three new columns replace ones with their names. Texts of any length
    are searched whole. Items are broadcast in blocks (BLOCK_BYTES at most); each shard meets all blocks in turn, one at a
    time in memory.
    """
    spark = docs.sparkSession
    new = ["n_words", "removal_spans", "items"]
    docs = docs.select([c for c in docs.columns if c not in new])
    names = [c for c in (docs.columns if carry is None else carry) if c not in new]
    blocks = []
    for block in item_blocks(benchmark):
        blocks.append(spark.sparkContext.broadcast(Phrases(block)))
        blocks[-1].__dict__.pop("_value", None)  # it lies in a file now
    several = len(blocks) > 1

    def phrases() -> Iterator[Phrases]:
        """The blocks in turn; of several only one is held."""
        if not blocks:
            yield Phrases([])
        for b in blocks:
            yield b.value
            if several:
                b.__dict__.pop("_value", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text)).cast(pa.string())
            n = spans = items = None
            for ph in phrases():
                n, more, also = search_shard(col, ph)
                spans = more if spans is None else [merge(x, y) if len(x) and len(y) else x if len(x) else y for x, y in zip(spans, more, strict=True)]
                items = also if items is None else [sorted({*x, *y}) for x, y in zip(items, also, strict=True)]
            made = [pa.array(n), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *made], [*names, *new])

    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in names), StructField("n_words", LongType()), StructField("removal_spans", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])
    need = list(dict.fromkeys([*names, text]))
    return docs.select(*need).mapInArrow(run, schema)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The union of two sets of spans."""
    pairs = sorted(map(tuple, np.concatenate([x, y]).reshape(-1, 2).tolist()))
    out: list[list[int]] = []
    for a, z in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return np.array(out, np.int64).ravel()


def judged(found: DataFrame) -> DataFrame:
    """The verdict columns of decontaminate()'s rows: n_hit, n_items, items_sha256, contaminated."""
    s = F.col("removal_spans")
    n_hit = F.aggregate(F.transform(s, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def brute_force(docs: list[tuple], benchmark: list[tuple]) -> list[tuple]:
    """The same verdicts in plain Python, for tests: (doc_id, n_words, n_hit, items, contaminated)."""
    import re

    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: pat.findall((t or "").translate(low))
    win: dict[tuple, set[str]] = {}
    for item, t in benchmark:
        w = words(t)
        n = min(WINDOW, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in win}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in win:
                    hit.update(range(i, i + n))
                    items |= win[k]
        out.append((d, len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
