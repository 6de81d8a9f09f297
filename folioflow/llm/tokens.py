"""Exact tokenizer ids at corpus speed: every distinct chunk of non-blank text goes through the library once a worker."""

from __future__ import annotations

import os
import string

import numpy as np

from folioflow.llm import common

#: Distinct chunks that a worker remembers before it keeps only those just used (bounds its memory to some 200 MB).
CACHE = 800_000
#: Bytes of text that are encoded at a time.
CHUNK = 2 << 20
#: ASCII punctuation: after letters, a run of it is one piece of its own for the splitter.
PUNCTUATION = string.punctuation
_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Encoder:
    """One encoder a process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Empties the encoders' caches (an encoder goes on without) and hands free memory back."""
    import pyarrow as pa

    full = [e for e in _encoders.values() if len(e.known) > 1]
    for e in full:
        e.known = {"": b""}
    if full:
        pa.default_memory_pool().release_unused()


#: Under this name text_chunks keeps the caches.
KEEP = "tokens"
common.remember(KEEP, forget)


class Encoder:
    """ids(texts) equals Tokenizer.encode(text, add_special_tokens=False).ids of each text.

    The vocabulary's normaliser and splitter work on each blank-separated chunk alone (blanks are dropped, no rule
    crosses a space or line end), so the ids of a text are those of its chunks in order. Chunks that are letters with
    trailing punctuation share the ids of their letters; letter runs are encoded many at once and cut at
    word-end tokens. Whatever does not fit that pattern is encoded alone.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        pair = self.one("Ab, ") + self.one("cd")
        self.split = bool(self.ends.any()) and pair == self.one("Ab, cd") == self.one("Ab,\ncd") == self.one(" Ab,  cd ")
        self.known: dict[str, bytes] = {"": b""}

    def one(self, s: str) -> bytes:
        return np.array(self.tok.encode(s, add_special_tokens=False).ids, self.dtype).tobytes()

    def letters(self, words: list[str]) -> list[bytes]:
        """The ids of each run of letters."""
        out: list[bytes] = []
        groups = [words[a : a + 128] for a in range(0, len(words), 128)]
        many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        w = self.dtype.itemsize
        for a in range(0, len(groups), 64):
            made = many([" ".join(g) for g in groups[a : a + 64]], add_special_tokens=False)
            for some, e in zip(groups[a : a + 64], made, strict=True):
                ids = np.array(e.ids, self.dtype)
                cut = np.flatnonzero(self.ends[ids]) + 1
                if len(cut) == len(some) and cut[-1] == len(ids):
                    raw, at = ids.tobytes(), [0, *(cut * w).tolist()]
                    out += [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
                else:
                    out += [self.one(x) for x in some]
        return out

    def learn(self, new: set[str]) -> None:
        """Adds the ids of chunks that are not known; letters go through the library once, whatever punctuation follows them."""
        known = self.known
        cores: set[str] = set()
        tailed = []
        for w in new:
            core = w.rstrip(PUNCTUATION)
            if not core.isalpha():
                known[w] = self.one(w)
                continue
            if core not in known:
                cores.add(core)
            if len(core) < len(w):
                tailed.append((w, core, w[len(core) :]))
        names = list(cores)
        known.update(zip(names, self.letters(names), strict=True))
        for w, core, tail in tailed:
            if tail not in known:
                known[tail] = self.one(tail)
            known[w] = known[core] + known[tail]

    def ids(self, texts: list[str | None], last: int | None = None, cache: int | None = None) -> list[bytes]:
        """The ids of each text as little-endian bytes of self.dtype; last: an id to append to each; cache: instead of CACHE."""
        tail = b"" if last is None else np.array([last], self.dtype).tobytes()
        if not self.split:
            return [self.one(t or "") + tail for t in texts]
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        words: set[str] = set()
        for p in parts:
            words.update(p)
        if len(self.known) > (CACHE if cache is None else cache):  # what this chunk of text uses stays: the frequent words do
            self.known = {"": b""} | {w: self.known[w] for w in words if w in self.known}
        self.learn(words.difference(self.known))  # difference(), as difference_update() would walk through all that is known
        get = self.known.__getitem__
        return [b"".join(map(get, p)) + tail for p in parts]
