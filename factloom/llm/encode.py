"""Byte-level BPE encoding of whole corpora by speculation and verification.

A word's tokens are proposed by greedy longest match. A proposal is the exact encoding if and only if every adjacent pair of its
tokens is compatible: encoding the two tokens' bytes together gives the same two tokens. Compatibility is tested for all new
pairs of a batch at once with numpy (both tokens are taken apart along the boundary in reverse merge order, looking for a merge
across the boundary that would have come first). Only words with an incompatible pair are merged exactly.

The vocabulary (a fixed file of about 1 MB, named by a parameter) is broadcast; texts stay where they are: no shuffle.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits a text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a Python worker remembers; the memory is emptied when full.
MEMORY = 400_000
SLICE = 1_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """A rank file and what verification needs of it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        for piece, rank in ranks.items():
            if len(piece) > 1:
                halves = self.merge(piece, below=rank)
                if len(halves) == 2:
                    self.left[rank], self.right[rank] = halves
        made = np.flatnonzero(self.left != np.arange(size))
        key = self.left[made].astype(np.int64) << 32 | self.right[made]
        order = np.argsort(key)
        self.pair_keys, self.pair_ids = key[order], made[order]
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: always the lowest-ranked adjacent pair, the leftmost of equal ones."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None and (below is None or r < below)]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(word[i : end[stop]])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0:
                r = ranks.get(word[h:stop])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ranks = [], 0, len(word), self.ranks
        while i < n:
            j = min(n, i + self.longest)
            while (r := ranks.get(word[i:j])) is None:
                j -= 1
            out.append(r)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each i: does encoding the bytes of a[i] and b[i] together keep the boundary between them?"""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit[live])
            result[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # undo the later of the two last merges; a single byte cannot be undone
            solid_x, solid_y = self.right[x] == x, self.left[y] == y
            undo_x = ~solid_x & (solid_y | (x > y))
            undo_y = ~solid_y & ~undo_x
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, 0))
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_y, self.left[y], y)
            live = live[undo_x | undo_y]
        return result

    def learn(self, words: set[str]) -> None:
        made = {w: self.greedy(w.encode()) for w in words}
        new = list({p for ids in made.values() for p in zip(ids, ids[1:])} - self.pairs.keys())
        if new:
            ab = np.array(new)
            self.pairs.update(zip(new, self.compatible(ab[:, 0], ab[:, 1]).tolist()))
        ok = self.pairs
        for w, ids in made.items():
            self.words[w] = ids if all(ok[p] for p in zip(ids, ids[1:])) else self.merge(w.encode())

    def _slices(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """The words of SLICE texts at a time, proposed and verified together, so that self.words has the ids of each."""
        split = _splitter().findall
        for k in range(0, len(texts), SLICE):
            parts = [split(t) for t in texts[k : k + SLICE]]
            needed = set().union(*parts)
            fresh = needed - self.words.keys()
            if len(self.words) + len(fresh) > MEMORY:
                self.words.clear()
                self.pairs.clear()
                fresh = needed
            self.learn(fresh)
            yield parts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text."""
        for parts in self._slices(texts):
            known = self.words
            for p in parts:
                yield np.fromiter(chain.from_iterable(map(known.__getitem__, p)), np.int32)

    def lengths(self, texts: list[str]) -> Iterator[int]:
        """The number of tokens of each text."""
        for parts in self._slices(texts):
            known = self.words
            for p in parts:
                yield sum(map(len, map(known.__getitem__, p)))


@functools.lru_cache(1)
def _splitter():
    import regex

    return regex.compile(WORDS)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


#: One vocabulary object for each Python worker.
_models: dict[int, Bpe] = {}


def model(raw: bytes) -> Bpe:
    key = hash(raw)
    if key not in _models:
        _models[key] = Bpe(read_ranks(raw))
    return _models[key]


def token_ids(spark: SparkSession, text: Column | str, vocabulary: str | None = None) -> Column:
    """array<int> of a text's token ids, without special tokens (their strings are ordinary text); [] for NULL and empty texts."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = model(raw.value)
        for texts in batches:
            yield pd.Series(list(bpe.encode([t if isinstance(t, str) else "" for t in texts])), dtype=object)

    ids.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(ids, "array<int>")(text)


def token_counts(spark: SparkSession, text: Column | str, vocabulary: str | None = None) -> Column:
    """struct<tokens int, loss int>: the tokens of a text, and those of them that bear loss in instruction data: the tokens after the
    first line break (the answer); a text of one line bears loss as a whole. NULL and empty texts have none."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = model(raw.value)
        for texts in batches:
            rows = [t if isinstance(t, str) else "" for t in texts]
            whole = np.fromiter(bpe.lengths(rows), np.int32, len(rows))
            asked = np.fromiter(bpe.lengths([t.partition("\n")[0] if "\n" in t.strip("\n") else "" for t in rows]), np.int32, len(rows))
            yield pd.DataFrame({"tokens": whole, "loss": np.maximum(whole - asked, 0)})

    counts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(counts, "tokens int, loss int")(text)
