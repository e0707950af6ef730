"""Splitting oversized payloads at natural boundaries by dynamic programming.

Boundary positions carry a penalty by kind; a chain of cuts costs its penalties plus the squared deviation of each piece from the even
size. The cheapest chain is found exactly over all boundary positions, subject to the byte limit of a piece including the overlap that it repeats. The cost of a
piece is convex in its length, so of two places to cut before, the later one stays better once it is, and each place is best for one range of
ends: a queue of those ranges makes the search linear. Payloads within the limit never leave the JVM.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut, skew_join

#: Boundary kinds: pattern (the boundary is the end of the match) and penalty, best first; then any character.
KINDS = [(rb"\n[ \t\r]*\n+", 0.0), (rb"\r?\n|\r", 0.5), (rb"[.!?;]['\")\]]?[ \t]+|\xe3\x80\x82", 1.0), (rb"[,:}\]>] ?", 2.0), (rb"[ \t]+", 2.5)]
ANYWHERE = 12.0
#: Weight of the squared deviation (in shares of the limit) from the even size.
BALANCE = 4.0
#: A run without natural boundary has boundary positions (of the penalty ANYWHERE, at every character) only if it is longer than so many bytes: shorter words stay whole.
WORD = 64


def cuts(payload: bytes, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: each at most `limit` bytes, each after the first beginning up to `overlap` bytes before the end of the one before."""
    n = len(payload)
    if n <= limit:
        return [(0, n)]
    pos, cost, begin = boundaries(payload, overlap)
    even = n / -(-n // max(1, limit - overlap))
    return chain(pos, cost, begin, even, limit)


def boundaries(payload: bytes, overlap: int) -> tuple[list[int], list[float], list[int]]:
    """All boundary positions from 0 to the end, their penalties, and where a piece that follows a cut there begins."""
    n = len(payload)
    solid = (np.frombuffer(payload, np.uint8) & 0xC0) != 0x80  # a character begins here
    penalty = np.full(n + 1, np.inf)
    for pattern, value in reversed(KINDS):
        at = np.fromiter((m.end() for m in re.finditer(pattern, payload)), np.int64)
        penalty[at] = value
    penalty[[0, n]] = 0.0
    fixed = np.flatnonzero(np.isfinite(penalty))
    for a, b in zip(fixed[:-1], fixed[1:]):
        if b - a > WORD:
            penalty[a + 1 : b][solid[a + 1 : b]] = ANYWHERE
    pos = np.flatnonzero(np.isfinite(penalty))
    # up to `overlap` bytes earlier, at a character
    nxt = np.append(np.minimum.accumulate(np.where(solid, np.arange(n), n)[::-1])[::-1], n)
    begin = np.minimum(nxt[np.maximum(pos - overlap, 0)], pos)
    begin[0] = 0
    return pos.tolist(), penalty[pos].tolist(), begin.tolist()


def chain(pos: list[int], cost: list[float], begin: list[int], even: float, limit: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of the cheapest chain from the first position to the last."""
    scale = limit * limit / BALANCE
    total, back = [0.0] * len(pos), [0] * len(pos)
    best: deque[tuple[int, float]] = deque([(0, 0.0)])  # (place to cut before, first end for which it is best)
    for j in range(1, len(pos)):
        x = pos[j]
        while len(best) > 1 and best[1][1] <= x:
            best.popleft()
        i = best[0][0]
        size = (x - pos[i] - even) / limit
        total[j], back[j] = total[i] + BALANCE * size * size + cost[j], i
        shift = total[j] * scale + (x + even) ** 2
        while best:
            k, since = best[-1]
            # from here on a cut at j is better than one at k, by cost or because the piece from k would exceed the limit
            better = min((shift - total[k] * scale - (pos[k] + even) ** 2) / (2 * (x - pos[k])), begin[k] + limit + 1)
            if better > since and better > x:
                break
            best.pop()
        best.append((j, better if best else x + 1))
    ends, j = [], len(pos) - 1
    while j:
        ends.append(j)
        j = back[j]
    ends.reverse()
    return [(begin[i], pos[j]) for i, j in zip([0, *ends[:-1]], ends)]


def piece_bounds(payload: Column, limit: int, overlap: int) -> Column:
    """array<struct<from int, to int>>: byte ranges of a payload's pieces."""
    if overlap + WORD + 8 > limit:
        raise ValueError("the limit must exceed the overlap by more than a word")

    def bounds(payloads: pd.Series) -> pd.Series:
        return pd.Series([[{"from": a, "to": b} for a, b in cuts(p.encode(), limit, overlap)] if isinstance(p, str) else None for p in payloads], dtype=object)

    bounds.__annotations__ = {"payloads": pd.Series, "return": pd.Series}
    return F.pandas_udf(bounds, "array<struct<from:int,to:int>>")(payload)


def listed(batches: DataFrame) -> DataFrame:
    """(chunk_name, list_name), distinct: which lists name a chunk. NULL and empty lists and NULL names give nothing."""
    one = lambda col, name: batches.select(F.explode(col).alias("chunk_name"), F.lit(name).alias("list_name"))
    return one("candidate_chunks", "candidate").unionByName(one("stored_chunks", "stored")).where("chunk_name is not null").distinct()


def _large(items: DataFrame, batches: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Distinct oversized items of named chunks with their bounds, computed once and written."""
    names = listed(batches).select("chunk_name").distinct()
    big = items.where(F.octet_length("payload") > limit).select("item_id", "chunk_name", "payload")
    big = skew_join(big, names, "chunk_name", "left_semi").dropDuplicates(["item_id"])
    return big.withColumn("bounds", piece_bounds(F.col("payload"), limit, overlap))


def split_items(items: DataFrame, batches: DataFrame, limit: int = 8192, overlap: int = 256) -> DataFrame:
    """(item_id, piece, pieces, byte_from, byte_to, repeated, text) of every item in a chunk that a list names.

    Pieces are ordered from 0; `repeated` is the number of bytes that a piece shares with the end of the one before; without them the
    pieces joined are the payload. NULL payloads have no piece, empty ones one empty piece. Repeated rows of an item count once.
    """
    names = listed(batches).select("chunk_name").distinct()
    small = items.where(F.octet_length("payload") <= limit).select("item_id", "chunk_name", "payload")
    small = skew_join(small, names, "chunk_name", "left_semi").dropDuplicates(["item_id"])
    whole = small.withColumn("bounds", F.array(F.struct(F.lit(0).alias("from"), F.octet_length("payload").alias("to"))))
    both = whole.select("item_id", "payload", "bounds").unionByName(_large(items, batches, limit, overlap).select("item_id", "payload", "bounds"))
    p = both.select("item_id", F.col("payload").cast("binary").alias("raw"), F.size("bounds").alias("pieces"), F.posexplode("bounds").alias("piece", "b"), F.col("bounds"))
    text = F.decode(F.substring(F.col("raw"), F.col("b.from") + 1, F.col("b.to") - F.col("b.from")), "UTF-8")
    before = F.when(F.col("piece") > 0, F.expr("bounds[piece - 1].to") - F.col("b.from")).otherwise(F.lit(0))
    return p.select("item_id", "piece", "pieces", F.col("b.from").alias("byte_from"), F.col("b.to").alias("byte_to"), before.alias("repeated"), text.alias("text"))


def oversized_items(items: DataFrame, batches: DataFrame, limit: int = 8192, overlap: int = 256) -> DataFrame:
    """(item_id, list_name) of the items that had to be cut, once for each list that names their chunk."""
    large = cut(_large(items, batches, limit, overlap).where(F.size("bounds") > 1).select("item_id", "chunk_name"))
    return skew_join(large, listed(batches), "chunk_name").select("item_id", "list_name").distinct()
