"""Near copies of token-shingle sets: MinHash banding with exact verification.

Equal sets are one class. Classes are hashed into BANDS x ROWS bands; the classes of a bucket meet in a join of the bucket with itself, so no member is
removed before it has met all others. A pair is first told apart by sizes and by one bit of each MinHash value (128 bits); what is left is made distinct, and
only then are the two sets fetched and compared exactly. There is one pass and no round: the work is that of the pairs of unlike classes that share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import cut, drop_cut, hot_keys, skew_join

BANDS, ROWS = 20, 6
#: Pairs of a bucket above which it counts as hot and is spread over salts.
HOT_PAIRS = 2_000_000
_rng = np.random.RandomState(20240101)
_A = _rng.randint(1, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_B = _rng.randint(0, 2**63 - 1, BANDS * ROWS, dtype=np.int64).astype(np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a set of 64-bit shingle hashes."""
    s = shingles.astype(np.uint64)
    out = np.full(len(_A), 2**32 - 1, np.uint64)
    for k in range(0, len(s), 2048):
        h = s[k : k + 2048, None] * _A[None, :] + _B[None, :]
        np.minimum(out, (h >> np.uint64(32)).min(0), out)
    return out.astype(np.uint32)


def _mix(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row of signature values."""
    h = np.full(rows.shape[0], 1469598103934665603, np.uint64)
    for col in rows.T:
        h = (h ^ col.astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return h


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = np.arange(BANDS, dtype=np.uint32)[:, None]
    for pdf in batches:
        if not len(pdf):
            continue
        sigs = np.array([signature(np.asarray(s, dtype=np.int64)) for s in pdf["sh"]])
        bands = np.concatenate([np.broadcast_to(number, (len(sigs), BANDS, 1)), sigs.reshape(-1, BANDS, ROWS)], axis=2)
        keys = _mix(bands.reshape(-1, ROWS + 1)).view(np.int64)
        bits = np.zeros((len(sigs), 128), np.uint8)
        bits[:, : sigs.shape[1]] = sigs & 1
        packed = np.packbits(bits, axis=1).view(np.int64)
        sizes = np.array([len(s) for s in pdf["sh"]], np.int32)
        again = lambda x: np.repeat(x, BANDS)
        yield pd.DataFrame({"cid": again(pdf["cid"].to_numpy()), "bucket": keys, "m": again(sizes), "b0": again(packed[:, 0]), "b1": again(packed[:, 1])})


def _alike(x: Column | str, y: Column | str, m: Column, n: Column, least: float) -> Column:
    return F.size(F.array_intersect(x, y)) >= F.ceil(least / (1 + least) * (m + n) - 1e-9)


def pairs(classes: DataFrame, least: float = 0.8) -> DataFrame:
    """classes(cid, sh array<bigint>), one row for each distinct non-empty set -> (cid, leader): all pairs of classes that share a bucket and have a Jaccard
    similarity >= `least`, each once, its smaller class as cid."""
    kind = classes.schema["cid"].dataType.simpleString()
    rows = cut(classes.mapInPandas(_bands, f"cid {kind}, bucket bigint, m int, b0 bigint, b1 bigint"))
    shared = cut(rows.groupBy("bucket").count().where("count > 1"))
    rows = skew_join(rows, shared.select("bucket"), "bucket", "left_semi", hot=hot_keys(shared, "bucket"))
    others = rows.select("bucket", F.col("cid").alias("leader"), F.col("m").alias("n"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))
    hot = hot_keys(shared.select("bucket", F.expr(f"count * (count - 1) div 2 * 10000 div {HOT_PAIRS}").alias("count")), "bucket")
    # one bit of each signature value, and the sizes, tell most unlike pairs apart: five standard deviations above what a pair of similarity `least` shows
    n = BANDS * ROWS
    most_unlike = math.ceil(n * (1 - least) / 2 + 5 * math.sqrt(n * (1 - least) / 2 * (1 + least) / 2))
    unlike = F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1")))
    sizes = F.least("m", "n") >= least * F.greatest("m", "n")
    met = skew_join(rows, others, "bucket", hot=hot).where((F.col("cid") < F.col("leader")) & sizes & (unlike <= most_unlike))
    met = met.select("cid", "leader", "m", "n").distinct()
    met = met.join(classes.select("cid", F.col("sh").alias("x")), "cid").join(classes.select(F.col("cid").alias("leader"), F.col("sh").alias("y")), "leader")
    out = cut(met.where(_alike("x", "y", F.col("m"), F.col("n"), least)).select("cid", "leader"))
    drop_cut(rows)
    return out


def links(sets: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """sets(id, sh array<bigint>) -> members(id, cid) and pairs() of the classes.

    NULL and empty sets belong to no class. Rows with an equal set have one class and need no link.
    """
    own = sets.where(F.size("sh") > 0).select("id", F.array_sort(F.array_distinct("sh")).alias("sh"))
    own = cut(own.withColumn("cid", F.struct(F.xxhash64("sh").alias("a"), F.hash("sh").alias("b"))))
    classes = cut(own.groupBy("cid").agg(F.first("sh").alias("sh")))
    return own.select("id", "cid"), pairs(classes, least)


def stars(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, cid): every class with its near copies and with itself; as many rows as classes and twice the pairs."""
    both = found.unionByName(found.select(F.col("leader").alias("cid"), F.col("cid").alias("leader")))
    return both.unionByName(classes.select("cid", F.col("cid").alias("leader"))).select("leader", "cid")
