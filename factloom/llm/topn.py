"""The N best rows of every group by simultaneous bisection.

Every row gets one order-preserving number from its score and its identifier (higher is better, no two rows of a group are
equal). All groups then narrow an interval of that number at once: a round counts, for each open group, the rows above each
of FAN - 1 midpoints and keeps the part in which the N-th best row lies. A group closes as soon as a midpoint leaves exactly
N rows above it. Rows are never sorted and no group is gathered: what is counted are rows per (group, part), combined
before the shuffle, so a group of any size costs as much as the same rows in small groups. A round reads only the rows that the one before left in an
open interval, so after the first round hardly any are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, drop_cut, hot_keys, skew_join

#: The type of codes that do not fit a bigint.
WIDE = "decimal(30,0)"
#: Parts into which a round divides the interval of a group (8 bits a round).
FAN = 256


def cutoffs(rows: DataFrame, n: int) -> DataFrame:
    """rows(g, code), code unique in a group -> (g, cutoff): exactly min(n, size of g) rows have code >= cutoff."""
    kind = rows.schema["code"].dataType
    state = cut(rows.groupBy("g").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.count("*").alias("count")))
    hot = hot_keys(state, "g")
    closed = state.where(F.col("count") <= n).select("g", F.col("lo").alias("cutoff"))
    state = state.where(F.col("count") > n).select("g", "lo", "hi", F.lit(n).cast("long").alias("need"))
    whole = kind.typeName() == "long"
    step = F.expr(f"(hi - lo) div {FAN} + 1" if whole else f"cast(ceil((hi - lo + 1) / {FAN}) as {WIDE})")
    inner = False
    while not state.isEmpty():
        state = cut(state.withColumn("step", step))
        live = cut(skew_join(rows.select("g", "code"), state, "g", hot=hot).where("code between lo and hi"))
        drop_cut(rows) if inner else None
        rows, inner = live, True
        if whole:
            live = live.withColumn("part", F.expr("cast((code - lo) div step as int)"))
        else:  # a decimal quotient may round up to the next part
            live = live.withColumn("q", F.expr("cast(floor((code - lo) / step) as int)")).withColumn("part", F.expr("if(lo + q * step > code, q - 1, q)"))
        counts = live.groupBy("g", "lo", "hi", "need", "step", "part").agg(F.count("*").alias("k"))
        # at most FAN rows a group
        above = F.sum("k").over(Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0))
        at = counts.withColumn("above", above).where("above >= need and above - k < need")
        low = (F.col("lo") + F.col("part").cast(kind) * F.col("step")).cast(kind)
        nxt = cut(at.select("g", low.alias("lo"), F.least(F.col("hi"), (low + F.col("step") - 1).cast(kind)).alias("hi"), (F.col("need") - (F.col("above") - F.col("k"))).alias("need"), ((F.col("above") == F.col("need")) | (F.col("step") == 1)).alias("exact")))
        closed = closed.unionByName(nxt.where("exact").select("g", F.col("lo").alias("cutoff")))
        state = nxt.where("not exact").drop("exact")
    return cut(closed)


def top_n(df: DataFrame, group: list[str], score: list[tuple[Column, str]], ident: str, n: int) -> DataFrame:
    """The n best rows of every group: by the score columns in turn ("asc" or "desc", whole numbers, not NULL), then the smaller `ident`.

    `ident` is a bigint, unique in its group; rows repeated with one `ident` must be removed before. Rows with a NULL in a group column
    form groups of their own, as in groupBy. An empty frame gives an empty frame. All columns of df are kept.
    """
    names = [f"_s{i}" for i in range(len(score))] + ["_id"]
    keyed = df.withColumns({f"_s{i}": c.cast("long") for i, (c, _) in enumerate(score)} | {"_id": F.col(ident).cast("long")})
    ways = [w for _, w in score] + ["asc"]
    ends = keyed.agg(*[f(x).alias(f"{x}{k}") for x in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends[f"{names[0]}lo"] is None:
        return df.limit(0)
    span = [ends[f"{x}hi"] - ends[f"{x}lo"] + 1 for x in names]
    whole = 1
    for x in span:
        whole *= x
    kind = "long" if whole < 2**62 else WIDE
    if whole >= 10**29:
        raise ValueError("scores and identifiers together span more than 29 digits")
    code = F.lit(0).cast(kind)
    for x, way, width in zip(names, ways, span):
        digit = F.col(x) - F.lit(ends[f"{x}lo"]) if way == "desc" else F.lit(ends[f"{x}hi"]) - F.col(x)
        code = (code * F.lit(width).cast(kind) + digit.cast(kind)).cast(kind)
    rows = cut(keyed.withColumn("code", code).withColumn("g", F.struct(*group)).drop(*names))
    best = cutoffs(rows, n)
    sizes = rows.groupBy("g").count()
    return skew_join(rows, best, "g", hot=hot_keys(sizes, "g")).where("code >= cutoff").select(*df.columns)


def latest_paths(paths: DataFrame) -> DataFrame:
    """One row for each path_id: the one with the latest recorded_at (equal ones agree in the columns kept)."""
    best = F.max(F.struct("recorded_at", "entry_id", "sink_id", "static_confidence", "call_depth")).alias("r")
    return paths.where("path_id is not null").groupBy("path_id").agg(best).select("path_id", "r.*")


def best_paths(paths: DataFrame, sinks: DataFrame, n: int = 3) -> DataFrame:
    """(path_id, entry_id, category, static_confidence, call_depth) of the n best paths of every entry and sink category."""
    norm = lambda c: F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    kinds = sinks.select(F.col("id").alias("sink_id"), norm("category").alias("category")).where("category <> ''").groupBy("sink_id").agg(F.max("category").alias("category"))
    p = latest_paths(paths).where(norm("entry_id") != "")
    p = skew_join(p, kinds, "sink_id").select("path_id", "entry_id", "category", "static_confidence", "call_depth")
    conf, depth = norm("static_confidence"), F.col("call_depth")
    rank = F.when(conf == "HIGH", 2).when(conf == "MEDIUM", 1).otherwise(0)
    return top_n(p, ["entry_id", "category"], [(rank, "desc"), (F.when(depth >= 0, depth.cast("long")).otherwise(F.lit(2**31)), "asc")], "path_id", n)
