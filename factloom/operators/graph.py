"""Bounded search on the call graph: reachability, simple paths, write paths, derived sinks.

All loops are frontier joins, one written table a round; a round's cost follows its frontier. Order-dependent results of a breadth-first
queue are restated as order by (depth, edge ordinals), so they hold however rows are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import cut, hot_keys, skew_join
from .hierarchy import _undo

#: Resolutions that count as certain.
CERTAIN = "receiver-type same-class interface-implementation static-class-name field-name-type deferred-callback runnable-arg-callback".split()


def links(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, edge_ord, resolution): parallel edges collapse to the one of smallest ordinal; blank and NULL ends link nothing."""
    e = edges.where("from_id <> '' and to_id <> ''")
    return e.groupBy("from_id", "to_id").agg(F.min(F.struct("edge_ord", "resolution")).alias("e")).select("from_id", "to_id", "e.edge_ord", "e.resolution")


def reverse_reach(edges: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(id, hops): least number of calls from each node to any target, at most `depth`; targets have 0."""
    pairs = cut(edges.select("from_id", "to_id").where("from_id <> '' and to_id <> ''").distinct())
    hot = hot_keys(pairs.groupBy("to_id").count(), "to_id")
    found = cut(targets.select(F.col(targets.columns[0]).alias("id")).where("id <> ''").distinct().withColumn("hops", F.lit(0)))
    front = found
    for k in range(1, depth + 1):
        nxt = skew_join(pairs, front.select(F.col("id").alias("to_id")), "to_id", hot=hot).select(F.col("from_id").alias("id")).distinct()
        front = cut(nxt.join(found, "id", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if k % 6 == 0:
            found = cut(found)
    return found


def simple_paths(entries: DataFrame, edges: DataFrame, goals: DataFrame, depth: int, per_entry: int | None = None) -> DataFrame:
    """(entry_id, depth, path, ords, resolutions, goals): states of a breadth-first search over simple paths that end at a node with goals.

    entries(entry_id, method_id); edges from links(); goals(id, goal_ord, goal): a node's goals are few. A state is kept while the goals
    of the entry's states before it, in order of (depth, edge ordinals), number less than `per_entry` (all goals of a kept state stay, so an
    entry may exceed it, as in the reference). Two prunings lose nothing: only nodes that reach a goal in the hops left are visited; and a state goes if `per_entry` others of its entry
    are sure to reach goals of their own before any that it can reach, so the states of a round number about per_entry x fan-out however many paths there are.
    """
    near = cut(reverse_reach(edges, goals.select("id"), depth))
    at = cut(goals.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("goal_ord", "goal"))).alias("goals")))
    e = cut(edges.join(near.select(F.col("id").alias("to_id"), "hops"), "to_id"))
    hot = hot_keys(e.groupBy("from_id").count(), "from_id")
    strings = F.expr("cast(array() as array<string>)")
    # low: the least number of hops to a goal of the nodes before; a shortest way on from a node of fewer hops than that meets none of them
    state = ["entry_id", "at", "path", "ords", "resolutions", "hops", "low"]
    front = entries.join(near, entries.method_id == near.id).select("entry_id", F.col("method_id").alias("at"), F.array("method_id").alias("path"), F.expr("cast(array() as array<int>)").alias("ords"), strings.alias("resolutions"), "hops", F.lit(depth + 1).alias("low"))
    hits: list[DataFrame] = []
    most_so_far = 0  # no entry has more goals than this yet
    for k in range(depth + 1):
        front = cut(front.join(at, front["at"] == at["id"], "left").select(*state, "goals"))
        hit = front.where("goals is not null").select("entry_id", F.lit(k).alias("depth"), "path", "ords", "resolutions", "goals")
        hits.append(hit)
        size = front.groupBy("entry_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("goals").isNotNull(), F.size("goals")).otherwise(0)).alias("g")).agg(F.sum("n"), F.max("g"), F.max("n")).first()
        if not size[0] or k == depth:
            break
        most_so_far += size[1]
        if per_entry and most_so_far >= per_entry:
            # entries that have their share already are not searched any further
            full = _union(hits).groupBy("entry_id").agg(F.sum(F.size("goals")).alias("g")).where(F.col("g") >= per_entry)
            front = front.join(full, "entry_id", "left_anti")
        if per_entry and size[2] > per_entry:
            when = F.struct("hops", "ords")  # all states have one depth: when a state's first goal can come
            sure = front.where("hops <= low").withColumn("_n", F.row_number().over(Window.partitionBy("entry_id").orderBy("hops", "ords")))
            bound = sure.where(F.col("_n") == per_entry).select("entry_id", when.alias("_bound"))
            front = front.join(bound, "entry_id", "left").where(F.col("_bound").isNull() | (when <= F.col("_bound"))).drop("_bound")
        step = e.select(F.col("from_id").alias("at"), "to_id", "edge_ord", "resolution", F.col("hops").alias("next")).where(F.col("next") <= depth - k - 1)
        j = skew_join(step, front.drop("goals"), "at", hot=hot).where(~F.array_contains("path", F.col("to_id")))
        front = j.select(
            "entry_id", F.col("to_id").alias("at"), F.concat("path", F.array("to_id")).alias("path"), F.concat("ords", F.array(F.col("edge_ord").cast("int"))).alias("ords"), F.concat("resolutions", F.array("resolution")).alias("resolutions"),
            F.col("next").alias("hops"), F.least("low", "hops").alias("low"),
        )
    out = _union(hits)
    if per_entry and most_so_far >= per_entry:
        order = Window.partitionBy("entry_id").orderBy("depth", "ords", "path")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_entry)  # each state has a goal, so these suffice
        before = F.coalesce(F.sum(F.size("goals")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("_before", before).where(F.col("_before") < per_entry).drop("_n", "_before")
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def static_confidence(resolutions: Column | str) -> Column:
    """HIGH if every resolution is certain (an empty path too), MEDIUM if one is by unique name, else LOW."""
    r = F.col(resolutions) if isinstance(resolutions, str) else resolutions
    return F.when(F.forall(r, lambda x: x.isin(CERTAIN)), "HIGH").when(F.exists(r, lambda x: x.startswith("unique-method-name")), "MEDIUM").otherwise("LOW")


def candidate_paths(entries: DataFrame, edges: DataFrame, sinks: DataFrame, depth: int = 20, per_entry: int = 200) -> DataFrame:
    """G3 with sinks(id, method_id, sink_ord): (entry_id, sink_id, path, call_depth, static_confidence)."""
    goals = sinks.where("method_id <> ''").select(F.col("method_id").alias("id"), F.col("sink_ord").alias("goal_ord"), F.col("id").alias("goal"))
    p = simple_paths(entries, links(edges), goals, depth, per_entry)
    return p.select("entry_id", F.explode("goals.goal").alias("sink_id"), "path", F.col("depth").alias("call_depth"), static_confidence("resolutions").alias("static_confidence"))


def shortest_paths(entries: DataFrame, edges: DataFrame, goals: DataFrame, depth: int) -> DataFrame:
    """(entry_id, id, depth, ords, path, resolutions): from each entry(entry_id, method_id) the least path, by (depth, edge ordinals, nodes), to each node of goals(id) within `depth`.

    A round keeps one state for each (entry, node) that no round before has reached: a least path begins with the least path to each of its nodes, so nothing is
    lost and the states number at most entries x nodes, however many paths there are. Only nodes that reach a goal in the hops left are visited.
    """
    near = cut(reverse_reach(edges, goals.select("id"), depth))
    wanted = cut(goals.select("id").distinct())
    e = cut(edges.join(near.select(F.col("id").alias("to_id"), "hops"), "to_id").select(F.col("from_id").alias("at"), "to_id", "edge_ord", "resolution", "hops"))
    hot = hot_keys(e.groupBy("at").count(), "at")
    empty = lambda t: F.expr(f"cast(array() as array<{t}>)")
    front = entries.join(near, entries.method_id == near.id).select("entry_id", F.col("method_id").alias("at"), empty("int").alias("ords"), F.array("method_id").alias("path"), empty("string").alias("resolutions"))
    front = cut(front)
    rounds, seen = [front.withColumn("depth", F.lit(0))], front.select("entry_id", "at")
    for k in range(1, depth + 1):
        j = skew_join(e.where(F.col("hops") <= depth - k), front, "at", hot=hot)
        new = F.struct(F.concat("ords", F.array(F.col("edge_ord").cast("int"))).alias("ords"), F.concat("path", F.array("to_id")).alias("path"), F.concat("resolutions", F.array("resolution")).alias("resolutions"))
        step = j.groupBy("entry_id", "to_id").agg(F.min(new).alias("s")).select("entry_id", F.col("to_id").alias("at"), "s.*")
        front = cut(step.join(seen, ["entry_id", "at"], "left_anti"))
        if front.isEmpty():
            break
        rounds.append(front.withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front.select("entry_id", "at"))
    return _union(rounds).join(wanted.withColumnRenamed("id", "at"), "at", "left_semi").select("entry_id", F.col("at").alias("id"), "depth", "ords", "path", "resolutions")


def write_paths(entries: DataFrame, edges: DataFrame, accesses: DataFrame, depth: int = 12, most: int | None = 1000) -> DataFrame:
    """(entry_id, access_id, path, call_depth, correlation) of the shortest path from each entry(entry_id, entry_ord, method_id) to each
    WRITE access(access_id, access_ord, method_id). most: states of a project (the column `project` of entries, else all are one) count until so many paths were found before them, in
    order of entries, depth and ordinals (the reference's bound); None keeps all."""
    p = shortest_paths(entries, links(edges), accesses.select(F.col("method_id").alias("id")), depth)
    conf = F.when(F.exists("resolutions", lambda x: x.startswith("unique-method-name")), "MEDIUM").otherwise("HIGH")
    p = p.withColumn("correlation", conf)
    if most is not None:
        known = entries.select("entry_id", "entry_ord", F.col("project") if "project" in entries.columns else F.lit("").alias("project"))
        sizes = accesses.groupBy(F.col("method_id").alias("id")).agg(F.count("*").alias("size"))
        p = p.join(known, "entry_id").join(sizes, "id")
        order = Window.partitionBy("project").orderBy("entry_ord", "depth", "ords", "path")
        p = p.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)  # each state has an access, so these suffice
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        p = p.withColumn("_before", before).where(F.col("_before") < most)
    a = accesses.select(F.col("method_id").alias("id"), "access_id")
    return skew_join(p, a, "id").select("entry_id", "access_id", "path", F.col("depth").alias("call_depth"), "correlation")


def derived_sinks(methods: DataFrame, forwards: DataFrame, sinks: DataFrame) -> DataFrame:
    """(method_id, category, target_id) of methods without a sink that hand a parameter on to a sink method, or to a derived one that comes
    before them in method order. methods(id, method_seq); forwards(from_id, to_id, edge_ord): calls that pass a parameter on;
    sinks(method_id, category, sink_ord): the category of the last row counts. The category comes from the first such call."""
    base = cut(sinks.where("method_id <> ''").groupBy("method_id").agg(F.max_by("category", "sink_ord").alias("category")))
    seq = methods.groupBy("id").agg(F.min("method_seq").alias("seq"))
    f = forwards.groupBy("from_id", "to_id").agg(F.min("edge_ord").alias("edge_ord")).where("from_id <> '' and to_id <> ''")
    f = f.join(base.select(F.col("method_id").alias("from_id")), "from_id", "left_anti")
    f = skew_join(f.join(seq.select(F.col("id").alias("from_id"), F.col("seq").alias("from_seq")), "from_id"), seq.select(F.col("id").alias("to_id"), F.col("seq").alias("to_seq")), "to_id", "left")
    f = cut(skew_join(f, base.select(F.col("method_id").alias("to_id"), F.lit(True).alias("base")), "to_id", "left"))
    down = cut(f.where("base is null and to_seq < from_seq"))
    found = cut(f.where("base").select(F.col("from_id").alias("id")).distinct())
    front = found
    while True:
        nxt = skew_join(down, front.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
        front = cut(nxt.join(found, "id", "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    ok = f.where("base").unionByName(skew_join(down, found.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(f.columns))
    first = cut(ok.groupBy("from_id").agg(F.min(F.struct("edge_ord", "to_id")).alias("e")).select(F.col("from_id").alias("nid"), F.col("e.to_id").alias("up")))
    last = _undo(first, weight=False)
    out = skew_join(last.select("nid", F.col("up").alias("method_id")), base, "method_id").select(F.col("nid").alias("method_id"), "category")
    return out.join(first.select(F.col("nid").alias("method_id"), F.col("up").alias("target_id")), "method_id")


def forwarding(methods: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose line has a call with an argument expression that names a parameter of the caller (substring, as in the reference)."""
    named = calls.where("argument_count > 0").join(methods.select(F.col("id").alias("method_id"), "parameter_names"), "method_id")
    hit = named.where(F.exists("parameter_names", lambda p: F.col("expression").contains(p))).select(F.col("method_id").alias("from_id"), "line").distinct()
    return edges.join(hit, ["from_id", "line"], "left_semi")


def dedup_sinks(sinks: DataFrame) -> DataFrame:
    """The first row (by sink_ord) of each (method_id, category, file_path, line); NULLs are equal."""
    rest = [c for c in sinks.columns if c not in ("method_id", "category", "file_path", "line")]
    best = F.min_by(F.struct(*rest), F.struct("sink_ord", *[c for c in rest if c != "sink_ord"])).alias("r")
    return sinks.groupBy("method_id", "category", "file_path", "line").agg(best).select("method_id", "category", "file_path", "line", "r.*").select(sinks.columns)
