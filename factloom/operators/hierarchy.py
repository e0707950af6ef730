"""Parent-child rows to full hierarchies by tree contraction.

Forward, each round rakes all leaves and compresses unary chains (an independent set of chain nodes, chosen by a coin, is
spliced out), so the number of live nodes falls by a constant share and O(log n) rounds suffice for wide and deep trees alike.
What a round removes is recorded as a link to the node it hung on. Whatever still lives at the end is a root or a self-loop: the
core of a circle, on which contraction never ends. Backward, the recorded links are undone pairwise (a link to a removed
node is replaced by that node's link), which reverses 2^k rounds in k joins.

A round is one aggregation of messages on node numbers (no join), so a parent with millions of children is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import cut, skew_join, trimmed


def parent_links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(child, parent), one row for each child; rows with a blank or NULL end link nothing, a child with several parents keeps
    the smallest (byte order)."""
    e = edges.select(trimmed(child).alias("child"), trimmed(parent).alias("parent"))
    return e.where("child <> '' and parent <> ''").groupBy("child").agg(F.min("parent").alias("parent"))


def other_parents(edges: DataFrame, parent: str = "from_id", child: str = "to_id") -> DataFrame:
    """(child, parent), distinct: the links that parent_links() leaves out because the child has a smaller parent. Empty where every child has one."""
    e = edges.select(trimmed(child).alias("child"), trimmed(parent).alias("parent")).where("child <> '' and parent <> ''").distinct()
    several = e.groupBy("child").agg(F.min("parent").alias("kept"), F.count("*").alias("n")).where("n > 1").select("child", "kept")
    return skew_join(e, several, "child").where("parent <> kept").select("child", "parent")


def _numbered(links: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """names(nid, id) and numbered links (nid, up): long numbers instead of long strings travel in the rounds."""
    ids = links.select(F.col("child").alias("id")).unionByName(links.select(F.col("parent").alias("id")))
    if nodes is not None:
        ids = ids.unionByName(nodes.select(trimmed(nodes.columns[0]).alias("id")).where("id <> ''"))
    names = cut(ids.distinct().withColumn("nid", F.monotonically_increasing_id()))
    up = links.join(names.select(F.col("id").alias("child"), "nid"), "child")
    up = skew_join(up, names.select(F.col("id").alias("parent"), F.col("nid").alias("up")), "parent")
    return names, names.select("nid").join(up.select("nid", "up"), "nid", "left")


def _coin(c, k: int):
    return F.xxhash64(c, F.lit(k)) % 2 == 0


def contract(links: DataFrame, with_paths: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """records(nid, up, seg, kid, round) of removed nodes and cores(nid, cyclic) of what stays.

    links: (nid, up), up NULL for roots. seg holds the nodes between nid and up that were spliced out before (with_paths), else
    their number is kept in w. kid is the only child of a node that compression removed, NULL for raked ones.

    A live node sends its own row to itself and its number to its parent; a node that is spliced out hands its link to its only child and that child's number to
    its parent. Messages to nodes that are gone fall away. A child that is raked while its parent is spliced out is counted once more, which delays a round and changes nothing.
    """
    extra = ["seg"] if with_paths else []
    state = links.select("nid", "up", F.lit(1).cast("long").alias("w"), *([F.expr("cast(array() as array<bigint>)").alias("seg")] if with_paths else []), F.lit(None).cast("long").alias("kid"), F.lit(0).alias("gone"), F.lit(False).alias("done"))
    null = F.lit(None).cast("long")
    records, cores, k = [], [], 0
    while True:
        def message(key, own=False, new=False, kid=null):
            parts = [key.alias("key"), F.lit(True if own else None).cast("boolean").alias("own"), (F.col("up") if own else null).alias("up"), (F.col("w") if own else null).alias("w")]
            parts += [(F.col("up") if new else null).alias("to"), (F.col("w") if new else null).alias("more"), kid.alias("kid")]
            if with_paths:
                none = F.lit(None).cast("array<bigint>")
                parts += [(F.col("seg") if own else none).alias("seg"), (F.concat("seg", F.array("nid")) if new else none).alias("pre")]
            return F.struct(*parts)

        node, up, kid = F.col("nid"), F.col("up"), F.col("kid")
        stays = F.array(message(node, own=True), message(F.coalesce(up, node), kid=F.when(up.isNotNull(), node)))
        spliced = F.array(message(kid, new=True), message(up, kid=kid))
        mail = state.where("gone <> 1 and not done").select(F.inline(F.when(F.col("gone") == 0, stays).otherwise(spliced)))
        st = mail.groupBy("key").agg(*[F.max(c).alias(c) for c in ("own", "up", "w", "to", "more")], F.count("kid").alias("kids"), F.max("kid").alias("kid"), *([F.max("seg").alias("seg"), F.max("pre").alias("pre")] if with_paths else []))
        cols = [F.col("key").alias("nid"), F.coalesce("to", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), "kids", "kid"]
        if with_paths:
            cols.append(F.when(F.col("pre").isNull(), F.col("seg")).otherwise(F.concat("pre", "seg")).alias("seg"))
        st = st.where("own").select(*cols)
        rake = (F.col("kids") == 0) & F.col("up").isNotNull()
        chain = (F.col("kids") == 1) & F.col("up").isNotNull() & (F.col("up") != F.col("nid")) & _coin(F.col("nid"), k) & ~_coin(F.col("up"), k)
        done = F.col("up").isNull() & (F.col("kids") == 0) | F.coalesce(F.col("up") == F.col("nid"), F.lit(False)) & (F.col("kids") == 1)
        st = st.select("nid", "up", "w", *extra, "kid", F.when(rake, F.lit(1)).when(chain, F.lit(2)).otherwise(F.lit(0)).alias("gone"), done.alias("done"))
        state = cut(st)
        records.append(state.where("gone > 0").select("nid", "up", "w", *extra, F.when(F.col("gone") == 2, F.col("kid")).alias("kid")))
        cores.append(state.where("done").select("nid", F.col("up").isNotNull().alias("cyclic")))
        k += 1
        if state.where("gone = 0 and not done").isEmpty():
            break
    union = lambda dfs: dfs[0] if len(dfs) == 1 else union([a.unionByName(b) for a, b in zip(dfs[::2], dfs[1::2])] + ([dfs[-1]] if len(dfs) % 2 else []))
    return cut(union(records)), cut(union(cores)), k


def _undo(links: DataFrame, weight: bool = True, with_paths: bool = False) -> DataFrame:
    """links (nid, up, w, seg) -> the same with `up` the last node of each chain of links."""
    extra = ["seg"] if with_paths else []
    cur = links.select("nid", "up", *(["w"] if weight else []), *extra, F.lit(False).alias("last"))
    while True:
        step = cur.select(F.col("nid").alias("up"), F.col("up").alias("up2"), *([F.col("w").alias("w2")] if weight else []), *([F.col("seg").alias("seg2")] if with_paths else []), F.col("last").alias("last2"))
        open_ = cur.where(~F.col("last"))
        j = skew_join(open_, step, "up", "left")
        cols = ["nid", F.coalesce("up2", "up").alias("up")]
        if weight:
            cols.append((F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"))
        if with_paths:
            cols.append(F.when(F.col("up2").isNull(), F.col("seg")).otherwise(F.concat("seg2", F.array("up"), "seg")).alias("seg"))
        new = cut(cur.where("last").unionByName(j.select(*cols, (F.col("up2").isNull() | F.col("last2")).alias("last"))))
        cur = new
        if cur.where(~F.col("last")).isEmpty():
            return cur.drop("last")


def cycles(edges: DataFrame, parent: str = "from_id", child: str = "to_id") -> DataFrame:
    """(id, cycle_id): nodes whose chain of parents never ends; cycle_id is the smallest id on the circle they reach.

    Empty input, NULL and blank ends give no rows; a node that is its own parent is a circle of one; repeated rows count once.
    """
    names, links = _numbered(parent_links(edges, parent, child), None)
    records, cores, _ = contract(links)
    return _cycle_rows(names, records, cores)


def _cycle_rows(names: DataFrame, records: DataFrame, cores: DataFrame) -> DataFrame:
    circle = cores.where("cyclic").select(F.col("nid").alias("up"))
    reached = skew_join(_undo(records).select("nid", "up"), circle, "up")
    reached = cut(reached.unionByName(circle.select(F.col("up").alias("nid"), "up")))
    # a spliced node lies on a circle if the child it was spliced out for does: its chain of such children ends at the core
    spliced = records.where("kid is not null").select("nid", F.col("kid").alias("up"))
    on = _undo(spliced, weight=False).join(circle, "up", "left_semi").select("nid").unionByName(circle.select(F.col("up").alias("nid")))
    named = reached.join(names, "nid")
    first = named.join(on, "nid", "left_semi").groupBy("up").agg(F.min("id").alias("cycle_id"))
    return skew_join(named.select("id", "up"), first, "up").select("id", "cycle_id")


def hierarchy(edges: DataFrame, parent: str = "from_id", child: str = "to_id", nodes: DataFrame | None = None) -> DataFrame:
    """(id, root, depth, path, cyclic): path lists the ids from the root to the node itself.

    nodes: optional frame whose first column lists ids that may have no link (they come out as roots of depth 0). Nodes on or
    below a circle have cyclic = true and NULL root, depth and path.
    """
    names, links = _numbered(parent_links(edges, parent, child), nodes)
    records, cores, _ = contract(links, with_paths=True)
    far = _undo(records, with_paths=True)
    top = cores.select(F.col("nid").alias("up"), "cyclic")
    tree = skew_join(far, top, "up").select("nid", "up", "w", F.concat(F.array("up"), "seg", F.array("nid")).alias("nids"), "cyclic")
    tree = cut(tree.unionByName(cores.select("nid", F.col("nid").alias("up"), F.lit(0).cast("long").alias("w"), F.array("nid").alias("nids"), "cyclic")))
    steps = tree.where(~F.col("cyclic")).select("nid", F.posexplode("nids").alias("pos", "anc"))
    steps = skew_join(steps, names.select(F.col("nid").alias("anc"), F.col("id").alias("name")), "anc")
    paths = steps.groupBy("nid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("path"))
    out = tree.select("nid", "w", "cyclic").join(names, "nid").join(paths, "nid", "left")
    return out.select("id", F.try_element_at("path", F.lit(1)).alias("root"), F.when(~F.col("cyclic"), F.col("w").cast("int")).alias("depth"), "path", "cyclic")


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance) for every proper ancestor of every node of hierarchy()."""
    up = tree.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "id"))
    return up.where("pos < depth").select("id", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
