import random

import pytest

from factloom.operators import hierarchy as h

EDGES = "from_id string, to_id string, from_id2 string, nid bigint, up string"


def brute(links):
    parent = {}
    for p, c in links:
        p, c = (p or "").strip(), (c or "").strip()
        if p and c:
            parent[c] = min(parent.get(c, p), p)
    tree, cyc = {}, {}
    for x in set(parent) | set(parent.values()):
        path, seen = [x], {x}
        while path[-1] in parent:
            y = parent[path[-1]]
            if y in seen:
                ring = path[path.index(y) :]
                cyc[x] = min(ring)
                break
            path.append(y)
            seen.add(y)
        else:
            tree[x] = path[::-1]
    return tree, cyc


def frame(spark, links):
    return spark.createDataFrame([(a, b, "x", 1, "y") for a, b in links], EDGES)  # extra columns with clashing names


def check(spark, links):
    tree, cyc = brute(links)
    got = {r.id: r.cycle_id for r in h.cycles(frame(spark, links)).collect()}
    assert got == cyc
    rows = h.hierarchy(frame(spark, links)).collect()
    assert len(rows) == len(tree) + len(cyc)
    for r in rows:
        if r.cyclic:
            assert r.id in cyc and r.path is None and r.root is None and r.depth is None
        else:
            assert list(r.path) == tree[r.id] and r.root == tree[r.id][0] and r.depth == len(tree[r.id]) - 1


@pytest.mark.parametrize("seed", range(2))
def test_random_forests_with_circles(spark, seed):
    r = random.Random(seed)
    n = 40
    links = [(f"m{r.randrange(n)}", f"m{i}") for i in range(n) if r.random() < 0.85]
    check(spark, links + links[:5])


def test_deep_chain_wide_root_and_self_loop(spark):
    links = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"w{i}") for i in range(40)] + [("s", "s"), ("s", "below")]
    check(spark, links)


def test_blank_and_null_ends_and_outer_space(spark):
    check(spark, [(None, "a"), ("a", None), ("", "b"), (" a\t", "b"), ("a", " b "), ("  ", "  ")])


def test_empty(spark):
    assert h.cycles(frame(spark, [])).count() == 0
    assert h.hierarchy(frame(spark, [])).count() == 0


def test_nodes_without_links_and_descendants(spark):
    nodes = spark.createDataFrame([("lone",), ("b",), (None,), (" ",)], "id string")
    t = h.hierarchy(frame(spark, [("a", "b"), ("b", "c")]), nodes=nodes)
    rows = {r.id: r for r in t.collect()}
    assert set(rows) == {"a", "b", "c", "lone"} and rows["lone"].depth == 0
    d = {(r.id, r.descendant, r.distance) for r in h.descendants(t).collect()}
    assert d == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_links_that_are_left_out_are_told(spark):
    d = frame(spark, [("b", "x"), ("a", "x"), ("a ", "x"), ("c", "x"), ("a", "y"), (None, "y"), ("a", "y")])
    assert {(r.child, r.parent) for r in h.other_parents(d).collect()} == {("x", "b"), ("x", "c")}
    assert h.other_parents(d.limit(0)).count() == 0
