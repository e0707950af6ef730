import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as g
from factloom.operators.resolve import closure


def random_graph(seed, n=6, m=12):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", i, r.choice(["same-class", "unique-method-name-untyped", "functional-method-reference"])) for i in range(m)]
    sinks = [(f"s{i}", f"n{r.randrange(n)}", i, r.choice("AB")) for i in range(4)]
    return n, edges, sinks


def queue_search(edges, goals, start, depth, cap):
    """The breadth-first queue that the set-oriented form must equal."""
    out, queue, seen = [], [((start,), ())], set()
    while queue:
        if cap and len(out) >= cap:
            break
        path, ords = queue.pop(0)
        for s, m, _, _ in goals:
            if m == path[-1] and (s, path) not in seen:
                seen.add((s, path))
                out.append((s, path))
        if len(path) - 1 < depth:
            for a, b, o, _ in sorted(edges, key=lambda e: e[2]):
                if a == path[-1] and b not in path and (path + (b,)) not in {q[0] for q in queue}:
                    queue.append((path + (b,), ords + (o,)))
    return out


@pytest.mark.parametrize("seed,cap", [(1, 200), (2, 3), (3, 2), (7, 1), (8, 2)])
def test_candidate_paths_equal_the_queue(spark, seed, cap):
    n, edges, sinks = random_graph(seed)
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_ord int, resolution string")
    s = spark.createDataFrame(sinks, "id string, method_id string, sink_ord int, category string")
    starts = spark.createDataFrame([(f"e{i}", f"n{i}") for i in range(n)], "entry_id string, method_id string")
    got = {(r.entry_id, r.sink_id, tuple(r.path)) for r in g.candidate_paths(starts, e, s, depth=4, per_entry=cap).collect()}
    want = {(f"e{i}", k, p) for i in range(n) for k, p in queue_search(edges, sinks, f"n{i}", 4, cap)}
    assert got == want


def test_candidate_paths_where_paths_explode(spark):
    """10 layers of 6 nodes, all joined to the next, and goals only at the end: 6 ** 10 simple paths, of which the first 7 in order are wanted."""
    layers, width = 10, 6
    edges = [(f"l{k}n{i}", f"l{k + 1}n{j}", j, "same-class") for k in range(layers) for i in range(width) for j in range(width)]
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_ord int, resolution string")
    s = spark.createDataFrame([("s", f"l{layers}n{i}", i, "A") for i in range(width)], "id string, method_id string, sink_ord int, category string")
    got = [tuple(r.path) for r in g.candidate_paths(spark.createDataFrame([("e", "l0n2")], "entry_id string, method_id string"), e, s, depth=12, per_entry=7).collect()]
    first = lambda a, b: ("l0n2", *(f"l{k}n0" for k in range(1, layers - 1)), f"l{layers - 1}n{a}", f"l{layers}n{b}")
    assert sorted(got) == sorted([first(0, b) for b in range(6)] + [first(1, 0)])


def test_reverse_reach_bounds_and_blanks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", ""), (None, "d"), ("d", "b")], "from_id string, to_id string")
    t = spark.createDataFrame([("d",), ("",), (None,)], "id string")
    assert {(r.id, r.hops) for r in g.reverse_reach(e, t, 2).collect()} == {("d", 0), ("c", 1), ("b", 2)}


def one_pass(methods, forwards, sinks):
    cat = {m: c for m, c, _ in sorted(sinks, key=lambda x: x[2])}
    base = set(cat)
    out = {}
    for m, _ in sorted(methods, key=lambda x: x[1]):
        if m in base:
            continue
        for _, t, _ in sorted((f for f in forwards if f[0] == m), key=lambda f: f[2]):
            if t in cat:
                out[m] = cat[m] = cat[t]
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_derived_sinks_equal_the_ordered_pass(spark, seed):
    r = random.Random(seed)
    n = 8
    methods = [(f"n{i}", i) for i in range(n)]
    forwards = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}", i) for i in range(14)]
    sinks = [(f"n{r.randrange(n)}", r.choice("AB"), i) for i in range(2)]
    got = g.derived_sinks(spark.createDataFrame(methods, "id string, method_seq int"), spark.createDataFrame(forwards, "from_id string, to_id string, edge_ord int"), spark.createDataFrame(sinks, "method_id string, category string, sink_ord int"))
    assert {x.method_id: x.category for x in got.collect()} == one_pass(methods, forwards, sinks)


def test_confidence_and_dedup(spark):
    d = spark.createDataFrame([([],), (["same-class"],), (["same-class", "unique-method-name-untyped"],), (["functional-method-reference"],)], "r array<string>")
    assert [x[0] for x in d.select(g.static_confidence("r")).collect()] == ["HIGH", "HIGH", "MEDIUM", "LOW"]
    s = spark.createDataFrame([(2, "b", None, "m", "f", 1), (1, "a", None, "m", "f", 1), (3, "c", "K", "m", "f", 1)], "sink_ord int, id string, category string, method_id string, file_path string, line int")
    assert {x.id for x in g.dedup_sinks(s).collect()} == {"a", "c"}


def test_closure_of_circles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "parent string, child string")
    assert {(r.parent, r.child) for r in closure(p).collect()} == {(x, y) for x in "abc" for y in "abc"}


def test_write_paths_shortest_and_global_bound(spark):
    e = spark.createDataFrame([("a", "b", 0, "same-class"), ("a", "c", 1, "unique-method-name-untyped"), ("b", "c", 0, "same-class")], "from_id string, to_id string, edge_ord int, resolution string")
    en = spark.createDataFrame([("e1", 1, "a"), ("e2", 2, "b")], "entry_id string, entry_ord int, method_id string")
    ac = spark.createDataFrame([("w", 0, "c")], "access_id string, access_ord int, method_id string")
    got = [(r.entry_id, tuple(r.path), r.correlation) for r in g.write_paths(en, e, ac).orderBy("entry_id").collect()]
    assert got == [("e1", ("a", "c"), "MEDIUM"), ("e2", ("b", "c"), "HIGH")]
    assert g.write_paths(en, e, ac, most=1).select(F.collect_list("entry_id")).first()[0] == ["e1"]


def test_write_paths_on_a_layered_graph(spark):
    """12 layers of 12 nodes, all joined to the next: 12 ** 12 simple paths, 12 x 12 states."""
    layers, width = 12, 12
    edges = [(f"l{k}n{i}", f"l{k + 1}n{j}", j, "same-class") for k in range(layers) for i in range(width) for j in range(width)]
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_ord int, resolution string")
    en = spark.createDataFrame([("e", 1, "l0n3")], "entry_id string, entry_ord int, method_id string")
    ac = spark.createDataFrame([("w", 0, f"l{layers}n5"), ("v", 1, "l2n7"), ("far", 2, "nowhere")], "access_id string, access_ord int, method_id string")
    got = {r.access_id: tuple(r.path) for r in g.write_paths(en, e, ac, most=None).collect()}
    assert got == {"w": ("l0n3", *(f"l{k}n0" for k in range(1, layers)), f"l{layers}n5"), "v": ("l0n3", "l1n0", "l2n7")}


@pytest.mark.parametrize("seed", [5, 6])
def test_write_paths_equal_the_least_simple_path(spark, seed):
    n, edges, _ = random_graph(seed, 7, 16)
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_ord int, resolution string")
    en = spark.createDataFrame([(f"e{i}", i, f"n{i}") for i in range(n)], "entry_id string, entry_ord int, method_id string")
    ac = spark.createDataFrame([("w", 0, "n2"), ("v", 1, "n5")], "access_id string, access_ord int, method_id string")
    first = {}
    for a, b, o, _ in edges:
        first[a, b] = min(o, first.get((a, b), o))

    def least(start, goal):
        best, todo = None, [((), (start,))]
        while todo:
            ords, path = todo.pop()
            if path[-1] == goal:
                best = min(best or (99,), (len(ords), ords, path))
            elif len(ords) < 4:
                todo += [((*ords, o), (*path, b)) for (a, b), o in first.items() if a == path[-1] and b not in path]
        return best and best[2]

    got = {(r.entry_id, r.access_id): tuple(r.path) for r in g.write_paths(en, e, ac, depth=4, most=None).collect()}
    assert got == {(f"e{i}", a): p for i in range(n) for a, m in (("w", "n2"), ("v", "n5")) if (p := least(f"n{i}", m))}
