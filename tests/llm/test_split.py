from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import split


def whole(payload, pieces):
    out = payload[: pieces[0][1]]
    for (_, e), (_, e2) in zip(pieces, pieces[1:]):
        out += payload[e:e2]
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é名🔎", max_size=1500))
def test_round_trip_limits_and_characters(text):
    p = text.encode()
    got = split.cuts(p, 200, 30)
    assert got[0][0] == 0 and got[-1][1] == len(p) and whole(p, got) == p
    for a, b in got:
        assert b - a <= 200
        p[a:b].decode()
    for (_, e), (s, _) in zip(got, got[1:]):
        assert 0 <= e - s <= 30


def test_natural_boundaries_and_least_cost():
    text = ("word " * 20 + "\n\n") * 30
    got = split.cuts(text.encode(), 500, 50)
    assert all(text[:e].endswith("\n\n") for _, e in got)
    data = b"x" * 5000
    assert max(b - a for a, b in split.cuts(data, 500, 50)) <= 500


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aaaa b.\n,é名", min_size=30, max_size=900), st.integers(110, 260), st.integers(0, 30))
def test_the_chain_is_the_cheapest_over_all_boundaries(text, limit, overlap):
    p = text.encode()
    n = len(p)
    pos, cost, begin = split.boundaries(p, overlap)
    even = n / -(-n // (limit - overlap))
    price = lambda i, j: split.BALANCE * ((pos[j] - pos[i] - even) / limit) ** 2 + cost[j] if pos[j] - begin[i] <= limit else float("inf")
    least = [0.0]
    for j in range(1, len(pos)):
        least.append(min(least[i] + price(i, j) for i in range(j)))
    got = split.chain(pos, cost, begin, even, limit)
    at = [0, *(pos.index(e) for _, e in got)]
    assert abs(sum(price(i, j) for i, j in zip(at, at[1:])) - least[-1]) < 1e-6
    # every natural boundary is a position, and so is every character of a long run
    assert {i + 1 for i, c in enumerate(p) if c == 10} <= set(pos)


def test_positions_in_runs():
    assert len(split.boundaries(b"x" * 64, 8)[0]) == 2 and len(split.boundaries(b"x" * 65, 8)[0]) == 66


def test_frames(spark):
    big = "line of text here\n" * 1000
    items = spark.createDataFrame([(1, "c1", big, "x"), (1, "c1", big, "x"), (2, "c1", "small", "x"), (3, "c9", big, "x"), (4, "c2", None, "x"), (5, "c2", "", "x"), (6, "c2", "é" * 4096, "x"), (7, "c2", "é" * 4096 + "a", "x")], "item_id bigint, chunk_name string, payload string, bounds string")
    batches = spark.createDataFrame([(["c1", None], ["c1", "c2"]), (None, []), (["c1"], None)], "candidate_chunks array<string>, stored_chunks array<string>")
    found = {(r.item_id, r.list_name) for r in split.oversized_items(items, batches).collect()}
    assert found == {(1, "candidate"), (1, "stored"), (7, "stored")}
    rows = split.split_items(items, batches).orderBy("item_id", "piece").collect()
    assert {r.item_id for r in rows} == {1, 2, 5, 6, 7}
    text = ""
    for r in (r for r in rows if r.item_id == 1):
        assert len(r.text.encode()) <= 8192 and (r.piece == 0 or 0 < r.repeated <= 256)
        text += r.text.encode()[r.repeated :].decode()
    assert text == big
    assert split.split_items(items.limit(0), batches).count() == 0 and split.oversized_items(items, batches.limit(0)).count() == 0
