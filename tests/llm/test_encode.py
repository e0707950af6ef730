import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import encode, pack

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    with open(encode.default_vocabulary(), "rb") as f:
        ranks = encode.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=encode.WORDS, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    with open(encode.default_vocabulary(), "rb") as f:
        return encode.model(f.read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abcdefg hij'stre.ABC012", max_size=200))
def test_equals_exact_merging(text):
    import tiktoken

    with open(encode.default_vocabulary(), "rb") as f:
        m = encode.model(f.read())
    want = tiktoken.Encoding("own", pat_str=encode.WORDS, mergeable_ranks=m.ranks, special_tokens={}).encode_ordinary(text)
    assert next(iter(m.encode([text]))).tolist() == want
    for w in encode._splitter().findall(text):
        assert m.merge(w.encode()) == m.words[w]


def test_long_word_memory_and_special_strings(bpe, exact, monkeypatch):
    texts = ["qx" * 30_000, "<|endoftext|> x", "日本語" * 500, "", " \n\n  \t"]
    assert [x.tolist() for x in bpe.encode(texts)] == [exact.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(encode, "MEMORY", 3)
    assert [x.tolist() for x in bpe.encode(["a b c d e f", "g a"])] == [exact.encode_ordinary(t) for t in ["a b c d e f", "g a"]]


def test_column(spark, exact):
    d = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world")], "doc_id bigint, text string")
    rows = [(r.doc_id, r.ids) for r in d.select("doc_id", encode.token_ids(spark, "text").alias("ids")).orderBy("doc_id").collect()]
    ids = exact.encode_ordinary("Hello world")
    assert rows == [(1, ids), (1, ids), (2, []), (3, [])]
    n = d.select(encode.token_counts(spark, F.lit("ask me\nthe answer is here")).alias("n")).first().n
    assert n.tokens > n.loss > 0


def test_packing(spark):
    rows = [(i, "word " * (1 + i % 90) + "\nanswer " * (i % 7)) for i in range(600)] + [(1000, "big " * 5000), (1001, None), (1002, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pack.pack(d, capacity=256, max_segments=12, max_loss=200).collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append(r)
    assert all(sum(x.tokens for x in v) <= 256 and len(v) <= 12 and sum(x.loss for x in v) <= 200 for v in by.values())
    assert {r.doc_id for r in got} == {r[0] for r in rows} - {1001, 1002}
    n = d.select("doc_id", encode.token_counts(spark, "text").alias("n")).select("doc_id", "n.*").collect()
    for x in n:
        mine = sorted((r.first_token, r.tokens) for r in got if r.doc_id == x.doc_id)
        assert sum(t for _, t in mine) == x.tokens and (len(mine) <= 1 or x.tokens > 200)
    assert len(by) <= 1.15 * max(sum(r.tokens for r in got) / 256, len(got) / 12)
    assert {r.doc_id for r in pack.oversized(d, capacity=256).collect()} == {x.doc_id for x in n if x.tokens > 256}
    assert pack.pack(d.limit(0)).count() == 0


def test_every_limit_of_a_container_binds(spark):
    """Texts of one line bear loss as a whole, many are short, and some alone exceed the limit of loss: each of the three limits is reached by some container, and no text within the capacity is split."""
    rows = [(i, "one line " * (20 + i % 60)) for i in range(200)] + [(1000 + i, "x\ny") for i in range(200)] + [(2000 + i, "question " * 150 + "\nyes\n") for i in range(40)] + [(3000, "loss " * 240)]
    got = pack.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=256, max_segments=12, max_loss=200).collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append(r)
    assert len(got) == len(rows)
    total = [(sum(x.tokens for x in v), len(v), sum(min(x.loss, 200) for x in v)) for v in by.values()]
    assert all(t <= 256 and n <= 12 and m <= 200 for t, n, m in total)
    assert any(t >= 254 for t, _, _ in total) and any(n == 12 for _, n, _ in total) and any(m == 200 for _, _, m in total)
