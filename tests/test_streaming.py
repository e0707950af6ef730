import json

from pyspark.sql import functions as F

from factloom.streaming import events as ev

LOG = [
    ("s", 1, "started", "t1", "alpha", None, None, None), ("s", 2, "started", "t2", None, None, None, None), ("s", 3, "noise", None, None, None, None, None), ("s", 4, "completed", "t1", None, "completed", "a\nb", None),
    ("s", 5, "completed", "t9", None, "odd", "x" * 2048, None), ("s", 6, "result", None, None, None, None, "one"), ("s", 7, "result", None, None, None, None, "two"), ("q", 1, "result", None, None, None, None, " "), ("z", 1, "error", None, None, None, None, None), ("z", 2, "result", None, None, None, None, "late"),
]
WANT = [(1, "alpha", None, 0, None), (2, "t2", None, 0, None), (4, "alpha", "done", 1, 2), (5, "t9", "failed", 2, 3)]


def write(folder, rows):
    names = ["session_id", "seq", "type", "task_id", "agent", "status", "summary", "result"]
    folder.mkdir(exist_ok=True)
    (folder / f"p{len(list(folder.iterdir()))}.json").write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows))


def test_results_levels_and_batch_progress(spark, tmp_path):
    write(tmp_path / "log", LOG)
    e = ev.read_events(spark, str(tmp_path / "log"), streaming=False)
    assert {(r.session_id, r.state, r.result) for r in ev.last_results(e).collect()} == {("s", "OK", "two"), ("q", "ERROR", " "), ("z", "ERROR", "late")}
    p = ev.progress_batch(e).orderBy("seq").collect()
    assert [(r.seq, r.agent, r.status, r.completed, r.total) for r in p] == WANT
    assert (p[2].result_size, p[2].preview, p[3].result_size) == ("3 B", "a | b", "2.0 KB") and len(p[3].preview) == 201
    d = spark.createDataFrame([("x [ERROR] y",), ("[WARN] z",), ("fine ERROR",), ("ERROR z",), ("[FATAL]",), ("WARNING",), ("error x FAILED Exception",), ("\rERROR",), (None,)], "l string")
    assert [r[0] for r in d.select(ev.log_level(ev.log_line("l"))).collect()] == ["ERROR", "WARN", "INFO", "ERROR", "ERROR", "WARN", "INFO", "ERROR", "INFO"]
    assert d.select(ev.log_line(F.lit("a\r\nb"))).first()[0] == "a | b"


def test_streamed_progress(spark, tmp_path):
    import pytest

    write(tmp_path / "in", LOG[:4])
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(2):  # the second run goes on from the state of the first
            q = ev.progress(ev.read_events(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            if q.exception():
                pytest.fail(str(q.exception())[:500])
            write(tmp_path / "in", LOG[4:])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.seq, r.agent, r.status, r.completed, r.total) for r in got] == [(a, b, c, d, e) for a, b, c, d, e in WANT]


def test_log_broadcast_and_tail(spark, tmp_path):
    src = tmp_path / "logs"
    src.mkdir()
    (src / "a.json").write_text("".join(json.dumps({"job_id": "j", "seq": i, "line": f"line {i}"}) + "\n" for i in range(10)))
    s = spark.readStream.schema("job_id string, seq bigint, line string").json(str(src))
    ev.broadcast_logs(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.seq for r in ev.tail_logs(spark, str(tmp_path / "out"), 3).collect()] == [7, 8, 9]
    done = spark.createDataFrame([("j",), ("empty",)], "job_id string")
    assert [(r.job_id, r.seq, r.line) for r in ev.tail_logs(spark, str(tmp_path / "out"), 2, done).collect()] == [("empty", 0, ev.DONE), ("j", 8, "line 8"), ("j", 9, "line 9"), ("j", 10, ev.DONE)]
    # a subscriber replays what is there and then gets only what comes after
    history = ev.tail_logs(spark, str(tmp_path / "out"), 3)
    rows = history.collect()
    history = spark.createDataFrame(rows, history.schema)
    (src / "b.json").write_text("".join(json.dumps({"job_id": "j", "seq": i, "line": f"two\nlines {i}"}) + "\n" for i in range(10, 13)))
    ev.broadcast_logs(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    q = ev.follow_logs(spark, str(tmp_path / "out"), history).writeStream.format("parquet").option("path", str(tmp_path / "live")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.seq, r.line) for r in spark.read.parquet(str(tmp_path / "live")).collect()) == [(i, f"two\\nlines {i}") for i in range(10, 13)]
