import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import topn


@pytest.mark.parametrize("wide", [False, True])
def test_equals_sorting(spark, wide):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.randrange(3), r.randrange(4), i * (10**14 if wide else 1) - 5, "x", 0) for i in range(400)]
    d = spark.createDataFrame(rows, "grp string, s int, depth int, pid bigint, code string, lo int")  # code and lo clash with inner names
    got = topn.top_n(d.drop("code", "lo"), ["grp"], [(F.col("s"), "desc"), (F.col("depth").cast("bigint") * (10**11 if wide else 1), "asc")], "pid", 3)
    want = set()
    for g in {x[0] for x in rows}:
        want |= {x[3] for x in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2], x[3]))[:3]}
    assert {x.pid for x in got.collect()} == want


def test_paths_rules(spark):
    t = F.lit("2024-01-01").cast("timestamp")
    p = [
        (1, "e", "s1", " high", 5, 1), (2, "e", "s1", "MEDIUM", 0, 1), (3, "e", "s1", None, 0, 1), (4, "e", "s1", "odd", None, 1), (5, "e", "s1", "", -3, 1), (6, "e", "s1", "Low ", 0, 1), (7, None, "s1", "HIGH", 0, 1), (8, "e", "lost", "HIGH", 0, 1), (9, "e", "blank", "HIGH", 0, 1), (10, " ", "s1", "HIGH", 0, 1),
        (1, "e", "s1", "LOW", 9, 0), (2, "e", "s1", "MEDIUM", 0, 1),
    ]
    paths = spark.createDataFrame(p, "path_id bigint, entry_id string, sink_id string, static_confidence string, call_depth int, day int").withColumn("recorded_at", F.date_add(t, F.col("day")).cast("timestamp")).drop("day")
    sinks = spark.createDataFrame([("s1", " sql "), ("s1", "SQL"), ("blank", " "), ("none", None)], "id string, category string")
    got = topn.best_paths(paths, sinks)
    assert {r.path_id for r in got.collect()} == {1, 2, 3}
    assert topn.best_paths(paths.limit(0), sinks).count() == 0
