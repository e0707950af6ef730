"""Queries of the training-data operators against SQL, and against each other, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.test_queries import FOLDER, duck, pytestmark, same  # noqa: F401


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p5_best"])
def test_sql(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


@pytest.mark.parametrize("name", [k for k in entry.llm.QUERIES if k not in entry.llm.ORACLES])
def test_runs(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name == "p6_ids":
        assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
