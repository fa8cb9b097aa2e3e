"""Plans are what they should be: scans read what is needed, nothing is crossed, hot keys combine before a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.errors import DataTypeMismatch, NoSuchTrendStore, translated
from tidemark.functions import tools
from tidemark.plans import general, measurements


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(text):
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


QUIET = sorted(n for n in {**general.QUERIES, **measurements.QUERIES} if n not in ("live_monitor_once", "csv_roundtrip"))


@pytest.mark.parametrize("name", QUIET)
def test_nothing_is_crossed(spark, data, name):
    text = plan(entry.queries()[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, data):
    for columns in read(plan(general.p4_found(spark, data))):
        assert set(columns) <= {"sample_id", "node", "timestamp", "created", "power_kwh"}
    for columns in read(plan(general.p2_found(spark, data))):
        assert set(columns) <= {"delivery_id", "entity_id", "timestamp", "modified", "power_kwh"}
    chunk = plan(measurements.time_agg_single_chunk(spark, data))
    assert "GreaterThan(ts" in chunk and "LessThanOrEqual(ts" in chunk and read(chunk) == [["ts", "user_id", "value"]]


def test_aggregates_combine_before_they_are_shuffled(spark, data):
    text = plan(general.p2_found(spark, data))
    assert text.count("partial_max") >= 1 and text.count("partial_sum") >= 2 and "Window" not in text


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "period_end"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_tools(spark):
    sql = "WITH a AS (SELECT * FROM x.y) SELECT * FROM a JOIN b ON a.k = b.k WHERE b.z IN (SELECT z FROM `c-d`)"
    assert {t.strip("`") for t in tools.tables_of(spark, sql)} == {"c-d", "b", "x.y"}
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert df.where(tools.equals(a=1, b=None)).count() == 1 and df.where(tools.all_of([])).count() == 2
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert tools.retried(flaky, (OSError,), wait=0) == "done"
    with pytest.raises(KeyError):
        tools.retried(lambda: {}["x"], (KeyError,), attempts=2, wait=0)
    for run, kind in ((lambda: spark.sql("SELECT * FROM nowhere"), NoSuchTrendStore), (lambda: df.select(F.col("b").cast("int")).collect(), DataTypeMismatch)):
        with pytest.raises(Exception) as caught:
            run()
        assert isinstance(translated(caught.value), kind)
    assert isinstance(translated(ValueError("x")), ValueError)
