from datetime import UTC, datetime, timedelta

import pytest

from tidemark.operators.grid import regular_series, without_reading

T0 = datetime(2023, 3, 2, 10, tzinfo=UTC)
SCHEMA = "sample_id bigint, node string, timestamp timestamp, created timestamp, power double, state string"


def rows(*readings):
    return [(i, n, None if m is None else T0 + timedelta(seconds=m), T0, p, "x") for i, (n, m, p) in enumerate(readings)]


def series(spark, data, **options):
    df = spark.createDataFrame(data, SCHEMA)
    out = regular_series(df, "node", "timestamp", "power", ["created", "sample_id"], **options)
    return {(r.node, r.period_end - int(T0.timestamp())): r for r in out.collect()}


def test_means_are_weighted_by_time(spark):
    got = series(spark, rows(("a", 300, 10.0), ("a", 600, 20.0), ("a", 1500, 30.0)))
    assert sorted(k[1] for k in got) == [900, 1800]
    first, second = got["a", 900], got["a", 1800]
    assert first.readings == 2 and first.mean == pytest.approx(15.0) and first.coverage == pytest.approx(2 / 3)
    assert second.readings == 1 and second.mean == pytest.approx((20 * 600 + 30 * 300) / 900) and second.coverage == 1


def test_gaps_are_filled_or_marked(spark):
    got = series(spark, rows(("a", 900, 10.0), ("a", 9000, 5.0)), hold=1800)
    assert [got["a", 900 * k].state for k in range(1, 11)] == ["observed", "filled", "filled", *["missing"] * 6, "observed"]
    assert got["a", 900].mean == 10.0 and got["a", 900].coverage == 0  # it stands at the very end
    assert got["a", 2700].mean == 10.0 and got["a", 3600].mean is None


def test_spans_do_not_show(spark):
    data = rows(*(("a", 500 * k * (1 + k % 3), float(k)) for k in range(1, 60)), ("a", 86400 * 40, 1.0), ("b", 10, 3.0))
    split, whole = series(spark, data, span_days=1), series(spark, data, span_days=10_000)
    assert split == whole
    assert len([k for k in whole if k[0] == "a"]) == 86400 * 40 // 900 - 1  # the first cell has no reading


def test_nulls_repeats_and_nothing(spark):
    got = series(spark, rows(("a", 100, 1.0), ("a", 100, 2.0), (None, 100, 1.0), ("a", None, 1.0), ("a", 2000, None), ("c", 5, None)))
    assert list(got) == [("a", 900)] and got["a", 900].mean == 2.0 and got["a", 900].readings == 1
    assert series(spark, []) == {}


def test_found_cells(spark):
    df = spark.createDataFrame(rows(("a", 1, 1.0), ("a", 2701, 1.0)), SCHEMA)
    found = without_reading(regular_series(df, "node", "timestamp", "power", ["sample_id"]))
    assert sorted(r.period_end - int(T0.timestamp()) for r in found.collect()) == [1800, 2700]


def test_a_gap_of_years_goes_to_several_tasks(spark):
    from tidemark.operators import grid

    rows = [(1, "a", datetime(2000, 1, 1, 0, 10), 1.0), (2, "a", datetime(2009, 1, 1, 0, 5), 2.0), (3, "a", datetime(2009, 1, 1, 0, 20), 4.0)]
    df = spark.createDataFrame(rows, "id bigint, node string, timestamp timestamp, power double")
    out = grid.regular_series(df, "node", "timestamp", "power", ["id"])
    cells = int((datetime(2009, 1, 1, 0, 30) - datetime(2000, 1, 1, 0, 15)).total_seconds() // 900) + 1
    assert out.count() == cells and out.where("state = 'missing'").count() == cells - 3 - 4
    assert out.select("period_end").distinct().count() == cells and "hashpartitioning(__source" in out._jdf.queryExecution().executedPlan().toString()
