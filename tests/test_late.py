from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import late

T0 = datetime(2023, 3, 2, 10)
SCHEMA = "delivery_id bigint, entity_id bigint, timestamp timestamp, modified timestamp, power decimal(12,3), period_end string"
MOMENTS = {"first": 300, "cutoff": 3 * 86400}


def minutes(n):
    return T0 + timedelta(minutes=n)


ROWS = [
    (1, 1, minutes(15), minutes(16), Decimal("2"), "x"),
    (2, 1, minutes(30), minutes(31), Decimal("4"), "x"),
    (3, 1, minutes(30), minutes(31), Decimal("4"), "x"),  # repeated
    (4, 1, minutes(60), minutes(65), Decimal("6"), "x"),  # up to and including first publication
    (5, 1, minutes(45), minutes(66), Decimal("10"), "x"),  # late
    (6, 1, minutes(15), minutes(500), Decimal("3"), "x"),  # corrected
    (7, 1, minutes(30), minutes(60 + 3 * 1440), None, "x"),  # withdrawn at the cut-off
    (8, 1, minutes(60), minutes(61 + 3 * 1440), Decimal("99"), "x"),  # too late
    (9, 1, minutes(61), minutes(62), Decimal("1"), "x"),  # next hour
    (10, None, minutes(15), minutes(16), Decimal("7"), "x"),
    (11, 2, None, minutes(16), Decimal("7"), "x"),
    (12, 2, minutes(15), None, Decimal("7"), "x"),
    (13, 3, minutes(15), minutes(14), None, "x"),  # arrives before the event, no value
    (14, 4, minutes(15), minutes(2000), Decimal("5"), "x"),
]


@pytest.fixture
def state(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return late.multisets(df, ["entity_id"], "timestamp", "modified", "delivery_id", "power", 3600, MOMENTS)


def test_totals_and_changes(state):
    found = {(r.entity_id, r.period_end): (r.total_first, r.total_cutoff) for r in late.totals(state, ["entity_id"], ["first", "cutoff"]).collect()}
    hour = int(datetime(2023, 3, 2, 11).timestamp())
    hour = 1677754800
    assert found == {(1, hour): (Decimal("12"), Decimal("19")), (1, hour + 3600): (Decimal("1"), Decimal("1")), (3, hour): (None, None), (4, hour): (None, Decimal("5"))}
    assert {(r.entity_id, r.period_end) for r in late.changed(state, ["entity_id"], "first", "cutoff").collect()} == {(1, hour), (4, hour)}


def test_statistics_are_exact(state):
    row = late.statistics(state, ["entity_id"], ["first", "cutoff"]).where("entity_id = 1").orderBy("period_end").first()
    assert (row.count_first, row.distinct_first, row.min_first, row.max_first, row.median_first) == (3, 3, 2, 6, 4)
    assert (row.count_cutoff, row.distinct_cutoff, row.min_cutoff, row.max_cutoff, row.median_cutoff) == (3, 3, 3, 10, 6)


def test_folding_batches_in_any_order_gives_the_state(spark):
    import random

    rows = [(1 + i % 3, minutes(15 * (i % 8)), minutes(i * 7 % 50), i, Decimal(i % 5)) for i in range(80)]
    schema = "entity_id bigint, event timestamp, arrival timestamp, tie bigint, value decimal(12,3)"
    whole = spark.createDataFrame(rows, schema)
    random.Random(3).shuffle(rows)
    latest, held = spark.createDataFrame([], schema), None
    for i in range(0, 80, 27):
        latest, deltas = late.fold(latest, spark.createDataFrame(rows[i : i + 27], schema), ["entity_id"], 3600)
        held = deltas if held is None else late.adjust(held, deltas, ["entity_id"], ["n"])
    direct = late.multisets(whole, ["entity_id"], "event", "arrival", "tie", "value", 3600, {"end": 10**7})
    key = lambda r: tuple(r)
    assert sorted(map(key, held.where("n > 0").select("entity_id", "period_end", "value", "n").collect())) == sorted(map(key, direct.where("n_end > 0").collect()))


def test_period_is_closed_at_its_end(spark):
    df = spark.createDataFrame([(datetime(2023, 1, 1, 10),), (datetime(2023, 1, 1, 10, 0, 0, 1),), (datetime(1969, 12, 31, 23, 30),)], "t timestamp")
    out = [r[0] for r in df.select(late.period_end(F.col("t"), 3600)).collect()]
    assert out == [1672567200, 1672570800, 0]


def test_no_rows(spark):
    state = late.multisets(spark.createDataFrame([], SCHEMA), ["entity_id"], "timestamp", "modified", "delivery_id", "power", 3600, MOMENTS)
    assert late.changed(state, ["entity_id"], "first", "cutoff").count() == 0 and late.statistics(state, ["entity_id"], ["first"]).count() == 0
