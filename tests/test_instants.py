from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.zones import transitions
from tidemark.operators.instants import parse_times, reader, same_instant_pairs, with_instant

AMS, DENVER, LORD_HOWE = "Europe/Amsterdam", "America/Denver", "Australia/Lord_Howe"


def one(text, zone=AMS, order="dmy"):
    out = parse_times(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), pd.Series([order], dtype=object))[0].as_py()
    return None if out is None else datetime.fromtimestamp(out // 1_000_000, UTC).replace(microsecond=int(out % 1_000_000)).replace(tzinfo=None).isoformat(" ")


@pytest.mark.parametrize(
    ("text", "zone", "order", "expected"),
    [
        ("2021-02-08T09:15:10Z", AMS, "dmy", "2021-02-08 09:15:10"),
        ("  '2021-02-08t09:15:10z' ", AMS, "dmy", "2021-02-08 09:15:10"),
        ("2021-07-08 09:15", AMS, "dmy", "2021-07-08 07:15:00"),
        ("2021-02-08T09:15:10.1234569+05:45", AMS, "dmy", "2021-02-08 03:30:10.123456"),
        ("2021-02-08T09:15:10,5-0330", AMS, "dmy", "2021-02-08 12:45:10.500000"),
        ("20210804.0815+0300", AMS, "dmy", "2021-08-04 05:15:00"),
        ("20210202T030010Z", AMS, "dmy", "2021-02-02 03:00:10"),
        ("2021-073T06:30:00Z", AMS, "dmy", "2021-03-14 06:30:00"),
        ("Tue, 09 Feb 2021 01:45:58 +0545", AMS, "dmy", "2021-02-08 20:00:58"),
        ("29-Sep-2024 02:10:00", AMS, "dmy", "2024-09-29 00:10:00"),
        ("2/3/2021 12:30:00 AM", AMS, "dmy", "2021-03-01 23:30:00"),
        ("2/3/2021 12:30:00 PM", DENVER, "mdy", "2021-02-03 19:30:00"),
        ("1613841300", AMS, "dmy", "2021-02-20 17:15:00"),
        ("1613841300123", AMS, "dmy", "2021-02-20 17:15:00.123000"),
        ("1613841300123456789", AMS, "dmy", "2021-02-20 17:15:00.123456"),
        ("1613841300.25", AMS, "dmy", "2021-02-20 17:15:00.250000"),
        ("2021-11-07 01:30:00 MST", DENVER, "mdy", "2021-11-07 08:30:00"),
        ("2021-11-07 01:30:00 MDT", DENVER, "mdy", "2021-11-07 07:30:00"),
        ("2021-11-07 01:30:00 UTC", DENVER, "mdy", "2021-11-07 01:30:00"),
        ("2021-06-01T12:00:00[Asia/Tokyo]", AMS, "dmy", "2021-06-01 03:00:00"),
        ("2021-06-01 12:00:00 asia/tokyo", AMS, "dmy", "2021-06-01 03:00:00"),
        ("2021-10-31T02:30:00+01:00[Europe/Amsterdam]", AMS, "dmy", "2021-10-31 01:30:00"),
        ("2021-06-01 12:00:00", None, None, None),
        ("2021-06-01T12:00:00Z", None, None, "2021-06-01 12:00:00"),
        ("01/02/2021 10:00:00 +01:00", AMS, None, None),
        ("2021-10-31 02:30:00", AMS, "dmy", None),  # shown twice
        ("2021-03-28 02:30:00", AMS, "dmy", None),  # never shown
        ("2021-10-31 02:30:00 Europe/Amsterdam", DENVER, "dmy", None),
        ("2021-04-04 01:45:00", LORD_HOWE, "dmy", None),  # half an hour comes twice
        ("2021-02-30T10:00:00Z", AMS, "dmy", None),
        ("2021-02-08T24:00:00Z", AMS, "dmy", None),
        ("2021-02-08T10:61:00Z", AMS, "dmy", None),
        ("13:00 PM", AMS, "dmy", None),
        ("2021-02-08 13:00:00 PM", AMS, "dmy", None),
        ("2021-02-08", AMS, "dmy", None),
        ("2021-02-08 10:00:00 XYZ", AMS, "dmy", None),
        ("2021-366T06:30:00Z", AMS, "dmy", None),
        ("99999", AMS, "dmy", None),
        ("٢٠٢١-02-08T10:00:00Z", AMS, "dmy", None),
        ("", AMS, "dmy", None),
        (None, AMS, "dmy", None),
        ("x" * 100_000, AMS, "dmy", None),
    ],
)
def test_notations(text, zone, order, expected):
    assert one(text, zone, order) == expected


def test_shapes_are_parsed_once():
    reader.cache_clear()
    texts = pd.Series(["2021-02-08T09:15:10Z"] * 500 + ["2021-02-08T09:15:1Z"] * 500)
    out = parse_times(texts, pd.Series([AMS] * 1000), pd.Series(["dmy"] * 1000))
    assert reader.cache_info().misses == 2
    assert len(out) - out.null_count == 500


@pytest.mark.parametrize("zone", [AMS, DENVER, LORD_HOWE, "America/New_York", "Africa/Casablanca", "Pacific/Apia", "Asia/Kolkata"])
def test_any_year_agrees_with_the_zone_database(zone):
    """Whatever the year: every clock time that the zone shows once, and only these."""
    import random
    from zoneinfo import ZoneInfo

    r, info = random.Random(zone), ZoneInfo(zone)
    times = [datetime(r.randint(1850, 2100) if k % 3 else r.randint(1900, 9998), r.randint(1, 12), r.randint(1, 28), r.randint(0, 23), r.choice((0, 15, 30))) for k in range(1500)]
    times += [datetime(y, m, d, 2, 30) for y in (1955, 2041, 2150, 2499, 2500, 4321) for m in (3, 4, 9, 10, 11) for d in range(1, 29)]

    def expected(t):
        seen = {t.replace(tzinfo=info, fold=f).astimezone(UTC) for f in (0, 1)}
        shown = {x for x in seen if x.astimezone(info).replace(tzinfo=None) == t}
        return int((shown.pop() - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) if len(shown) == 1 else None

    clock = np.array([int((t - datetime(1970, 1, 1)).total_seconds()) for t in times], np.int64)
    out, settled = transitions(zone).instants(clock)
    assert [int(o) if s else None for o, s in zip(out, settled)] == [expected(t) for t in times]


def test_years_of_bare_numbers():
    texts = pd.Series(["1613841300", "186400000", "413841300"])
    other = pd.Series([None] * 3, dtype=object)
    assert parse_times(texts, other, other).to_pylist() == [1613841300000000, None, None]
    assert parse_times(texts, other, other, (1972, 2000)).to_pylist() == [None, 186400000 * 10**6, 413841300 * 10**6]


def test_another_zone_database_fails(spark):
    from tidemark.operators import instants

    df = spark.createDataFrame([("2021-02-08T09:15:10Z", None, None)], "t string, z string, o string")
    with pytest.raises(Exception, match="zone database"):
        df.select(instants._parser(instants.BARE_YEARS, "1999z")("t", "z", "o")).collect()
    assert instants.zone_version() == transitions(AMS).version


def test_tables_carry_their_version():
    table = transitions("europe/amsterdam")
    assert table.zone == AMS and table.version
    assert set(table.name) >= {"CET", "CEST"}
    assert transitions("No/Where") is None


def test_pairs(spark):
    sites = spark.createDataFrame([("a", AMS, "dmy"), ("b", DENVER, "mdy")], "name string, tz_name string, date_order string")
    rows = [(1, "a-1", "2021-07-08 09:15:00"), (2, "a-1", "2021-07-08T07:15:00Z"), (3, "a-1", "2021-07-08T07:15:00Z"), (4, "b-1", "2021-07-08T07:15:00Z"), (5, None, "2021-07-08T07:15:00Z"), (6, None, "2021-07-08T07:15:00Z"), (7, "a-1", None), (8, "zz-1", "2021-07-08T07:15:00Z"), (9, "zz-1", "2021-07-08 07:15:00")]
    df = spark.createDataFrame(rows, "row_id bigint, node string, timestamp string").withColumn("name", F.lit("x"))
    timed = with_instant(df, sites)
    assert timed.columns == ["row_id", "node", "timestamp", "name", "instant_us"] and timed.count() == 9
    pairs = same_instant_pairs(timed, "row_id", "node", "instant_us")
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (2, 3)]
    assert same_instant_pairs(timed.limit(0), "row_id", "node", "instant_us").count() == 0
