from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError
from tidemark.functions import datatypes as dt
from tidemark.functions import names, tables
from tidemark.functions.granularity import Granularity, bucket_end, duration_text, parse, partition_index, partition_size, stamps

AMS = ZoneInfo("Europe/Amsterdam")


@pytest.mark.parametrize(("text", "shown"), [(900, "00:15:00"), (3600, "01:00:00"), (86400, "1 day"), ("15m", "00:15:00"), ("1 day, 0:00:00", "1 day"), ("7 days", "7 days"), ("2 weeks", "14 days"), ("3 months", "3 months"), ("1month", "1 month"), ("00:30:00", "00:30:00"), (timedelta(hours=1), "01:00:00")])
def test_granularity_texts(text, shown):
    assert str(parse(text)) == shown


@pytest.mark.parametrize("text", ["900", "x", "15 parsecs", ""])
def test_no_granularity(text):
    with pytest.raises(ValueError):
        parse(text)


def test_granularity_arithmetic():
    month = parse("1month")
    assert month.range(datetime(2012, 12, 1, tzinfo=AMS), datetime(2013, 3, 1, tzinfo=AMS)) == [datetime(2013, m, 1, tzinfo=AMS) for m in (1, 2, 3)]
    day = parse("1d")
    assert day.add(day.add(datetime(2012, 10, 29, tzinfo=AMS), -1), -1) == datetime(2012, 10, 27, tzinfo=AMS)
    assert day.add(datetime(2012, 10, 28, tzinfo=AMS)).utcoffset() == timedelta(hours=1)
    assert parse("15m").add(datetime(2013, 1, 1, 13)) == datetime(2013, 1, 1, 13, 15)
    assert parse("1h").floor(datetime(2012, 10, 18, 2, 42)) == datetime(2012, 10, 18, 2)
    assert parse("1w").floor(datetime(2012, 10, 28, 23, 59, 59)) == datetime(2012, 10, 22)
    assert month.add(datetime(2013, 1, 31)) == datetime(2013, 2, 28)
    assert parse("1d") < parse("1w") < parse("1month")
    assert partition_size("30m") == Granularity(2 * 86400) and partition_size("1w").months == 12
    assert duration_text(timedelta(minutes=75)) == "1 hour 15 minutes" and duration_text(timedelta(0)) == "0 seconds"


@pytest.mark.parametrize(
    ("granularity", "at", "end"),
    [("1h", "2024-01-01 10:00:00", "2024-01-01 10:00:00"), ("1h", "2024-01-01 10:00:00.000001", "2024-01-01 11:00:00"), ("1d", "2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("1w", "2024-01-01 00:00:01", "2024-01-08 00:00:00"), ("1month", "2024-02-01 00:00:00", "2024-02-01 00:00:00"), ("3month", "2024-02-01 00:00:00", "2024-04-01 00:00:00"), ("3month", "2024-01-01 00:00:00", "2024-01-01 00:00:00"), ("15m", None, None)],
)
def test_bucket_end(spark, granularity, at, end):
    out = spark.range(1).select(bucket_end(F.lit(at).cast("timestamp"), granularity).cast("string")).first()[0]
    assert out == end


def test_stamps_and_partitions(spark):
    a, b = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(F.size(stamps(a, b, "15m")), F.size(stamps(b, a, "15m")), partition_index(F.lit("1970-01-02 00:00:00").cast("timestamp"), "1d"), partition_index(F.lit("1970-05-02 00:00:00").cast("timestamp"), "3month")).first()
    assert tuple(row) == (4, 0, 1, 1)


@pytest.mark.parametrize(("texts", "kind"), [(["405", "41033", "880"], "integer"), (["0.0", "22.3"], "real"), (["enabled"], "text"), (["", None], "smallint"), ([], "smallint"), (["100"], "smallint"), (["0"], "integer"), (["100000"], "integer"), (["10,89au"], "text"), (["30.0"], "real"), (["9999999999"], "bigint"), (["0,1,2"], "text"), (["2020-01-01T00:00:00"], "timestamp")])
def test_inference(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert dt.infer(df, ["x"]).first()[0] == kind


def value(spark, text, form, strict=True):
    return spark.createDataFrame([(text,)], "x string").select(dt.parse(F.col("x"), form, strict)).first()[0]


def test_parsing(spark):
    f = dt.Format
    assert value(spark, "42", f("smallint")) == 42 and value(spark, "", f("integer")) is None and value(spark, "\\N", f("real")) is None
    assert value(spark, "1,2,3", f("integer[]")) == [1, 2, 3] and value(spark, "[1, 2]", f("integer[]")) == [1, 2]
    assert value(spark, "yes", f("boolean", true=("yes", "1"), false=("no",))) is True
    assert value(spark, "2013-01-01T00:00:00", f("timestamp with time zone", zone="Europe/Amsterdam")) == datetime(2012, 12, 31, 23)
    assert value(spark, "70000", f("smallint"), strict=False) is None and value(spark, "x", f("double precision"), strict=False) is None
    for text, form in (("70000", f("smallint")), ("1,2,4.5", f("integer[]")), ("maybe", f("boolean")), ("", f("real"))):
        with pytest.raises(Exception, match="Error parsing value"):
            value(spark, text, form)
    assert dt.pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"


def test_promotion():
    assert [dt.promoted("SUM", t) for t in ("smallint", "bigint", "real")] == ["bigint", "numeric", "real"]
    assert [dt.promoted("AVG", t) for t in ("integer", "real")] == ["numeric", "double precision"]
    assert dt.promoted("max", "integer") == "integer" and dt.widest("smallint", "real", "bigint") == "real"
    with pytest.raises(ConfigurationError):
        dt.aggregate("nonsense", "x", "integer")


def test_names(spark):
    row = spark.range(1).select(names.explode_dn(F.lit("a=1,b=2")), names.dn_entity_type(F.lit("a=1,b=2")), names.dn_entity_type(F.lit("plain")), names.split_dn(F.lit(r"a=1\,2,b=3")), names.substring_from(F.lit("Abc"), "([a-z]+)-")).first()
    assert [tuple(x) for x in row[0]] == [("a", "1"), ("b", "2")] and row[1] == "b" and row[2] is None and row[3] == [r"a=1\,2", "b=3"] and row[4] is None
    assert names.aggregate_part_name("hub_node_main_15m", "1d") == "hub_node_main_1d"
    assert names.aggregate_part_name("hub_node_main_15m", "15m", "v-site", "node") == "hub_v-site_main_15m"
    assert names.parse_size("10MB") == 10 << 20 and names.quoted("end") == "`end`" and names.quoted("a_1") == "a_1"


def test_text_tables():
    assert tables.plain(["a", "b"], [(1, None), ("long", "x")]).splitlines()[0] == "a    | b"
    assert tables.rst(["a"], [("x" * 80,)], 10).splitlines()[3] == "xxxxxxx..."
