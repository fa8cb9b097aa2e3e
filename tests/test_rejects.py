import re
from datetime import UTC, datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.rejects import LineFormat, index_lines, parse_lines, records_of_files, rejected, samples, split_lines

FORM = LineFormat(",", ".", "", ("node", "timestamp", "outside_temp", "inside_temp", "power_kwh"))
SEMI = LineFormat(";", ",", "-", ("timestamp", "node", "power_kwh", "outside_temp", "inside_temp"))
GOOD = "oxwold-1,2022-05-28T07:45:00Z,19.6,24.5,55.6"


def reasons(line, form=FORM):
    return [f for f, rows in parse_lines(pa.array([line]), form)[1] if len(rows)]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        (GOOD, []),
        (GOOD + "\r", []),
        (GOOD.replace("oxwold-1", '"oxwold-1"'), []),
        (GOOD.replace("19.6", '" 19.6 "'), []),
        (GOOD.replace("oxwold-1", '"oxw""old-1"'), ["node"]),
        (GOOD.replace("oxwold-1", '"ox,wold-1"'), ["node"]),
        (GOOD.replace("oxwold-1", 'oxw"old-1'), ["quoting"]),
        (GOOD.replace("oxwold-1", '"oxwold-1'), ["quoting"]),
        (GOOD.replace("oxwold-1", '"oxwold-1" '), ["quoting"]),
        (GOOD.replace("oxwold-1", ' "oxwold-1"'), ["quoting"]),
        (GOOD.replace("55.6", '"'), ["quoting"]),
        (GOOD.replace("55.6", '""'), []),
        (GOOD.replace("55.6", '"""'), ["quoting"]),
        (GOOD + ",", ["column_count"]),
        ("# note", ["column_count"]),
        (GOOD.replace("19.6", "nan").replace("oxwold-1", "OXWOLD-1"), ["node", "outside_temp"]),
        (GOOD.replace("19.6", "12."), []),
        (GOOD.replace("19.6", ".5"), []),
        (GOOD.replace("19.6", "-2E+1"), []),
        (GOOD.replace("19.6", "1e"), ["outside_temp"]),
        (GOOD.replace("19.6", "."), ["outside_temp"]),
        (GOOD.replace("19.6", "٣"), ["outside_temp"]),
        (GOOD.replace("19.6", "--1"), ["outside_temp"]),
        (GOOD.replace("19.6", ""), []),
        (GOOD.replace("05-28T", "02-29T"), ["timestamp"]),
        (GOOD.replace("07:45:00Z", "07:45:60Z"), ["timestamp"]),
        (GOOD.replace("07:45:00Z", "07:45:00+14:00"), []),
        (GOOD.replace("07:45:00Z", "07:45:00+2:00"), ["timestamp"]),
        ("oxwöld-1" + GOOD[8:], ["node"]),
    ],
)
def test_faults(line, expected):
    assert reasons(line) == expected


def test_other_marks():
    assert reasons("2022-05-28T07:45:00Z;oxwold-1;-;1,5;2", SEMI) == []
    assert reasons("2022-05-28T07:45:00Z;oxwold-1;NULL;1.5;2", SEMI) == ["power_kwh", "outside_temp"]


def slow(line):
    """A state machine, byte by byte: (quoting is broken, fields)."""
    fields, text, i, n = [], "", 0, len(line)
    while True:
        if i < n and line[i] == '"':
            text, i = "", i + 1
            while True:
                if i >= n:
                    return True, None
                if line[i] == '"' and line[i + 1 : i + 2] == '"':
                    text, i = text + '"', i + 2
                elif line[i] == '"':
                    i += 1
                    break
                else:
                    text, i = text + line[i], i + 1
            if i < n and line[i] != ",":
                return True, None
        else:
            found = re.match(r"[^,]*", line[i:])[0]
            if '"' in found:
                return True, None
            text, i = found, i + len(found)
        fields.append(text)
        if i >= n:
            return False, fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",\r é', max_size=12), min_size=1, max_size=6))
def test_index_equals_a_state_machine(lines):
    found = index_lines(pa.array(lines), ",")
    for i, line in enumerate(lines):
        clean = line[:-1] if line.endswith("\r") else line
        broken, fields = slow(clean)
        assert found["bad"][i] == broken
        if not broken:
            assert found["fields"][i] == len(fields)


def test_lines_to_samples_and_rejects(spark):
    formats = spark.createDataFrame([("a", ",", ".", None, ",".join(FORM.columns)), ("s", ";", ",", "-", ",".join(SEMI.columns))], "config_name string, field_sep string, decimal_mark string, null_literal string, column_list string")
    rows = [(1, 1, "a", "bad header"), (2, 2, "a", GOOD), (3, 3, "a", ""), (4, 4, "a", " \r"), (5, 5, "a", None), (6, 6, "s", "2022-05-28T07:45:00+02:00;oxwold-1;-;-1,5;2\r"), (7, 7, "zz", GOOD), (8, 8, None, GOOD), (9, 9, "a", GOOD + "," + "x" * 200_000), (10, None, "a", "x"), (11, 2, "a", GOOD)]
    df = spark.createDataFrame(rows, "line_id bigint, line_no int, config_name string, raw_line string")
    parsed = split_lines(df, formats)
    assert sorted(map(tuple, rejected(parsed).collect())) == [(7, "config_name"), (8, "config_name"), (9, "column_count"), (10, "column_count")]
    good = {r.line_id: r for r in samples(parsed).collect()}
    assert sorted(good) == [2, 6, 11]
    assert good[6].power_kwh is None and good[6].outside_temp == -1.5 and good[6].node == "oxwold-1"
    assert good[6].timestamp.astimezone(UTC) == datetime(2022, 5, 28, 5, 45, tzinfo=UTC)
    assert split_lines(df.limit(0), formats).count() == 0


def test_records_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'h1,h2\n' + GOOD.encode() + b'\r\n"two\nlines",x\n\nlast')
    (tmp_path / "b.csv").write_bytes(b"")
    (tmp_path / "c.csv").write_bytes(b'x\n"open\n' + GOOD.encode())
    rows = records_of_files(spark, str(tmp_path), "a")
    by_file = {}
    for r in rows.orderBy("file_name", "line_no").collect():
        by_file.setdefault(r.file_name[-5], []).append(r.raw_line)
    assert by_file == {"a": ["h1,h2", GOOD + "\r", '"two\nlines",x', "", "last"], "c": ["x", '"open\n' + GOOD]}
    assert rows.select("line_id").distinct().count() == 7


def test_records_over_several_splits(spark, tmp_path):
    """Wherever a file is cut, the records are the same."""
    import random

    r = random.Random(4)
    records = []
    for i in range(400):
        fields = [f"f{i}", *("".join(r.choice(("a", '""', "\n", ",", "é", "\r")) for _ in range(r.randint(0, 30))) for _ in range(2))]
        records.append(",".join([fields[0], *(f'"{f}"' for f in fields[1:])]))
    (tmp_path / "big.csv").write_bytes("\n".join(records).encode() + b"\n")
    (tmp_path / "other.csv").write_bytes(b"x\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = records_of_files(spark, str(tmp_path), "a").orderBy("line_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x.raw_line for x in rows] == [*records, "x", "y"]
    assert [x.line_id for x in rows] == list(range(1, 403)) and [x.line_no for x in rows][-3:] == [400, 1, 2]
