"""Rows that fail to parse, told apart from valid ones with their reasons.

Structural indexing: the bytes of a whole batch of lines stand one after
another; one pass marks quotes, a prefix parity of the marks tells which
separators are literal, and the positions of the others delimit the fields.
Counts per line and type checks on the field texts follow, so a line is
either a valid row or a reject with one reason for each fault.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import written

QUOTE, CARRIAGE_RETURN, BLANK = ord('"'), ord("\r"), ord(" ")

NODE = r"^[a-z]+-[0-9]+$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"


@dataclass(frozen=True)
class LineFormat:
    """How the lines of one configuration are made up."""

    separator: str
    decimal_mark: str
    null_literal: str
    columns: tuple[str, ...]

    def number_pattern(self) -> str:
        mark = "\\" + self.decimal_mark
        return rf"^[+-]?([0-9]+({mark}[0-9]*)?|{mark}[0-9]+)([eE][+-]?[0-9]+)?$"


#: How each column is checked; columns without an entry are text.
KINDS = {"node": "node", "timestamp": "timestamp", "outside_temp": "number", "inside_temp": "number", "power_kwh": "number"}


def index_lines(lines: pa.Array, separator: str) -> dict[str, np.ndarray]:
    """Structure of a batch of lines.

    Returns data (all bytes), begin and end of each line (without one trailing
    carriage return), bad (its quoting is broken), fields (their number), and
    of all fields in order their line, begin and end. A quoted field keeps its
    quotes here.
    """
    lines = lines.cast(pa.large_binary()).fill_null(b"")
    size = pc.binary_length(lines).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(lines.to_pylist()), np.uint8)
    end = np.cumsum(size)
    begin = end - size
    some = size > 0
    cut = some.copy()
    cut[some] = data[end[some] - 1] == CARRIAGE_RETURN
    end = end - cut
    n = len(data)
    line = np.repeat(np.arange(len(size)), size)
    inside_line = np.arange(n) < end[line] if n else np.zeros(0, bool)
    quote = (data == QUOTE) & inside_line
    count = np.cumsum(quote)
    before = count - quote  # quotes ahead of each byte, since the batch began
    at_begin = np.zeros(len(size), np.int64)
    at_begin[some] = before[begin[some]]
    odd = ((before - at_begin[line]) & 1).astype(bool)  # the byte stands within quotes
    delimiter = (data == ord(separator)) & inside_line & ~odd
    # an opening quote follows the line's begin, a delimiter, or the quote that closed just before it
    place = np.flatnonzero(quote & ~odd)
    previous = np.maximum(place - 1, 0)
    fine = (place == begin[line[place]]) | delimiter[previous] | quote[previous]
    bad = np.zeros(len(size), bool)
    bad[line[place[~fine]]] = True
    # a closing one precedes the line's end, a separator or another quote
    place = np.flatnonzero(quote & odd)
    following = np.minimum(place + 1, max(n - 1, 0))
    fine = (place + 1 == end[line[place]]) | (data[following] == ord(separator)) | quote[following]
    bad[line[place[~fine]]] = True
    total = np.zeros(len(size), np.int64)
    np.add.at(total, line[np.flatnonzero(quote)], 1)
    bad |= (total & 1) == 1
    cuts = np.flatnonzero(delimiter)
    fields = np.bincount(line[cuts], minlength=len(size)) + 1 if len(size) else np.zeros(0, np.int64)
    # fields in order: each begins at the line's begin or after a delimiter
    owner = np.repeat(np.arange(len(size)), fields)
    first = np.cumsum(fields) - fields
    field_begin = np.empty(len(owner), np.int64)
    field_end = np.empty(len(owner), np.int64)
    is_first = np.zeros(len(owner), bool)
    is_first[first] = True
    is_last = np.zeros(len(owner), bool)
    is_last[first + fields - 1] = True
    field_begin[is_first] = begin
    field_begin[~is_first] = cuts + 1
    field_end[is_last] = end
    field_end[~is_last] = cuts
    return {"data": data, "begin": begin, "end": end, "bad": bad, "fields": fields, "line": owner, "first": first, "field_begin": field_begin, "field_end": field_end}


def _texts(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as texts, without quotes around and blanks at the ends; bytes that are no UTF-8 never pass a check."""
    length = end - begin
    offsets = np.concatenate([[0], np.cumsum(length)])
    taken = data[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])] if len(length) else data[:0]
    texts = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken.tobytes())])
    quoted = pc.starts_with(texts, '"')
    if pc.any(quoted).as_py():
        inner = pc.replace_substring(pc.utf8_slice_codeunits(pc.if_else(quoted, texts, '""'), 1, -1), '""', '"')
        texts = pc.if_else(quoted, inner, texts)
    return pc.utf8_trim(texts, " ")


def existing_times(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(whether each text is a time that exists, its microseconds since 1970)."""
    shaped = pc.fill_null(pc.match_substring_regex(texts, TIMESTAMP), False)
    good = pc.if_else(shaped, texts, "1970-01-01T00:00:00Z")
    fixed = pc.if_else(pc.ends_with(good, "Z"), pc.binary_replace_slice(good, 19, 20, "+00:00"), good)
    flat = np.frombuffer(b"".join(fixed.cast(pa.large_binary()).to_pylist()), np.uint8).reshape(-1, 25)
    digit = (flat - ord("0")).astype(np.int64)
    number = lambda a, b: digit[:, a:b] @ (10 ** np.arange(b - a - 1, -1, -1))
    year, month, day, hour, minute, second = (number(a, a + w) for a, w in ((0, 4), (5, 2), (8, 2), (11, 2), (14, 2), (17, 2)))
    off_hour, off_minute, sign = number(20, 22), number(23, 25), np.where(flat[:, 19] == ord("-"), -1, 1)
    exists = (month >= 1) & (month <= 12) & (year >= 1)
    first = np.where(exists, (year - 1970) * 12 + month - 1, 0).astype("datetime64[M]")
    days = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    exists &= (day >= 1) & (day <= days) & (hour <= 23) & (minute <= 59) & (second <= 59) & (off_hour <= 23) & (off_minute <= 59)
    micros = ((first.astype("datetime64[D]").astype(np.int64) + day - 1) * 86400 + hour * 3600 + minute * 60 + second - sign * (off_hour * 3600 + off_minute * 60)) * 1_000_000
    return shaped.to_numpy(zero_copy_only=False) & exists, micros


def parse_lines(lines: pa.Array, form: LineFormat) -> tuple[dict[str, pa.Array], list[tuple[str, np.ndarray]]]:
    """Values of each checked column, and the faults: (fault, rows that have it)."""
    found = index_lines(lines, form.separator)
    wrong = ~found["bad"] & (found["fields"] != len(form.columns))
    whole = np.flatnonzero(~found["bad"] & ~wrong)
    faults = [("quoting", np.flatnonzero(found["bad"])), ("column_count", np.flatnonzero(wrong))]
    values: dict[str, pa.Array] = {"__rows": pa.array(whole)}
    for k, column in enumerate(form.columns):
        at = found["first"][whole] + k
        texts = _texts(found["data"], found["field_begin"][at], found["field_end"][at])
        kind = KINDS.get(column)
        if kind == "number":
            empty = pc.or_(pc.equal(texts, ""), pc.equal(texts, form.null_literal))
            shaped = pc.match_substring_regex(texts, form.number_pattern())
            good = pc.or_(empty, shaped)
            plain = pc.replace_substring(texts, form.decimal_mark, ".") if form.decimal_mark != "." else texts
            values[column] = pc.if_else(pc.and_not(shaped, empty), plain, pa.scalar(None, pa.large_string())).cast(pa.float64())
            good = good.to_numpy(zero_copy_only=False)
        elif kind == "timestamp":
            good, micros = existing_times(texts)
            values[column] = pa.array(micros, mask=~good).cast(pa.timestamp("us", tz="UTC"))
        elif kind == "node":
            good = pc.match_substring_regex(texts, NODE).to_numpy(zero_copy_only=False)
            values[column] = texts.cast(pa.string())
        else:
            values[column] = texts.cast(pa.string())
            continue
        faults.append((column, whole[~good]))
    return values, faults


VALUES = ("node", "timestamp", "outside_temp", "inside_temp", "power_kwh")
SCHEMA = "line_id bigint, faults array<string>, node string, timestamp timestamp, outside_temp double, inside_temp double, power_kwh double"


def split_lines(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Each line, read as its configuration says: one row with typed values or with faults.

    lines: line_id, line_no, config_name, raw_line. formats: config_name,
    field_sep, decimal_mark, null_literal, column_list; a handful of rows of
    configuration, read on the driver.

    Header lines (line_no 1), blank lines and null lines give no row. faults
    is empty for a valid line, else holds `quoting`, or `column_count`, or the
    name of each invalid column; values of a faulty line are null. A line of
    an unknown or null configuration has the one fault `config_name`. Columns
    that a configuration lacks are null. Repeated lines give repeated rows;
    lines of any length are read whole.
    """
    known = {
        r["config_name"]: LineFormat(r["field_sep"], r["decimal_mark"], r["null_literal"] or "", tuple(r["column_list"].split(",")))
        for r in formats.select("config_name", "field_sep", "decimal_mark", "null_literal", "column_list").collect()
    }
    types = {f.name: f for f in T._parse_datatype_string(SCHEMA).fields}
    arrow = {"node": pa.string(), "timestamp": pa.timestamp("us", tz="UTC")}

    def run(batches):
        for batch in batches:
            names = batch.column(1).fill_null("").dictionary_encode()
            for code, name in enumerate(names.dictionary.to_pylist()):
                rows = pa.array(np.flatnonzero(names.indices.to_numpy() == code))
                ids, raw = batch.column(0).take(rows), batch.column(2).take(rows)
                form, n = known.get(name), len(rows)
                if form is None:
                    columns = [pa.nulls(n, arrow.get(c, pa.float64())) for c in VALUES]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([["config_name"]] * n, pa.list_(pa.string())), *columns], names=list(types))
                    continue
                values, faults = parse_lines(raw, form)
                # lists of reasons in order of lines, and of faults within a line
                hit = np.concatenate([at for _, at in faults])
                which = np.repeat(np.arange(len(faults)), [len(at) for _, at in faults])
                order = np.argsort(hit, kind="stable")
                per_line = np.bincount(hit, minlength=n)
                bounds = np.concatenate([[0], np.cumsum(per_line)]).astype(np.int32)
                said = pa.array([f for f, _ in faults], pa.string()).take(pa.array(which[order]))
                reasons = pa.ListArray.from_arrays(pa.array(bounds), said)
                valid = per_line == 0
                place = np.zeros(n, np.int64)
                place[values["__rows"].to_numpy()] = np.arange(len(values["__rows"]))
                pick = pa.array(place, mask=~valid)
                columns = [values[c].take(pick) if c in values else pa.nulls(n, arrow.get(c, pa.float64())) for c in VALUES]
                yield pa.RecordBatch.from_arrays([ids, reasons, *columns], names=list(types))

    text = F.col("raw_line")
    content = F.when(text.endswith("\r"), F.expr("left(raw_line, length(raw_line) - 1)")).otherwise(text)
    read = lines.where((F.coalesce("line_no", F.lit(0)) != 1) & (F.trim(content) != "")).select("line_id", "config_name", "raw_line")
    return read.mapInArrow(run, SCHEMA)


def records_of_files(spark: SparkSession, path: str, config_name: str) -> DataFrame:
    """The records of files as rows for split_lines: line_id, file_name, line_no, config_name, raw_line.

    Fields in quotes may hold line ends. Files are read in splits: each tells
    how many quotes it holds, so that the parity with which the next one
    begins is known, and how many records begin in it; a record over several
    lines, or splits, is put together, all others stay where they were read.
    A file with an unclosed quote gives one last record up to its end. line_no
    counts a file's records, line_id those of all files in order of their
    names. What is gathered in one task is splits of a file, and a row a file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    # written once: the order of a split's lines is that in which they were read
    lines = written(lines.withColumn("q", quotes), "lines")
    split = Window.partitionBy("file", "at")
    upto = split.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumn("upto", F.sum("q").over(upto))
    ahead = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "at").agg(F.sum("q").alias("held"))
    parity = splits.select("file", "at", (F.coalesce(F.sum("held").over(ahead), F.lit(0)) % 2).alias("odd"))
    # a line begins a record if an even number of quotes stands before it in the file
    placed = counted.join(parity, ["file", "at"]).withColumn("begins", ((F.col("odd") + F.col("upto") - F.col("q")) % 2 == 0).cast("int"))
    placed = placed.withColumn("ends", (F.col("odd") + F.col("upto")) % 2 == 0).withColumn("number", F.sum("begins").over(upto))
    begun = placed.groupBy("file", "at").agg(F.sum("begins").alias("n"))
    begun = begun.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    files = begun.groupBy("file").agg(F.sum("n").alias("records"))
    every = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = files.select("file", F.coalesce(F.sum("records").over(every), F.lit(0)).alias("start"))
    numbered = placed.join(begun.select("file", "at", "before"), ["file", "at"]).withColumn("number", F.col("before") + F.col("number"))
    whole = (F.col("begins") == 1) & F.col("ends")
    single = numbered.where(whole).select("file", "number", F.col("value").alias("raw_line"))
    several = numbered.where(~whole).groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "value"))), lambda x: x["value"]), "\n").alias("raw_line"))
    records = single.unionByName(several).join(starts, "file")
    return records.select((F.col("start") + F.col("number")).alias("line_id"), F.col("file").alias("file_name"), F.col("number").cast("int").alias("line_no"), F.lit(config_name).alias("config_name"), "raw_line")


def samples(parsed: DataFrame) -> DataFrame:
    """The valid lines as typed samples."""
    return parsed.where(F.size("faults") == 0).drop("faults")


def rejected(parsed: DataFrame) -> DataFrame:
    """A row for each fault of each bad line."""
    return parsed.select("line_id", F.explode("faults").alias("fault"))
