"""Mixed notations of time brought to one instant.

A text is reduced to its shape: each digit a 9, each letter an A, all else as
it stands. Texts of one shape have every field at the same place, so a parser
is found for each distinct shape once (by matching the shape, not the text)
and applied to all texts of that shape at once, as fixed columns of a byte
matrix. Clock times become instants through transition tables of zones. All
this works on the bytes of a whole Arrow batch, never on one text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.zones import transitions, version
from tidemark.session import cut

SECOND = 1_000_000
#: Months by their English abbreviations and names.
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
#: Names of UTC, valid at any site.
UTC_NAMES = {"Z", "UTC", "GMT", "UT"}
#: Bare numbers lie in these years (the last left out), in the unit that makes it so, where nothing else is asked for.
BARE_YEARS = (2021, 2026)
BARE_UNITS = (1, 1_000, 1_000_000, 1_000_000_000)  # units per second

_CLOCK = r"(?P<hour>9{1,2}):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?"
_AMPM = r"(?: ?(?P<ampm>AA)(?!A))"
_ZONE = r"(?: ?(?P<offset>[+-]99(?::?99)?)(?: ?\[(?P<named>[A/_+-]+9*)\])?|\[(?P<only>[A/_+-]+9*)\]| (?P<zone>A+(?:[/_-]A+)+)| ?(?P<abbreviation>A+))"
_DATE = [
    r"(?P<year>9999)-(?P<month>99)-(?P<day>99)",
    r"(?P<year>9999)-(?P<ordinal>999)",
    r"(?P<year>9999)/(?P<month>99)/(?P<day>99)",
    r"(?P<first>9{1,2})(?P<mark>[./-])(?P<next>9{1,2})(?P=mark)(?P<year>9999)",
    r"(?:A{3,9},? )?(?P<day>9{1,2})[ -](?P<word>A{3,9})[ -](?P<year>9999)",
]
#: Shapes of full times: a date, a clock time and perhaps what places it.
SHAPES = [re.compile(rf"{date}(?:(?P<tee>A)| )(?:{_CLOCK}){_AMPM}?{_ZONE}?") for date in _DATE]
SHAPES.append(re.compile(r"(?P<year>9{4})(?P<month>99)(?P<day>99)(?:(?P<tee>A)|[ .])(?P<hour>99)(?P<minute>99)(?:(?P<second>99)(?:[.,](?P<fraction>9+))?)?(?:" + _ZONE + ")?"))
BARE = re.compile(r"(?P<number>9{9,20})(?:\.(?P<fraction>9+))?")


@dataclass(frozen=True)
class Reader:
    """Where the fields of one shape stand."""

    fields: tuple[tuple[str, int, int], ...]
    bare: bool = False


@functools.lru_cache(maxsize=100_000)
def reader(shape: str) -> Reader | None:
    """The parser of a shape, None if texts of it are no times."""
    bare = BARE.fullmatch(shape)
    for found in [bare] if bare else (s.fullmatch(shape) for s in SHAPES):
        if found:
            return Reader(tuple((k, *found.span(k)) for k, v in found.groupdict().items() if v), bool(bare))
    return None


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("0") : ord("9") + 1] = ord("9")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")


def clean(texts: pa.Array) -> pa.Array:
    """Texts without blanks and quotes around, in upper case; null where they hold other than ASCII signs."""
    bare = pc.utf8_trim_whitespace(pc.utf8_trim(pc.utf8_trim_whitespace(texts.cast(pa.large_string())), "\"'"))
    upper = pc.utf8_upper(bare)
    return pc.if_else(pc.string_is_ascii(upper), upper, pa.scalar(None, pa.large_string()))


def shapes(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The shape of each clean text (none null), as a dictionary; their bytes, and where each begins."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    masked = pa.py_buffer(_SHAPE[data].tobytes())
    held = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets.tobytes()), masked])
    return held.dictionary_encode(), data, offsets[:-1]


def _number(digits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(digits), np.int64)
    for k in range(digits.shape[1]):
        out = out * 10 + (digits[:, k] - ord("0"))
    return out


def _micros(digits: np.ndarray | None, n: int) -> np.ndarray:
    """Microseconds of a decimal fraction, further digits cut off."""
    out = np.zeros(n, np.int64)
    for k in range(6):
        out = out * 10 + (digits[:, k] - ord("0") if digits is not None and k < digits.shape[1] else 0)
    return out


def _bare(matrix: np.ndarray, at: dict[str, tuple[int, int]], years: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    n = len(matrix)
    a, b = at["number"]
    low, high = (int(np.datetime64(f"{y:04d}", "s").astype(np.int64)) for y in years)
    micros, good = np.zeros(n, np.int64), np.zeros(n, bool)
    if b - a > 19:
        return micros, good
    for unit in BARE_UNITS:
        wide = len(str(unit)) - 1  # digits after those of whole seconds
        if b - a - wide < 1:
            continue
        seconds = _number(matrix[:, a : b - wide])
        rest = matrix[:, b - wide : b]
        if "fraction" in at:
            rest = np.concatenate([rest, matrix[:, slice(*at["fraction"])]], axis=1)
        fits = (seconds >= low) & (seconds < high) & ~good
        micros[fits] = (seconds * SECOND + _micros(rest, n))[fits]
        good |= fits
    return micros, good


def _words(block: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(number of the word in each row of bytes, distinct words)."""
    distinct, codes = np.unique(np.ascontiguousarray(block).view(f"S{block.shape[1]}")[:, 0], return_inverse=True)
    return codes, [w.decode("ascii") for w in distinct.tolist()]


def read_shape(found: Reader, matrix: np.ndarray, zones: np.ndarray, orders: np.ndarray, years: tuple[int, int] = BARE_YEARS) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds since 1970, whether settled) of texts of one shape, each a row of bytes.

    zones and orders give the site's zone and order of numeric dates, or None.
    """
    n = len(matrix)
    at = {k: (a, b) for k, a, b in found.fields}
    if found.bare:
        return _bare(matrix, at, years)
    part = lambda k: matrix[:, slice(*at[k])]
    number = lambda k, other=0: _number(part(k)) if k in at else np.full(n, other, np.int64)
    words = lambda k: _words(part(k))
    good = np.ones(n, bool)
    if "tee" in at:
        good &= part("tee")[:, 0] == ord("T")
    year = number("year")
    if "first" in at:
        first, second = number("first"), number("next")
        mdy = orders == "mdy"
        good &= mdy | (orders == "dmy")
        month, day = np.where(mdy, first, second), np.where(mdy, second, first)
    elif "word" in at:
        codes, distinct = words("word")
        month = np.array([next((i + 1 for i, m in enumerate(MONTHS) if w in (m, m[:3]) or (w == "SEPT" and m == "SEPTEMBER")), 0) for w in distinct], np.int64)[codes]
        day = number("day")
    elif "ordinal" in at:
        month, day = np.ones(n, np.int64), np.ones(n, np.int64)
    else:
        month, day = number("month"), number("day")
    good &= (year >= 1) & (month >= 1) & (month <= 12)
    start = np.where(good, (year - 1970) * 12 + month - 1, 0).astype("datetime64[M]")
    days = start.astype("datetime64[D]").astype(np.int64)
    if "ordinal" in at:
        ordinal = number("ordinal")
        length = (start + 12).astype("datetime64[D]").astype(np.int64) - days
        good &= (ordinal >= 1) & (ordinal <= length)
        days = days + ordinal - 1
    else:
        length = (start + 1).astype("datetime64[D]").astype(np.int64) - days
        good &= (day >= 1) & (day <= length)
        days = days + day - 1
    hour, minute, second = number("hour"), number("minute"), number("second")
    if "ampm" in at:
        codes, distinct = words("ampm")
        half = np.array(distinct, object)[codes]
        good &= np.isin(half, ("AM", "PM")) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * (half == "PM")
    good &= (hour <= 23) & (minute <= 59) & (second <= 59)
    clock = days * 86400 + hour * 3600 + minute * 60 + second
    fraction = _micros(part("fraction") if "fraction" in at else None, n)
    seconds, settled = _place(clock, good, at, part, words, zones)
    return seconds * SECOND + fraction, good & settled


def _place(clock, good, at, part, words, zones) -> tuple[np.ndarray, np.ndarray]:
    """Clock times to epoch seconds, by offset, zone name, abbreviation or the site's zone."""
    n = len(clock)
    if "offset" in at:
        digits = part("offset")
        plain = digits[:, [i for i in range(1, digits.shape[1]) if not (digits[:, i] == ord(":")).all()]]
        hours = _number(plain[:, :2])
        minutes = _number(plain[:, 2:]) if plain.shape[1] > 2 else np.zeros(n, np.int64)
        sign = np.where(digits[:, 0] == ord("-"), -1, 1)
        return clock - sign * (hours * 3600 + minutes * 60), (hours <= 23) & (minutes <= 59)
    out, settled = clock.copy(), np.zeros(n, bool)
    # a table for each distinct zone, or zone and abbreviation
    zone_of, zones_held = words("only" if "only" in at else "zone") if "only" in at or "zone" in at else pd.factorize(zones)
    name_of, names = words("abbreviation") if "abbreviation" in at else (np.zeros(n, np.int64), [None])
    known_utc = np.array([w in UTC_NAMES for w in names], bool)[name_of] if len(names) else settled
    settled |= known_utc
    pair, place = np.unique((zone_of + 1) * len(names) + name_of, return_inverse=True)
    for code, key in enumerate(pair.tolist()):
        number, name = key // len(names) - 1, names[key % len(names)]
        own = np.flatnonzero((place == code) & good & ~known_utc)
        table = transitions(zones_held[number]) if number >= 0 else None
        if table is None or not len(own):
            continue
        out[own], settled[own] = table.instants(clock[own]) if name is None else table.abbreviated(name, clock[own])
    return out, settled


def parse_times(texts: pa.Array, zones: pa.Array, orders: pa.Array, years: tuple[int, int] = BARE_YEARS) -> pa.Array:
    """Microseconds since 1970 UTC of each text, null where it settles no instant. Series do as well as arrays."""
    texts, zones, orders = (pa.array(x, pa.string(), from_pandas=True) if isinstance(x, pd.Series) else x for x in (texts, zones, orders))
    micros = np.zeros(len(texts), np.int64)
    good = np.zeros(len(texts), bool)
    plain = clean(texts)
    rows = np.flatnonzero(plain.is_valid().to_numpy(zero_copy_only=False))
    if len(rows):
        held, data, begin = shapes(plain.take(pa.array(rows)))
        codes, distinct = held.indices.to_numpy(), held.dictionary.to_pylist()
        zone, order = zones.to_numpy(zero_copy_only=False), orders.to_numpy(zero_copy_only=False)
        by_shape = np.argsort(codes, kind="stable")
        for own in np.split(by_shape, np.flatnonzero(np.diff(codes[by_shape])) + 1):
            shape = distinct[codes[own[0]]]
            found = reader(shape)
            if found is not None:
                at = rows[own]
                matrix = data[begin[own][:, None] + np.arange(len(shape))]
                micros[at], good[at] = read_shape(found, matrix, zone[at], order[at], years)
    return pa.array(micros, mask=~good)


def _parser(years: tuple[int, int], zones: str):
    def parsed(texts: pa.Array, zone: pa.Array, order: pa.Array) -> pa.Array:
        if version() != zones:
            raise RuntimeError(f"zone database {version()} here, {zones} where the query was made")
        return parse_times(texts, zone, order, years)

    # called nondeterministic so that no filter on its result is moved below it, which would parse every text twice
    return F.arrow_udf(parsed, T.LongType()).asNondeterministic()


def instant(text: Column, zone: Column, order: Column, years: tuple[int, int] = BARE_YEARS) -> Column:
    """Microseconds since 1970 UTC that a text names, null where it settles none.

    Offsets and zone names in the text count; an abbreviation means what it
    means in `zone`; bare numbers count from 1970 UTC in the unit that gives a
    date from the first of `years` up to the last, that left out; all else is
    on the clock of `zone`. Numeric dates with the year last follow `order`
    (dmy or mdy). Blanks and quotes around and letter case do not matter.
    Clock times shown twice or never, and texts that are no full existing date
    and time of day, are null; seconds may be missing. A null zone or order
    matters only where it is needed. Executors must have the zone database of
    the driver: another version fails the query.
    """
    return _parser(years, version())(text, zone, order)


def zone_version() -> str:
    """The version of the zone database that instants are made with, to be kept beside them."""
    return version()


def sited(df: DataFrame, sites: DataFrame, node: str = "node") -> DataFrame:
    """Add tz_name and date_order of each row's site, the node's name before the hyphen; null where unknown.

    Sites are a fixed table of a few dozen rows; its size is left to the
    planner, which broadcasts it below its limit and shuffles it above.
    """
    own = sites.select(F.col("name").alias("__site"), F.col("tz_name").alias("__zone"), F.col("date_order").alias("__order")).where(F.col("__site").isNotNull()).dropDuplicates(["__site"])
    return df.withColumn("__site", F.substring_index(node, "-", 1)).join(own, "__site", "left").drop("__site")


def with_instant(df: DataFrame, sites: DataFrame, text: str = "timestamp", node: str = "node", out: str = "instant_us") -> DataFrame:
    """df with the instant its text names, by the site of its node; all its rows and columns stay."""
    return sited(df, sites, node).withColumn(out, instant(F.col(text), F.col("__zone"), F.col("__order"))).drop("__zone", "__order")


def same_instant_pairs(df: DataFrame, row: str, node: str, instant_us: str) -> DataFrame:
    """Pairs (a < b) of rows of one node and one instant. Rows without either are in no pair.

    An equi-join on both, so the work follows the pairs asked for. The three
    columns it needs are written once to the checkpoint folder, so that texts
    are parsed for one side only.
    """
    rows = df.select(F.col(node).alias("__node"), F.col(instant_us).alias("__at"), F.col(row).alias("__row")).where(F.col("__node").isNotNull() & F.col("__at").isNotNull())
    rows = cut(rows)
    a = rows.withColumnRenamed("__row", f"{row}_a")
    b = rows.withColumnRenamed("__row", f"{row}_b")
    return a.join(b, ["__node", "__at"]).where(F.col(f"{row}_a") < F.col(f"{row}_b")).select(f"{row}_a", f"{row}_b")


def instant_classes(df: DataFrame, row: str, node: str, instant_us: str) -> DataFrame:
    """Rows of one node and one instant as a class: node, instant, how many rows, and the least row, which stands for it.

    One row for each class however many rows it has, where all pairs would grow
    with their square. Rows without node or instant are in none.
    """
    rows = df.where(F.col(node).isNotNull() & F.col(instant_us).isNotNull())
    return rows.groupBy(F.col(node).alias(node), F.col(instant_us).alias(instant_us)).agg(F.count(F.lit(1)).alias("rows"), F.min(row).alias("first"))
