"""Implausible values in measurements, relative to their own source.

Three kinds of fault, told apart:

limit  the value is physically impossible;
stuck  it belongs to a long run of one value where the source's field
       otherwise repeats far less long;
spike  it departs from what a robust autoregression of the source foretells,
       both forward from the readings before and backward from those after.

The last is an additive-outlier test, iterated on the readings cleaned so far.
Beside it stands a level-shift test: where the level changes for good the
series is cut, and readings on either side are held against their own side.

What is usual for a source - its noise, the coefficient of its autoregression,
the length of its runs - is taken over all its readings: histograms and sums
that add up, however many parts a long source is tested in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut


@dataclass(frozen=True)
class Field:
    """A measured field: its physical limits, the departure that makes a spike, the value at which it may rest.

    limit is in units of the source's own noise; a field with heavier tails needs a higher one.
    """

    name: str
    low: float
    high: float
    limit: float
    rest: float | None = None


#: Air and room temperatures in degrees Celsius; energy drawn in a period, never negative.
FIELDS = (Field("outside_temp", -95.0, 65.0, 5.0), Field("inside_temp", -95.0, 95.0, 5.0), Field("power_kwh", 0.0, 1e7, 8.0, rest=0.0))

#: Readings of each side that give the level there.
SIDE = 7
#: Where one side is missing, at either end of a series, the departure must be this many times the limit.
EDGE = 2.0
#: A level shift: the levels of both sides differ by so many times the limit.
SHIFT = 2.4
ROUNDS = 4
#: A run of this many readings may be stuck, if it is this many times as long as the source's other runs.
RUN, TIMES = 10, 3.0
#: One or two readings between rests of so many readings are held against the rest.
REST = 10
#: Readings of one source that are tested together, and readings shared with its neighbours on either side.
PART, HALO = 20_000, 300
#: Readings of a slot of a day that holds more than PART.
SLOT = 1_000
#: Slots of long sources that are broadcast at most.
BROADCAST_DAYS = 100_000
#: Histograms have so many bins for a factor of e, and bins from exp(-LEAST_BIN / BINS) on.
BINS, LEAST_BIN = 50, 1_500
#: What a sketch counts: sizes of interpolation errors and of steps, lengths of runs, and the sums of the autoregression.
ERROR, STEP, LENGTH, SUMS = range(4)


def _sides(values: np.ndarray, clean: np.ndarray, bounds: np.ndarray, rows: np.ndarray, after: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The SIDE clean values before and after each of `rows` within its series, nearest first, NaN where there are none.

    bounds: for each row, begin and end of its series (2 x n).
    """
    held = values[clean]
    upto = np.concatenate([[0], np.cumsum(clean)])
    begin, end = upto[bounds[0, rows]], upto[bounds[1, rows]]
    padded = np.append(held, np.nan)
    last = len(held)
    place = upto[rows][:, None] - 1 - np.arange(SIDE)
    ahead = padded[np.where(place >= begin[:, None], place, last)]
    if not after:
        return ahead, None
    place = upto[rows + 1][:, None] + np.arange(SIDE)
    return ahead, padded[np.where(place < end[:, None], place, last)]


def _median(block: np.ndarray) -> np.ndarray:
    """Median of each row without its NaN."""
    ordered = np.sort(block, axis=1)  # NaN last
    count = (~np.isnan(block)).sum(axis=1)
    rows = np.arange(len(block))
    low = ordered[rows, np.maximum((count - 1) // 2, 0)]
    high = ordered[rows, np.maximum(count // 2, 0) - (count == block.shape[1]) * 0]
    return np.where(count > 0, (low + high) / 2, np.nan)


def _group_medians(values: np.ndarray, series: np.ndarray, n: int, quantile: float = 0.5) -> np.ndarray:
    """A quantile of the values of each series (lower value), 0 where it has none."""
    order = np.lexsort((values, series))
    counts = np.bincount(series, minlength=n)
    ends = np.cumsum(counts)
    at = np.minimum(ends - counts + np.floor(quantile * np.maximum(counts - 1, 0)).astype(np.int64), len(values) - 1)
    return np.where(counts > 0, values[order][at], 0.0) if len(values) else np.zeros(n)


@dataclass(frozen=True)
class Usual:
    """What is usual for each series: noise, autoregression, and the length that nearly all its short runs keep to."""

    noise: np.ndarray
    phi: np.ndarray
    run: np.ndarray


def _runs(values: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of one value."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (series[1:] != series[:-1])]))
    return begin, np.diff(np.append(begin, len(values)))


def _bins(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log(sizes) * BINS).astype(np.int64) + LEAST_BIN, 0)


def _interpolated(values: np.ndarray, series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors of interpolating each reading from its two neighbours, and which readings have both."""
    error, inner = np.zeros(len(values)), np.zeros(len(values), bool)
    error[1:-1] = values[1:-1] - (values[2:] + values[:-2]) / 2
    inner[1:-1] = (series[1:-1] == series[:-2]) & (series[1:-1] == series[2:])
    return np.abs(error), inner


def _added(owner: np.ndarray, bins: np.ndarray, *sums: np.ndarray | None) -> list[np.ndarray]:
    """(series, bin, n, and the sum of each of `sums`) of each series and bin that occurs, in order."""
    width = int(bins.max()) + 2 if len(bins) else 1  # bins begin at -1
    key = owner * width + bins + 1
    n = np.bincount(key)
    held = np.flatnonzero(n)
    return [held // width, held % width - 1, n[held], *(np.zeros(len(held)) if x is None else np.bincount(key, x)[held] for x in sums)]


def sketch(values: np.ndarray, series: np.ndarray, counted: np.ndarray, rest: np.ndarray, single: np.ndarray) -> list[list[np.ndarray]]:
    """Sums that add up over the parts of a source: for ERROR, STEP, LENGTH and SUMS each (series, bin, n, a, b).

    counted: the readings that this part counts (its halo is there for their
    neighbours). rest: readings at rest; single: those that the spike test
    sees. ERROR: n readings, a sum of sizes, b of squares (bin -1: of size 0);
    STEP: n, a; LENGTH: n runs of that length; SUMS: n pairs of neighbours, a
    those on one side of the level less those on both.
    """
    begin, length = _runs(values, series)
    usable = counted[begin] & ~rest[begin] & (length < RUN)
    lengths = _added(series[begin][usable], length[usable], None, None)
    v, s, mine = values[single], series[single], counted[single]
    if len(v) < 3:
        nothing = _added(np.zeros(0, np.int64), np.zeros(0, np.int64), None, None)
        return [nothing, nothing, lengths, nothing]
    size, inner = _interpolated(v, s)
    own = inner & mine
    size, owner = size[own], s[own]
    bins = np.full(len(size), -1)
    moving = size > 0
    bins[moving] = _bins(size[moving])
    errors = _added(owner, bins, size, size**2)
    step = np.abs(np.diff(v))
    moved = (s[1:] == s[:-1]) & (step > 0) & mine[1:]
    steps = _added(s[1:][moved], _bins(step[moved]), step[moved], None)
    numbers = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    before, _ = _sides(v, np.ones(len(v), bool), _bounds(numbers), np.arange(len(v)), after=False)
    level = _median(before)
    # whether a reading and the one before lie on one side of the level: no size of an outlier enters
    together = np.sign(v - level) * np.sign(before[:, 0] - level)
    ok = mine & ~np.isnan(together) & (together != 0)
    return [errors, steps, lengths, _added(s[ok], np.zeros(int(ok.sum()), np.int64), together[ok], None)]


def _quantile(series: np.ndarray, n: np.ndarray, quantile: float, count: int, values: np.ndarray) -> np.ndarray:
    """The lower quantile of each series' histogram, its bins in order; 0 where it is empty."""
    if not len(series):
        return np.zeros(count)
    total = np.bincount(series, n, count)
    ahead = np.concatenate([[0], np.cumsum(total)[:-1]])
    place = np.floor(quantile * np.maximum(total - 1, 0)) + ahead
    at = np.minimum(np.searchsorted(n.cumsum(), place, "right"), len(values) - 1)
    return np.where(total > 0, values[at], 0.0)


def usual(held: list[list[np.ndarray]], count: int) -> Usual:
    """What is usual for each series, from the sketch of all its readings: series and bins in order, each bin once."""
    owner, bins, n, a, b = held[ERROR]
    among = np.maximum(np.bincount(owner, n, count), 1)
    owner, n, a, b = (x[bins >= 0] for x in (owner, n, a, b))
    typical = 1.4826 * _quantile(owner, n, 0.5, count, a / n)
    top = 9 * typical[owner] ** 2
    noise = np.sqrt(np.bincount(owner, np.minimum(b, top * n), count) / among / 1.5)
    owner, _, n, a, _ = held[STEP]
    resolution = _quantile(owner, n, 0.02, count, a / n)
    owner, bins, n, _, _ = held[LENGTH]
    length = np.maximum(_quantile(owner, n, 0.99, count, bins.astype(float)), 1.0)
    # the quadrant correlation of a reading and the one before is the coefficient of a first-order autoregression
    owner, _, n, a, _ = held[SUMS]
    pairs, agreed = np.bincount(owner, n, count), np.bincount(owner, a, count)
    phi = np.clip(np.sin(np.pi / 2 * np.divide(agreed, pairs, out=np.zeros(count), where=pairs > 0)), 0.0, 0.95)
    return Usual(np.maximum(noise, resolution / 2), phi, length)


def _bounds(series: np.ndarray) -> np.ndarray:
    """Begin and end of the series of each row; series are numbered from 0 in order."""
    ends = np.cumsum(np.bincount(series))
    return np.stack([np.concatenate([[0], ends[:-1]])[series], ends[series]])


def stuck_runs(values: np.ndarray, series: np.ndarray, rest: float | None = None, run: np.ndarray | None = None) -> np.ndarray:
    """Mask of values in runs that are long for their series. Values and series are in order, series from 0."""
    if not len(values):
        return np.zeros(0, bool)
    resting = np.zeros(len(values), bool) if rest is None else values == rest
    if run is None:
        every = np.ones(len(values), bool)
        run = usual(sketch(values, series, every, resting, np.zeros(len(values), bool)), int(series[-1]) + 1).run
    begin, length = _runs(values, series)
    long = (length >= np.maximum(RUN, TIMES * run[series[begin]])) & ~resting[begin]
    return np.repeat(long, length)


def level_shifts(values: np.ndarray, clean: np.ndarray, bounds: np.ndarray, noise: np.ndarray, limit: float) -> np.ndarray:
    """Mask of the clean readings with which a new level begins.

    The level of the SIDE readings from there on differs from that of the SIDE
    before by more than SHIFT times the limit, in units of noise; of the
    readings around it the one that leaves the least unexplained counts.
    """
    out = np.zeros(len(values), bool)
    rows = np.flatnonzero(clean)
    if len(rows) < 2 * SIDE:
        return out
    held = values[rows]
    begin = np.searchsorted(rows, bounds[0, rows])
    end = np.searchsorted(rows, bounds[1, rows])
    place = np.arange(len(rows))
    # a shift is a step too: only there the levels of both sides are looked at
    far = np.concatenate([[False], np.abs(np.diff(held)) > limit * noise[rows[1:]]])
    place = place[far & (place - begin >= SIDE) & (end - place >= SIDE)]
    if not len(place):
        return out
    before, after = held[place[:, None] - 1 - np.arange(SIDE)], held[place[:, None] + np.arange(SIDE)]
    old, new = np.median(before, axis=1), np.median(after, axis=1)
    spread = 1.4826 * np.maximum(np.median(np.abs(before - old[:, None]), axis=1), np.median(np.abs(after - new[:, None]), axis=1))
    size = np.abs(new - old) / np.maximum(np.maximum(spread, noise[rows[place]]), 1e-12)
    turns = (np.abs(held[place] - new) < np.abs(held[place] - old)) & (np.abs(held[place - 1] - old) < np.abs(held[place - 1] - new)) & (size > SHIFT * limit)
    cost = np.full(len(rows) + 2 * SIDE, np.inf)
    own = np.abs(before - old[:, None]).sum(axis=1) + np.abs(after - new[:, None]).sum(axis=1)
    cost[place[turns] + SIDE] = own[turns]
    near = cost[place[turns][:, None] + np.arange(2 * SIDE + 1)].min(axis=1) if turns.any() else own[turns]
    out[rows[place[turns][own[turns] <= near]]] = True
    return out


def spikes(values: np.ndarray, series: np.ndarray, limit: float, norm: Usual | None = None) -> np.ndarray:
    """Mask of additive outliers. Values and series are in order, series from 0; values are within their limits.

    norm: what is usual for the series; else it is taken from these values.
    The first pass, against levels only, finds the gross outliers; all later
    ones hold every reading against the autoregression and the level shifts.
    """
    n = len(values)
    flagged = np.zeros(n, bool)
    if n < 3:
        return flagged
    if norm is None:
        every = np.ones(n, bool)
        norm = usual(sketch(values, series, every, ~every, every), int(series[-1]) + 1)
    noise, whole = norm.noise[series], _bounds(series)
    phi, bounds, todo = np.zeros(n), whole, np.arange(n)
    for turn in range(ROUNDS):
        before, after = _sides(values, ~flagged, bounds, todo)
        level_b, level_a = _median(before), _median(after)
        # forecasts: the level of that side, and what the autoregression carries over from the nearest reading
        forward = level_b + phi[todo] * (before[:, 0] - level_b)
        backward = level_a + phi[todo] * (after[:, 0] - level_a)
        one_sided = np.isnan(forward) | np.isnan(backward)
        forward, backward = np.where(np.isnan(forward), backward, forward), np.where(np.isnan(backward), forward, backward)
        d_b, d_a = values[todo] - forward, values[todo] - backward
        # additive outlier: departs from both in one direction
        departure = np.where(np.sign(d_b) == np.sign(d_a), np.minimum(np.abs(d_b), np.abs(d_a)), 0.0)
        hit = departure > np.where(one_sided, EDGE, 1.0) * limit * np.maximum(noise[todo], 1e-12)
        # where the series is noisier than usual its own neighbourhood tells
        some = np.flatnonzero(hit)
        left, right = before[some], after[some]
        local = np.fmin(_median(np.abs(left - level_b[some, None])), _median(np.abs(right - level_a[some, None]))) * 1.4826
        slope = np.nan_to_num(np.abs(level_a[some] - level_b[some])) / (SIDE + 1) * SIDE / 4 * 1.4826
        hit[some] = departure[some] > np.where(one_sided[some], EDGE, 1.0) * limit * np.maximum(np.nan_to_num(local) - slope, 1e-12)
        turned = todo[hit != flagged[todo]]
        flagged[todo] = hit
        if turn and not len(turned):
            break
        if turn == 0:
            phi = norm.phi[series]
            begins = level_shifts(values, ~flagged, whole, noise, limit)
            bounds = _bounds(np.cumsum(begins | np.concatenate([[True], series[1:] != series[:-1]])) - 1)
        else:
            # only what is near a reading that was cleaned or given back can change
            reach = np.zeros(n + 1, np.int64)
            np.add.at(reach, np.maximum(turned - 2 * SIDE, 0), 1)
            np.add.at(reach, np.minimum(turned + 2 * SIDE + 1, n), -1)
            todo = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
    return flagged


@dataclass(frozen=True)
class Prepared:
    """The readings of one field, each time and value once: places of the rows used, their reading, and the readings."""

    used: np.ndarray
    row_of: np.ndarray
    fresh: np.ndarray
    series: np.ndarray
    values: np.ndarray
    rest: np.ndarray
    single: np.ndarray


def _prepared(key: np.ndarray, at: np.ndarray, x: np.ndarray, field: Field) -> Prepared:
    """Readings of a field in order; a row that repeats the one before is none of its own, nulls and impossible values are passed over."""
    used = np.flatnonzero(~np.isnan(x) & (x >= field.low) & (x <= field.high))
    k, t, v = key[used], at[used], x[used]
    fresh = np.ones(len(used), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    row_of = np.cumsum(fresh) - 1
    k, v = k[fresh], v[fresh]
    rest = np.zeros(len(v), bool)
    single = np.ones(len(v), bool)
    if len(v):
        begin, length = _runs(v, k)
        if field.rest is not None:
            rest = v == field.rest  # a lone one too: most of a rest may not have been reported
        # a run that may be stuck stands for one reading in the spike test, a rest for none
        single = np.repeat(length < RUN, length)
        single[begin] = True
        single &= ~rest
    return Prepared(used, row_of, used[fresh], k, v, rest, single)


def faults(key: np.ndarray, at: np.ndarray, columns: list[np.ndarray], fields: tuple[Field, ...] = FIELDS, given: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(stuck, spike) masks for each field, of rows in order of key (numbered from 0), time and arrival.

    A row that repeats the one before (time and value) shares its fate and
    does not lengthen a run. Null and impossible values are passed over. A
    rest is sound, and no reading is held against it but one or two within it.
    given: keys whose readings here are only part of their source's, and what
    is usual for these (keys x noise, phi and run x fields).
    """
    out = []
    count = int(key[-1]) + 1 if len(key) else 0
    for number, (field, x) in enumerate(zip(fields, columns)):
        p = _prepared(key, at, x, field)
        norm = usual(sketch(p.values, p.series, np.ones(len(p.values), bool), p.rest, p.single), count)
        if given is not None:
            for k, own in enumerate((norm.noise, norm.phi, norm.run)):
                own[given[0]] = given[1][:, k, number]
        held = np.zeros(len(p.values), bool)
        hit = np.zeros(len(p.values), bool)
        if len(p.values):
            begin, length = _runs(p.values, p.series)
            held = np.repeat((length >= np.maximum(RUN, TIMES * norm.run[p.series[begin]])) & ~p.rest[begin], length)
            # runs that are not stuck after all count with each reading
            within = _within_rest(p) if field.rest is not None else np.zeros(len(held), bool)
            single = (p.single | ~held) & ~p.rest & ~within
            if single.any():
                owner = p.series[single]
                kept = np.unique(owner)
                own = Usual(norm.noise[kept], norm.phi[kept], norm.run[kept])
                hit[single] = spikes(p.values[single], np.searchsorted(kept, owner), field.limit, own)
            if field.rest is not None:
                hit |= within & (np.abs(p.values - field.rest) > field.limit * np.maximum(norm.noise[p.series], 1e-12))
        hit &= ~held & ~p.rest
        stuck, spike = np.zeros(len(x), bool), np.zeros(len(x), bool)
        stuck[p.used], spike[p.used] = held[p.row_of], hit[p.row_of]
        out.append((stuck, spike))
    return out


def _within_rest(p: Prepared) -> np.ndarray:
    """One or two readings between two long rests of the source: they are held against the rest."""
    n = len(p.values)
    out = np.zeros(n, bool)
    begin = np.flatnonzero(np.concatenate([[True], (p.rest[1:] != p.rest[:-1]) | (p.series[1:] != p.series[:-1])]))
    length = np.diff(np.append(begin, n))
    long = p.rest & np.repeat(length >= REST, length)
    for k in (1, 2):
        at = begin[(length == k) & ~p.rest[begin]]
        at = at[(at > 0) & (at + k < n)]
        at = at[np.logical_and.reduce([long[i] & (p.series[i] == p.series[at]) for i in (at - 1, at + k)])]
        for j in range(k):
            out[at + j] = True
    return out


def _hinted(small: DataFrame) -> DataFrame:
    """A table that was written and counted: broadcast up to a bound, so that the readings need not be moved for it."""
    return F.broadcast(small) if small.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else small


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their part of the source, those near a part's border also with the neighbour's number, as its halo; and the parts of long sources.

    Sources of up to PART readings are one part. Longer ones are cut at days,
    days of more than PART readings at slots of about SLOT, by the running
    number of their readings: days, slots of a day and parts are gathered for
    one source, never its readings. __long tells sources of several parts.
    """
    days = rows.groupBy("__source", "__day").agg(F.count(F.lit(1)).alias("__day_n"))
    source = Window.partitionBy("__source")
    upto = source.orderBy("__day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.withColumn("__all", F.sum("__day_n").over(source)).where(F.col("__all") > PART)
    days = days.withColumn("__day_ahead", F.sum("__day_n").over(upto) - F.col("__day_n"))
    days = cut(days.withColumn("__slots", F.when(F.col("__day_n") > PART, F.ceil(F.col("__day_n") / SLOT)).otherwise(F.lit(1))))
    units = days.where("__slots = 1").select("__source", "__day", F.lit(0).cast("bigint").alias("__slot"), "__all", F.col("__day_n").alias("__n"), F.col("__day_ahead").alias("__ahead"))
    busy = days.where("__slots > 1").select("__source", "__day", "__slots", "__all", "__day_ahead")
    keys = ["__source", "__day"]
    if not busy.isEmpty():
        keys.append("__slot")
        slot = F.floor((F.col("__at") - F.col("__day") * 86_400_000_000) * F.col("__slots") / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("bigint")
        rows = rows.join(_hinted(busy).select("__source", "__day", "__slots"), ["__source", "__day"], "left").withColumn("__slot", F.coalesce(slot, F.lit(0).cast("bigint")))
        within = Window.partitionBy("__source", "__day").orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        slots = rows.where("__slots is not null").groupBy("__source", "__day", "__slot").agg(F.count(F.lit(1)).alias("__n")).withColumn("__within", F.sum("__n").over(within) - F.col("__n"))
        units = units.unionByName(slots.join(busy, ["__source", "__day"]).select("__source", "__day", "__slot", "__all", "__n", (F.col("__day_ahead") + F.col("__within")).alias("__ahead")))
    size = F.col("__all") / F.ceil(F.col("__all") / PART)  # parts of about equal size
    units = units.withColumn("__home", F.floor(F.col("__ahead") / size)).withColumn("__upto", F.col("__ahead") + F.col("__n"))
    parts = units.groupBy("__source", "__home").agg(F.min("__ahead").alias("__begin"), F.max("__upto").alias("__end"))
    order = source.orderBy("__home")
    parts = parts.withColumn("__previous", F.lag("__home").over(order)).withColumn("__next", F.lead("__home").over(order))
    units = units.join(parts, ["__source", "__home"])
    also = F.array("__home", F.when(F.col("__ahead") < F.col("__begin") + HALO, F.col("__previous")), F.when(F.col("__upto") > F.col("__end") - HALO, F.col("__next")))
    split = cut(units.select(*keys, "__home", F.array_compact(also).alias("__also")))
    joined = rows.join(_hinted(split), keys, "left")
    first = F.lit(0).cast("bigint")
    joined = joined.withColumn("__long", F.col("__home").isNotNull()).withColumn("__home", F.coalesce("__home", first))
    return joined.withColumn("__part", F.explode(F.coalesce("__also", F.array(first)))), split.select("__source", F.col("__home").alias("__part")).distinct()


def implausible(df: DataFrame, source: str, at: str, row: str, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """Each faulty value: row id, field_name and kind (limit, stuck or spike).

    A source's readings are put in order of time and arrival (`row`). Rows
    with a null source or time are held against the physical limits only.
    Null and NaN values are no readings. Repeated rows of a faulty reading are
    cases too. A power at rest is sound, however long.
    """
    values = [F.col(f.name).cast("double").alias(f"__v{i}") for i, f in enumerate(fields)]
    rows = df.select(F.col(row).alias("__row"), F.col(source).alias("__source"), F.unix_micros(at).alias("__at"), *values)
    beyond = [F.struct(F.lit(f.name).alias("field_name"), ((F.col(f"__v{i}") < f.low) | (F.col(f"__v{i}") > f.high)).alias("bad")) for i, f in enumerate(fields)]
    impossible = rows.select(F.col("__row").alias(row), F.inline(F.array(*beyond))).where(F.col("bad")).select(row, "field_name", F.lit("limit").alias("kind"))
    placed = rows.where(F.col("__source").isNotNull() & F.col("__at").isNotNull()).withColumn("__day", F.floor(F.col("__at") / 86_400_000_000))
    names = [f"__v{i}" for i in range(len(fields))]
    parts, numbers = _parts(placed)
    parts = parts.select("__source", "__part", "__home", "__long", "__at", "__row", *names)
    norms = cut(_norms(parts.where("__long").select("__source", "__part", "__home", "__at", "__row", *names), fields))
    kinds = dict(zip(parts.columns, parts.schema))
    blank = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in ("__at", "__row")]
    # what is usual for a long source stands among the rows of each of its parts: noise, phi and run, marked by homes below 0
    told = numbers.join(norms, "__source").select("__source", "__part", F.posexplode("__norm").alias("__k", "__values"), *blank)
    told = told.select("__source", "__part", (-1 - F.col("__k")).cast("bigint").alias("__home"), "__at", "__row", *(F.col("__values")[i].alias(c) for i, c in enumerate(names)))
    every = parts.drop("__long").unionByName(told)
    ordered = every.repartition("__source", "__part").sortWithinPartitions("__source", "__part", "__at", "__row")
    schema = T.StructType([T.StructField(row, df.schema[row].dataType), T.StructField("field_name", T.StringType()), T.StructField("kind", T.StringType())])

    def test(table: pa.Table, key: np.ndarray) -> pa.RecordBatch:
        home = table.column("__home").to_numpy()
        given, marks = None, home < 0
        if marks.any():
            # three rows for each key that has them, of one column for each field
            at = np.flatnonzero(marks)
            keys = np.unique(key[at])
            told = np.zeros((len(keys), 3, len(names)))
            told[np.searchsorted(keys, key[at]), -1 - home[at]] = np.stack([table.column(c).take(pa.array(at)).to_numpy() for c in names], axis=1)
            given = (keys, told)
            table, key, home = table.filter(pa.array(~marks)), key[~marks], home[~marks]
        columns = [table.column(c).to_numpy().astype(float) for c in names]
        found = faults(key, table.column("__at").to_numpy(), columns, fields, given)
        home = home == table.column("__part").to_numpy()
        ids, which, kinds = [], [], []
        for field, (stuck, spike) in zip(fields, found):
            for kind, mask in (("stuck", stuck), ("spike", spike)):
                hit = np.flatnonzero(mask & home)
                ids.append(hit)
                which += [field.name] * len(hit)
                kinds += [kind] * len(hit)
        picked = table.column("__row").take(pa.array(np.concatenate(ids))).combine_chunks()
        return pa.RecordBatch.from_arrays([picked, pa.array(which, pa.string()), pa.array(kinds, pa.string())], names=schema.names)

    def run(batches):
        for table in _whole(batches):
            yield test(table, _keys(table))

    return impossible.unionByName(ordered.mapInArrow(run, schema))


def _whole(batches):
    """Tables of whole parts from batches in order of source and part; a part is passed on once its last row has been read."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PART:
            table = pa.Table.from_batches(held)
            key = _keys(table)
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield table.slice(0, last)
                held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


def _norms(parts: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """What is usual for sources of several parts: __source and __norm (noise, phi and run of each field).

    Each part's sketch is made beside its readings; sketches of a source add
    up, and are no longer than their bins however many readings it has.
    """
    ordered = parts.repartition("__source", "__part").sortWithinPartitions("__source", "__part", "__at", "__row")
    kind = parts.schema["__source"]
    schema = T.StructType([kind, *T._parse_datatype_string("field int, what int, bin bigint, n bigint, a double, b double").fields])

    def run(batches):
        for table in _whole(batches):
            key = _keys(table)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            home = table.column("__home").to_numpy() == table.column("__part").to_numpy()
            at = table.column("__at").to_numpy()
            for number, field in enumerate(fields):
                p = _prepared(key, at, table.column(f"__v{number}").to_numpy().astype(float), field)
                for what, (owner, bins, *sums) in enumerate(sketch(p.values, p.series, home[p.fresh], p.rest, p.single)):
                    rows = pa.array(first[owner])
                    numbers = [pa.array(np.full(len(owner), x, np.int32)) for x in (number, what)]
                    sums = [pa.array(x.astype(t)) for x, t in zip((bins, *sums), (np.int64, np.int64, float, float))]
                    yield pa.RecordBatch.from_arrays([table.column("__source").take(rows).combine_chunks(), *numbers, *sums], names=schema.names)

    sketches = ordered.mapInArrow(run, schema)
    keys = ("field", "what", "bin")
    merged = sketches.groupBy("__source", *keys).agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))
    merged = merged.groupBy("__source").agg(F.array_sort(F.collect_list(F.struct(*keys, "n", "a", "b"))).alias("__held"))
    out = T.StructType([kind, T.StructField("__norm", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def told(batches):
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            field, what, *sums = (flat.field(c).to_numpy() for c in (*keys, "n", "a", "b"))
            norms = [usual([[x[(field == i) & (what == w)] for x in (owner, *sums)] for w in range(4)], batch.num_rows) for i in range(len(fields))]
            table = np.stack([np.stack([u.noise, u.phi, u.run]) for u in norms], axis=2).transpose(1, 0, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.tolist(), pa.list_(pa.list_(pa.float64())))], names=out.names)

    return merged.mapInArrow(told, out)


def _keys(table: pa.Table) -> np.ndarray:
    """A number for each source and part, rising from 0 in the order of the rows."""
    source = pd.factorize(table.column("__source").to_pandas())[0]
    part = table.column("__part").to_numpy()
    if not len(part):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum((source[1:] != source[:-1]) | (part[1:] != part[:-1]))])


def found(faulty: DataFrame, row: str) -> DataFrame:
    """Row id and field of each faulty value, once."""
    return faulty.select(row, "field_name").dropDuplicates()
