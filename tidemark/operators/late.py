"""Aggregates by event time that late records correct.

State of a period is a multiset: how often each value counts. A record that
arrives late takes its predecessor's value out (-1) and puts its own in (+1),
so totals, exact medians, distinct numbers and extremes of the period follow
from the counts alone, at any moment and after any correction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds.
SECOND = 1_000_000


def period_end(at: Column, seconds: int) -> Column:
    """Epoch seconds of the end of the period (end - seconds, end] that holds a timestamp."""
    micros = F.unix_micros(at)
    return (F.ceil(micros / F.lit(seconds * SECOND).cast("decimal(20,0)")) * seconds).cast("bigint")


def valid_records(df: DataFrame, keys: list[str], event: str, arrival: str, tie: str, value: str) -> DataFrame:
    """The columns used, of rows that can be placed: no key, event time or arrival is null."""
    kept = df.select(*keys, F.col(event).alias("__event"), F.col(arrival).alias("__arrival"), F.col(tie).alias("__tie"), F.col(value).alias("__value"))
    for c in [*keys, "__event", "__arrival"]:
        kept = kept.where(F.col(c).isNotNull())
    return kept


def multisets(df: DataFrame, keys: list[str], event: str, arrival: str, tie: str, value: str, seconds: int, moments: dict[str, int]) -> DataFrame:
    """Counts of each value in each period, as known at given moments.

    moments: name -> seconds after the period's end. For each event time the
    record last by (arrival, tie) of those that arrived up to and including
    the moment counts; what comes later is left out. Columns: keys,
    period_end, value, and n_<moment> for each moment. A value that is null
    counts nothing, but keeps its period. Rows with a null key, event time or
    arrival are left out; repeated rows change nothing. All aggregates combine
    before they are shuffled, so a hot key costs one row for each event time.
    """
    rows = valid_records(df, keys, event, arrival, tie, value).withColumn("period_end", period_end(F.col("__event"), seconds))
    record = F.struct("__arrival", "__tie", "__value")
    after = F.unix_micros("__arrival") - F.col("period_end") * SECOND
    last = [F.max(F.when(after <= s * SECOND, record)).alias(f"__{m}") for m, s in moments.items()]
    # brought together by period, so that neither counting values nor what follows from the counts moves rows again
    latest = rows.groupBy(*keys, "period_end", "__event").agg(*last).repartition(*keys, "period_end")
    adjustments = F.array(*(F.struct(F.col(f"__{m}.__value").alias("value"), *(F.lit(int(m == n)).alias(f"n_{n}") for n in moments)) for m in moments))
    exploded = latest.select(*keys, "period_end", F.inline(adjustments))
    return exploded.groupBy(*keys, "period_end", "value").agg(*(F.sum(F.when(F.col("value").isNotNull(), F.col(f"n_{m}")).otherwise(0)).alias(f"n_{m}") for m in moments))


def adjust(state: DataFrame, deltas: DataFrame | None, keys: list[str], counts: list[str]) -> DataFrame:
    """A state with further adjustments: counts are added, values that no longer count vanish. None: those in the state itself."""
    groups = [*keys, "period_end", "value"]
    rows = state.select(*groups, *counts)
    if deltas is not None:
        rows = rows.unionByName(deltas.select(*groups, *counts))
    summed = rows.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in counts))
    live = F.lit(False)
    for c in counts:
        live = live | (F.col(c) != 0)
    return summed.where(live | F.col("value").isNull())


def totals(state: DataFrame, keys: list[str], moments: list[str]) -> DataFrame:
    """total_<moment> of each period: value times count, null without any value. One partial aggregation."""

    def total(m: str) -> Column:
        return F.sum(F.when(F.col(f"n_{m}") > 0, F.col("value") * F.col(f"n_{m}").cast("decimal(18,0)")))

    return state.groupBy(*keys, "period_end").agg(*(total(m).alias(f"total_{m}") for m in moments))


def statistics(state: DataFrame, keys: list[str], moments: list[str]) -> DataFrame:
    """Count, distinct values, least, greatest, total and exact median of each period at each moment.

    The median is read off the cumulative counts of the sorted values: with n
    values it is the mean of those at places (n + 1) div 2 and n div 2 + 1.
    A period holds one state row for each distinct value, so the window sorts
    distinct values only.
    """
    period = Window.partitionBy(*keys, "period_end")
    upto = period.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed, aggregates = state, []
    for m in moments:
        n, upper, every = f"n_{m}", f"__upto_{m}", f"__all_{m}"
        placed = placed.withColumn(upper, F.sum(n).over(upto)).withColumn(every, F.sum(n).over(period))
        counts = F.col(n) > 0
        value = F.when(counts, F.col("value"))

        def at(place: Column, upper=upper, n=n, counts=counts) -> Column:
            return F.max(F.when(counts & (F.col(upper) >= place) & (F.col(upper) - F.col(n) < place), F.col("value")))

        low, high = F.floor((F.col(every) + 1) / 2), F.floor(F.col(every) / 2) + 1
        aggregates += [
            F.sum(n).alias(f"count_{m}"),
            F.count(value).alias(f"distinct_{m}"),
            F.min(value).alias(f"min_{m}"),
            F.max(value).alias(f"max_{m}"),
            F.sum(value * F.col(n).cast("decimal(18,0)")).alias(f"total_{m}"),
            ((at(low) + at(high)) / 2).alias(f"median_{m}"),
        ]
    return placed.groupBy(*keys, "period_end").agg(*aggregates)


def changed(state: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Periods whose total differs between two moments; null against a value differs."""
    t = totals(state, keys, [before, after])
    return t.where(~F.col(f"total_{before}").eqNullSafe(F.col(f"total_{after}")))


def newest(records: DataFrame, names: list[str]) -> DataFrame:
    """The record last by (arrival, tie) of each of `names`."""
    return records.groupBy(*names).agg(F.max(F.struct("arrival", "tie", "value")).alias("now")).select(*names, "now.*")


def fold(latest: DataFrame, batch: DataFrame, keys: list[str], seconds: int) -> tuple[DataFrame, DataFrame]:
    """Take a batch of records into the table of latest records.

    Both have keys, event, arrival, tie and value. Returns the new table, one
    row for each key and event time (won: it is the batch's), and the
    adjustments it makes to the multisets (column n). The order in which
    batches come does not matter.
    """
    names = [*keys, "event"]
    record = F.struct("arrival", "tie", "value")
    one = lambda d, as_: d.groupBy(*names).agg(F.max(record).alias(as_))
    both = one(latest, "old").join(one(batch, "new"), names, "full")
    wins = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
    merged = both.withColumn("now", F.when(wins, F.col("new")).otherwise(F.col("old")))
    table = merged.select(*names, "now.*", wins.alias("won"))
    moves = F.array(F.struct(F.col("old.value").alias("value"), F.when(F.col("old").isNotNull(), -1).otherwise(0).alias("n")), F.struct(F.col("new.value").alias("value"), F.lit(1).alias("n")))
    deltas = merged.where(wins).select(*keys, period_end(F.col("event"), seconds).alias("period_end"), F.inline(moves))
    counted = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    return table, deltas.groupBy(*keys, "period_end", "value").agg(F.sum(counted).alias("n"))
