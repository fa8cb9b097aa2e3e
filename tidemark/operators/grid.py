"""Irregular readings onto a regular grid.

A reading holds until the next one of its source, at most for a given time:
readings become validity intervals of a step function. Intersecting these
with the cells of the grid gives each cell its time-weighted average and the
share of it that is covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

SECOND = 1_000_000


def _cell(at: Column, step: int) -> Column:
    """Number of the cell (k - 1, k] * step that holds a time in microseconds."""
    return F.ceil(at / F.lit(step).cast("decimal(20,0)")).cast("bigint")


def regular_series(df: DataFrame, source: str, at: str, value: str, newest: list[str], seconds: int = 900, hold: int = 3600, span_days: int = 7) -> DataFrame:
    """An unbroken series of cells of `seconds` for each source.

    Columns: source, period_end (epoch seconds; the cell is (end - seconds,
    end]), readings (times in the cell that have a value), mean (time-weighted
    over what is covered, null where nothing is), coverage (0 to 1) and state:
    observed (a reading lies in the cell), filled (none, but an earlier one
    still holds), missing (marked, no value). The series runs from the source's
    first cell with a reading to its last.

    Rows with a null source, time or value are left out. Of several rows of
    one time the last by `newest` counts. A reading holds until the next one,
    at most `hold` seconds; the last one to the end of its cell.

    No window spans a whole source: rows are ordered within spans of
    `span_days`, and each span learns from a small table of the spans' first
    times where the next one begins, so a hot source is split by time.
    """
    step, span = seconds * SECOND, max(1, span_days * 86400 // seconds)
    rows = df.select(F.col(source).alias("__source"), F.unix_micros(at).alias("__at"), F.struct(*newest, F.col(value).cast("double").alias("__value")).alias("__row"))
    rows = rows.where(F.col("__source").isNotNull() & F.col("__at").isNotNull() & F.col("__row.__value").isNotNull())
    rows = rows.withColumn("__cell", _cell(F.col("__at"), step)).withColumn("__span", F.floor(F.col("__cell") / span))
    # where each span ends and the next one of the source begins; that as a row without a value in the span before it
    ends = rows.groupBy("__source", "__span").agg(F.min("__at").alias("__at"), F.max("__at").alias("__end"))
    ends = ends.withColumn("__next", F.lead("__at").over(Window.partitionBy("__source").orderBy("__span"))).where(F.col("__next").isNotNull())
    ends = cut(ends)  # a row for each span; written once, as it is needed twice
    marks = ends.select("__source", F.col("__next").alias("__at"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(None).cast("bigint").alias("__cell"), "__span")
    # one exchange brings readings and marks of a span together; what follows needs no other until the cells
    times = rows.unionByName(marks).repartition("__source", "__span").groupBy("__source", "__span", "__at", "__cell").agg(F.max("__row").alias("__row"))
    readings = times.select("__source", "__span", "__at", "__cell", F.col("__row.__value").alias("__value"))
    following = F.lead("__at").over(Window.partitionBy("__source", "__span").orderBy("__at"))
    steps = readings.withColumn("__next", following).where(F.col("__value").isNotNull())
    until = F.coalesce(F.least("__next", F.col("__at") + hold * SECOND), F.col("__cell") * step)
    # cells up to the next reading, beyond the span only as far as this one holds
    last = F.coalesce(_cell(F.col("__next"), step), F.col("__cell"))
    reach = F.when(F.floor(last / span) == F.col("__span"), last).otherwise(F.least(last, F.greatest(F.col("__cell"), _cell(F.col("__at") + hold * SECOND, step))))
    parts = steps.select("__source", "__at", F.col("__cell").alias("__own"), "__value", until.alias("__until"), F.explode(F.sequence(F.col("__cell"), reach)).alias("__cell"))
    # what is left of gaps between spans is empty, and however long cut by span in tasks of their own
    begin, end = F.greatest(_cell(F.col("__end"), step), _cell(F.col("__end") + hold * SECOND, step)) + 1, _cell(F.col("__next"), step) - 1
    gaps = ends.select("__source", F.col("__end").alias("__at"), begin.alias("__begin"), end.alias("__last")).where("__begin <= __last")
    gaps = gaps.withColumn("__stretch", F.explode(F.sequence(F.floor(F.col("__begin") / span), F.floor(F.col("__last") / span)))).repartition("__source", "__stretch")
    cells = F.sequence(F.greatest("__begin", F.col("__stretch") * span), F.least("__last", (F.col("__stretch") + 1) * span - 1))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("__own", "bigint"), ("__value", "double"), ("__until", "bigint"))]
    parts = parts.unionByName(gaps.select("__source", "__at", *none, F.explode(cells).alias("__cell")))
    overlap = F.when(F.col("__until").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least("__until", F.col("__cell") * step) - F.greatest("__at", (F.col("__cell") - 1) * step)))
    grid = (
        parts.withColumn("__w", overlap)
        .groupBy("__source", "__cell")
        .agg(
            F.sum(F.coalesce((F.col("__own") == F.col("__cell")).cast("bigint"), F.lit(0))).alias("readings"),
            F.sum("__w").alias("__w"),
            F.sum(F.when(F.col("__w") > 0, F.col("__value") * F.col("__w"))).alias("__area"),
            F.max_by(F.when(F.col("__own") == F.col("__cell"), F.col("__value")), F.when(F.col("__own") == F.col("__cell"), F.col("__at"))).alias("__last"),
        )
    )
    # a cell whose only reading stands at its very end has no width covered: the reading itself is its mean
    mean = F.when(F.col("__w") > 0, F.col("__area") / F.col("__w")).otherwise(F.col("__last"))
    state = F.when(F.col("readings") > 0, "observed").when(F.col("__w") > 0, "filled").otherwise("missing")
    return grid.select(F.col("__source").alias(source), (F.col("__cell") * seconds).alias("period_end"), "readings", mean.alias("mean"), (F.col("__w") / step).alias("coverage"), state.alias("state"))


def without_reading(series: DataFrame) -> DataFrame:
    """The cells of a regular series in which no reading lies."""
    return series.where(F.col("readings") == 0)
