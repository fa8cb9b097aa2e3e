"""Late and out-of-order records as a stream, with state that corrections adjust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import late
from tidemark.operators.tables_on_disk import Entry, PartitionedTable

DAY = 86_400


class LateAggregates:
    """Multisets of periods, kept up to date batch by batch.

    State is two tables under `root`, a folder that all executors share, both
    partitioned by the day of the period's end: the latest record of each key
    and event time, and how often each value counts in each period. A batch
    reads the records of the days it touches and writes only what it changes:
    records that won, and adjustments of counts, which add up on reading. A
    day with DELTAS of them is folded. Both tables change in one step, as one
    manifest names the folders of both: partition 2 * day holds the latest
    records, 2 * day + 1 the counts. So a batch that fails changes nothing,
    and one that is run again does not either, as a record does not win
    against itself. One stream writes at a time. Records later than `cut_off`
    seconds after their period's end are left out, whenever they are read.
    """

    DELTAS = 16

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], value_type: str, seconds: int, cut_off: int):
        self.spark, self.keys, self.seconds, self.cut_off = spark, list(keys), seconds, cut_off
        named = ", ".join(f"{k} {t}" for k, t in keys.items())
        self.latest = PartitionedTable(spark, root, f"{named}, event timestamp, arrival timestamp, tie bigint, value {value_type}")
        self.counts = PartitionedTable(spark, root, f"{named}, period_end bigint, value {value_type}, n bigint")

    def batch(self, records: DataFrame, _: int = 0) -> None:
        """Take records (keys, event, arrival, tie, value) in."""
        end = late.period_end(F.col("event"), self.seconds)
        valid = records.where(F.col("event").isNotNull() & F.col("arrival").isNotNull())
        for k in self.keys:
            valid = valid.where(F.col(k).isNotNull())
        timely = valid.where(F.unix_micros("arrival") <= (end + self.cut_off) * late.SECOND).select(*self.keys, "event", "arrival", "tie", "value")
        days = [r[0] for r in timely.select(F.floor(end / DAY).alias("d")).distinct().collect()]  # days, not records
        if not days:
            return
        table, deltas = late.fold(self.latest.read([2 * d for d in days]), timely, self.keys, self.seconds)
        won = table.where("won").drop("won").withColumn("__day", F.floor(end / DAY) * 2)
        changed = deltas.withColumn("__day", F.floor(F.col("period_end") / DAY) * 2 + 1)
        new = self.latest.write(won, "__day", [*self.keys, "event"]) | self.counts.write(changed, "__day", [*self.keys, "period_end"])
        if new:
            self.latest.commit(lambda held, seq: held | {p: [*held.get(p, []), Entry(f, seq)] for p, f in new.items()})
        self.fold_days([p for p, own in self.latest.snapshot().entries.items() if len(own) > self.DELTAS])

    def fold_days(self, partitions: list[int]) -> None:
        """Bring partitions back to one folder each."""
        if even := [p for p in partitions if p % 2 == 0]:
            last = lambda rows: late.newest(rows.drop("__seq", "__columns"), [*self.keys, "event"])
            self.latest.rewrite(even, lambda rows: last(rows).withColumn("__day", F.floor(late.period_end(F.col("event"), self.seconds) / DAY) * 2), "__day", [*self.keys, "event"])
        if odd := [p for p in partitions if p % 2]:
            summed = lambda rows: late.adjust(rows.drop("__seq", "__columns"), None, self.keys, ["n"])
            self.counts.rewrite(odd, lambda rows: summed(rows).withColumn("__day", F.floor(F.col("period_end") / DAY) * 2 + 1), "__day", [*self.keys, "period_end"])

    def _counts(self) -> DataFrame:
        held = self.counts.read([p for p in self.counts.snapshot().entries if p % 2])
        return late.adjust(held, None, self.keys, ["n"]).withColumnRenamed("n", "n_now")

    def totals(self) -> DataFrame:
        """The total of each period as of now."""
        return late.totals(self._counts(), self.keys, ["now"])

    def statistics(self) -> DataFrame:
        """Exact count, distinct values, extremes, total and median of each period as of now."""
        return late.statistics(self._counts(), self.keys, ["now"])

    def start(self, records: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follow a stream of records."""
        writer = records.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
