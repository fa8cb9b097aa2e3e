"""Incremental maintenance of derived parts.

Storing data logs which timestamps were modified. The log is folded into the
time of the last change; from it each target timestamp gets a fingerprint of
its sources; targets whose fingerprint differs from the one they were last
made from are due, and all due targets of a materialization are made in one
job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.granularity import Granularity, bucket_end, parse, partition_index
from tidemark.operators.store import fold_modified
from tidemark.operators.tables_on_disk import PartitionedTable
from tidemark.session import cut

LOG = "part string, timestamp timestamp, modified timestamp"


@dataclass(frozen=True)
class Materialization:
    """A derived part: how to make it, from what, and when.

    make: rows of the sources for the given targets -> target rows, both with
    column `timestamp`. A source stamp counts for the target stamp that ends
    its bucket of the granularity, or for those in the array that `mapping`
    gives of it; then make's rows have the column `target_timestamp` too.
    fingerprint: fold of modifications -> timestamp, max_modified, fingerprint,
    in place of the usual one. processing_delay follows the last change;
    reprocessing bounds how far back changes are still taken in (None: not).
    stability_delay is kept and used by nothing. by_part: make takes the rows
    as part -> DataFrame, else those of all sources together.
    """

    name: str
    sources: tuple[str, ...]
    granularity: Granularity
    make: Callable[[DataFrame], DataFrame]
    processing_delay: timedelta = timedelta(minutes=30)
    stability_delay: timedelta = timedelta(minutes=5)
    reprocessing: timedelta | None = timedelta(days=3)
    enabled: bool = True
    mapping: Callable[[Column], Column] | None = None
    fingerprint: Callable[[DataFrame], DataFrame] | None = None
    by_part: bool = False


def _targets(at: Column, granularity: Granularity | str, mapping: Callable[[Column], Column] | None) -> Column:
    return F.explode(mapping(at)) if mapping else bucket_end(at, granularity)


def fingerprints(modified: DataFrame, sources: tuple[str, ...], granularity: Granularity | str, target: str, mapping: Callable[[Column], Column] | None = None) -> DataFrame:
    """What each target stamp is made from: target, timestamp, max_modified, fingerprint.

    The fingerprint is JSON, ordered by part and source stamp, so equal
    sources give equal texts.
    """
    g = parse(granularity) if isinstance(granularity, str) else granularity
    own = modified.where(F.col("part").isin(*sources)).select("part", "timestamp", "last", _targets(F.col("timestamp"), g, mapping).alias("__target"))
    entry = F.struct("part", F.col("timestamp").alias("at"), "last")
    return own.groupBy("__target").agg(F.max("last").alias("max_modified"), F.to_json(F.array_sort(F.collect_list(entry))).alias("fingerprint")).select(F.lit(target).alias("target"), F.col("__target").alias("timestamp"), "max_modified", "fingerprint")


def due(state: DataFrame, now: Column, processing_delay: Column, retention: Column | None = None, reset: bool = False, newest_first: bool = True, most: int = 0) -> DataFrame:
    """Target stamps to be made: target, timestamp, max_modified, fingerprint, processed.

    Due is what lies before now, whose sources have rested for the delay (or
    were never modified), and whose fingerprint differs from the processed one
    or was never processed; a null fingerprint against a processed one is not
    due. reset ignores fingerprints. most limits the number (0: all), with the
    target's name as tie-breaker.
    """
    differs = F.lit(True) if reset else (F.col("processed").isNull() | F.coalesce(F.col("fingerprint") != F.col("processed"), F.lit(False)))
    rested = F.col("max_modified").isNull() | (F.col("max_modified") + processing_delay < now)
    chosen = state.where((F.col("timestamp") < now) & rested & differs)
    if retention is not None:
        chosen = chosen.where(now - retention < F.col("timestamp"))
    ordered = chosen.orderBy(F.desc("timestamp") if newest_first else F.asc("timestamp"), "target")
    return ordered.limit(most) if most else ordered


def rows_of_targets(source: DataFrame, targets: DataFrame, granularity: Granularity, mapping: Callable[[Column], Column] | None = None) -> DataFrame:
    """Source rows that fall into due target stamps; a semi-join on the bucket, or with a mapping one row for each stamp it counts for."""
    due_ = targets.select(F.col("timestamp").alias("__target"))
    placed = source.select("*", _targets(F.col("timestamp"), granularity, mapping).alias("__target"))
    kept = placed.join(due_, "__target", "left_semi")
    return kept.withColumnRenamed("__target", "target_timestamp") if mapping else kept.drop("__target")


def rematerialize(target: DataFrame, made: DataFrame, targets: DataFrame) -> DataFrame:
    """The target with all due stamps replaced; a stamp that no longer has rows is emptied."""
    return target.join(targets.select("timestamp").distinct(), "timestamp", "left_anti").select(target.columns).unionByName(made.select(target.columns))


class State:
    """What is known of modifications and of what was made from them, in a folder that all executors share.

    `modified` holds when each part's timestamp was last modified, whatever
    batch told it; `processed` the fingerprint each target stamp was last made
    from. Both are stored by months of 30 days of the timestamp.
    """

    SPAN = Granularity(30 * 86_400)

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.modified = PartitionedTable(spark, f"{root}/modified", "part string, timestamp timestamp, last timestamp")
        self.processed = PartitionedTable(spark, f"{root}/processed", "target string, timestamp timestamp, processed string, job bigint")
        self.errors: dict[str, str] = {}

    def add(self, log: DataFrame, _: int = 0) -> None:
        """Take log entries in; once more changes nothing."""
        folded = fold_modified(log.where(F.col("timestamp").isNotNull())).select("part", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("last").cast("timestamp").alias("last"))
        self.modified.append(folded.withColumn("__day", partition_index(F.col("timestamp"), self.SPAN)), "__day", ["part", "timestamp"])

    def take(self, log_path: str, reset: bool = False) -> None:
        """Take in what was added to a log since it was last read; reset: all of it, anew."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(log_path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return
        if reset:
            self.modified.drop(list(self.modified.snapshot().entries))
            return self.add(self.spark.read.schema(LOG).parquet(log_path))
        log = self.spark.readStream.schema(LOG).parquet(log_path)
        log.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.root}/log-read").trigger(availableNow=True).start().awaitTermination()

    def folded(self) -> DataFrame:
        """When each part's timestamp was last modified: part, timestamp, last."""
        return self.modified.read().groupBy("part", "timestamp").agg(F.max("last").alias("last"))

    def targets(self, m: Materialization) -> DataFrame:
        """The target stamps of a materialization with their fingerprints, now and as last made from."""
        now = m.fingerprint(self.folded()).withColumn("target", F.lit(m.name)) if m.fingerprint else fingerprints(self.folded(), m.sources, m.granularity, m.name, m.mapping)
        done = self.processed.stored(self.processed.snapshot()).where(F.col("target") == m.name)
        done = done.groupBy("timestamp").agg(F.max_by("processed", "__seq").alias("processed"))
        return now.join(done, "timestamp", "left").select("target", "timestamp", "max_modified", "fingerprint", "processed")

    def due(self, m: Materialization, now: datetime | None = None, reset: bool = False, newest_first: bool = True, most: int = 0) -> DataFrame:
        """The target stamps of a materialization that are to be made."""
        state = self.targets(m)
        if m.reprocessing is not None:
            state = state.where(F.col("max_modified") <= F.col("timestamp") + _interval(m.reprocessing))
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        return due(state, at, _interval(m.processing_delay), reset=reset, newest_first=newest_first, most=most)

    def run(self, materializations: list[Materialization], source: Callable, write: Callable, now: datetime | None = None, reset: bool = False, newest_first: bool = True, most: int = 0) -> dict[str, int]:
        """Make what is due of each enabled materialization; how many stamps, or -1 where it failed (see errors) and others went on.

        source: (materialization, part) -> DataFrame or table with `between`,
        of which only the due stamps' stretch of time is read. write:
        (materialization, rows, stamps, first, last, job) must put the rows in
        place of those stamps.
        """
        out: dict[str, int] = {}
        for m in materializations:
            if not m.enabled:
                continue
            try:
                out[m.name] = self._run(m, source, write, now, reset, newest_first, most)
            except Exception as error:  # noqa: BLE001
                out[m.name] = -1
                self.errors[m.name] = str(error).splitlines()[0]
        return out

    def _run(self, m: Materialization, source: Callable, write: Callable, now, reset, newest_first, most) -> int:
        stamps = cut(self.due(m, now, reset, newest_first, most))
        first, last, number = stamps.agg(F.min("timestamp"), F.max("timestamp"), F.count(F.lit(1))).first()
        if not number:
            return 0
        parts = {}
        for part in m.sources:
            held = source(m, part)
            if m.mapping is None:
                # the first stamp's bucket begins one granularity before it
                begin, end = F.lit(m.granularity.add(first, -1)).cast("timestamp"), F.lit(last).cast("timestamp")
                held = held.between(begin, end) if isinstance(held, PartitionedTable) else held.where((F.col("timestamp") > begin) & (F.col("timestamp") <= end))
            elif isinstance(held, PartitionedTable):
                held = held.read()
            parts[part] = rows_of_targets(held, stamps, m.granularity, m.mapping)
        rows = parts if m.by_part else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
        job = self.processed.snapshot().version + 1
        write(m, m.make(rows), stamps, first, last, job)
        made = stamps.select("target", "timestamp", F.col("fingerprint").alias("processed"), F.lit(job).cast("bigint").alias("job"))
        self.processed.append(made.withColumn("__day", partition_index(F.col("timestamp"), self.SPAN)), "__day", ["target", "timestamp"])
        return number


def _interval(span: timedelta) -> Column:
    return F.expr(f"INTERVAL {int(span.total_seconds())} SECONDS")


class LiveMonitor:
    """A streaming query over the modified log that keeps derived parts up to date.

    Each batch of log entries is added to the state, then what is due is made:
    a stamp whose sources have not rested for the delay is made by a later
    batch, or by `work`, which makes what is due without new entries.
    read: part -> DataFrame or table; write: (materialization, rows, target
    stamps). Checkpoints make it resume where it stopped; making a stamp twice
    gives the same rows. now: the time by which to judge (None: the clock).
    """

    def __init__(self, spark: SparkSession, log_path: str, checkpoint: str, materializations: list[Materialization], read: Callable, write: Callable[[Materialization, DataFrame, DataFrame], None], now: Callable[[], datetime] | None = None, most: int = 0):
        self.spark, self.log_path, self.checkpoint = spark, log_path, checkpoint
        self.materializations, self.read, self.write = materializations, read, write
        self.now, self.most, self.state = now, most, State(spark, f"{checkpoint}-state")

    def work(self) -> dict[str, int]:
        """Make what is due."""
        return self.state.run(self.materializations, lambda _, part: self.read(part), lambda m, rows, stamps, *_: self.write(m, rows, stamps), self.now() if self.now else None, most=self.most)

    def batch(self, log: DataFrame, _: int) -> None:
        self.state.add(log)
        self.work()

    def start(self, every: str | None = None, files: int | None = None) -> StreamingQuery:
        """Run on a trigger interval, or without one over what is there."""
        reader = self.spark.readStream.schema(LOG)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        writer = reader.parquet(self.log_path).writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def retained(now: datetime, retention: timedelta, size: timedelta) -> datetime:
    """Partitions begun before this time may go."""
    return now - retention - 2 * size
