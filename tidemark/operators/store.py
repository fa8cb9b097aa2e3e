"""Storing packages: upsert by key, the log of what was modified, partitions and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.granularity import Granularity, partition_index
from tidemark.operators.package import KEYS
from tidemark.operators.tables_on_disk import PartitionedTable, folded


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by `order`. A single aggregation that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*(o.alias(f"__o{i}") for i, o in enumerate(order))).alias("__order"), F.struct(*rest).alias("__row"))
    return packed.groupBy(*keys).agg(F.max_by("__row", "__order").alias("__row")).select(*keys, "__row.*").select(df.columns)


def one_each(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row for each key: the last by `order`, without one that of the greatest values, so that the outcome is always one."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return latest(df, keys, order or rest) if order or rest else df.dropDuplicates(keys)


def upsert(table: DataFrame, package: DataFrame, keys: list[str] | None = None, job: int | None = None, now: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """The table after a package is stored.

    Rows of a known key take the package's values in the columns it has, its
    nulls too; columns it lacks keep theirs; `created` stays that of the first
    storing, `job_id` becomes the new one. Of several rows of one key in the
    package the last by `order` counts, without one that of the greatest
    values. Rows with a null in a key are not stored.
    """
    keys = list(keys or KEYS)
    for k in keys:
        package = package.where(F.col(k).isNotNull())
    own = [c for c in package.columns if c not in keys and c in table.columns and c not in ("created", "job_id")]
    fresh = one_each(package, keys, order)
    fresh = fresh.select(*keys, F.struct(F.lit(True).alias("is"), *(F.col(f"`{c}`") for c in own)).alias("__new"))
    old = table.withColumn("__old", F.lit(True))
    joined = old.join(fresh, keys, "full")
    came = F.col("__new").isNotNull()
    kinds = {f.name: f.dataType for f in table.schema}

    def column(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if c == "created":
            return F.coalesce(F.col(c), now if now is not None else F.current_timestamp()).cast(kinds[c]).alias(c)
        if c == "job_id":
            return F.when(came, F.lit(job)).otherwise(F.col(c)).cast(kinds[c]).alias(c)
        return (F.when(came, F.col(f"__new.`{c}`")).otherwise(F.col(f"`{c}`")) if c in own else F.col(f"`{c}`")).cast(kinds[c]).alias(c)

    return joined.select(*(column(c) for c in table.columns))


def insert_missing(table: DataFrame, package: DataFrame, keys: list[str]) -> DataFrame:
    """The table with those rows of the package whose key it lacks."""
    new = one_each(package, keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*(c for c in table.columns if c in new.columns)), allowMissingColumns=True)


def update_existing(table: DataFrame, package: DataFrame, keys: list[str], modified: str | None = None) -> DataFrame:
    """The table with values of the package where it knows the key; `modified` becomes the later of the two."""
    own = [c for c in package.columns if c not in keys]
    other = one_each(package, keys).select(*keys, F.struct(F.lit(True).alias("is"), *own).alias("__new"))
    joined = table.join(other, keys, "left")

    def column(c: str) -> Column:
        if c in keys or c not in own:
            return F.col(c)
        if c == modified:
            return F.greatest(F.col(c), F.col(f"__new.{c}")).alias(c)
        return F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(column(c) for c in table.columns))


def delete_using(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose key occurs in another."""
    return table.join(other.select(*keys), keys, "left_anti")


def modified_log(package: DataFrame, part: str, modified: Column | None = None) -> DataFrame:
    """A log entry for each timestamp that a package stores: part, timestamp, modified."""
    return package.select("timestamp").where(F.col("timestamp").isNotNull()).distinct().select(F.lit(part).alias("part"), "timestamp", (modified if modified is not None else F.current_timestamp()).alias("modified"))


def fold_modified(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """When each part's timestamp was last modified: part, timestamp, last. `known` is an earlier fold."""
    rows = log.select("part", "timestamp", F.col("modified").alias("last"))
    if known is not None:
        rows = rows.unionByName(known.select("part", "timestamp", "last"))
    return rows.groupBy("part", "timestamp").agg(F.max("last").alias("last"))


def clear(table: DataFrame, at: datetime | str) -> DataFrame:
    """The table without the rows of one timestamp."""
    return table.where(~F.col("timestamp").eqNullSafe(F.lit(at)))


def expired(partitions: DataFrame, now: Column, retention: Column, size: Column) -> DataFrame:
    """Partitions (with column `begin`) that retention lets go: begun before now - retention - 2 sizes."""
    return partitions.where(F.col("begin") < now - retention - size - size)


def missing_partitions(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions that should exist and do not."""
    return wanted.join(present.select(*keys), keys, "left_anti")


class TrendTable(PartitionedTable):
    """A part on disk, partitioned by time.

    A package is stored as rows beside those that are there; which of them
    count is settled on reading, and for good once a partition has DELTAS of
    them. So writers do not wait for each other, and what a store writes is
    the package, however large the partition.
    """

    #: Packages in a partition before it is folded.
    DELTAS = 16
    KEYS = ("entity_id", "timestamp")

    def __init__(self, spark: SparkSession, path: str, schema: str, size: Granularity):
        super().__init__(spark, path, schema)
        self.size = size

    def read(self, partitions: list[int] | None = None) -> DataFrame:
        """The rows that count, of all partitions or of some."""
        now = self.snapshot()
        wanted = set(now.entries) if partitions is None else set(partitions) & set(now.entries)
        # a partition of one package has one row for each key already
        plain = [p for p in wanted if len(now.entries[p]) == 1]
        rows = self.stored(now, plain).drop("__seq", "__columns")
        several = sorted(wanted - set(plain))
        return rows.unionByName(self._folded(self.stored(now, several))) if several else rows

    def _folded(self, rows: DataFrame) -> DataFrame:
        return folded(rows, list(self.KEYS), ("created",))

    def between(self, begin: Column, end: Column) -> DataFrame:
        """Rows with begin < timestamp <= end; only the partitions that hold such are read."""
        first, last = self.spark.range(1).select(partition_index(begin, self.size), partition_index(end, self.size)).first()
        return self.read([p for p in self.snapshot().entries if first <= p <= last]).where((F.col("timestamp") > begin) & (F.col("timestamp") <= end))

    def store(self, package: DataFrame, job: int | None = None, order: list[Column] | None = None, now: Column | None = None) -> list[int]:
        """Upsert a package; returns the partitions that changed.

        Of several rows of one key the last by `order` counts; without one,
        the one with the greatest values, so that the outcome is always one.
        """
        keys = list(self.KEYS)
        placed = package.where(F.col("entity_id").isNotNull() & F.col("timestamp").isNotNull())
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        own = [c for c in package.columns if c in kinds and c not in (*keys, "created", "job_id")]
        values = [F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in own]
        rows = latest(placed.select(*keys, *values, *(o.alias(f"__by{i}") for i, o in enumerate(order or []))), keys, [F.col(f"__by{i}") for i in range(len(order or []))] or [F.col(f"`{c}`") for c in own] or [F.lit(0)])
        stamped = rows.select(*keys, *own, (now if now is not None else F.current_timestamp()).cast("timestamp").alias("created"), F.lit(job).cast("bigint").alias("job_id"))
        touched = self.append(stamped.withColumn("__index", partition_index(F.col("timestamp"), self.size)), "__index", keys)
        many = [p for p, own in self.snapshot().entries.items() if len(own) > self.DELTAS]
        if many:
            self.compact(many)
        return touched

    def compact(self, partitions: list[int] | None = None) -> None:
        """Fold the packages of partitions into one folder each."""
        wanted = sorted(self.snapshot().entries) if partitions is None else partitions
        index = partition_index(F.col("timestamp"), self.size)
        self.rewrite(wanted, lambda rows: self._folded(rows).withColumn("__index", index), "__index", list(self.KEYS))

    def remove(self, partitions: list[int], condition: Column) -> None:
        """Rows of some partitions that meet a condition go."""
        index = partition_index(F.col("timestamp"), self.size)
        self.rewrite(partitions, lambda rows: self._folded(rows).where(~F.coalesce(condition, F.lit(False))).withColumn("__index", index), "__index", list(self.KEYS))

    def drop_before(self, index: int) -> list[int]:
        """Let partitions below an index go."""
        gone = sorted(p for p in self.snapshot().entries if p < index)
        if gone:
            self.drop(gone)
        return gone


def current(table: DataFrame, key: str = "entity_id", at: str = "timestamp") -> DataFrame:
    """The latest row of each key; ties go to the greatest values, so the result is one."""
    rest = [F.col(c) for c in table.columns if c not in (key, at)]
    return latest(table, [key], [F.col(at), *rest])


def rank_latest(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same by a window; for rows whose columns cannot be compared."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*(o.desc() for o in order)))
    return table.withColumn("__k", number).where(F.col("__k") == 1).drop("__k")

