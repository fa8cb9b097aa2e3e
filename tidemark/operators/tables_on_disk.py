"""Tables in Parquet that several writers change at once, partition by partition."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import TidemarkError

#: Times that a change of the manifest is tried before giving up.
ATTEMPTS = 200


class Conflict(TidemarkError):
    """Someone else changed the same partitions first."""


@dataclass(frozen=True)
class Entry:
    """A folder with rows of one partition; of several the one of the greater seq was stored later."""

    folder: str
    seq: int
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Snapshot:
    """What a table consists of at one version of its manifest."""

    version: int
    entries: dict[int, list[Entry]]


class Versioned:
    """A text in numbered versions under a folder. The next one is put in place only if nobody has put one there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> tuple[int, str]:
        """The last version with its text; 0 and nothing where there is none."""
        while True:
            root, fs = self._file(".")
            names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
            versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]
            if not versions:
                return 0, ""
            path, _ = self._file(f"{max(versions):020d}.json")
            if not fs.exists(path):  # a later one has replaced it
                continue
            file = fs.open(path)
            try:
                return max(versions), self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            finally:
                file.close()

    def put(self, version: int, text: str) -> bool:
        """Put a version in place unless it is there."""
        draft, fs = self._file(f"_{uuid.uuid4().hex}")
        final, _ = self._file(f"{version:020d}.json")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                # a hard link is made by one only
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            return bool(fs.rename(draft, final))
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)

    def update(self, change: Callable[[str, int], str]) -> int:
        """Put what `change` makes of the text in place; it is called anew with the newer text where another writer was first. Returns the version."""
        for attempt in range(ATTEMPTS):
            version, text = self.newest()
            if self.put(version + 1, change(text, version + 1)):
                return version + 1
            time.sleep(random.random() * min(0.02 * (attempt + 1), 1.0))
        raise Conflict(f"{self.path}: no turn in {ATTEMPTS} attempts")

    def forget(self) -> None:
        """Delete all versions but the last."""
        root, fs = self._file(".")
        version, _ = self.newest()
        for status in fs.listStatus(root) if fs.exists(root) else []:
            if status.getPath().getName() != f"{version:020d}.json":
                fs.delete(status.getPath(), False)


class PartitionedTable:
    """Rows by a number, their partition, under one folder.

    Data are written to folders of their own; a numbered manifest names those
    that count. A change is made on the state it was meant for, or again on a
    newer one: readers see a table before or after it, and no writer's change
    is lost. The file system must not let two put one file in place (local
    disks and HDFS do not).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.versions = Versioned(spark, f"{path}/manifest")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    # the manifest

    @staticmethod
    def _parsed(text: str) -> dict[int, list[Entry]]:
        rows = [json.loads(line) for line in text.splitlines()]
        return {r["p"]: [Entry(e["folder"], e["seq"], tuple(e["columns"])) for e in r["entries"]] for r in rows}

    def snapshot(self) -> Snapshot:
        """The table as it is."""
        version, text = self.versions.newest()
        return Snapshot(version, self._parsed(text))

    def manifest(self) -> dict[int, list[str]]:
        """The folders of each partition, in the order in which they were stored."""
        return {p: [e.folder for e in own] for p, own in self.snapshot().entries.items()}

    def commit(self, change: Callable[[dict[int, list[Entry]], int], dict[int, list[Entry]]]) -> int:
        """Put a change of the entries in place. Returns the version."""

        def text(old: str, version: int) -> str:
            new = change(self._parsed(old), version)
            return "".join(json.dumps({"p": p, "entries": [{"folder": e.folder, "seq": e.seq, "columns": list(e.columns)} for e in own]}) + "\n" for p, own in sorted(new.items()) if own)

        return self.versions.update(text)

    # rows

    def read(self, partitions: list[int] | None = None) -> DataFrame:
        """The rows of all partitions, or of some, as they were stored."""
        return self.stored(self.snapshot(), partitions).drop("__seq", "__columns")

    def stored(self, snapshot: Snapshot, partitions: list[int] | None = None) -> DataFrame:
        """The rows of a snapshot with __seq and __columns (those that their folder has) of their entry; columns a folder lacks are null."""
        kinds = T._parse_datatype_string(self.schema)
        wanted = snapshot.entries if partitions is None else {p: snapshot.entries[p] for p in set(partitions) & set(snapshot.entries)}
        by_columns: dict[tuple[str, ...], list[Entry]] = {}
        for own in wanted.values():
            for e in own:
                by_columns.setdefault(e.columns or tuple(kinds.names), []).append(e)
        parts = []
        for columns, own in by_columns.items():
            schema = T.StructType([f for f in kinds.fields if f.name in columns])
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{e.folder}" for e in own))
            versions = sorted({(e.folder.split("/")[0], e.seq) for e in own})
            if len(versions) == 1:
                rows = rows.withColumn("__seq", F.lit(versions[0][1]).cast("bigint"))
            else:
                # the manifest's own size: a row for each folder written
                known = self.spark.createDataFrame(versions, "__folder string, __seq bigint")
                folder = F.regexp_extract(F.col("_metadata.file_path"), "/(v-[0-9a-f]{32})/", 1)
                rows = rows.withColumn("__folder", folder).join(F.broadcast(known), "__folder").drop("__folder")
            parts.append(rows.withColumn("__columns", F.array(*(F.lit(c) for c in columns))))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*kinds.fields, T.StructField("__seq", T.LongType()), T.StructField("__columns", T.ArrayType(T.StringType()))]))
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in kinds.fields if f.name not in whole.columns}
        return whole.withColumns(missing).select(*kinds.names, "__seq", "__columns")

    def write(self, rows: DataFrame, partition: str, order: list[str] | None = None) -> dict[int, str]:
        """Write rows by the column with their partition's number; returns the folder of each, which counts only once it is committed.

        Rows of a partition are brought together as far as a task can hold
        them: one with many is written by several tasks.
        """
        folder = f"v-{uuid.uuid4().hex}"
        placed = rows.withColumnRenamed(partition, "__p").hint("rebalance", "__p")
        placed.sortWithinPartitions("__p", *(order or [])).write.partitionBy("__p").parquet(f"{self.path}/{folder}")
        written, fs = self._file(folder)
        names = [s.getPath().getName() for s in fs.listStatus(written)]
        if not any(n.startswith("__p=") for n in names):
            fs.delete(written, True)
        return {int(n.removeprefix("__p=")): f"{folder}/{n}" for n in names if n.startswith("__p=")}

    def append(self, rows: DataFrame, partition: str, order: list[str] | None = None) -> list[int]:
        """Store rows after those that are there; returns the partitions that they went to. Writers do not wait for each other."""
        new = self.write(rows, partition, order)
        columns = tuple(c for c in rows.columns if c != partition)
        if new:
            self.commit(lambda held, seq: held | {p: [*held.get(p, []), Entry(f, seq, columns)] for p, f in new.items()})
        return sorted(new)

    def rewrite(self, partitions: list[int], make: Callable[[DataFrame], DataFrame], partition: str, order: list[str] | None = None) -> None:
        """Put what `make` gives of their rows in place of some partitions; made anew where one of them was changed meanwhile."""
        for _ in range(ATTEMPTS):
            base = self.snapshot()
            before = {p: base.entries.get(p, []) for p in partitions}
            new = self.write(make(self.stored(base, partitions)), partition, order)
            try:
                return self._exchange(before, new)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: partitions {partitions} kept changing")

    def _exchange(self, before: dict[int, list[Entry]], new: dict[int, str]) -> None:
        """Let the new folders take the place of entries that are still there as they were; later ones stay behind them."""

        def change(held: dict[int, list[Entry]], seq: int) -> dict[int, list[Entry]]:
            for p, own in before.items():
                now = held.get(p, [])
                if now[: len(own)] != own:
                    raise Conflict(f"{self.path}: partition {p}")
                last = own[-1].seq if own else seq
                held[p] = ([Entry(new[p], last)] if p in new else []) + now[len(own) :]
            return held | {p: [Entry(f, seq)] for p, f in new.items() if p not in before}

        self.commit(change)

    def drop(self, partitions: list[int]) -> None:
        """Let partitions go."""
        gone = set(partitions)
        self.commit(lambda held, _: {p: own for p, own in held.items() if p not in gone})

    def vacuum(self) -> list[str]:
        """Delete folders that the manifest does not name, and earlier manifests; not while someone may read or write them."""
        root, fs = self._file(".")
        if not fs.exists(root):
            return []
        now = self.snapshot()
        named = {e.folder.split("/")[0] for own in now.entries.values() for e in own}
        gone = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in named:
                fs.delete(status.getPath(), True)
                gone.append(name)
        self.versions.forget()
        return gone


def folded(rows: DataFrame, keys: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows (with __seq and __columns) as one for each key.

    A column keeps the value that was stored last by someone who had it, a
    null too; those in `first` the one stored first. One partial aggregation.
    """
    kinds = [c for c in rows.columns if c not in ("__seq", "__columns")]
    own = [c for c in kinds if c not in keys]

    def held(c: str):
        value = F.struct(F.col(f"`{c}`").alias("v"))
        if c in first:
            return F.min_by(value, F.when(F.col(f"`{c}`").isNotNull(), F.col("__seq"))).alias(c)
        return F.max_by(value, F.when(F.array_contains("__columns", c), F.col("__seq"))).alias(c)

    return rows.groupBy(*keys).agg(*(held(c) for c in own)).select(*(F.col(k) for k in keys), *(F.col(f"`{c}`.v").alias(c) for c in own)).select(*kinds)
