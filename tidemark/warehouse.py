"""Stored parts, attributes, notifications, entities and logs under one root folder, and the way of a file into them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, part_schema
from tidemark.errors import ConfigurationError, NoSuchAttribute, NoSuchTrendStore
from tidemark.functions import datatypes
from tidemark.functions.datatypes import spark_type
from tidemark.functions.granularity import parse, partition_index
from tidemark.model import Attribute
from tidemark.operators import attributes, package, relations, store, triggers
from tidemark.operators.tables_on_disk import Conflict, Entry, PartitionedTable, Versioned, folded
from tidemark.session import written
from tidemark.sources.csv import CsvPackage
from tidemark.streaming.incremental import Materialization, State

ENTITIES = "id bigint, name string, created timestamp, entity_type_id int"
ALIASES = "alias_type string, alias string, entity_id bigint"
RELATION = "source_id bigint, target_id bigint"
LOG = "part string, timestamp timestamp, modified timestamp"


@dataclass
class Statistics:
    """What a load stored: rows of each part, and the partitions that changed."""

    job: int
    rows: dict[str, int]
    partitions: dict[str, list[int]]


class AttributeTable(PartitionedTable):
    """The history of a store's attributes, in buckets of entities, and beside it the current row of each entity.

    What is stored are the staged rows, folded on reading: a known entity and
    time is updated and its `modified` set anew. The current table is made
    when asked for, from the buckets stored to since.
    """

    BUCKETS = 64
    KEYS = ("entity_id", "timestamp")

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str]):
        named = ", ".join(f"`{c}` {t}" for c, t in columns.items())
        schema = "entity_id bigint, timestamp timestamp, modified timestamp" + (f", {named}" if named else "")
        super().__init__(spark, f"{path}/history", schema)
        self.now = PartitionedTable(spark, f"{path}/current", schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("entity_id"), F.lit(self.BUCKETS))

    def store(self, staged: DataFrame, modified: Column | None = None, order: list[Column] | None = None) -> list[int]:
        """Take staged rows in; without rows or attributes nothing is stored. Of several rows of a key the last by `order` (else the greatest) counts."""
        keys = list(self.KEYS)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], self.schema).schema}
        own = [c for c in staged.columns if c in kinds and c not in (*keys, "modified")]
        if not own:
            return []
        placed = staged.where(F.col("entity_id").isNotNull() & F.col("timestamp").isNotNull())
        rows = placed.select(*keys, *(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in own), *(o.alias(f"__by{i}") for i, o in enumerate(order or [])))
        last = store.latest(rows, keys, [F.col(f"__by{i}") for i in range(len(order or []))] or [F.col(f"`{c}`") for c in own])
        stamped = last.select(*keys, (modified if modified is not None else F.current_timestamp()).cast("timestamp").alias("modified"), *own)
        return self.append(stamped.withColumn("__bucket", self._bucket()), "__bucket", keys)

    def history(self) -> DataFrame:
        """All rows that count."""
        return folded(self.stored(self.snapshot()), list(self.KEYS))

    def compact(self) -> None:
        """Rows that repeat the values of the row before go; the first of equal rows stays."""
        made = lambda rows: attributes.compact(folded(rows, list(self.KEYS))).withColumn("__bucket", self._bucket())
        self.rewrite(sorted(self.snapshot().entries), made, "__bucket", list(self.KEYS))

    def with_end(self) -> DataFrame:
        """The history with the end of each row's validity."""
        return attributes.with_end(self.history())

    def stale(self) -> list[int]:
        """Buckets stored to since their current rows were made."""
        made = self.now.snapshot().entries
        last = {p: own[-1].seq for p, own in self.snapshot().entries.items()}
        known = {p: int(own[-1].columns[-1].removeprefix("seq:")) if own and own[-1].columns else 0 for p, own in made.items()}
        return sorted(p for p, seq in last.items() if known.get(p, 0) < seq)

    def refresh(self) -> list[int]:
        """Make the current rows of stale buckets anew."""
        buckets = self.stale()
        if buckets:
            now = self.snapshot()
            rows = attributes.current(folded(self.stored(now, buckets), list(self.KEYS)))
            names = rows.columns
            new = self.now.write(rows.withColumn("__bucket", self._bucket()), "__bucket", ["entity_id"])
            entries = {p: [Entry(new[p], 0, (*names, f"seq:{now.entries[p][-1].seq}"))] for p in buckets if p in new}
            self.now.commit(lambda held, _: {p: own for p, own in held.items() if p not in buckets} | entries)
        return buckets

    def current(self) -> DataFrame:
        """The current row of each entity, as last made."""
        return self.now.read()


class Warehouse:
    """Tables of a catalogue's stores. The root must be a folder that all executors share.

    Any number of writers may store at once; readers are never disturbed.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None):
        self.spark, self.root = spark, root
        self.catalog = catalog if catalog is not None else self._kept()

    # the catalogue

    def _kept(self) -> Catalog:
        return Catalog.from_text(Versioned(self.spark, f"{self.root}/catalog").newest()[1])

    def save_catalog(self) -> None:
        """Write the definitions beside the data."""
        Versioned(self.spark, f"{self.root}/catalog").update(lambda *_: self.catalog.to_text())

    def change(self, make: Callable[[Catalog], Any]) -> Any:
        """Change the stored catalogue; made anew on the newer one where another was first. Returns what `make` gives."""
        out = []

        def text(old: str, _: int) -> str:
            catalog = Catalog.from_text(old)
            out.append(make(catalog))
            self.catalog = catalog
            return catalog.to_text()

        Versioned(self.spark, f"{self.root}/catalog").update(text)
        return out[-1]

    # jobs

    def start_job(self, description: dict) -> int:
        """A new job's number; its begin is logged."""
        job = Versioned(self.spark, f"{self.root}/job/number").update(lambda text, _: str(int(text or 0) + 1))
        self._job(job, "started", description)
        return job

    def end_job(self, job: int) -> None:
        self._job(job, "finished", None)

    def _job(self, job: int, event: str, description: dict | None) -> None:
        line = json.dumps({"job": job, "event": event, "at": datetime.now(UTC).isoformat(), "description": None if description is None else json.dumps(description, sort_keys=True)})
        Versioned(self.spark, f"{self.root}/job/log").put(2 * job + (event == "finished"), line)

    def jobs(self) -> DataFrame:
        """The job log: id, description, started, finished (null while it runs, or failed)."""
        rows = self.spark.read.schema("job bigint, event string, at string, description string").json(f"{self.root}/job/log/*.json")
        at = lambda event: F.max(F.when(F.col("event") == event, F.to_timestamp("at")))
        return rows.groupBy(F.col("job").alias("id")).agg(F.max("description").alias("description"), at("started").alias("started"), at("finished").alias("finished"))

    # entities and relations

    def part(self, name: str) -> store.TrendTable:
        own, part = self.catalog.part(name)
        return store.TrendTable(self.spark, f"{self.root}/trend/{name}", part_schema(part), parse(own.partition_size))

    def _entities(self, entity_type: str) -> PartitionedTable:
        return PartitionedTable(self.spark, f"{self.root}/entity/{entity_type.lower()}", ENTITIES)

    def entities(self, entity_type: str) -> DataFrame:
        return self._entities(entity_type).read()

    def add_entities(self, entity_type: str, names: DataFrame, name: str = "name", created: Column | None = None) -> None:
        """Make entities for names that are new; names that someone else makes at the same time become one entity."""
        table = self._entities(entity_type)
        while True:
            base = table.snapshot()
            known = table.stored(base).drop("__seq", "__columns")
            new = table.write(relations.new_entities(known, names, name, created).withColumn("__p", F.lit(0)), "__p", ["name"])
            if not new:
                return
            try:
                table.commit(lambda held, seq, base=base, new=new: _unless_changed(held, base.entries, {0: [*base.entries.get(0, []), Entry(new[0], seq)]}))
                return
            except Conflict:
                continue

    def relation(self, name: str) -> DataFrame:
        """The pairs of a relation as last filled."""
        return PartitionedTable(self.spark, f"{self.root}/relation/{name}", RELATION).read()

    def fill_relation(self, name: str, query: DataFrame) -> None:
        """Fill a relation anew from its query."""
        table = PartitionedTable(self.spark, f"{self.root}/relation/{name}", RELATION)
        new = table.write(relations.refresh(query).withColumn("__p", F.lit(0)), "__p")
        table.commit(lambda _, seq: {p: [Entry(f, seq)] for p, f in new.items()})

    # logs

    def log(self) -> DataFrame:
        """The log of what was modified."""
        return self.spark.read.schema(LOG).parquet(self.log_path())

    def log_path(self) -> str:
        return f"{self.root}/modified_log"

    def state(self) -> State:
        """What is known of modifications and of what was made from them."""
        return State(self.spark, f"{self.root}/materialization")

    # storing

    def store(self, df: DataFrame, data_source: str, entity_type: str, granularity: str, transform: Callable[[DataFrame], DataFrame] | None = None, description: dict | None = None, order: list[Column] | None = None) -> Statistics:
        """Store a package with a column `entity` of names: new entities are made, trends go to their parts.

        Trends that no part defines are left out. Every distinct timestamp of
        a part is logged as modified. The source is read once: the package is
        written to the shared folder with its entities resolved.
        """
        definition = self.catalog.trend_store(data_source, entity_type, granularity)
        job = self.start_job(description or {"data_source": data_source})
        rows = written(transform(df) if transform else df, "package")
        self.add_entities(entity_type, rows.select("entity"), "entity")
        resolved = relations.resolve(rows, self.entities(entity_type), "entity").drop("entity")
        parts = package.route(resolved, definition.parts_by_trend())
        number = rows.count() if parts else 0
        partitions = {name: self.part(name).store(own, job, order) for name, own in parts.items()}
        for name in parts:
            store.modified_log(rows, name).write.mode("append").parquet(self.log_path())
        self.end_job(job)
        return Statistics(job, dict.fromkeys(parts, number), partitions)

    def load(self, path: str | list[str], form: CsvPackage, data_source: str, strict: bool = True) -> Statistics:
        """Read files and store what they hold."""
        df = form.read(self.spark, path, strict=strict)
        return self.store(df, data_source, form.entity_type, form.granularity, description={"data_source": data_source, "files": path})

    def load_many(self, files: dict[str, CsvPackage], data_source: str, stop_on_missing: bool = False) -> dict[str, Statistics | str]:
        """Load several files; one whose store is missing is reported and passed over, or stops all."""
        out: dict[str, Statistics | str] = {}
        for path, form in files.items():
            try:
                out[path] = self.load(path, form, data_source)
            except NoSuchTrendStore as error:
                if stop_on_missing:
                    raise
                out[path] = f"no trend store: {error}"
        return out

    def clear(self, part: str, at: datetime) -> None:
        """Rows of one timestamp of a part go."""
        table = self.part(part)
        index = self.spark.range(1).select(partition_index(F.lit(at).cast("timestamp"), table.size)).first()[0]
        table.remove([index], F.col("timestamp") == F.lit(at).cast("timestamp"))

    def remove_old(self, now: datetime, pretend: bool = False) -> dict[str, list[int]]:
        """Let partitions go that the retention of their store does not keep; returns them by part."""
        out = {}
        for own in self.catalog.trend_stores.values():
            if not own.retention_period:
                continue
            size, kept = parse(own.partition_size), parse(own.retention_period)
            limit = size.add(size.add(kept.add(now, -1), -1), -1)
            first = self.spark.range(1).select(partition_index(F.lit(limit).cast("timestamp"), size)).first()[0]
            for p in own.parts:
                table = self.part(p.name)
                out[p.name] = sorted(i for i in table.snapshot().entries if i < first) if pretend else table.drop_before(first)
        return out

    # attributes and notifications

    def attribute_table(self, name: str) -> AttributeTable:
        if name not in self.catalog.attribute_stores:
            raise NoSuchAttribute(f"no attribute store {name}")
        own = self.catalog.attribute_stores[name]
        return AttributeTable(self.spark, f"{self.root}/attribute/{name}", {a.name: spark_type(a.data_type) for a in own.attributes})

    def store_attributes(self, name: str, df: DataFrame, modified: Column | None = None, order: list[Column] | None = None) -> int:
        """Store a package of attributes with a column `entity` of names or `entity_id`; returns the job."""
        job = self.start_job({"attribute_store": name})
        if "entity" in df.columns:
            kind = self.catalog.attribute_stores[name].entity_type
            rows = written(df, "package")
            self.add_entities(kind, rows.select("entity"), "entity")
            df = relations.resolve(rows, self.entities(kind), "entity").drop("entity")
        self.attribute_table(name).store(df, modified, order)
        self.end_job(job)
        return job

    def store_texts(self, name: str, df: DataFrame, modified: Column | None = None) -> dict[str, str]:
        """Store attributes that come as texts: each gets the narrowest type that holds all of them, or a wider one that it has. Returns the types."""
        keys = ("entity", "entity_id", "timestamp")
        columns = [c for c in df.columns if c not in keys]
        own = datatypes.infer(df, columns).first().asDict() if columns else {}  # a row of types
        self.change(lambda c: c.add_attributes(name, [Attribute(n, t) for n, t in own.items()]))
        types = {a.name: a.data_type for a in self.catalog.attribute_stores[name].attributes if a.name in own}
        parsed = df.select(*(c for c in df.columns if c in keys), *(datatypes.parse(F.coalesce(F.col(f"`{c}`"), F.lit("")), datatypes.Format(t, null="")).alias(c) for c, t in types.items()))
        self.store_attributes(name, parsed, modified)
        return types

    def refresh_current(self) -> dict[str, list[int]]:
        """Make the current rows of all attribute stores with newer history; returns the buckets made by store."""
        return {name: made for name in sorted(self.catalog.attribute_stores) if (made := self.attribute_table(name).refresh())}

    def _notifications(self, name: str) -> PartitionedTable:
        own = self.catalog.notification_stores.get(name)
        if own is None:
            raise ConfigurationError(f"no notification store {name}")
        kinds = "".join(f", `{a.name}` {'string' if a.data_type in ('json', 'jsonb') else spark_type(a.data_type)}" for a in own.attributes)
        return PartitionedTable(self.spark, f"{self.root}/notification/{name}", f"id bigint, entity_id bigint, timestamp timestamp{kinds}")

    def notifications(self, name: str) -> DataFrame:
        return self._notifications(name).read()

    def notify(self, name: str, records: DataFrame) -> int:
        """Append records; ids go on without a gap, by entity, time and the rest. Returns how many there are."""
        table = self._notifications(name)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], table.schema).schema}
        rows = written(triggers.flattened(records, kinds), "records")
        count = rows.count()
        if count:
            taken = []

            def block(text: str, _: int) -> str:
                taken.append(int(text or 0))
                return str(taken[-1] + count)

            Versioned(self.spark, f"{self.root}/notification/{name}-number").update(block)
            made = relations.numbered(rows, triggers.in_order(rows), taken[-1])
            table.append(made.withColumn("__day", partition_index(F.col("timestamp"), parse("1d"))), "__day", ["entity_id", "timestamp"])
        return count

    def create_notifications(self, trigger: triggers.Trigger, indicators: DataFrame, at: datetime | None = None, created: Column | None = None) -> int:
        """Run a trigger over its indicators, at one time or at all; what meets it goes to its notification store. Returns how many there are; a disabled trigger gives none."""
        definition = self.catalog.triggers[trigger.name]
        if trigger.name in self.catalog.disabled:
            return 0
        rows = indicators if at is None else indicators.where(F.col("timestamp") == F.lit(at).cast("timestamp"))
        return self.notify(definition.notification_store, trigger.notifications(rows, created))

    # what is derived

    def materialize(self, materializations: list[Materialization], now: datetime | None = None, reset: bool = False, newest_first: bool = True, most: int = 0) -> dict[str, int]:
        """Take the log in and make what is due of each materialization into its part; returns how many stamps were made.

        One that fails is reported as -1 and passed over.
        """
        state = self.state()
        state.take(self.log_path())
        return state.run(materializations, lambda m, p: self._source(p), self._made, now, reset, newest_first, most)

    def _source(self, part: str) -> store.TrendTable:
        return self.part(part)

    def _made(self, m: Materialization, rows: DataFrame, stamps: DataFrame, first: datetime, last: datetime, job: int) -> None:
        """Put rows in place of what a part holds for some stamps, all from `first` to `last`."""
        table = self.part(m.name)
        index = lambda c: partition_index(c, table.size)
        touched = [r[0] for r in stamps.select(index(F.col("timestamp")).alias("p")).distinct().collect()]  # partitions
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], table.schema).schema}
        own = [F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items() if c in rows.columns]
        made = written(rows.select(*own).withColumn("created", F.current_timestamp()).withColumn("job_id", F.lit(job).cast("bigint")), "made")

        def replaced(stored: DataFrame) -> DataFrame:
            kept = folded(stored, ["entity_id", "timestamp"], ("created",)).join(stamps.select("timestamp"), "timestamp", "left_anti")
            return kept.unionByName(made, allowMissingColumns=True).withColumn("__index", index(F.col("timestamp")))

        table.rewrite(sorted(touched), replaced, "__index", ["entity_id", "timestamp"])
        store.modified_log(stamps, m.name).write.mode("append").parquet(self.log_path())


def _unless_changed(held: dict[int, list[Entry]], before: dict[int, list[Entry]], new: dict[int, list[Entry]]) -> dict[int, list[Entry]]:
    for p in new:
        if held.get(p, []) != before.get(p, []):
            raise Conflict(f"partition {p}")
    return held | new
