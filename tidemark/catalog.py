"""The catalogue of definitions: creating, changing, comparing and looking up stores."""

from __future__ import annotations

import copy
import json
from collections import Counter
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError, DuplicateDefinition, NoSuchAttribute, NoSuchTrend, NoSuchTrendStore
from tidemark.functions.datatypes import spark_type, widens
from tidemark.functions.granularity import parse
from tidemark.model import Attribute, AttributeStore, NotificationStore, Part, Relation, Trend, TrendStore, TriggerDefinition, ViewMaterialization


def duplicates(store: TrendStore) -> list[str]:
    """Names that occur more than once among a store's parts, or among a part's trends."""
    parts = Counter(p.name for p in store.parts)
    out = [n for n, k in parts.items() if k > 1]
    for p in store.parts:
        out += [f"{p.name}.{n}" for n, k in Counter([*(t.name for t in p.trends), *(t.name for t in p.generated_trends)]).items() if k > 1]
    return out


def check(store: TrendStore) -> list[str]:
    """What is wrong with a definition, in words."""
    wrong = [f"{n} is defined more than once" for n in duplicates(store)]
    for text in (store.granularity, store.partition_size, *([store.retention_period] if store.retention_period else [])):
        try:
            parse(text)
        except ValueError as error:
            wrong.append(str(error))
    for p in store.parts:
        for t in [*p.trends, *p.generated_trends]:
            try:
                spark_type(t.data_type)
            except ConfigurationError as error:
                wrong.append(f"{p.name}.{t.name}: {error}")
    return wrong


def part_schema(part: Part) -> str:
    """The schema of a stored part: its keys, bookkeeping and trends."""
    trends = [f"`{t.name}` {spark_type(t.data_type)}" for t in part.trends]
    return ", ".join(["entity_id bigint", "timestamp timestamp", "created timestamp", "job_id bigint", *trends])


@dataclass
class Changes:
    """What a change of a part's trends did: names added and removed, and name -> (old, new type)."""

    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    changed: dict[str, tuple[str, str]] = field(default_factory=dict)


class Catalog:
    """Definitions by kind. Names of data sources and entity types are looked up with letter case aside."""

    def __init__(self):
        self.trend_stores: dict[tuple, TrendStore] = {}
        self.attribute_stores: dict[str, AttributeStore] = {}
        self.notification_stores: dict[str, NotificationStore] = {}
        self.relations: dict[str, Relation] = {}
        self.materializations: dict[str, ViewMaterialization] = {}
        self.triggers: dict[str, TriggerDefinition] = {}
        self.entity_types: dict[str, str] = {}
        self.data_sources: dict[str, str] = {}
        self.aliases: dict[str, int] = {}
        self.disabled: list[str] = []
        self.virtual: dict[str, str] = {}
        self.jobs: list[dict[str, Any]] = []

    # kept as text

    #: Kinds of definitions with their class, by the name under which they are held.
    KINDS = {"trend_stores": TrendStore, "attribute_stores": AttributeStore, "notification_stores": NotificationStore, "relations": Relation, "materializations": ViewMaterialization, "triggers": TriggerDefinition}
    NAMES = ("entity_types", "data_sources", "aliases", "disabled", "virtual")

    def to_text(self) -> str:
        """All definitions as JSON; jobs are kept apart."""
        held = {kind: [d.to_dict() for d in getattr(self, kind).values()] for kind in self.KINDS}
        return json.dumps(held | {n: getattr(self, n) for n in self.NAMES}, indent=1)

    @classmethod
    def from_text(cls, text: str) -> Catalog:
        """The catalogue of such a text; an empty one gives an empty catalogue."""
        catalog = cls()
        held = json.loads(text) if text else {}
        for kind, own in cls.KINDS.items():
            for d in held.get(kind, []):
                definition = own.from_dict(d)
                getattr(catalog, kind)[catalog.key(kind, definition)] = definition
        for n in cls.NAMES:
            setattr(catalog, n, held.get(n, getattr(catalog, n)))
        return catalog

    @staticmethod
    def key(kind: str, definition: Any) -> Any:
        """The name under which a definition is held."""
        if kind == "trend_stores":
            return definition.key()
        if kind == "attribute_stores":
            return definition.name()
        return getattr(definition, {"notification_stores": "data_source", "materializations": "target_trend_store_part"}.get(kind, "name"))

    # names

    def data_source(self, name: str) -> str:
        """The data source of a name, made if it is new."""
        return self.data_sources.setdefault(name.lower(), name)

    def entity_type(self, name: str) -> str:
        """The entity type of a name, made if it is new."""
        return self.entity_types.setdefault(name.lower(), name)

    def alias_type(self, name: str) -> int:
        return self.aliases.setdefault(name, len(self.aliases) + 1)

    # trend stores

    def create_trend_store(self, store: TrendStore) -> TrendStore:
        if wrong := check(store):
            raise ConfigurationError("; ".join(wrong))
        if store.key() in self.trend_stores:
            raise DuplicateDefinition("trend store " + "/".join(store.key()))
        taken = {p.name for s in self.trend_stores.values() for p in s.parts}
        if again := taken & {p.name for p in store.parts}:
            raise DuplicateDefinition(f"parts {sorted(again)}")
        self.data_source(store.data_source)
        self.entity_type(store.entity_type)
        self.trend_stores[store.key()] = copy.deepcopy(store)
        return self.trend_stores[store.key()]

    def trend_store(self, data_source: str, entity_type: str, granularity: str) -> TrendStore:
        try:
            return self.trend_stores[data_source.lower(), entity_type.lower(), granularity]
        except KeyError:
            raise NoSuchTrendStore(f"{data_source}/{entity_type}/{granularity}") from None

    def part(self, name: str) -> tuple[TrendStore, Part]:
        for store in self.trend_stores.values():
            for part in store.parts:
                if part.name == name:
                    return store, part
        raise NoSuchTrendStore(f"no part {name}")

    def trend(self, part: str, name: str) -> Trend:
        for t in self.part(part)[1].trends:
            if t.name == name:
                return t
        raise NoSuchTrend(f"{part}.{name}")

    def delete_trend_store(self, store: TrendStore) -> None:
        self.trend_store(*store.key())
        del self.trend_stores[store.key()]

    def missing_parts(self, store: TrendStore) -> list[Part]:
        """Parts of a definition that the catalogue's store lacks."""
        known = {p.name for p in self.trend_store(*store.key()).parts}
        return [p for p in store.parts if p.name not in known]

    def add_parts(self, store: TrendStore) -> list[str]:
        new = self.missing_parts(store)
        self.trend_store(*store.key()).parts += copy.deepcopy(new)
        return [p.name for p in new]

    def add_trends(self, store: TrendStore) -> dict[str, Changes]:
        return self.change_trends(store, remove=False, change="none")

    def remove_trends(self, store: TrendStore) -> dict[str, Changes]:
        """Trends that a definition no longer has are let go."""
        out = {}
        for part in store.parts:
            own = self.part(part.name)[1]
            keep = {t.name for t in part.trends}
            gone = [t.name for t in own.trends if t.name not in keep]
            own.trends = [t for t in own.trends if t.name in keep]
            out[part.name] = Changes(removed=gone)
        return out

    def change_trends(self, store: TrendStore, remove: bool = True, change: str = "upward") -> dict[str, Changes]:
        """Make each part's trends those of a definition. change: none, upward (only to types that hold the old one) or any."""
        out = {}
        for part in store.parts:
            own = self.part(part.name)[1]
            known = {t.name: t for t in own.trends}
            changes = Changes()
            for t in part.trends:
                if t.name not in known:
                    own.trends.append(copy.deepcopy(t))
                    changes.added.append(t.name)
                elif (old := known[t.name].data_type) != t.data_type and (change == "any" or change == "upward" and widens(old, t.data_type)):
                    changes.changed[t.name] = old, t.data_type
                    known[t.name].data_type = t.data_type
            if remove:
                changes.removed = self.remove_trends(TrendStore(store.data_source, store.entity_type, store.granularity, store.partition_size, [part]))[part.name].removed
            out[part.name] = changes
        return out

    # attribute stores

    def create_attribute_store(self, store: AttributeStore) -> AttributeStore:
        if store.name() in self.attribute_stores:
            raise DuplicateDefinition(f"attribute store {store.name()}")
        self.attribute_stores[store.name()] = copy.deepcopy(store)
        return store

    def attribute(self, store: str, name: str) -> Attribute:
        for a in self.attribute_stores[store].attributes:
            if a.name == name:
                return a
        raise NoSuchAttribute(f"{store}.{name}")

    def add_attributes(self, store: str, attributes: list[Attribute]) -> Changes:
        """Attributes that are new are added, those whose type has grown widened."""
        own, changes = self.attribute_stores[store], Changes()
        known = {a.name: a for a in own.attributes}
        for a in attributes:
            if a.name not in known:
                own.attributes.append(copy.deepcopy(a))
                changes.added.append(a.name)
            elif known[a.name].data_type != a.data_type and widens(known[a.name].data_type, a.data_type):
                changes.changed[a.name] = known[a.name].data_type, a.data_type
                known[a.name].data_type = a.data_type
        return changes

    def remove_attribute(self, store: str, name: str) -> None:
        gone = self.attribute(store, name)
        self.attribute_stores[store].attributes.remove(gone)

    # others

    def define(self, kind: str, name: str, definition: Any, replace: bool = False) -> None:
        """A relation, materialization, trigger or notification store."""
        held = getattr(self, kind)
        if name in held and not replace:
            raise DuplicateDefinition(f"{kind}: {name}")
        held[name] = definition

    def update(self, kind: str, name: str, **values: Any) -> None:
        """Change fields of a definition."""
        held = getattr(self, kind)
        if name not in held:
            raise ConfigurationError(f"{kind}: no {name}")
        held[name] = type(held[name]).from_dict(held[name].to_dict() | values)

    def enable(self, trigger: str, on: bool = True) -> None:
        """Let a trigger run, or not."""
        if trigger not in self.triggers:
            raise ConfigurationError(f"no trigger {trigger}")
        self.disabled = sorted({*self.disabled, trigger} - ({trigger} if on else set()))

    def drop(self, kind: str, name: str) -> None:
        if getattr(self, kind).pop(name, None) is None:
            raise ConfigurationError(f"{kind}: no {name}")

    # jobs

    def start_job(self, description: dict) -> int:
        self.jobs.append({"id": len(self.jobs) + 1, "description": json.dumps(description, sort_keys=True), "started": datetime.now(UTC), "finished": None})
        return len(self.jobs)

    def end_job(self, job: int) -> None:
        self.jobs[job - 1]["finished"] = datetime.now(UTC)

    # listings

    def listing(self, spark: SparkSession) -> DataFrame:
        """A row for each trend: data source, entity type, granularity, part, trend, type."""
        rows = [(s.data_source, s.entity_type, s.granularity, p.name, t.name, t.data_type) for s in self.trend_stores.values() for p in s.parts for t in p.trends]
        return spark.createDataFrame(rows, "data_source string, entity_type string, granularity string, part string, trend string, data_type string")

    def report(self, parts: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
        """Rows, entities and latest time of each stored part: one pass over each."""
        out = spark.createDataFrame([], "part string, rows bigint, entities bigint, latest timestamp")
        for name, df in sorted(parts.items()):
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("entity_id").alias("entities"), F.max("timestamp").cast("timestamp").alias("latest")).withColumn("part", F.lit(name)))
        return out
