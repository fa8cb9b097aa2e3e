"""Triggers: indicators against thresholds, and the notifications that follow."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigurationError
from tidemark.operators.relations import numbered


@dataclass(frozen=True)
class Trigger:
    """A rule over indicator rows.

    indicators: names that the rows must have. thresholds: name -> value,
    available to the expressions as columns. condition, weight, details, data
    and tags are Spark SQL expressions over both.
    """

    name: str
    indicators: tuple[str, ...]
    thresholds: dict[str, float] = field(default_factory=dict)
    condition: str = "true"
    weight: str = "1"
    details: str = "''"
    data: str = "'{}'"
    rule_id: int = 1
    enabled: bool = True

    def joined(self, rows: DataFrame) -> DataFrame:
        """Indicator rows with the thresholds beside them."""
        missing = set(self.indicators) - set(rows.columns)
        if missing:
            raise ConfigurationError(f"trigger {self.name} lacks indicators: {sorted(missing)}")
        return rows.withColumns({n: F.lit(v) for n, v in self.thresholds.items()})

    def notifications(self, rows: DataFrame, created: Column | None = None) -> DataFrame:
        """A notification for each row that meets the condition; a condition that is null is not met. A disabled trigger gives none."""
        met = self.joined(rows).where(F.expr(self.condition) & F.lit(self.enabled))
        return met.select(
            "entity_id",
            "timestamp",
            F.lit(self.rule_id).alias("rule_id"),
            F.expr(self.details).cast("string").alias("details"),
            F.expr(self.data).cast("string").alias("data"),
            F.expr(self.weight).cast("int").alias("weight"),
            (created if created is not None else F.current_timestamp()).alias("created"),
        )


def weights(*cases: tuple[str, int], otherwise: int) -> str:
    """A CASE of weights; the first that holds wins."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {weight}" for condition, weight in cases) + f" ELSE {otherwise} END"


def notification_sets(notifications: DataFrame, keys: list[str], at: str = "timestamp") -> DataFrame:
    """Notifications that belong together: first and last time of each key."""
    return notifications.groupBy(*keys).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("notifications"))


def flattened(records: DataFrame, kinds: dict) -> DataFrame:
    """Records in the types of a store's columns; maps, structs and lists as JSON text where the store holds text."""
    return records.select(*((F.to_json(c) if kinds[c].typeName() == "string" and records.schema[c].dataType.typeName() in ("map", "struct", "array") else F.col(c)).cast(kinds[c]).alias(c) for c in records.columns if c in kinds and c != "id"))


def in_order(records: DataFrame) -> list[str]:
    """The columns by which records are numbered: entity, time, then all others."""
    first = [c for c in ("entity_id", "timestamp") if c in records.columns]
    return first + [c for c in records.columns if c not in first]


def append(store: DataFrame, records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The notification store with records added; ids go on from the greatest without a gap, by `order` (else entity, time and the rest)."""
    kinds = {f.name: f.dataType for f in store.schema}
    start = store.agg(F.max("id")).first()[0] or 0
    flat = flattened(records, kinds)
    return store.unionByName(numbered(flat, order or in_order(flat), start).select("id", *flat.columns), allowMissingColumns=True)
