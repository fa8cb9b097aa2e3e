"""Aggregation over time and over entities, and the plans that chain them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.datatypes import aggregate
from tidemark.functions.granularity import Granularity, bucket_end, parse
from tidemark.functions.names import aggregate_part_name


@dataclass(frozen=True)
class Measure:
    """A trend with its type and its aggregates over time and entities."""

    name: str
    type: str = "double precision"
    time: str = "sum"
    entity: str = "sum"

    def over_time(self) -> Column:
        return aggregate(self.time, self.name, self.type).alias(self.name)

    def over_entities(self) -> Column:
        return aggregate(self.entity, self.name, self.type).alias(self.name)


def _samples(df: DataFrame) -> Column:
    return (F.sum("samples") if "samples" in df.columns else F.count(F.lit(1))).cast("bigint").alias("samples")


def time_aggregate(df: DataFrame, measures: list[Measure], granularity: Granularity | str, entity: str = "entity_id", at: str = "timestamp") -> DataFrame:
    """Each entity's aggregates over right-closed buckets, named by their end.

    All buckets in one job. `samples` counts the rows behind a value; it is
    summed where the source has it already.
    """
    g = parse(granularity) if isinstance(granularity, str) else granularity
    bucketed = df.where(F.col(at).isNotNull()).withColumn("__end", bucket_end(F.col(at), g))
    grouped = bucketed.groupBy(F.col(entity), F.col("__end").alias(at))
    return grouped.agg(_samples(df), *(m.over_time() for m in measures if m.name != "samples"))


def time_aggregate_chunk(df: DataFrame, measures: list[Measure], granularity: Granularity | str, end, entity: str = "entity_id", at: str = "timestamp") -> DataFrame:
    """The aggregates of the one bucket that ends at `end`: a range filter that reaches the scan."""
    g = parse(granularity) if isinstance(granularity, str) else granularity
    begin = g.add(end, -1)
    rows = df.where((F.col(at) > F.lit(begin)) & (F.col(at) <= F.lit(end)))
    return rows.groupBy(entity).agg(F.lit(end).alias(at), _samples(df), *(m.over_time() for m in measures if m.name != "samples")).select(entity, at, "samples", *(m.name for m in measures if m.name != "samples"))


def entity_aggregate(df: DataFrame, relation: DataFrame, measures: list[Measure], entity: str = "entity_id", at: str = "timestamp") -> DataFrame:
    """Aggregates over the entities that a relation (source_id, target_id) leads to one target.

    Entities without a target are left out; one with several counts for each.
    The planner broadcasts the relation where its size allows.
    """
    edges = relation.select(F.col("source_id").alias(entity), F.col("target_id").alias("__target"))
    joined = df.join(edges, entity)
    grouped = joined.groupBy(F.col("__target").alias(entity), F.col(at))
    return grouped.agg(_samples(df), *(m.over_entities() for m in measures if m.name != "samples"))


#: The granularities derived from each.
CASCADE = {"15m": ("1h", "1d"), "30m": ("1h", "1d"), "1d": ("1w", "1month")}


@dataclass(frozen=True)
class Step:
    """One derived part: read `source`, aggregate over time or entities into `target`."""

    source: str
    target: str
    kind: str
    granularity: str
    relation: str | None = None


def cascade(part: str, granularity: str, entity_type: str, relations: dict[str, str]) -> list[Step]:
    """The steps that derive all aggregates of a part, in an order in which each finds its source made.

    relations: relation name -> target entity type. Each level is aggregated
    over entities too. A level that has an average is an average of averages.
    """
    steps, todo = [], [(part, granularity)]
    while todo:
        source, level = todo.pop(0)
        for relation, target in relations.items():
            steps.append(Step(source, aggregate_part_name(source, level, target, entity_type), "entity", level, relation))
        for coarser in CASCADE.get(level, ()):
            target = aggregate_part_name(source, coarser)
            steps.append(Step(source, target, "time", coarser))
            todo.append((target, coarser))
    return sorted(steps, key=lambda s: (parse(s.granularity).span(), s.kind != "time"))


def run_cascade(parts: dict[str, DataFrame], steps: list[Step], relations: dict[str, DataFrame], measures: list[Measure]) -> dict[str, DataFrame]:
    """The parts with all that the steps derive; lazy, so Spark plans them together."""
    made = dict(parts)
    for step in steps:
        source = made[step.source]
        made[step.target] = time_aggregate(source, measures, step.granularity) if step.kind == "time" else entity_aggregate(source, relations[step.relation], measures)
    return made


def standard_sources(titles: dict[str, str]) -> list[str]:
    """Names of stores whose title says they hold raw data; only these get the standard aggregates."""
    return [name for name, title in titles.items() if "raw" in title.lower()]
