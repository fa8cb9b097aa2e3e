"""Entities and the relations between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def numbered(rows: DataFrame, order: list[str], start: int, out: str = "id") -> DataFrame:
    """The rows with numbers after `start` in their order, without a gap, however they are partitioned.

    Rows are numbered within ranges of their order, and a small table of the
    ranges' sizes gives each its start; no window spans all rows.
    """
    # written once, as the ranges drawn might differ if they were drawn twice
    ranged = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    within = cut(ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order))))
    sizes = within.groupBy("__range").agg(F.max("__k").alias("__n"))
    ahead = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    placed = within.join(F.broadcast(ahead), "__range")  # one row for each range
    return placed.withColumn(out, (F.lit(start) + F.col("__ahead") + F.col("__k")).cast("bigint")).drop("__range", "__k", "__ahead")


def new_entities(entities: DataFrame, names: DataFrame, name: str = "name", created: Column | None = None, entity_type_id: int | None = None) -> DataFrame:
    """Entities for the names that are new: id, name, created, entity_type_id.

    Ids follow the greatest known one in the order of names. Null names are no entities.
    """
    new = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().join(entities.select("name"), "name", "left_anti")
    start = entities.agg(F.max("id")).first()[0] or 0
    made = numbered(new, ["name"], start)
    return made.select("id", "name", (created if created is not None else F.current_timestamp()).alias("created"), F.lit(entity_type_id).cast("int").alias("entity_type_id"))


def get_or_create(entities: DataFrame, names: DataFrame, name: str = "name", created: Column | None = None, entity_type_id: int | None = None) -> DataFrame:
    """The entities with those added whose names are new."""
    added = new_entities(entities, names, name, created, entity_type_id)
    kinds = {f.name: f.dataType for f in entities.schema}
    return entities.unionByName(added.select(*(F.col(c).cast(kinds[c]).alias(c) for c in added.columns if c in kinds)), allowMissingColumns=True)


def resolve(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """names with the id of each; null where no entity has it."""
    known = entities.select(F.col("id").alias("entity_id"), F.col("name").alias(name))
    return names.join(known, name, "left")


def resolve_alias(aliases: DataFrame, table: DataFrame, alias_type: str, alias: str = "alias") -> DataFrame:
    """aliases with the id of each in one name space; null where it has none."""
    own = table.where(F.col("alias_type") == alias_type).select(F.col("alias").alias(alias), "entity_id")
    return aliases.join(own, alias, "left")


def refresh(query: DataFrame) -> DataFrame:
    """A relation from the query that fills it: distinct pairs of ids, none null."""
    placed = query.toDF(*(f"__{i}" for i in range(len(query.columns))))
    edges = placed.select(F.col("__0").cast("bigint").alias("source_id"), F.col("__1").cast("bigint").alias("target_id"))
    return edges.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).distinct()


def violations(relation: DataFrame, cardinality: str) -> DataFrame:
    """Ids that break a cardinality: side and id, with how often each occurs."""
    sides = {"one-to-one": ("source_id", "target_id"), "one-to-many": ("target_id",), "many-to-one": ("source_id",)}[cardinality]
    found = None
    for side in sides:
        many = relation.groupBy(F.col(side).alias("id")).count().where(F.col("count") > 1).select(F.lit(side).alias("side"), "id", "count")
        found = many if found is None else found.unionByName(many)
    return found


def virtual_entities(entities: DataFrame, view: DataFrame, created: Column | None = None, entity_type_id: int | None = None) -> DataFrame:
    """The entities with those of a view (column name) added; run twice, nothing changes."""
    return get_or_create(entities, view, "name", created, entity_type_id)
