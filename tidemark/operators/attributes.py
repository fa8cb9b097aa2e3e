"""Slowly changing attributes: history, compaction, validity and the current view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.datatypes import widens
from tidemark.operators.store import latest, upsert

KEYS = ["entity_id", "timestamp"]


def attributes(history: DataFrame, key: str = "entity_id", at: str = "timestamp") -> list[str]:
    """The attribute columns of a history."""
    return [c for c in history.columns if c not in (key, at, "modified", "end")]


def transfer(history: DataFrame, staged: DataFrame, modified: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """The history with staged rows taken in; a known (entity, timestamp) is updated and its `modified` set anew."""
    stamp = modified if modified is not None else F.current_timestamp()
    return upsert(history, staged.withColumn("modified", stamp), KEYS, order=order)


def sample_view(history: DataFrame, view: DataFrame, at: Column, modified: Column | None = None) -> DataFrame:
    """The history with the rows of a view (entity_id and attributes) taken in as of one time."""
    return transfer(history, view.withColumn("timestamp", at), modified if modified is not None else at)


def compact(history: DataFrame, key: str = "entity_id", order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The history without rows that repeat the values of the row before; the first of equal rows stays."""
    own = columns or attributes(history, key)
    previous = Window.partitionBy(key).orderBy(*(order or ["timestamp"]))
    before = F.lag(F.struct(*own)).over(previous)
    number = F.row_number().over(previous)
    marked = history.withColumn("__same", (number > 1) & before.eqNullSafe(F.struct(*own)))
    return marked.where(~F.col("__same")).drop("__same")


def with_end(history: DataFrame, key: str = "entity_id", order: list[str] | None = None, at: str = "timestamp") -> DataFrame:
    """The history with the end of each row's validity, [timestamp, end); null while it lasts."""
    return history.withColumn("end", F.lead(at).over(Window.partitionBy(key).orderBy(*(order or [at]))))


def current(history: DataFrame, key: str = "entity_id", order: list[str] | None = None) -> DataFrame:
    """The latest row of each entity."""
    return latest(history, [key], [F.col(c) for c in order or ["timestamp"]])


def stale(stores: DataFrame, materialized: DataFrame, name: str = "store") -> DataFrame:
    """Stores modified since their current view was made, or whose view never was: name, modified, materialized."""
    return stores.join(materialized, name, "left").where(F.col("materialized").isNull() | (F.col("modified") > F.col("materialized")))


def widen(history: DataFrame, types: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns added, or cast where the new type holds all of the old. types: name -> (old, new) type names."""
    from tidemark.functions.datatypes import spark_type

    for name, (old, new) in types.items():
        if name not in history.columns:
            history = history.withColumn(name, F.lit(None).cast(spark_type(new)))
        elif widens(old, new):
            history = history.withColumn(name, F.col(name).cast(spark_type(new)))
    return history


def tag_links(attributes_: DataFrame, tags: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """New links of attributes and tags, matched by name with letter case aside.

    attributes_: attribute_id, name; tags: tag_id, name; wanted: attribute,
    tag; known: attribute_id, tag_id.
    """
    a = attributes_.select("attribute_id", F.lower("name").alias("__a"))
    t = tags.select("tag_id", F.lower("name").alias("__t"))
    named = wanted.select(F.lower("attribute").alias("__a"), F.lower("tag").alias("__t"))
    return named.join(a, "__a").join(t, "__t").select("attribute_id", "tag_id").distinct().join(known, ["attribute_id", "tag_id"], "left_anti")
