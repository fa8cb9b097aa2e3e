"""Packages of measurements: choosing, splitting, routing and merging their columns.

A package is a DataFrame with key columns (entity and timestamp) and one
column for each trend.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("entity_id", "timestamp")
#: Columns that every stored part has besides its trends.
SYSTEM = ("entity_id", "timestamp", "created", "job_id")


def trends(df: DataFrame, keys: Iterable[str] = KEYS) -> list[str]:
    """The trend columns of a package or part: all but keys and system columns."""
    return [c for c in df.columns if c not in {*keys, *SYSTEM}]


def filter_trends(df: DataFrame, keep: Callable[[str], bool], keys: Iterable[str] = KEYS) -> DataFrame:
    """The package with the trends that pass; without any, only its keys."""
    return df.select(*keys, *(c for c in trends(df, keys) if keep(c)))


def known_trends(df: DataFrame, defined: Iterable[str], keys: Iterable[str] = KEYS) -> DataFrame:
    """The package without trends that its store does not define."""
    names = set(defined)
    return filter_trends(df, lambda c: c in names, keys)


def split(df: DataFrame, group: Callable[[str], str | None], keys: Iterable[str] = KEYS) -> dict[str, DataFrame]:
    """A package for each group of trends; a trend whose group is None is dropped."""
    columns: dict[str, list[str]] = {}
    for c in trends(df, keys):
        name = group(c)
        if name is not None:
            columns.setdefault(name, []).append(c)
    return {name: df.select(*keys, *own) for name, own in columns.items()}


def route(df: DataFrame, parts: dict[str, str], keys: Iterable[str] = KEYS) -> dict[str, DataFrame]:
    """A package for each part, by a map from trend to part; trends without a part are dropped."""
    return split(df, parts.get, keys)


def matching(column: str, expression: str | None) -> Column:
    """Rows whose text matches from its start; without an expression, all."""
    return F.col(column).rlike(f"^(?:{expression})") if expression else F.lit(True)


def filter_rows_and_trends(df: DataFrame, column: str, entities: str | None, names: str | None, keys: Iterable[str] = KEYS) -> DataFrame:
    """Rows whose entity and trends whose name match regular expressions."""
    import re

    kept = df.where(matching(column, entities))
    return filter_trends(kept, lambda c: not names or re.match(names, c) is not None, keys)


def merge(packages: list[DataFrame], keys: Iterable[str] = KEYS) -> DataFrame:
    """One package of several: rows of one key become one.

    A later package overwrites the trends that it has, with its nulls too;
    trends it lacks keep their values; trends that no package has for a key
    are null. Columns come in the order first seen. One union, one partial
    aggregation by key.
    """
    keys = list(keys)
    names = list(dict.fromkeys(c for p in packages for c in p.columns if c not in keys))
    rows = []
    for number, package in enumerate(packages):
        held = [F.struct(F.lit(number).alias("at"), F.col(f"`{c}`").alias("value")).alias(c) if c in package.columns else None for c in names]
        rows.append(package.select(*keys, *(h for h in held if h is not None)))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    last = union.groupBy(*keys).agg(*(F.max_by(F.col(f"`{c}`"), F.col(f"`{c}`.at")).alias(c) for c in names))
    return last.select(*keys, *(F.col(f"`{c}`.value").alias(c) for c in names))


def timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """The distinct timestamps of a package."""
    return df.select(column).distinct()
