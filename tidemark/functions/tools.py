"""Helpers around queries: tables a query reads, retries, predicates."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Result = TypeVar("Result")


def tables_of(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables and views that a query reads, without running it."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, own = set(), set()
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "UnresolvedRelation":
            found.add(node.tableName())
        if name == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.length()):
                own.add(relations.apply(i)._1())
                todo.append(relations.apply(i)._2())
        for group in (node.children(), node.subqueries()):
            todo += [group.apply(i) for i in range(group.length())]
    return sorted(found - own)


def all_of(conditions: Iterable[Column]) -> Column:
    """Rows that meet every condition; without any, all."""
    return reduce(and_, conditions, F.lit(True))


def equals(**values) -> Column:
    """Rows whose columns have these values; None stands for null."""
    return all_of(F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items())


def retried(run: Callable[[], Result], on: tuple[type[Exception], ...], attempts: int = 3, wait: float = 1.0) -> Result:
    """The result of `run`, tried again after errors of some kinds; the last error is raised."""
    for attempt in range(attempts):
        try:
            return run()
        except on:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait)
    raise ValueError("no attempts")
