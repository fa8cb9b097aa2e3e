"""Queries of the text operators (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import encoding, mixing, spam
from tidemark.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_texts(table(spark, d, "documents"), ["doc_id"])


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).chosen


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target")).shares


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(table(spark, d, "documents")).select("doc_id").dropDuplicates()


QUERIES = {f.__name__: f for f in (p6_ids, p7_chosen, p7_shares, p8_found)}
SQL: dict[str, str] = {}
