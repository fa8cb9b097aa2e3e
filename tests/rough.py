"""Rough copies of the test tables: nulls in every column, repeated rows, extra columns, or no rows at all."""

from pyspark.sql import functions as F

EXTRA = ("instant_us", "period_end", "value", "state", "mean", "kind", "field_name", "faults", "fault", "tokens", "repeats", "reason", "doc", "words", "ids", "shard", "slot", "__row", "__source", "__at")


def rough(spark, source, target, tables, empty=()):
    for name in tables:
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if name in empty:
            df = df.limit(0)
        elif name not in ("v_site", "parser_config", "mix_target"):
            for i, c in enumerate(df.columns):
                df = df.withColumn(c, F.when(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(i)), F.lit(17)) != 0, F.col(c)))
            df = df.unionByName(df.where(F.rand(3) < 0.1))
        held = set(df.columns)
        df.withColumns({c: F.lit("x") for c in EXTRA if c not in held}).coalesce(2).write.parquet(f"{target}/{name}.parquet")
    return str(target)
