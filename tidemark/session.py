"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arithmetic and timestamps must not depend on the machine's clock zone.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings in REQUIRED to a running session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset (local
    tests) a temporary folder of this machine is used.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    _shared(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; nothing is there yet."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table to the shared checkpoint folder and read it from there; what reads it reads only the columns it needs."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
