"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Blocks of vectors and long texts reach Python in batches that stay small beside a worker, however many a task has.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # A repeated header name in a table record keeps the last cell.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Trees are walked to their leaves, whatever their depth and size.
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build_session(app: str = "filingdelta", master: str | None = None, **extra: str) -> SparkSession:
    """Create or reuse a session; executor sizes and partitions stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may leave it unset; it has one in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return os.path.join(shared_dir(spark), f"filingdelta-{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows to a table in the shared folder and read it back.

    This cuts the lineage: the rows are computed once, whatever number of results
    read them, and stay as they are if executors are lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
