"""Helpers of the training-data operators: settings, tables in the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from filingdelta.session import SETTINGS

BLANKS = " \t\n\x0b\x0c\r"
# Rows and bytes that a Python task holds at once.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that the operators rely on."""
    for key, value in {**SETTINGS, **BATCHES}.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests), one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/llm-shared").rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to a table in the shared folder and read it: lineage ends here, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is empty."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def arrow_map(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: pa.Schema, sql: str | StructType) -> DataFrame:
    """mapInArrow over functions that yield one dict of columns per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return df.mapInArrow(run, sql)
