"""CSV export of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fields may hold line breaks, so a file is read by one task: a larger export is more files, not longer ones.
FILE_ROWS = 10_000


def write_csv(rows: DataFrame, path: str, *partition_by: str) -> None:
    """UTF-8 CSV with a header; a field is quoted only where it must be, quotes are doubled."""
    writer = (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", FILE_ROWS)
    )
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export read back; blank fields are empty strings."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
        .fillna("")
    )
