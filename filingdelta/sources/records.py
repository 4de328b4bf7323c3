"""Document metadata records and comparison results in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filingdelta.schemas import METADATA

REQUIRED = ("document_id", "filename", "stored_path", "size_bytes")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as uploads. File bytes are read only when the content column is used."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("length").alias("size_bytes"), "content", F.lit(None).cast("string").alias("content_type"),
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per file; files that are no valid record are skipped."""
    records = (
        spark.read.schema(METADATA)
        .option("mode", "DROPMALFORMED")
        .option("multiLine", True)
        .json(path)
    )
    return valid_records(records)


def parse_metadata(lines: DataFrame, column: str = "record_json") -> DataFrame:
    """Records held as JSON strings, corrupt ones skipped."""
    raw = F.from_json(F.col(column), f"{METADATA}, _corrupt_record string")
    parsed = lines.select(raw.alias("r")).where("r is not null and r._corrupt_record is null")
    return valid_records(parsed.select("r.*").drop("_corrupt_record"))


def valid_records(records: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for name in REQUIRED:
        ok = ok & F.col(name).isNotNull()
    return records.where(ok)


def list_documents(records: DataFrame) -> DataFrame:
    """Newest first; equal times are ordered by id."""
    return records.orderBy(F.desc("created_at"), "document_id")


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records left after deleting the given ids; absent ids change nothing."""
    return records.join(ids.select("document_id"), "document_id", "left_anti")


def unknown_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids asked to be deleted that no record has: worth a warning."""
    return ids.select("document_id").join(records, "document_id", "left_anti")


def iso_now(now: str) -> Column:
    return F.date_format(F.to_timestamp(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def apply_structured(records: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Overwrite structured data, method and extraction metadata, and bump updated_at.

    ``results``: (document_id, structured_data, extraction_method,
    extraction_metadata), one row per document; null metadata becomes empty.
    """
    empty = F.create_map().cast("map<string,string>")
    new = results.select(
        "document_id", F.col("structured_data").alias("_data"), F.col("extraction_method").alias("_method"),
        F.coalesce("extraction_metadata", empty).alias("_meta"), F.lit(True).alias("_new"),
    )
    has = F.coalesce("_new", F.lit(False))

    def pick(new_col: Column, old: str) -> Column:
        return F.when(has, new_col).otherwise(F.col(old))

    return (
        records.join(new, "document_id", "left")
        .withColumn("structured_data", pick(F.col("_data"), "structured_data"))
        .withColumn("extraction_method", pick(F.col("_method"), "extraction_method"))
        .withColumn("extraction_metadata", pick(F.col("_meta"), "extraction_metadata"))
        .withColumn("updated_at", pick(iso_now(now), "updated_at"))
        .drop("_data", "_method", "_meta", "_new")
    )


def _by_day(rows: DataFrame, by: str) -> DataFrame:
    """Rows of a day together, so that a day gets few files; a busy day is split over tasks."""
    return rows.withColumn("day", F.substring(by, 1, 10)).hint("rebalance", "day")


def write_records(records: DataFrame, path: str, by: str = "created_at") -> None:
    """Parquet, one folder per day of the given timestamp text."""
    _by_day(records, by).write.mode("overwrite").partitionBy("day").parquet(path)


def save_comparison(results: DataFrame, path: str) -> None:
    """Append results; each needs an id. Saving an id again replaces it: readers take the latest save."""
    checked = results.withColumn(
        "comparison_id",
        F.when(
            F.coalesce(F.col("comparison_id"), F.lit("")) == "", F.raise_error(F.lit("comparison_id is required"))
        ).otherwise(F.col("comparison_id")),
    )
    _by_day(checked.withColumn("saved_at", F.current_timestamp()), "created_at").write.mode("append").partitionBy("day").parquet(path)


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """The latest save of each id. A filter on the id reaches the file scan, as it is the grouping key."""
    rows = spark.read.parquet(path).drop("day")
    kept = [name for name in rows.columns if name not in ("comparison_id", "saved_at")]
    latest = rows.groupBy("comparison_id").agg(F.max_by(F.struct(*kept), F.col("saved_at")).alias("r"))
    return latest.select("comparison_id", "r.*")


def load_comparison(spark: SparkSession, path: str, comparison_id: str) -> DataFrame:
    """One stored result; the id filter reaches the file scan. Raises when absent."""
    found = read_comparisons(spark, path).where(F.col("comparison_id") == comparison_id)
    if found.isEmpty():
        raise FileNotFoundError(f"no comparison result {comparison_id!r}")
    return found
