"""Incremental intake: validate, classify and gate new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from filingdelta.operators.classify import Lexicon, classify
from filingdelta.operators.intake import gate, validate
from filingdelta.operators.pages import SAMPLE_CHARS

UPLOAD_FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """New files below a folder as uploads."""
    return (
        spark.readStream.format("binaryFile").schema(UPLOAD_FILE)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
        .select(
            F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("length").alias("size_bytes"),
            "content", F.lit(None).cast("string").alias("content_type"),
        )
    )


def intake(uploads: DataFrame, lexicon: Lexicon, max_mb: float = 50) -> DataFrame:
    """Validate, classify and gate a batch; a stream does so with each micro-batch.

    Text decoding is outside this library: where the uploads carry a ``text_sample`` of their pages that is classified,
    else the file's leading bytes read as UTF-8. Rejected uploads are not classified.
    """
    checked = validate(uploads, max_mb)
    accepted = F.col("status") == "accepted"
    sample = F.make_valid_utf8(F.substring("content", 1, SAMPLE_CHARS).cast("string"))
    if "text_sample" in uploads.columns:
        sample = F.coalesce("text_sample", sample)
    typed = classify(
        checked.withColumn("text_sample", F.when(accepted, sample)).drop("content"), lexicon
    ).drop("text_sample")
    for name in ("detected_type", "detected_type_label", "detection_confidence", "matched_keywords"):
        typed = typed.withColumn(name, F.when(accepted, F.col(name)))
    gated = gate(typed.withColumn("manual_type", F.lit(None).cast("string")))
    return gated.withColumn(
        "processing_status", F.when(accepted, F.col("processing_status")).otherwise("rejected")
    ).withColumn("queueable", accepted & F.col("queueable")).drop("manual_type")


def run_intake(uploads: DataFrame, lexicon: Lexicon, out: str, checkpoint: str, max_mb: float = 50) -> StreamingQuery:
    """Process what is there and stop; each micro-batch has a folder below ``out``, which a repeated one overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        intake(batch, lexicon, max_mb).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
