"""Upload validation, type gating and overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.functions.text import filled, first_filled
from filingdelta.schemas import UNKNOWN_LABEL, UNKNOWN_TYPE, WORKING_STATES

# Limits, file signature and messages.
MAX_FILES, MAX_FILE_MB, BYTES_PER_MB = 5, 50, 1024 * 1024
PDF_SIGNATURE = b"%PDF"
EMPTY_FILE = "The file is empty."
NOT_A_PDF = "Only valid PDF documents can be uploaded."
NO_FILES = "At least one PDF must be provided."
UNSUPPORTED_TYPE = "Unsupported document type override provided."


def is_pdf(content_type: Column, content: Column) -> Column:
    declared = filled(F.lower(content_type))
    right_type = F.coalesce(F.contains(declared, F.lit("pdf")), F.lit(True))
    signature = F.substring(content, 1, len(PDF_SIGNATURE)) == F.lit(PDF_SIGNATURE)
    return right_type & F.coalesce(signature, F.lit(False))


def validate(uploads: DataFrame, max_mb: float = MAX_FILE_MB) -> DataFrame:
    """Collect the errors of each upload; accepted when there are none."""
    size = F.col("size_bytes")
    too_big = F.format_string(
        f"File size %.2fMB exceeds the limit of {max_mb}MB.", size / F.lit(float(BYTES_PER_MB))
    )
    errors = F.array_compact(
        F.array(
            F.when(size == 0, EMPTY_FILE),
            F.when(size > max_mb * BYTES_PER_MB, too_big),
            F.when(~is_pdf(F.col("content_type"), F.col("content")), NOT_A_PDF),
        )
    )
    accepted = F.size("errors") == 0
    return (
        uploads.withColumn("errors", errors)
        .withColumn("status", F.when(accepted, "accepted").otherwise("rejected"))
        .withColumn("processing_status", F.when(accepted, "queued").otherwise("rejected"))
    )


def check_batches(batches: DataFrame, uploads: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Number of files per announced batch and the error that rejects the whole batch."""
    counts = uploads.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"))
    n = F.coalesce("n_files", F.lit(0))
    error = F.when(n == 0, NO_FILES).when(
        n > max_files,
        F.lit(f"Maximum number of files exceeded. Up to {max_files} files are allowed."),
    )
    return batches.select("batch_id").join(counts, "batch_id", "left").select(
        "batch_id", n.alias("n_files"), error.alias("error")
    )


def uploads_in_valid_batches(uploads: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Uploads whose batch keeps the file limit."""
    over = uploads.groupBy("batch_id").count().where(F.col("count") > max_files)
    return uploads.join(over.select("batch_id"), "batch_id", "left_anti")


def effective_type() -> Column:
    return first_filled(F.col("manual_type"), F.col("detected_type"))


def effective_label() -> Column:
    return first_filled(F.col("manual_type_label"), F.col("detected_type_label"))


def is_typed(kind: Column) -> Column:
    return F.coalesce(filled(kind) != UNKNOWN_TYPE, F.lit(False))


def gate(docs: DataFrame) -> DataFrame:
    """Queue documents with a known type; the others wait for a classification."""
    typed = is_typed(effective_type())
    return docs.withColumn(
        "processing_status", F.when(typed, "queued").otherwise("pending_classification")
    ).withColumn("queueable", typed)


def apply_overrides(docs: DataFrame, overrides: DataFrame, supported: DataFrame) -> DataFrame:
    """Set or clear the manual type; an unsupported type leaves the document as it is.

    ``overrides`` has one row per document (document_id, requested_type);
    ``supported`` is (document_type, display_name) and bounded by the catalogue.
    """
    names = supported.select(
        F.col("document_type").alias("requested_type"), F.col("display_name").alias("_display")
    )
    asked = overrides.join(names, "requested_type", "left").select(
        "document_id", "requested_type", "_display", F.lit(True).alias("_asked")
    )
    request = F.col("requested_type")
    is_unknown = F.coalesce(request == UNKNOWN_TYPE, F.lit(False))
    bad = F.col("_asked") & request.isNotNull() & ~is_unknown & F.col("_display").isNull()
    change = F.coalesce(F.col("_asked") & ~bad, F.lit(False))
    label = F.when(is_unknown, F.lit(UNKNOWN_LABEL)).otherwise(F.col("_display"))
    return (
        docs.join(asked, "document_id", "left")
        .withColumn("error", F.when(bad, UNSUPPORTED_TYPE))
        .withColumn("manual_type", F.when(change, request).otherwise(F.col("manual_type")))
        .withColumn("manual_type_label", F.when(change, label).otherwise(F.col("manual_type_label")))
        .withColumn(
            "processing_status",
            F.when(change & is_typed(effective_type()), "queued").otherwise(F.col("processing_status")),
        )
        .drop("requested_type", "_display", "_asked")
    )


def supported_types(types: DataFrame) -> DataFrame:
    return types.where(F.col("document_type") != UNKNOWN_TYPE)


def with_display_name(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Display name of the effective type, the type itself when the catalogue has none."""
    names = types.select("document_type", F.col("display_name").alias("_display"))
    return (
        docs.withColumn("document_type", effective_type())
        .join(names, "document_type", "left")
        .withColumn("display_name", F.coalesce("_display", "document_type"))
        .drop("_display")
    )


def pending(docs: DataFrame, states: Sequence[str] = WORKING_STATES) -> DataFrame:
    """Documents still in a working state."""
    return docs.where(F.col("document_id").isNotNull() & F.col("processing_status").isin(*states))
