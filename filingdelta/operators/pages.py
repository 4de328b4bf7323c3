"""Page ranges, text sufficiency, extraction route, samples and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filingdelta.functions.text import filled
from filingdelta.operators.intake import effective_type

# Limits of the text sample, the sufficiency test and the previews.
SAMPLE_PAGES, SAMPLE_CHARS, MIN_CHARS_PER_PAGE = 5, 64_000, 50
PREVIEW_PAGES, PREVIEW_CHARS, PREVIEW_TABLES, PREVIEW_ROWS = 10, 500, 5, 5
INSUFFICIENT_TEXT = "Insufficient text content detected"


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))


def page_range(pages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of each requested range (1-based, inclusive), and the invalid requests.

    ``requests``: (document_id, start_page, end_page), one per document.
    """
    checked = requests.join(page_counts(pages), "document_id", "left").withColumn(
        "total_pages", F.coalesce("total_pages", F.lit(0))
    )
    invalid = (F.col("start_page") < 1) | (F.col("end_page") > F.col("total_pages")) | (
        F.col("start_page") > F.col("end_page")
    )
    message = F.format_string(
        "Invalid page range: %d-%d (total: %d)", "start_page", "end_page", "total_pages"
    )
    errors = checked.where(invalid).withColumn("error", message)
    valid = checked.where(~invalid).select("document_id", "start_page", "end_page")
    chosen = pages.join(valid, "document_id").where(
        F.col("page_number").between(F.col("start_page"), F.col("end_page"))
    )
    return chosen.drop("start_page", "end_page"), errors


def text_sufficiency(docs: DataFrame, pages: DataFrame, threshold: float = MIN_CHARS_PER_PAGE) -> DataFrame:
    """Average characters per page of the joined text, newline separators included."""
    sums = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.length("text")).alias("_chars"),
    )
    n = F.coalesce("page_count", F.lit(0))
    average = F.coalesce(F.try_divide(F.col("_chars") + n - 1, n), F.lit(0.0))
    return (
        docs.select("document_id")
        .join(sums, "document_id", "left")
        .select("document_id", n.alias("page_count"), average.alias("avg_chars"))
        .withColumn("sufficient", F.col("avg_chars") >= threshold)
        .withColumn("error", F.when(~F.col("sufficient"), INSUFFICIENT_TEXT))
    )


def extraction_route(docs: DataFrame, text: DataFrame, vision: DataFrame, tables: DataFrame) -> DataFrame:
    """Which result each document keeps.

    ``text``, ``vision`` and ``tables`` hold (document_id, success); a document
    without a row failed that step. Sections need a type and successful text.
    """
    out = docs
    for name, step in (("text_ok", text), ("vision_ok", vision), ("tables_ok", tables)):
        out = out.join(
            step.select("document_id", F.col("success").alias(name)), "document_id", "left"
        ).withColumn(name, F.coalesce(name, F.lit(False)))
    return (
        out.withColumn("use_vision", ~F.col("text_ok") & F.col("vision_ok"))
        .withColumn("extraction_method", F.when(F.col("use_vision"), "vision").otherwise("text"))
        .withColumn("keep_pages", F.col("text_ok"))
        .withColumn("keep_tables", F.col("tables_ok"))
        .withColumn("detect_sections", F.col("text_ok") & filled(effective_type()).isNotNull())
    )


def text_sample(pages: DataFrame, n_pages: int = SAMPLE_PAGES, n_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Leading pages that have text, joined by newlines and cut to the sample size.

    Each page is cut before it is shuffled: no more of it can reach the sample.
    """
    head = pages.where((F.col("page_number") <= n_pages) & (F.col("text") != "")).select(
        "document_id", "page_number", F.substring("text", 1, n_chars).alias("text")
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"])
    return head.groupBy("document_id").agg(
        F.substring(F.array_join(parts, "\n"), 1, n_chars).alias("text_sample")
    )


def page_previews(pages: DataFrame, n_pages: int = PREVIEW_PAGES, n_chars: int = PREVIEW_CHARS) -> DataFrame:
    """First pages of each document with the start of their text."""
    return pages.where(F.col("page_number") <= n_pages).select(
        "document_id", "page_number", F.length("text").alias("char_count"),
        F.substring("text", 1, n_chars).alias("preview"),
    )


def table_previews(grids: DataFrame, n_tables: int = PREVIEW_TABLES, n_rows: int = PREVIEW_ROWS) -> DataFrame:
    """First tables of each document with their first rows; the limit is applied before the shuffle."""
    order = Window.partitionBy("document_id").orderBy("page_number", "table_index")
    return (
        grids.select(
            "document_id", "page_number", "table_index",
            F.size("rows").alias("row_count"), F.slice("rows", 1, n_rows).alias("rows"),
        )
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= n_tables)
    )
