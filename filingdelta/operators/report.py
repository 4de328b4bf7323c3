"""Report tables: dashboard, filters, ordering, progress, outcomes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.functions.numbers import to_fixed
from filingdelta.functions.ordinals import number_within
from filingdelta.functions.text import any_contains, filled
from filingdelta.operators.intake import effective_type, is_typed

# Searched fields and progress marks.
LISTED_FIELDS = ("section_name", "summary", "doc1_section_name", "doc2_section_name")
COUNTED_FIELDS = ("section_name", "summary")
LOADING_FROM, LOADING_SPAN, ANALYSIS_FROM, ANALYSIS_SPAN, SAVING, DONE = 10, 10, 30, 60, 90, 100


def dashboard(comparisons: DataFrame, reviews: DataFrame, numeric_diffs: DataFrame) -> DataFrame:
    """Per comparison: sections, high and medium counts, numeric differences."""
    sections = reviews.groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("total_sections"),
        F.count_if(F.col("importance") == "high").alias("high_priority"),
        F.count_if(F.col("importance") == "medium").alias("medium_priority"),
    )
    numbers = numeric_diffs.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("numerical_changes"))
    return (
        comparisons.select("comparison_id")
        .join(sections, "comparison_id", "left")
        .join(numbers, "comparison_id", "left")
        .fillna(0)
    )


def filter_reviews(
    reviews: DataFrame, importance: str = "all", query: str = "", fields: tuple[str, ...] = LISTED_FIELDS
) -> DataFrame:
    """Reviews of one importance that contain the query; pass COUNTED_FIELDS for the header's count."""
    out = reviews if importance == "all" else reviews.where(F.col("importance") == importance)
    return out.where(any_contains([F.col(c) for c in fields], query)) if query else out


def leading_page(page_range: Column) -> Column:
    """Leading integer of a page range, 0 when there is none."""
    return F.coalesce(F.regexp_extract(page_range, r"^([0-9]+)", 1).try_cast("int"), F.lit(0))


def page_order(reviews: DataFrame) -> DataFrame:
    """Reviews sorted by the start pages of both documents, then by mapping order."""
    return (
        reviews.withColumn("doc1_start", leading_page(F.col("doc1_page_range")))
        .withColumn("doc2_start", leading_page(F.col("doc2_page_range")))
        .orderBy("comparison_id", "doc1_start", "doc2_start", "mapping_index")
    )


def multi_index(reviews: DataFrame) -> DataFrame:
    """Running index and total of the reviews that share a doc1 section, in page order.

    The group total is an aggregate and the index is numbered across
    partitions, so one section may hold any share of the reviews.
    """
    key = F.coalesce(filled(F.col("doc1_section_name")), F.col("section_name"))
    keyed = (
        reviews.withColumn("doc1_key", key)
        .withColumn("doc1_start", leading_page(F.col("doc1_page_range")))
        .withColumn("doc2_start", leading_page(F.col("doc2_page_range")))
    )
    keys = ["comparison_id", "doc1_key"]
    totals = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_count"))
    order = [F.col("doc1_start"), F.col("doc2_start"), F.col("mapping_index")]
    return (
        number_within(keyed, keys, order, "current_index")
        .join(totals, keys)
        .withColumn("is_multi", F.col("total_count") > 1)
    )


def loading_progress(position: Column, total: Column) -> Column:
    """Progress after loading the document at the 0-based position."""
    return (LOADING_FROM + F.floor((position + 1) * LOADING_SPAN / total)).cast("int")


def analysis_progress(done: Column, total: Column) -> Column:
    share = F.try_divide(done, total) * ANALYSIS_SPAN
    return (ANALYSIS_FROM + F.coalesce(share.cast("int"), F.lit(0))).cast("int")


def progress(finished: DataFrame) -> DataFrame:
    """Progress after each finished section: (comparison_id, finished_at, section)."""
    totals = finished.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("total_sections"))
    order = [F.col("finished_at"), F.col("section")]
    return (
        number_within(finished, ["comparison_id"], order, "completed_sections")
        .join(totals, "comparison_id")
        .withColumn("progress", analysis_progress(F.col("completed_sections"), F.col("total_sections")))
    )


def document_outcomes(docs: DataFrame) -> DataFrame:
    """Outcome per document of a processing run; ``docs`` carries the structuring result."""
    skipped = ~is_typed(effective_type())
    return docs.withColumn(
        "outcome",
        F.when(skipped, "skipped").when(F.col("structure_status") == "structured", "completed").otherwise("failed"),
    ).withColumn("reason", F.when(skipped, "unknown_type"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def section_outcomes(sections: DataFrame) -> DataFrame:
    """Sections processed and skipped per document; ``sections`` carries has_content."""
    return sections.groupBy("document_id").agg(
        F.count_if("has_content").alias("processed"), F.count_if(~F.col("has_content")).alias("skipped")
    )


def _blank(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def percent(value: Column) -> Column:
    """Share as a percentage with one decimal, blank when missing or not finite."""
    return F.coalesce(to_fixed(value * 100, 1), F.lit(""))


def _json_or_blank(value: Column) -> Column:
    return F.when(F.coalesce(F.size(value) > 0, F.lit(False)), F.to_json(value)).otherwise("")


def sections_csv(sections: DataFrame) -> DataFrame:
    """The seven export columns of a document's sections, all text, keyed by document.

    ``extracted_content`` is a struct, null when the section has none.
    """
    content = F.when(F.col("extracted_content").isNotNull(), F.to_json("extracted_content")).otherwise("")
    return sections.select(
        "document_id", _blank(F.col("section_name")).alias("section_name"),
        _blank(F.col("start_page")).alias("start_page"), _blank(F.col("end_page")).alias("end_page"),
        _blank(F.col("char_count")).alias("char_count"), percent(F.col("confidence")).alias("confidence_pct"),
        _blank(F.col("summary")).alias("summary"), content.alias("extracted_content"),
    )


def comparison_csv(comparisons: DataFrame, reviews: DataFrame) -> DataFrame:
    """The 25 export columns, one row per review.

    ``comparisons``: comparison_id, created_at, mode, priority, doc1 and doc2
    structs (document_id, filename, company_name, fiscal_year).
    """
    def named(n: int) -> Column:
        return _blank(F.coalesce(F.col(f"doc{n}.filename"), F.col(f"doc{n}.document_id")))

    section = F.col("section_name")
    return comparisons.join(reviews, "comparison_id").select(
        _blank(F.col("comparison_id")).alias("comparison_id"), _blank(F.col("created_at")).alias("created_at"),
        _blank(F.col("mode")).alias("mode"), _blank(F.col("priority")).alias("priority"),
        named(1).alias("doc1_filename"), _blank(F.col("doc1.company_name")).alias("doc1_company"),
        _blank(F.col("doc1.fiscal_year")).alias("doc1_fiscal_year"),
        named(2).alias("doc2_filename"), _blank(F.col("doc2.company_name")).alias("doc2_company"),
        _blank(F.col("doc2.fiscal_year")).alias("doc2_fiscal_year"),
        _blank(section).alias("section_name"),
        _blank(F.coalesce("doc1_section_name", section)).alias("doc1_section_name"),
        _blank(F.col("doc1_page_range")).alias("doc1_page_range"),
        _blank(F.coalesce("doc2_section_name", section)).alias("doc2_section_name"),
        _blank(F.col("doc2_page_range")).alias("doc2_page_range"),
        _blank(F.col("importance")).alias("importance"), _blank(F.col("importance_reason")).alias("importance_reason"),
        _blank(F.col("summary")).alias("summary"), _blank(F.col("mapping_method")).alias("mapping_method"),
        percent(F.col("mapping_confidence")).alias("mapping_confidence_pct"),
        _json_or_blank(F.col("text_changes")).alias("text_changes"),
        _json_or_blank(F.col("numerical_changes")).alias("numerical_changes"),
        _json_or_blank(F.col("tone_analysis")).alias("tone_analysis"),
        F.coalesce("has_additional_context", F.lit(False)).cast("string").alias("has_additional_context"),
        _json_or_blank(F.col("additional_searches")).alias("additional_searches"),
    )


def comparison_history(comparisons: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored comparisons, newest first, with their section counts; missing fields are blank."""
    counts = reviews.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("section_count"))
    return (
        comparisons.join(counts, "comparison_id", "left")
        .select(
            "comparison_id", _blank(F.col("created_at")).alias("created_at"), _blank(F.col("mode")).alias("mode"),
            _blank(F.col("doc1.filename")).alias("doc1_filename"), _blank(F.col("doc2.filename")).alias("doc2_filename"),
            F.coalesce("section_count", F.lit(0)).alias("section_count"),
        )
        .orderBy(F.desc("created_at"), "comparison_id")
    )
