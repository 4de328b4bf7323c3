"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from filingdelta.functions.company import normalise_company, same_company
from filingdelta.functions.numbers import extract_number_unit, normalise_unit, within_tolerance
from filingdelta.functions.vectors import cosine
from filingdelta.operators import (
    alignment, changes, checks, classify, companies, content, differences, grids, intake, mapping, pages, related, report, reviews,
    search, sections, textdiff,
)
from filingdelta.plans.compare import Corpus, compare, compare_many, pair_inputs
from filingdelta.plans.structure import detect, extraction_inputs
from filingdelta.plans.tables import Tables
from filingdelta.session import configure, materialise, scratch_path
from filingdelta.sources import exports, records, templates
from filingdelta.sources.store import ResultStore, Store
from filingdelta.streaming import intake as intake_stream, retention, status

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}

# The vectors of the given data stay below the default threshold, so a lower one is passed.
THRESHOLD, DIMENSION = 0.3, 64
UPLOAD_LIMIT_MB = 0.0003
NOW = "2024-01-20T12:00:00"


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Tables(configure(spark), sf_dir))

    call.__name__ = name
    return call


def listed(column: str, sep: str = ",") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), sep)


# Sources, sinks, catalogue


def _template_rows(t: Tables) -> DataFrame:
    """One small YAML template per part."""
    words = F.split("p_name", " ")
    body = F.concat(
        F.lit("display_name: "), "p_name", F.lit("\ndescription: "), "p_type",
        F.lit("\nkeywords_for_detection:\n  - "), F.element_at(words, 1), F.lit("\n  - "), F.element_at(words, 2),
        F.lit("\nsections:\n  - name: "), "p_brand", F.lit("\n    required: true\n    items:\n      - plain entry\n      - name: size "),
        F.col("p_size").cast("string"), F.lit("\n"),
    )
    kind = F.concat(F.lit("part"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    return templates.parse_templates(t.base("part").select(kind.alias("document_type"), body.alias("body")))


@register("a1_template_catalog")
def a1(t: Tables) -> DataFrame:
    return _template_rows(t).select("document_type", "kind", "ordinal", "node_id", "parent_id", "name", "required")


@register("a2_read_uploads")
def a2(t: Tables) -> DataFrame:
    return records.read_uploads(t.spark, t.sf_dir).select("filename", "size_bytes")


def _records(t: Tables) -> DataFrame:
    return t.shared("metadata").select(
        "*", F.col("created_at").alias("updated_at"), F.lit(None).cast("string").alias("structured_data"),
        F.lit(None).cast("string").alias("extraction_method"),
        F.lit(None).cast("map<string,string>").alias("extraction_metadata"),
    )


@register("a3_read_metadata")
def a3(t: Tables) -> DataFrame:
    """JSON records of all documents; those in one language are cut short and must be skipped."""
    record = F.to_json(F.struct("document_id", "filename", "stored_path", "size_bytes", "created_at", "detected_type"))
    lines = t.shared("metadata").select(
        F.when(F.col("created_at").endswith("+00:00"), F.substring(record, 1, 20)).otherwise(record).alias("record_json")
    )
    return records.list_documents(records.parse_metadata(lines)).select(
        "document_id", "filename", "size_bytes", "created_at", "detected_type"
    )


@register("a4_save_structured")
def a4(t: Tables) -> DataFrame:
    """Update the labelled documents, write all, read back."""
    done = t.base("labels").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("structured_data"),
        F.when(F.col("toxic") == 1, "vision").otherwise("text").alias("extraction_method"),
        F.when(F.col("quality") == 1, F.create_map(F.lit("pages"), F.col("toxic").cast("string"))).alias("extraction_metadata"),
    )
    path = scratch_path(t.spark, "records")
    records.write_records(records.apply_structured(_records(t), done, NOW), path)
    return t.spark.read.parquet(path).select(
        "document_id", "structured_data", "extraction_method",
        F.size("extraction_metadata").alias("n_metadata"), "updated_at",
    )


def _comparisons(t: Tables) -> DataFrame:
    def doc(n: int) -> Column:
        return F.struct(
            F.col(f"doc{n}_document_id").alias("document_id"), F.col(f"doc{n}_filename").alias("filename"),
            F.col(f"doc{n}_company").alias("company_name"), F.col(f"doc{n}_year").alias("fiscal_year"),
        ).alias(f"doc{n}")

    return t.shared("comparisons").select("comparison_id", "created_at", "mode", "priority", doc(1), doc(2))


@register("a4_structured_store")
def a4_store(t: Tables) -> DataFrame:
    """All records saved, then the labelled documents' updates: only these are read, changed and saved again."""
    done = t.base("labels").select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("structured_data"),
        F.when(F.col("toxic") == 1, "vision").otherwise("text").alias("extraction_method"), F.lit(None).cast("map<string,string>").alias("extraction_metadata"),
    )
    kept = Store(scratch_path(t.spark, "records"), "document_id")
    kept.save(_records(t), ["updated_at"])
    touched = kept.latest(t.spark).join(done.select("document_id"), "document_id", "left_semi")
    kept.save(records.apply_structured(touched, done, NOW), ["updated_at"])
    return kept.latest(t.spark).select("document_id", "filename", "structured_data", "extraction_method", F.size("extraction_metadata").alias("n_metadata"), "updated_at")


@register("a5_result_store")
def a5_store(t: Tables) -> DataFrame:
    """Results with their reviews saved, those of some customers saved again with the important reviews only, and read back."""
    kept = ResultStore(scratch_path(t.spark, "results"))
    rows = t.shared("reviews").select("comparison_id", "mapping_index", "section_name", "importance", "summary")
    kept.save(_comparisons(t), {"reviews": rows})
    again = _comparisons(t).where(F.col("mode").isNull()).withColumn("priority", F.lit("high"))
    kept.save(again, {"reviews": rows.where("importance = 'high'").join(again.select("comparison_id"), "comparison_id", "left_semi")})
    head = kept.current(t.spark, "header").select("comparison_id", "priority")
    return kept.current(t.spark, "reviews").join(head, "comparison_id").select("comparison_id", "mapping_index", "section_name", "importance", "summary", "priority")


@register("a5_save_comparison")
def a5(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "comparisons")
    records.save_comparison(_comparisons(t), path)
    return records.read_comparisons(t.spark, path).select(
        "comparison_id", "created_at", "mode", F.col("doc1.filename").alias("doc1_filename")
    )


@register("a6_list_comparisons")
def a6(t: Tables) -> DataFrame:
    return report.comparison_history(_comparisons(t), t.shared("reviews"))


@register("a7_export_sections_csv")
def a7(t: Tables) -> DataFrame:
    """Written as CSV and read back."""
    replies = content.parse_content_reply(t.shared("content_replies"))
    rows = replies.select(
        "document_id", "section_name", F.lit(1).alias("start_page"), F.lit(None).cast("int").alias("end_page"),
        F.length("reply_json").alias("char_count"),
        F.when(F.length("reply_json") > 0, F.col("document_id") / 7000.0).alias("confidence"),
        F.lit(None).cast("string").alias("summary"), "extracted_content",
    )
    path = scratch_path(t.spark, "sections-csv")
    table = report.sections_csv(rows)
    exports.write_csv(table, path)
    back = exports.read_csv(t.spark, path, ", ".join(f"{c} string" for c in table.columns))
    return back.select(
        "document_id", "section_name", "start_page", "end_page", "char_count", "confidence_pct", "summary",
        (F.length("extracted_content") > 0).alias("has_content"),
        F.get_json_object("extracted_content", "$.messages[0].content").alias("first_message"),
    )


@register("a8_export_comparison_csv")
def a8(t: Tables) -> DataFrame:
    rows = t.shared("reviews").select(
        "comparison_id", "section_name", "doc1_section_name", "doc2_section_name", "doc1_page_range", "doc2_page_range",
        "importance", F.lit("").alias("importance_reason"), "summary", F.lit("exact").alias("mapping_method"),
        (F.col("o_totalprice") / 500000).alias("mapping_confidence"),
        F.when(F.col("importance") == "high", F.create_map(F.lit("added"), "section_name")).alias("text_changes"),
        F.when(F.col("importance") == "low", F.array("section_name")).otherwise(F.array().cast("array<string>")).alias("numerical_changes"),
        F.create_map().cast("map<string,string>").alias("tone_analysis"),
        (F.col("importance") == "medium").alias("has_additional_context"),
        F.lit(None).cast("array<string>").alias("additional_searches"),
    )
    return report.comparison_csv(_comparisons(t), rows)


@register("a11_delete_document")
def a11(t: Tables) -> DataFrame:
    """Delete the labelled documents that are toxic."""
    ids = t.base("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return records.without(t.shared("metadata"), ids).select("document_id", "filename")


# Intake


def _uploads(t: Tables) -> DataFrame:
    return t.shared("uploads").withColumn("content", F.col("body").cast("binary")).withColumn(
        "size_bytes", F.octet_length("body").cast("long")
    )


@register("b1_validate_upload")
def b1(t: Tables) -> DataFrame:
    return intake.validate(_uploads(t), UPLOAD_LIMIT_MB).select(
        "batch_id", "filename", listed("errors", "|").alias("errors"), "status", "processing_status"
    )


@register("b2_is_pdf")
def b2(t: Tables) -> DataFrame:
    return _uploads(t).select(
        "batch_id", "filename", intake.is_pdf(F.col("content_type"), F.col("content")).alias("is_pdf")
    )


@register("b3_batch_limits")
def b3(t: Tables) -> DataFrame:
    """Batches are announced per document id, so some have no files."""
    announced = t.base("documents").select(F.col("doc_id").alias("batch_id"))
    return intake.check_batches(announced, t.shared("uploads"))


@register("b5_effective_type")
def b5(t: Tables) -> DataFrame:
    return t.shared("metadata").select(
        "document_id", intake.effective_type().alias("selected_type"), intake.effective_label().alias("selected_label")
    )


@register("b6_classification_gate")
def b6(t: Tables) -> DataFrame:
    return intake.gate(t.shared("metadata")).select("document_id", "processing_status", "queueable")


def _catalogue(t: Tables) -> DataFrame:
    """Filing types with display names, counted from the documents' detected types."""
    return t.shared("metadata").where("detected_type <> ''").groupBy("detected_type").agg(
        F.max("detected_type_label").alias("display_name")
    ).withColumnRenamed("detected_type", "document_type")


@register("b7_override_type")
def b7(t: Tables) -> DataFrame:
    wanted = t.base("labels").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "memo")
        .when(F.col("toxic") == 1, "unknown")
        .when(F.col("quality") == 0, "earnings_report").alias("requested_type"),
    )
    supported = intake.supported_types(_catalogue(t))
    return intake.apply_overrides(intake.gate(t.shared("metadata")), wanted, supported).select(
        "document_id", "manual_type", "manual_type_label", "processing_status", "error"
    )


@register("b8_supported_types")
def b8(t: Tables) -> DataFrame:
    """Display name of every document's effective type, supported types only."""
    supported = intake.supported_types(_catalogue(t))
    return intake.with_display_name(t.shared("metadata"), supported).select(
        "document_id", "document_type", "display_name"
    )


@register("b9_page_range")
def b9(t: Tables) -> DataFrame:
    """Pages 2 to 2 + quality of the labelled documents; ranges beyond the end are reported."""
    asked = t.base("labels").select(
        F.col("doc_id").alias("document_id"), (F.col("quality") * 2).alias("start_page"),
        (F.col("quality") * 2 + F.col("toxic") + 1).alias("end_page"),
    )
    found, errors = pages.page_range(t.pages(), asked)
    return found.select(
        "document_id", "page_number", F.length("text").alias("char_count"), F.lit(None).cast("string").alias("error")
    ).unionByName(
        errors.select("document_id", F.lit(None).cast("int").alias("page_number"),
                      F.lit(None).cast("int").alias("char_count"), "error")
    )


@register("b10_text_sufficiency")
def b10(t: Tables) -> DataFrame:
    docs = t.base("documents").select(F.col("doc_id").alias("document_id"))
    return pages.text_sufficiency(docs, t.pages(), 150).select(
        "document_id", "page_count", F.round("avg_chars", 6).alias("avg_chars"), "sufficient", "error"
    )


@register("b11_extraction_route")
def b11(t: Tables) -> DataFrame:
    meta = t.shared("metadata")
    text = pages.text_sufficiency(
        meta.select("document_id"), t.pages().withColumn("document_id", F.col("document_id").cast("string")), 150
    ).select("document_id", F.col("sufficient").alias("success"))
    labels = t.base("labels").select(F.col("doc_id").cast("string").alias("document_id"), "quality", "toxic")
    vision = labels.select("document_id", (F.col("quality") == 1).alias("success"))
    tables = labels.select("document_id", (F.col("toxic") == 0).alias("success"))
    return pages.extraction_route(meta, text, vision, tables).select(
        "document_id", "extraction_method", "keep_pages", "keep_tables", "detect_sections"
    )


def _raw_grids(t: Tables) -> DataFrame:
    """One grid per order: a header with a repeated name, one row per line item, one cell beyond the header."""
    items = t.base("lineitem").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(
                F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
            )
        ).alias("items")
    )
    row = F.transform(
        "items",
        lambda i: F.array(
            F.concat(F.lit("  item "), i["l_linenumber"].cast("string")), F.concat(i["l_returnflag"], F.lit("　")),
            F.when(i["l_linestatus"] == "F", i["l_quantity"].cast("long").cast("string")), i["l_linestatus"],
        ),
    )
    header = F.array(F.array(F.lit("name"), F.lit("flag "), F.lit(" flag")))
    return items.select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("table_index"),
        F.concat(header, row).alias("grid"),
    )


@register("b12_is_numeric_table")
def b12(t: Tables) -> DataFrame:
    """Grids whose first cells are words: the quantities decide."""
    grid = grids.normalise_tables(_raw_grids(t))
    words = grid.withColumn("rows", F.transform("rows", lambda r: F.slice(r, 2, 3)))
    return words.select("document_id", grids.is_numeric_table(F.col("rows")).alias("is_numeric"))


@register("b13_analysis_eligible")
def b13(t: Tables) -> DataFrame:
    return reviews.eligible(_exact_mappings(t), _content_sections(t)).select("pair_id", "doc1_section")


@register("b14_importance_and_keyword_filter")
def b14(t: Tables) -> DataFrame:
    return report.filter_reviews(t.shared("reviews"), "high", "f-PART").select(
        "comparison_id", "mapping_index", "importance", "summary"
    )


@register("b14_filtered_count")
def b14_count(t: Tables) -> DataFrame:
    found = report.filter_reviews(t.shared("reviews"), "medium", "Total 2", report.COUNTED_FIELDS)
    return found.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("n"))


@register("b15_pending_filter")
def b15(t: Tables) -> DataFrame:
    return intake.pending(t.shared("status_events")).select("event_id", "document_id", "processing_status")


# Classification


def _samples(t: Tables) -> DataFrame:
    names = t.base("documents").select(
        F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("filename")
    )
    return names.join(pages.text_sample(t.pages()), "document_id", "left")


@register("c1_classify_by_keywords")
def c1(t: Tables) -> DataFrame:
    return classify.classify(_samples(t), t.languages()).select(
        "document_id", "detected_type", "detected_type_label", "detection_confidence", listed("matched_keywords").alias("matched_keywords")
    )


@register("c1_catalogue_keywords")
def c1_catalogue(t: Tables) -> DataFrame:
    """Whole documents against a catalogue read from templates: a type per benchmark item, its sentences as keywords."""
    body = F.to_json(F.struct(F.col("label").alias("display_name"), F.split("text", r"\.\s*").alias("keywords_for_detection")))
    kind = F.concat(F.lit("item"), F.lpad(F.col("item_id").cast("string"), 9, "0"))
    lexicon = templates.load_lexicon(templates.parse_templates(t.shared("catalogue_words").select(kind.alias("document_type"), body.alias("body"))))
    docs = t.base("documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("text").alias("text_sample"))
    return classify.classify(docs, lexicon).select(
        "document_id", "detected_type", "detected_type_label", "detection_confidence", F.size("matched_keywords").alias("n_matched")
    )


@register("c2_collect_keywords")
def c2(t: Tables) -> DataFrame:
    docs = t.base("documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("text").alias("text_sample"),
        F.col("lang").alias("document_type"),
    )
    return classify.matched_keywords(docs, t.languages()).select("document_id", listed("matched_keywords").alias("matched_keywords"))


@register("c3_normalise_classifier_reply")
def c3(t: Tables) -> DataFrame:
    return classify.parse_type_reply(t.shared("type_replies"), t.languages()).select(
        "doc_id", "reply_type", "reply_confidence", "reply_reason", listed("reply_keywords").alias("reply_keywords")
    )


@register("c4_classification_fallback")
def c4(t: Tables) -> DataFrame:
    return classify.classify_final(t.shared("type_replies"), t.languages()).select(
        "doc_id", "classified_by", "detected_type", "detected_type_label", "detection_confidence", "detection_reason",
        listed("matched_keywords").alias("matched_keywords"),
    )


@register("c5_text_sample")
def c5(t: Tables) -> DataFrame:
    return pages.text_sample(t.pages())


# Structuring


@register("d1_normalise_table")
def d1(t: Tables) -> DataFrame:
    record = F.element_at("records", 1)
    return grids.normalise_tables(_raw_grids(t)).select(
        "document_id", listed("header", "|").alias("header"), "row_count", "column_count",
        F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"),
        F.size(record).alias("record_keys"), record["flag"].alias("first_flag"), record["column_3"].alias("first_extra"),
    )


@register("d2_flatten_template")
def d2(t: Tables) -> DataFrame:
    return sections.template_paths(t.shared("nodes")).select("node_id", "path", "depth", "required")


@register("d3_template_leaves")
def d3(t: Tables) -> DataFrame:
    return sections.leaves(sections.template_paths(t.shared("nodes"))).select("node_id", "path")


@register("d5_overlapping_page_batches")
def d5(t: Tables) -> DataFrame:
    return sections.page_batches(t.pages().select("document_id", "page_number"))


@register("d6_batch_text")
def d6(t: Tables) -> DataFrame:
    return sections.batch_text(t.pages()).select("document_id", "batch_index", "batch_text")


def _merged(t: Tables) -> DataFrame:
    return sections.merge_sections(t.candidates())


@register("d8_merge_section_candidates")
def d8(t: Tables) -> DataFrame:
    return _merged(t).withColumn("pages", listed("pages"))


@register("d8_pages_in_document")
def d8_clamped(t: Tables) -> DataFrame:
    """Every third candidate ends far behind its document."""
    far = F.when(F.col("ordinal") % 3 == 0, 2_000_000_000).otherwise(F.col("end_page")).cast("int")
    found = sections.merge_sections(t.candidates().withColumn("end_page", far), t.pages())
    return found.select("document_id", "section_name", "start_page", "end_page", listed("pages").alias("pages"))


@register("d9_section_char_count")
def d9(t: Tables) -> DataFrame:
    return sections.with_char_count(_merged(t), t.pages()).select("document_id", "section_name", "char_count")


def _sections(t: Tables) -> DataFrame:
    return detect(t.candidates(), t.pages())


@register("d10_rebuild_parents")
def d10(t: Tables) -> DataFrame:
    return _sections(t).select(
        "document_id", "section_name", "start_page", "end_page", listed("pages").alias("pages"),
        F.round("confidence", 6).alias("confidence"), "is_continuing", "char_count",
    )


@register("d11_has_children")
def d11(t: Tables) -> DataFrame:
    return sections.with_has_children(_merged(t)).select("document_id", "section_name", "has_children")


@register("d12_exclusive_pages")
def d12(t: Tables) -> DataFrame:
    return sections.with_exclusive_pages(_merged(t)).select(
        "document_id", "section_name", listed("own_pages").alias("own_pages")
    )


@register("d13_section_text")
def d13(t: Tables) -> DataFrame:
    return sections.section_text(sections.section_pages(_merged(t)), t.pages())


@register("d14_section_tables")
def d14(t: Tables) -> DataFrame:
    return _section_tables(t).select("document_id", "section_name", "table_index", F.size("rows").alias("n_rows"))


def _document_grids(t: Tables) -> DataFrame:
    """A grid on every page: one row per line, its words as cells."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return t.pages().select("document_id", "page_number", (F.col("page_number") % 3).alias("table_index"), rows.alias("rows"))


def _section_tables(t: Tables) -> DataFrame:
    return grids.section_tables(sections.section_pages(_merged(t)), _document_grids(t))


@register("d15_extraction_eligible")
def d15(t: Tables) -> DataFrame:
    return extraction_inputs(_merged(t), t.pages()).select("document_id", "section_name", F.length("text").alias("n_chars"))


@register("d16_table_preview")
def d16(t: Tables) -> DataFrame:
    return grids.table_preview(_merged(t), _section_tables(t), 2, 2)


@register("d17_conform_extracted_content")
def d17(t: Tables) -> DataFrame:
    c = F.col("extracted_content")
    return content.parse_content_reply(t.shared("content_replies")).select(
        "document_id", c.isNotNull().alias("has_content"),
        *[F.when(c.isNotNull(), F.size(c[g])).alias(f"n_{g}") for g in content.GROUPS],
        F.get(c["financial_data"], F.lit(0))["value"].alias("first_value"),
    )


@register("d18_embedding_text")
def d18(t: Tables) -> DataFrame:
    parsed = content.parse_content_reply(t.shared("content_replies"))
    return parsed.select("document_id", content.embedding_text(F.col("section_name"), F.col("extracted_content")).alias("embedding_text"))


@register("d19_content_digest")
def d19(t: Tables) -> DataFrame:
    parsed = content.parse_content_reply(t.shared("content_replies"))
    return parsed.select("document_id", content.content_digest(F.col("extracted_content")).alias("digest"))


@register("d20_structured_summary")
def d20(t: Tables) -> DataFrame:
    docs = t.base("documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("lang") == "en", "text").otherwise("vision").alias("extraction_method")
    )
    return content.structured_summary(docs, t.pages(), _document_grids(t).select("document_id"), _content_sections(t))


# Comparison


def _folded_filings(t: Tables) -> DataFrame:
    return t.shared("filings").withColumn("norm", normalise_company(F.col("company_name")))


@register("e1_normalise_company")
def e1(t: Tables) -> DataFrame:
    return _folded_filings(t).select("document_id", F.col("norm").alias("company"))


@register("e2_same_company")
def e2(t: Tables) -> DataFrame:
    """Each order's company against the next order's."""
    a = _folded_filings(t).select(F.col("document_id").alias("doc1_id"), F.col("company_name").alias("n1"), F.col("norm").alias("f1"))
    b = _folded_filings(t).select((F.col("document_id") - 1).alias("doc1_id"), F.col("company_name").alias("n2"), F.col("norm").alias("f2"))
    return a.join(b, "doc1_id").select(
        "doc1_id", same_company(F.col("n1"), F.col("n2"), F.col("f1"), F.col("f2")).alias("same_company")
    )


@register("e2_company_links")
def e2_links(t: Tables) -> DataFrame:
    return companies.link_companies(t.shared("company_names"))[0]


@register("e2_company_members")
def e2_members(t: Tables) -> DataFrame:
    return companies.link_companies(t.shared("company_names"))[1].select("name_id", "company", "n_links")


@register("e3_determine_mode")
def e3(t: Tables) -> DataFrame:
    return mapping.determine_modes(t.shared("requests"), t.shared("filings")).select(
        "comparison_id", "n_documents", "mode", "error"
    )


def _content_sections(t: Tables) -> DataFrame:
    """Merged sections; content exists where there is enough text to extract from."""
    return sections.with_char_count(_merged(t), t.pages()).withColumn("has_content", F.col("char_count") >= 300)


def _copy_pairs(t: Tables) -> DataFrame:
    return t.shared("copy_pairs")


def _exact_mappings(t: Tables) -> DataFrame:
    return mapping.map_exact(_copy_pairs(t), _content_sections(t))


@register("e5_map_exact")
def e5(t: Tables) -> DataFrame:
    return _exact_mappings(t).select(
        "pair_id", "mapping_index", "doc1_section", "doc2_section", "confidence_score", "mapping_method"
    )


@register("e5_exact_mapping_counts")
def e5_counts(t: Tables) -> DataFrame:
    return mapping.exact_mapping_counts(_copy_pairs(t), _content_sections(t))


def _label_pairs(t: Tables) -> DataFrame:
    """Each embedding label against the next."""
    labels = t.base("embeddings").select(F.col("label").cast("long").alias("doc1_id")).distinct()
    return labels.select(F.col("doc1_id").cast("string").alias("pair_id"), "doc1_id", (F.col("doc1_id") + 1).alias("doc2_id"))


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@register("e6_map_semantic")
def e6(t: Tables) -> DataFrame:
    found = mapping.map_semantic(_label_pairs(t), t.vectors(), THRESHOLD, DIMENSION)
    return _rounded(found, "confidence_score").select(
        "pair_id", "doc1_section", "doc2_section", "confidence_score", "mapping_method"
    )


@register("e4_map_sections_dispatch")
def e4(t: Tables) -> DataFrame:
    """Labels up to 4 share a missing type, so they map by name; the others by vector."""
    v = t.vectors()
    named = v.select(
        "document_id", F.concat(F.lit("n"), F.floor(F.col("ordinal") / 10).cast("string")).alias("section_name")
    ).distinct().withColumn("has_content", F.lit(True))
    typed = _label_pairs(t).withColumn("doc1_type", F.when(F.col("doc1_id") > 4, "a")).withColumn(
        "doc2_type", F.when(F.col("doc2_id") > 4, "b")
    )
    found = mapping.map_sections(typed, named, v, THRESHOLD, DIMENSION)
    return _rounded(found, "confidence_score").select("pair_id", "doc1_section", "doc2_section", "confidence_score", "mapping_method")


@register("e7_cosine")
def e7(t: Tables) -> DataFrame:
    """Each vector against the next."""
    a = t.base("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t.base("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def _cell_numbers(t: Tables) -> DataFrame:
    return t.shared("cells").withColumn("n", extract_number_unit(F.col("text")))


CELL = ["document_id", "table_id", "row", "col"]


@register("e8_extract_number_unit")
def e8(t: Tables) -> DataFrame:
    return _cell_numbers(t).select(*CELL, "n.value", "n.unit")


@register("e9_normalise_unit")
def e9(t: Tables) -> DataFrame:
    return _cell_numbers(t).withColumn("u", normalise_unit(F.col("n.value"), F.col("n.unit"))).select(
        *CELL, F.col("u.value").alias("value"), F.col("u.unit").alias("unit")
    )


@register("e10_within_tolerance")
def e10(t: Tables) -> DataFrame:
    """Every line price against the price without discount, scaled close to the tolerance."""
    price, other = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount") / 500)
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber", price.alias("price"), "l_discount", within_tolerance(price, other).alias("within")
    )


def _month_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    numbers = differences.with_numbers(t.shared("cells"))
    pairs = t.shared("month_pairs")
    return (
        pairs.join(numbers.withColumnRenamed("document_id", "doc1_id"), "doc1_id"),
        pairs.join(numbers.withColumnRenamed("document_id", "doc2_id"), "doc2_id"),
    )


@register("e11_compare_tables")
def e11(t: Tables) -> DataFrame:
    """Same-named tables: the table name is a join key, not a product."""
    found = differences.compare_cells(*_month_sides(t), ["pair_id", "table_id"])
    return found.select(
        "pair_id", "table_id", "row", "col", "item_name", "value1", "value2", F.round("difference", 4).alias("difference"),
        F.round("difference_pct", 6).alias("difference_pct"), "unit1", "unit2", "normalized_unit",
    )


def _month_mappings(t: Tables) -> DataFrame:
    """Two sections per month document: small and large parts."""
    return t.shared("month_pairs").select(
        "pair_id", "doc1_id", "doc2_id",
        F.explode(F.array(F.struct(F.lit(1).cast("long").alias("i"), F.lit("small").alias("s")),
                          F.struct(F.lit(2).cast("long").alias("i"), F.lit("large").alias("s")))).alias("m"),
    ).select("pair_id", F.col("m.i").alias("mapping_index"), "doc1_id", "doc2_id",
             F.col("m.s").alias("doc1_section"), F.col("m.s").alias("doc2_section"))


def _month_table_sections(t: Tables) -> DataFrame:
    section = F.when(F.col("table_id").isin("SMALL", "ECONOMY"), "small").otherwise("large")
    return t.shared("cells").select("document_id", section.alias("section_name"), "table_id").distinct()


@register("e12_compare_numbers")
def e12(t: Tables) -> DataFrame:
    found = differences.compare_numbers(_month_mappings(t), t.shared("cells"), _month_table_sections(t))
    return found.groupBy("pair_id", "mapping_index", "section", "table1", "table2").agg(
        F.count(F.lit(1)).alias("n_diffs"), F.round(F.max(F.abs("difference_pct")), 6).alias("largest_pct")
    )


@register("e12_numbers_by_position")
def e12_position(t: Tables) -> DataFrame:
    found = differences.compare_numbers(_month_mappings(t), t.shared("cells"), _month_table_sections(t), "position")
    return found.select(
        "pair_id", "mapping_index", "section", "table_position", "row", "col", "item_name", "value1", "value2",
        F.round("difference", 4).alias("difference"), F.round("difference_pct", 6).alias("difference_pct"), "normalized_unit",
    )


@register("e13_text_match_ratio")
def e13(t: Tables) -> DataFrame:
    found = textdiff.text_diff_chars(t.text_pairs(textdiff.COMPARED_CHARS))
    return found.select(
        "pair_id", F.round("match_ratio", 6).alias("match_ratio"), F.size("added_text").alias("n_added"),
        F.size("removed_text").alias("n_removed"), F.size("changed_text").alias("n_changed"),
    )


@register("e13_ordered_alignment")
def e13_alignment(t: Tables) -> DataFrame:
    """Whole texts, in order."""
    found = _rounded(alignment.text_alignment(t.text_pairs()), "match_ratio")
    return found.select(
        "pair_id", "n1", "n2", "matched", "match_ratio", "n_added", "n_removed", "n_changed",
        F.to_json("added_text").alias("added_text"), F.to_json("removed_text").alias("removed_text"), F.to_json("changed_text").alias("changed_text"),
    )


@register("e13_ordered_changes")
def e13_changes(t: Tables) -> DataFrame:
    return alignment.text_changes(t.text_pairs())


@register("e13_sentence_changes")
def e13_sentences(t: Tables) -> DataFrame:
    return alignment.text_changes(t.text_pairs(), unit="sentence")


@register("e14_text_line_diff")
def e14(t: Tables) -> DataFrame:
    return _rounded(textdiff.text_diff_lines(t.text_pairs()), "match_ratio")


@register("e14_line_changes")
def e14_lines(t: Tables) -> DataFrame:
    return textdiff.line_changes(t.text_pairs())


def _kpis(t: Tables) -> DataFrame:
    points = F.when(
        F.col("point") != "",
        F.array(F.struct(F.lit("year").alias("period"), F.col("point").alias("value"), F.lit(None).cast("string").alias("note"))),
    ).otherwise(F.expr("array()").cast("array<struct<period:string,value:string,note:string>>"))
    return t.shared("kpis").withColumn("time_series", points).drop("point")


@register("e15_compare_kpi_series")
def e15(t: Tables) -> DataFrame:
    found = changes.compare_kpis(t.shared("customer_mappings"), _kpis(t))
    return found.select(
        "pair_id", "section", "pos", "indicator", F.get("time_series1", F.lit(0))["value"].alias("value1"),
        F.get("time_series2", F.lit(0))["value"].alias("value2"),
        F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["type"], F.coalesce(c["previous"], F.lit("-")), F.coalesce(c["current"], F.lit("-")))), ";").alias("changes"),
        F.get("changes", F.lit(0))["description"].alias("first_description"),
    )


def _relations(t: Tables) -> DataFrame:
    def only(kind: str, column: str) -> Column:
        return F.when(F.col("relationship_type") == kind, F.col(column))

    rel = F.struct(
        "relationship_type", "original_text", only("causality", "a").alias("subject"), only("causality", "b").alias("reason"),
        only("condition_consequence", "a").alias("condition"), only("condition_consequence", "b").alias("consequence"),
        only("problem_solution", "a").alias("problem"), only("problem_solution", "b").alias("solution"),
        only("premise_conclusion", "a").alias("premise"), only("premise_conclusion", "b").alias("conclusion"),
    )
    return t.shared("relations").select(
        "document_id", "section_name", F.struct("l_orderkey", "l_linenumber", "l_partkey", "cents").alias("pos"), rel.alias("relation")
    )


@register("e16_relation_key")
def e16(t: Tables) -> DataFrame:
    return _relations(t).select(
        "document_id", "pos.l_orderkey", "pos.l_linenumber", "pos.l_partkey", "pos.cents",
        changes.relation_key(F.col("relation")).alias("relation_key"),
    )


@register("e17_compare_relations")
def e17(t: Tables) -> DataFrame:
    found = changes.compare_relations(t.shared("supplier_mappings"), _relations(t))
    return found.select(
        "pair_id", "section", "change_type", "relation_key",
        F.coalesce("relationship.original_text", "previous.original_text").alias("text1"),
        F.col("current.original_text").alias("text2"),
    )


def _review_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "comparison_id", "mapping_index", "importance", "importance_reason", "summary",
        "contradiction_count", F.size("text_changes").alias("n_text_changes"),
        F.size("numerical_changes").alias("n_numerical"), F.col("tone_analysis")["tone1"].alias("tone1"),
        "search_needed", F.size("search_phrases").alias("n_phrases"),
    )


@register("e18_section_review_from_reply")
def e18(t: Tables) -> DataFrame:
    return _review_columns(reviews.reviews_from_replies(t.shared("review_replies")))


@register("e18_search_review_from_reply")
def e18_search(t: Tables) -> DataFrame:
    return _review_columns(reviews.reviews_from_replies(t.shared("review_replies"), search=True))


@register("e19_attach_mapping_info")
def e19(t: Tables) -> DataFrame:
    mapped = _exact_mappings(t)
    answers = mapped.select("pair_id", "mapping_index", F.lit("medium").alias("importance"))
    return reviews.assemble_reviews(mapped, answers, _content_sections(t)).select(
        "pair_id", "review_index", "section_name", "doc1_section_name", "doc2_section_name", "doc1_page_range",
        "doc2_page_range", "importance", "mapping_confidence", "mapping_method",
    )


@register("e20_search_gate")
def e20(t: Tables) -> DataFrame:
    read = reviews.reviews_from_replies(t.shared("review_replies"), search=True)
    return read.select(
        "comparison_id", "mapping_index",
        *[
            reviews.search_gate(F.col("search_needed"), F.col("importance"), F.col("search_phrases"), m).alias(f"search_{m}")
            for m in ("off", "high_only", "all")
        ],
    )


def _vector_queries(t: Tables) -> DataFrame:
    """Every section asks for its relatives among the other sections of its document."""
    return t.vectors().select(
        F.col("section_name").alias("query_id"), "document_id", "ordinal", "vector", F.array("section_name").alias("exclude")
    )


@register("e21_related_sections_topk")
def e21(t: Tables) -> DataFrame:
    found = related.related_topk(_vector_queries(t), t.vectors(), dimension=DIMENSION)
    return _rounded(found, "similarity").select("query_id", "rank", "section_name", "similarity")


@register("e22_iterative_search")
def e22(t: Tables) -> DataFrame:
    """Sections whose vector starts positive get a second round, with the opposite vector."""
    first = _vector_queries(t).withColumn("iteration", F.lit(1))
    second = _vector_queries(t).where(F.get("vector", F.lit(0)) > 0).withColumn("iteration", F.lit(2)).withColumn(
        "vector", F.transform("vector", lambda v: -v)
    )
    found = related.iterative_search(first.unionByName(second), t.vectors(), dimension=DIMENSION)
    return _rounded(found, "similarity").select("query_id", "iteration", "rank", "section_name", "similarity")


@register("e23_enhanced_summary")
def e23(t: Tables) -> DataFrame:
    """Each line of a text is a finding; its first line is the summary, two rounds split the rest."""
    lines = F.split("text", "\n")
    rounds = F.when(F.size(lines) == 1, F.expr("array()").cast("array<array<string>>")).when(
        F.size(lines) == 2, F.array(F.array().cast("array<string>"))
    ).otherwise(F.array(F.slice(lines, 2, 1), F.slice(lines, F.lit(3), F.size(lines))))
    return t.base("documents").select(
        "doc_id", reviews.enhanced_summary(F.get(lines, F.lit(0)), rounds).alias("summary")
    )


def comparison_results(t: Tables) -> dict[str, DataFrame]:
    """The whole comparison over each order's filing against the customer's others."""
    docs = t.shared("filings").join(
        t.base("orders").select(F.col("o_orderkey").alias("document_id"), "o_orderdate", "o_custkey", "o_orderpriority", "o_orderstatus"), "document_id"
    )
    parsed = materialise(
        content.parse_content_reply(t.shared("content_replies")).withColumn("section_name", F.lit("order"))
    )
    facts = parsed.where("extracted_content is not null")
    # An order has a handful of line items; their order is total.
    items = Window.partitionBy("document_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    cells = t.base("lineitem").withColumnRenamed("l_orderkey", "document_id").select(
        "document_id", F.lit("items").alias("table_id"), F.row_number().over(items).alias("row"),
        F.lit(1).alias("col"), F.col("l_linestatus").alias("item_name"), F.col("l_quantity").cast("long").cast("string").alias("text"),
    )
    lines = F.concat_ws("\n", "company_name", F.col("o_orderdate").cast("string"), "o_orderpriority", "o_orderstatus")
    corpus = Corpus(
        documents=docs.withColumn("text", F.concat_ws(" ", "company_name", F.col("o_orderdate").cast("string"))),
        sections=parsed.select("document_id", "section_name", F.lit(1).alias("start_page"), F.lit(None).cast("int").alias("end_page"),
                               F.col("extracted_content").isNotNull().alias("has_content")),
        section_texts=docs.select("document_id", F.lit("order").alias("section_name"), lines.alias("text")),
        vectors=facts.select("document_id", F.lit(1).cast("long").alias("ordinal"), "section_name",
                             F.array(F.lit(1.0), F.length("reply_json").cast("double") / 100).alias("vector")),
        cells=cells,
        table_sections=cells.select("document_id", F.lit("order").alias("section_name"), "table_id").distinct(),
        kpis=changes.explode_kpis(facts), relations=changes.explode_relations(facts),
    )
    replies = t.shared("requests").groupBy("comparison_id").agg(F.max("document_id").alias("document_id")).join(
        t.shared("review_replies").select(F.col("mapping_index").alias("document_id"), "reply_json"), "document_id"
    ).select(F.col("comparison_id").cast("string").alias("pair_id"), F.lit(1).cast("long").alias("mapping_index"), "reply_json")
    return compare(t.shared("requests"), corpus, replies, dimension=2)


@register("e24_compare_documents")
def e24(t: Tables) -> DataFrame:
    """Rows per result table and pair."""
    out = None
    for name, df in comparison_results(t).items():
        key = F.col("comparison_id").cast("string") if name == "comparisons" else F.col("pair_id")
        counts = df.groupBy(key.alias("pair_id")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("result", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


@register("e24_text_differences")
def e24_texts(t: Tables) -> DataFrame:
    """The ordered alignment of the mapped sections' texts."""
    found = _rounded(comparison_results(t)["text_diffs"], "match_ratio")
    return found.select("pair_id", "mapping_index", "section", "n1", "n2", "matched", "match_ratio")


@register("e24_numeric_differences")
def e24_numbers(t: Tables) -> DataFrame:
    return comparison_results(t)["numeric_diffs"].select(
        "pair_id", "section", "row", "col", "item_name", "value1", "value2", F.round("difference_pct", 6).alias("difference_pct")
    )


@register("e20_search_rounds")
def e20_rounds(t: Tables) -> DataFrame:
    """Every section's review, searched further in each mode: the first round asks with its own vector, the second with the opposite."""
    v = t.vectors().withColumn("pair_id", F.concat(F.lit("p"), F.col("ordinal").cast("string"))).withColumn("mapping_index", F.lit(1).cast("long"))
    listed = lambda *words: F.transform(F.array(*map(F.lit, words)), lambda w: F.concat(w, F.col("ordinal").cast("string")))
    none = F.array().cast("array<string>")
    reviewed = v.select(
        "pair_id", "mapping_index", F.col("document_id").alias("doc1_id"), F.col("section_name").alias("doc1_section_name"),
        F.when(F.col("ordinal") % 3 == 0, "high").otherwise("low").alias("importance"), (F.col("ordinal") % 2 == 0).alias("search_needed"),
        F.when(F.col("ordinal") % 5 == 0, none).otherwise(F.array(F.lit("more"))).alias("search_phrases"), F.concat(F.lit("S"), F.col("ordinal").cast("string")).alias("summary"),
    )
    first = v.select("pair_id", "mapping_index", F.lit(1).alias("iteration"), listed("x").alias("phrases"), "vector", F.when(F.col("ordinal") % 7 == 0, none).otherwise(listed("a", "b", "c")).alias("new_findings"))
    second = v.select("pair_id", "mapping_index", F.lit(2).alias("iteration"), F.when(F.get("vector", F.lit(0)) > 0, listed("y")).otherwise(none).alias("phrases"),
                      F.transform("vector", lambda x: -x).alias("vector"), listed("d").alias("new_findings"))
    out = None
    for mode in ("off", "high_only", "all"):
        found = search.search_rounds(reviewed, first.unionByName(second), t.vectors(), mode, dimension=DIMENSION)
        names = F.flatten(F.transform("additional_searches", lambda r: F.transform(r["found_sections"], lambda f: f["section_name"])))
        rows = found.select(F.lit(mode).alias("mode"), "pair_id", F.size("additional_searches").alias("n_rounds"), "has_additional_context", F.array_join(names, ",").alias("found"), "summary")
        out = rows if out is None else out.unionByName(rows)
    return out


def _family_results(t: Tables) -> dict[str, DataFrame]:
    """Every four neighbouring documents are a request; languages are types, so sections map by name within a language."""
    base = t.base("documents")
    requests = base.select(F.floor(F.col("doc_id") / 4).cast("long").alias("comparison_id"), (F.col("doc_id") % 4).cast("int").alias("position"), F.col("doc_id").alias("document_id"))
    docs = base.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("document_type"), F.lit(None).cast("string").alias("company_name"), F.lit(None).cast("int").alias("fiscal_year"))
    found = _content_sections(t)
    empty = lambda schema: t.spark.createDataFrame([], schema)
    corpus = Corpus(
        documents=docs, sections=found, section_texts=empty("document_id long, section_name string, text string"),
        vectors=empty("document_id long, ordinal long, section_name string, vector array<double>"),
        cells=empty("document_id long, table_id string, row int, col int, item_name string, text string"),
        table_sections=empty("document_id long, section_name string, table_id string"),
        kpis=changes.explode_kpis(_no_facts(t)), relations=changes.explode_relations(_no_facts(t)),
    )
    return compare_many(requests, corpus, empty("pair_id string, mapping_index long, reply_json string"), dimension=1)


def _no_facts(t: Tables) -> DataFrame:
    return content.parse_content_reply(t.shared("content_replies")).where(F.lit(False)).withColumn("section_name", F.lit(""))


@register("e24_section_families")
def e24_families(t: Tables) -> DataFrame:
    return _family_results(t)["families"]


@register("e24_family_members")
def e24_members(t: Tables) -> DataFrame:
    return _family_results(t)["members"]


@register("e25_compare_inputs")
def e25(t: Tables) -> DataFrame:
    texts = t.base("documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.when(F.col("lang") != "fr", F.col("text")).alias("full_text"), "text"
    )
    docs = t.shared("metadata").join(texts, "document_id")
    pairs = _copy_pairs(t).select("pair_id", F.col("doc1_id").cast("string").alias("doc1_id"), F.col("doc2_id").cast("string").alias("doc2_id"))
    return pair_inputs(pairs, docs).select(
        "pair_id", "doc1_id", "doc2_id", F.col("doc1.document_type").alias("type1"), F.col("doc2.document_type").alias("type2"),
        F.col("doc2.document_type_label").alias("label2"), F.length("doc1.text_sample").alias("sample1"),
        F.length("doc2.text").alias("chars2"),
    )


# Reporting


@register("f1_importance_dashboard")
def f1(t: Tables) -> DataFrame:
    numeric = t.base("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("comparison_id"))
    return report.dashboard(t.shared("comparisons"), t.shared("reviews"), numeric)


@register("f2_page_order")
def f2(t: Tables) -> DataFrame:
    return report.page_order(t.shared("reviews")).select("comparison_id", "mapping_index", "doc1_start", "doc2_start")


@register("f3_multi_mapping_index")
def f3(t: Tables) -> DataFrame:
    return report.multi_index(t.shared("reviews")).select(
        "comparison_id", "mapping_index", "doc1_key", "current_index", "total_count", "is_multi"
    )


@register("f4_progress")
def f4(t: Tables) -> DataFrame:
    finished = t.shared("reviews").select("comparison_id", "finished_at", F.col("mapping_index").alias("section"))
    return report.progress(finished).select("comparison_id", "section", "completed_sections", "total_sections", "progress")


@register("f4_loading_progress")
def f4_loading(t: Tables) -> DataFrame:
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber",
        report.loading_progress(F.col("l_linenumber") - 1, F.lit(7)).alias("progress"),
    )


@register("f6_batch_outcomes")
def f6(t: Tables) -> DataFrame:
    done = t.shared("metadata").withColumn(
        "structure_status", F.when(F.col("size_bytes") > 1000, "structured").otherwise("failed")
    )
    return report.document_outcomes(done).select("document_id", "outcome", "reason")


@register("f6_outcome_counts")
def f6_counts(t: Tables) -> DataFrame:
    done = t.shared("metadata").withColumn(
        "structure_status", F.when(F.col("size_bytes") > 1000, "structured").otherwise("failed")
    )
    return report.outcome_counts(report.document_outcomes(done))


@register("f6_section_outcomes")
def f6_sections(t: Tables) -> DataFrame:
    return report.section_outcomes(_content_sections(t))


@register("f7_page_previews")
def f7(t: Tables) -> DataFrame:
    return pages.page_previews(t.pages())


@register("f7_table_previews")
def f7_tables(t: Tables) -> DataFrame:
    return pages.table_previews(_document_grids(t)).select(
        "document_id", "position", "page_number", "table_index", "row_count", F.size("rows").alias("shown_rows")
    )


# Streaming


@register("g1_intake_stream")
def g1(t: Tables) -> DataFrame:
    """The uploads as a file stream: validated, classified and gated into a parquet table."""
    schema = t.base("conversations").schema
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/conversations.parque[t]")
    uploads = t.shared("uploads", conversations=source).withColumn("content", F.col("body").cast("binary")).withColumn(
        "size_bytes", F.octet_length("body").cast("long")
    )
    out = scratch_path(t.spark, "intake")
    intake_stream.run_intake(uploads, t.languages(), f"{out}/rows", f"{out}/checkpoint", UPLOAD_LIMIT_MB).awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select(
        "batch_id", "filename", "status", "detected_type", "detection_confidence", "processing_status", "queueable"
    )


@register("g2_latest_status")
def g2(t: Tables) -> DataFrame:
    return status.latest_status(t.shared("status_events"))


@register("g2_latest_status_stream")
def g2_stream(t: Tables) -> DataFrame:
    source = t.spark.readStream.schema(t.base("events").schema).parquet(f"{t.sf_dir}/events.parque[t]")
    out = scratch_path(t.spark, "status")
    status.run_status(t.shared("status_events", events=source), f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return status.current_status(status.read_log(t.spark, f"{out}/log"))


@register("g3_expire_documents")
def g3(t: Tables) -> DataFrame:
    return retention.expired(t.shared("metadata"), NOW).select("document_id", "created_at")


@register("g3_kept_documents")
def g3_kept(t: Tables) -> DataFrame:
    return retention.kept(t.shared("metadata"), NOW).select("document_id", "created_at")


@register("g3_expiry_stream")
def g3_stream(t: Tables) -> DataFrame:
    """Every event creates a document; the newest event is the stream's present."""
    source = t.spark.readStream.schema(t.base("events").schema).parquet(f"{t.sf_dir}/events.parque[t]")
    created = source.select(F.col("event_id").alias("document_id"), F.col("ts").cast("timestamp").alias("created_at"))
    out = scratch_path(t.spark, "expiry")
    retention.run_expiry(created, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("document_id", "created_at")


# Checks and lists


@register("p1_unmatched_sections")
def p1(t: Tables) -> DataFrame:
    found = _content_sections(t)
    return checks.unmatched_sections(_copy_pairs(t), found, mapping.map_exact(_copy_pairs(t), found, numbered=False))


@register("p2_missing_numbers")
def p2(t: Tables) -> DataFrame:
    return checks.missing_numbers(*_month_sides(t), ["pair_id", "table_id"])


@register("p2_missing_values")
def p2_values(t: Tables) -> DataFrame:
    """Numbers that the same table of the next year has nowhere."""
    return checks.missing_values(*_month_sides(t), ["pair_id", "table_id"])


@register("p3_text_match")
def p3(t: Tables) -> DataFrame:
    return _rounded(checks.text_match(t.text_pairs()), "match_ratio")


@register("p4_semantic_bands")
def p4(t: Tables) -> DataFrame:
    return e7(t).select("vec_id", checks.similarity_band(F.col("similarity")).alias("band"))


@register("p5_topic_comparison")
def p5(t: Tables) -> DataFrame:
    return _rounded(checks.compare_topics(t.text_pairs(), t.languages()), "volume_ratio")


WARNING_LEVELS = {"the": 1, "with": 2, "eaux": 2, "that": 3, "und": 1, "keit": 3}


@register("p6_warning_strength")
def p6(t: Tables) -> DataFrame:
    return checks.compare_warnings(t.text_pairs(), t.spark.createDataFrame(list(WARNING_LEVELS.items()), "phrase string, level int"))


@register("p7_priority")
def p7(t: Tables) -> DataFrame:
    rows = t.shared("reviews").select(
        "comparison_id", "mapping_index", F.col("section_name").alias("section"), (F.col("o_totalprice") / 400000).alias("match_ratio")
    )
    return checks.with_priority(rows, ["1-URGENT"], ["2-HIGH"], ["comparison_id", "mapping_index"]).select("comparison_id", "mapping_index", "section", "priority")


EXPECTED_SECTIONS = ["Appendix", "Preface", "S0 - T0 - U0", "S0 - T1 - U2"]


@register("p8_undetected_sections")
def p8(t: Tables) -> DataFrame:
    docs = t.base("documents").select(F.col("doc_id").alias("document_id"))
    return checks.undetected_sections(docs, _merged(t), EXPECTED_SECTIONS)


@register("p8_extra_sections")
def p8_extra(t: Tables) -> DataFrame:
    return checks.extra_sections(_merged(t), EXPECTED_SECTIONS)


@register("p8_low_confidence")
def p8_low(t: Tables) -> DataFrame:
    return checks.low_confidence(_merged(t)).select("document_id", "section_name", "confidence")


@register("p8_overlapping_pages")
def p8_overlap(t: Tables) -> DataFrame:
    return checks.overlapping_pages(_merged(t))


@register("p9_series_checks")
def p9(t: Tables) -> DataFrame:
    """Three points per order: a year back, the year, a year on."""
    total = F.floor("o_totalprice").cast("long")
    last = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).when(
        F.col("o_orderstatus") == "F", (total * 30).cast("string")
    ).otherwise(total.cast("string"))
    year = F.year("o_orderdate")
    turned = F.substring("o_orderpriority", 1, 1) == "1"

    def point(offset: int, value: Column) -> Column:
        period = F.concat((year + F.when(turned, -offset).otherwise(offset)).cast("string"), F.lit("年3月期"))
        return F.struct(period.alias("period"), value.alias("value"))

    series = F.array(point(-1, total.cast("string")), point(0, total.cast("string")), point(1, last))
    return checks.check_series(t.base("orders").select("o_orderkey", series.alias("time_series"))).drop("time_series")


@register("p9_unquoted_relations")
def p9_unquoted(t: Tables) -> DataFrame:
    rel = F.struct(
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "R", F.lit(None).cast("string"))
        .otherwise("quoted").alias("original_text")
    )
    rows = t.base("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", rel.alias("relation"))
    return checks.unquoted_relations(rows).select("l_orderkey", "l_linenumber", "l_returnflag")


@register("p10_difference_counts")
def p10(t: Tables) -> DataFrame:
    """Numeric, text, KPI and relation differences with the sections they are in."""
    kind = lambda name, rows, section: rows.select(F.lit(name).alias("kind"), section.alias("section"))
    text = F.when(F.startswith(F.col("pair_id"), F.lit("d")), "document").otherwise("conversation")
    found = kind("numeric", e11(t), F.col("table_id")).unionByName(kind("relation", e17(t), F.col("section")))
    return checks.difference_counts(found.unionByName(kind("kpi", e15(t), F.col("section"))).unionByName(kind("text", e14_lines(t), text)))


@register("p11_difference_list")
def p11(t: Tables) -> DataFrame:
    return checks.difference_list(t.shared("reviews"), "high", None, "total 4", "page").select(
        "comparison_id", "mapping_index", "section_name", "summary"
    )
