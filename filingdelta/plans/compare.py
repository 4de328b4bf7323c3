"""Comparison of document pairs end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from filingdelta.functions.text import first_filled
from filingdelta.operators.alignment import text_alignment
from filingdelta.operators.changes import compare_kpis, compare_relations
from filingdelta.operators.differences import compare_numbers
from filingdelta.operators.families import family_rows, section_families
from filingdelta.operators.intake import MAX_FILES, effective_label, effective_type
from filingdelta.operators.mapping import SIMILARITY_THRESHOLD, determine_modes, map_sections
from filingdelta.operators.reviews import assemble_reviews, eligible, reviews_from_replies
from filingdelta.operators.search import search_rounds
from filingdelta.session import materialise

INFO_SAMPLE_CHARS = 5_000
NOT_TWO = "現在は2つのドキュメント間の比較のみサポートしています"
TOO_MANY_DOCUMENTS = f"at most {MAX_FILES} documents can be compared"


@dataclass(frozen=True)
class Corpus:
    """Structured documents, one table per kind of part.

    documents: document_id, document_type, company_name, fiscal_year, text
    sections: document_id, section_name, start_page, end_page, has_content
    section_texts: document_id, section_name, text; whole texts
    vectors: document_id, ordinal, section_name, vector
    cells: document_id, table_id, row, col, item_name, text
    table_sections: document_id, section_name, table_id
    kpis, relations: rows of the sections' content
    """

    documents: DataFrame
    sections: DataFrame
    section_texts: DataFrame
    vectors: DataFrame
    cells: DataFrame
    table_sections: DataFrame
    kpis: DataFrame
    relations: DataFrame


def pair_inputs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Both documents of each pair with effective type and label, text and its leading sample."""
    text = F.coalesce(first_filled(F.col("full_text"), F.col("text")), F.lit(""))
    info = docs.select(
        "document_id",
        F.struct(
            "document_id", "filename", effective_type().alias("document_type"),
            effective_label().alias("document_type_label"),
            F.substring(text, 1, INFO_SAMPLE_CHARS).alias("text_sample"), text.alias("text"),
        ).alias("doc"),
    )
    out = pairs
    for n in (1, 2):
        side = info.select(F.col("document_id").alias(f"doc{n}_id"), F.col("doc").alias(f"doc{n}"))
        out = out.join(side, f"doc{n}_id")
    return out


def section_text_differences(mappings: DataFrame, section_texts: DataFrame) -> DataFrame:
    """One row per mapping whose sections both have a text: the ordered alignment of the two whole texts."""
    pairs = mappings.select("pair_id", "mapping_index", "doc1_id", "doc2_id", "doc1_section", "doc2_section")
    for n in (1, 2):
        side = section_texts.select(
            F.col("document_id").alias(f"doc{n}_id"), F.col("section_name").alias(f"doc{n}_section"), F.col("text").alias(f"text{n}")
        )
        pairs = pairs.join(side, [f"doc{n}_id", f"doc{n}_section"])
    key = ["pair_id", "mapping_index"]
    labels = mappings.select(*key, F.col("doc1_section").alias("section"))
    return labels.join(text_alignment(pairs, key), key).withColumn("semantic_similarity", F.lit(None).cast("double"))


def compare_pairs(
    pairs: DataFrame, corpus: Corpus, replies: DataFrame, threshold: float = SIMILARITY_THRESHOLD, dimension: int = 1536,
    scope: str = "section", search_mode: str | None = None, rounds: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The result tables of document pairs ``(pair_id, doc1_id, doc2_id, mode)``.

    ``replies``: (pair_id, mapping_index, reply_json); a mapping without one gets a failure review. With a
    ``search_mode`` (off, high_only, all) reviews that ask for it are searched further, by ``rounds`` as ``search_rounds``
    takes them, and carry what was found.
    """
    kind = corpus.documents.select("document_id", "document_type")
    typed = pairs.join(
        kind.withColumnsRenamed({"document_id": "doc1_id", "document_type": "doc1_type"}), "doc1_id"
    ).join(kind.withColumnsRenamed({"document_id": "doc2_id", "document_type": "doc2_type"}), "doc2_id")
    mappings = materialise(map_sections(typed, corpus.sections, corpus.vectors, threshold, dimension))
    ready = eligible(mappings, corpus.sections)
    answered = ready.select("pair_id", "mapping_index").join(replies, ["pair_id", "mapping_index"], "left").join(
        pairs.select("pair_id", "mode"), "pair_id"
    )
    reviews = assemble_reviews(ready, reviews_from_replies(answered, search=search_mode is not None), corpus.sections)
    if search_mode is not None:
        filled = corpus.vectors.join(corpus.sections.where("has_content"), ["document_id", "section_name"], "left_semi")
        reviews = search_rounds(materialise(reviews, "reviews"), rounds, filled, search_mode, dimension=dimension)
    return {
        "mappings": mappings,
        "numeric_diffs": compare_numbers(mappings, corpus.cells, corpus.table_sections, scope),
        "text_diffs": section_text_differences(mappings, corpus.section_texts),
        "section_reviews": reviews,
        "kpi_changes": compare_kpis(mappings, corpus.kpis),
        "relation_changes": compare_relations(mappings, corpus.relations),
    }


def compare(requests: DataFrame, corpus: Corpus, replies: DataFrame, **options: object) -> dict[str, DataFrame]:
    """All result tables of the requested comparisons; options as for ``compare_pairs``.

    ``requests``: (comparison_id, position, document_id); requests of other than
    two documents, or with an unknown one, get an error in ``comparisons`` and no results. The results are independent tables
    over the modes and the mappings, which are computed once into tables of the shared folder.
    """
    modes = materialise(
        determine_modes(requests, corpus.documents).withColumn(
            "error", F.coalesce("error", F.when(F.col("n_documents") > 2, NOT_TWO))
        )
    )
    pairs = modes.where(F.col("error").isNull()).select(
        F.col("comparison_id").cast("string").alias("pair_id"), "doc1_id", "doc2_id", "mode"
    )
    return {"comparisons": modes, **compare_pairs(pairs, corpus, replies, **options)}


def request_pairs(requests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their errors, and the document pairs of those without: every two documents of a request, in its order.

    A request has at most MAX_FILES documents, as an upload has, so its pairs are few.
    """
    checked = determine_modes(requests, docs).withColumn("error", F.coalesce("error", F.when(F.col("n_documents") > MAX_FILES, TOO_MANY_DOCUMENTS)))
    fine = checked.where(F.col("error").isNull()).select("comparison_id")
    listed = requests.join(fine, "comparison_id").groupBy("comparison_id").agg(F.sort_array(F.collect_list(F.struct("position", "document_id"))).alias("_d"))
    later = lambda one, i: F.transform(F.slice("_d", i + 2, F.size("_d")), lambda two: F.struct(one.alias("one"), two.alias("two")))
    pairs = listed.select("comparison_id", F.explode(F.flatten(F.transform("_d", later))).alias("_p"))
    name = F.concat_ws("/", F.col("comparison_id").cast("string"), F.concat_ws("-", F.col("_p.one.position").cast("string"), F.col("_p.two.position").cast("string")))
    named = pairs.select(
        "comparison_id", name.alias("pair_id"), F.col("_p.one.position").alias("position1"), F.col("_p.one.document_id").alias("doc1_id"),
        F.col("_p.two.position").alias("position2"), F.col("_p.two.document_id").alias("doc2_id"),
    )
    side = lambda n: named.select(F.col("pair_id").alias("comparison_id"), F.lit(n).alias("position"), F.col(f"doc{n}_id").alias("document_id"))
    modes = determine_modes(side(1).unionByName(side(2)), docs).select(F.col("comparison_id").alias("pair_id"), "mode")
    return checked, named.join(modes, "pair_id")


def compare_many(requests: DataFrame, corpus: Corpus, replies: DataFrame, **options: object) -> dict[str, DataFrame]:
    """Comparisons of two to MAX_FILES documents: the results of all their pairs, and the families their sections form.

    ``members`` has (comparison_id, position, document_id, section_name, family_position, family_section); ``families`` one row
    for each, its first section standing for it. Sections without a mapping are in no family.
    """
    checked, pairs = (materialise(df, "requests") for df in request_pairs(requests, corpus.documents))
    results = compare_pairs(pairs.select("pair_id", "doc1_id", "doc2_id", "mode"), corpus, replies, **options)
    at = lambda n: F.struct(F.col(f"position{n}").alias("position"), F.col(f"doc{n}_section").alias("section_name"))
    edges = results["mappings"].select("pair_id", "doc1_section", "doc2_section").join(pairs, "pair_id").select("comparison_id", at(1).alias("one"), at(2).alias("two"))
    members = section_families(edges)
    named = members.select("comparison_id", "section.position", "section.section_name", F.col("family.position").alias("family_position"), F.col("family.section_name").alias("family_section"))
    return {"comparisons": checked, "pairs": pairs, **results, "families": family_rows(members), "members": named.join(requests, ["comparison_id", "position"])}
