"""Comparison modes and section mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.functions.company import normalise_company, same_company
from filingdelta.functions.ordinals import number_within
from filingdelta.functions.text import filled
from filingdelta.operators.vectorblocks import block_rows, greatest_cosine, similarities, unpack, vector_blocks
from filingdelta.schemas import BY_COMPANY, BY_YEAR, CONSISTENCY, MULTI
from filingdelta.session import materialise

# Similarity threshold, method names and the error of a one-document request.
SIMILARITY_THRESHOLD = 0.7
EXACT, SEMANTIC = "exact", "semantic_embedding"
TOO_FEW_DOCUMENTS = "比較には最低2つのドキュメントが必要です"
UNKNOWN_BEFORE, UNKNOWN_AFTER = "ドキュメント ", " が見つかりません"


def mode_of(n: Column, one: Column, two: Column) -> Column:
    """Mode of a request with n documents; ``one`` and ``two`` are document structs."""
    company = same_company(one["company_name"], two["company_name"], one["norm"], two["norm"])
    kind = F.coalesce(filled(one["document_type"]) == filled(two["document_type"]), F.lit(False))
    year = F.coalesce(one["fiscal_year"] == two["fiscal_year"], F.lit(False))
    return (
        F.when(n < 2, F.lit(None).cast("string"))
        .when(n >= 3, MULTI)
        .when(company & ~kind, CONSISTENCY)
        .when(~company & kind, BY_COMPANY)
        .when(company & kind & ~year, BY_YEAR)
        .otherwise(BY_COMPANY)
    )


def determine_modes(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Mode per comparison request.

    ``requests``: (comparison_id, position, document_id). Only the first and the
    last document of a request and its size matter, so one aggregation with
    map-side combine serves requests of any size. All requested documents are
    counted; a request with one that ``docs`` does not have gets an error that
    names the first such id, and no mode.
    """
    info = docs.select(
        "document_id", "company_name", "document_type", "fiscal_year",
        normalise_company(F.col("company_name")).alias("norm"), F.lit(True).alias("known"),
    )
    doc = F.struct("document_id", "company_name", "document_type", "fiscal_year", "norm")
    grouped = requests.join(info, "document_id", "left").groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.min(F.when(F.col("known").isNull(), F.col("document_id").cast("string"))).alias("unknown"),
        F.min_by(doc, F.col("position")).alias("one"),
        F.max_by(doc, F.col("position")).alias("two"),
    )
    return grouped.select(
        "comparison_id", "n_documents",
        F.col("one.document_id").alias("doc1_id"), F.col("two.document_id").alias("doc2_id"),
        F.when(F.col("unknown").isNull(), mode_of(F.col("n_documents"), F.col("one"), F.col("two"))).alias("mode"),
        F.when(F.col("n_documents") < 2, TOO_FEW_DOCUMENTS)
        .when(F.col("unknown").isNotNull(), F.concat(F.lit(UNKNOWN_BEFORE), "unknown", F.lit(UNKNOWN_AFTER))).alias("error"),
    )


def map_exact(pairs: DataFrame, sections: DataFrame, numbered: bool = True) -> DataFrame:
    """Sections of the same name in both documents, both with extracted content.

    ``pairs``: (pair_id, doc1_id, doc2_id); ``sections``: (document_id,
    section_name, has_content). mapping_index follows the name order.
    """
    common = _common_sections(pairs, sections).where("both")
    out = common.select(
        "pair_id", "doc1_id", "doc2_id",
        F.col("section_name").alias("doc1_section"), F.col("section_name").alias("doc2_section"),
        F.lit(1.0).alias("confidence_score"), F.lit(EXACT).alias("mapping_method"),
    )
    return number_within(out, ["pair_id"], [F.col("doc1_section")], "mapping_index") if numbered else out


def exact_mapping_counts(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Per pair: sections mapped, and common sections skipped for missing content."""
    return _common_sections(pairs, sections).groupBy("pair_id").agg(
        F.count_if("both").alias("mapped"), F.count_if(~F.col("both")).alias("skipped")
    )


def _common_sections(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    left = sections.select(
        F.col("document_id").alias("doc1_id"), "section_name", F.col("has_content").alias("_c1")
    )
    right = sections.select(
        F.col("document_id").alias("doc2_id"), "section_name", F.col("has_content").alias("_c2")
    )
    return (
        pairs.select("pair_id", "doc1_id", "doc2_id")
        .join(left, "doc1_id")
        .join(right, ["doc2_id", "section_name"])
        .withColumn("both", F.col("_c1") & F.col("_c2"))
    )


def of_documents(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``parts`` (document_id, ...) of the documents that ``pairs`` (doc1_id, doc2_id) name; no other row can meet a pair."""
    named = pairs.select(F.col("doc1_id").alias("document_id")).union(pairs.select("doc2_id")).distinct()
    return parts.join(named, "document_id", "left_semi")


_BEST = pa.schema(
    [
        ("pair_id", pa.string()), ("ordinal1", pa.int64()), ("doc1_section", pa.string()),
        ("ordinal2", pa.int64()), ("doc2_section", pa.string()), ("similarity", pa.float64()),
    ]
)


def _best_in_blocks(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair_ids = batch.column("pair_id")
            left, right = batch.column("items1"), batch.column("items2")
            found = []
            for i in range(batch.num_rows):
                by1, o1, m1, n1 = unpack(left[i].values)
                by2, o2, m2, n2 = unpack(right[i].values)
                s1, s2 = (x[i].values.field("section_name").take(pa.array(by)) for x, by in ((left, by1), (right, by2)))
                sim = similarities(m1, n1, m2, n2)
                best = sim.argmax(axis=1)
                top = sim[np.arange(len(o1)), best]
                keep = np.flatnonzero(top > threshold)
                if not len(keep):
                    continue
                found.append(pa.RecordBatch.from_arrays(
                    [
                        pa.array([pair_ids[i].as_py()] * len(keep), pa.string()),
                        pa.array(o1[keep], pa.int64()), s1.take(pa.array(keep)),
                        pa.array(o2[best[keep]], pa.int64()), s2.take(pa.array(best[keep])),
                        pa.array(top[keep], pa.float64()),
                    ],
                    schema=_BEST,
                ))
            yield from pa.Table.from_batches(found, _BEST).combine_chunks().to_batches()

    return run


def _meeting_blocks(keyed: DataFrame, vectors: DataFrame, threshold: float, dimension: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and every block pair of a document pair with ``met``: whether its cones allow a cosine above the threshold."""
    # Read four times: both sides' cones, then both sides' rows.
    blocks = materialise(vector_blocks(vectors, block_rows(dimension), ["section_name"]), "blocks")
    cones = lambda n: blocks.select(F.col("document_id").alias(f"doc{n}_id"), F.col("block").alias(f"block{n}"), F.col("cone").alias(f"cone{n}"))
    paired = keyed.join(cones(1), "doc1_id").join(cones(2), "doc2_id")
    return blocks, paired.withColumn("met", greatest_cosine("cone1", "cone2") > threshold).drop("cone1", "cone2")


def pruning_report(pairs: DataFrame, vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD, dimension: int = 1536) -> DataFrame:
    """One row: block pairs of all document pairs, those that ``map_semantic`` ships, and the share of full places in all blocks but each document's last."""
    blocks, met = _meeting_blocks(pairs.select("pair_id", "doc1_id", "doc2_id"), vectors, threshold, dimension)
    size = block_rows(dimension)
    filled = blocks.groupBy("document_id").agg(F.sum(F.size("items")).alias("_rows"), F.count("*").alias("_blocks"), F.min_by(F.size("items"), -F.col("block")).alias("_last"))
    fill = filled.where("_blocks > 1").agg(F.try_divide(F.sum(F.col("_rows") - F.col("_last")), F.sum(F.col("_blocks") - 1) * size).alias("fill"))
    counted = met.agg(F.count("*").alias("block_pairs"), F.count_if("met").alias("shipped"))
    return counted.withColumn("_one", F.lit(1)).join(fill.withColumn("_one", F.lit(1)), "_one").drop("_one")


def map_semantic(
    pairs: DataFrame, vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD, dimension: int = 1536
) -> DataFrame:
    """For each doc1 section the doc2 section with the greatest cosine above the threshold.

    ``vectors``: (document_id, ordinal, section_name, vector). Exact: each pair
    of blocks is one matrix product inside a task and returns at most one row
    per doc1 section, so no pair of sections is ever a row. Pairs of blocks whose
    cones rule out a cosine above the threshold are not shipped. A pair with very
    many sections becomes many block pairs, spread over tasks. Documents of no
    pair have no blocks. A tie goes to the first doc2 section.
    """
    keyed = pairs.select("pair_id", "doc1_id", "doc2_id").withColumn("pair_id", F.col("pair_id").cast("string"))
    blocks, met = _meeting_blocks(keyed, of_documents(vectors, keyed), threshold, dimension)

    def side(n: int) -> DataFrame:
        return blocks.select(F.col("document_id").alias(f"doc{n}_id"), F.col("block").alias(f"block{n}"), F.col("items").alias(f"items{n}"))

    best = (
        met.where("met").select("pair_id", "doc1_id", "block1", "doc2_id", "block2")
        .join(side(1), ["doc1_id", "block1"])
        .join(side(2), ["doc2_id", "block2"])
        .select("pair_id", "items1", "items2")
        .mapInArrow(
            _best_in_blocks(threshold),
            "pair_id string, ordinal1 long, doc1_section string, ordinal2 long, doc2_section string, similarity double",
        )
        .groupBy("pair_id", "ordinal1")
        .agg(
            F.max_by(
                F.struct("doc1_section", "doc2_section", "similarity"),
                F.struct(F.col("similarity"), -F.col("ordinal2")),
            ).alias("m")
        )
    )
    return best.join(keyed, "pair_id").select(
        "pair_id", "doc1_id", "doc2_id", "m.doc1_section", "m.doc2_section",
        F.col("m.similarity").alias("confidence_score"), F.lit(SEMANTIC).alias("mapping_method"),
        F.col("ordinal1").alias("mapping_index"),
    )


def map_sections(
    pairs: DataFrame, sections: DataFrame, vectors: DataFrame,
    threshold: float = SIMILARITY_THRESHOLD, dimension: int = 1536,
) -> DataFrame:
    """Exact mapping for pairs of one type (two missing types count as one), else semantic.

    ``pairs`` also carries doc1_type and doc2_type.
    """
    same = F.col("doc1_type").eqNullSafe(F.col("doc2_type"))
    exact = map_exact(pairs.where(same), sections)
    exact = exact.withColumn("pair_id", F.col("pair_id").cast("string"))
    return exact.unionByName(map_semantic(pairs.where(~same), vectors, threshold, dimension))
