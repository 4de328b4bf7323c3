"""Changes in KPI series and in logical relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAPPING = ["pair_id", "mapping_index"]
# Change descriptions, and the two fields that identify each kind of relation.
TREND_TEXT = "トレンド表現が「%s」から「%s」に変化"
TARGET_TEXT, COMMENT_TEXT = "目標値の記載が変更", "コメントが変更"
RELATION_FIELDS = {
    "causality": ("subject", "reason"),
    "condition_consequence": ("condition", "consequence"),
    "problem_solution": ("problem", "solution"),
    "premise_conclusion": ("premise", "conclusion"),
}
KEY_CHARS = 100


def _sided(mappings: DataFrame, side: int) -> DataFrame:
    return mappings.select(
        *MAPPING, F.col(f"doc{side}_id").alias("document_id"), F.col(f"doc{side}_section").alias("section_name")
    )


def explode_kpis(content: DataFrame) -> DataFrame:
    """KPI rows of each section: (document_id, section_name, pos, kpi fields)."""
    return content.select(
        "document_id", "section_name", F.posexplode("extracted_content.kpi_time_series").alias("pos", "k")
    ).select(
        "document_id", "section_name", "pos", F.col("k.indicator").alias("indicator"),
        F.col("k.time_series").alias("time_series"),
        F.col("k.stated_metrics.trend_stated").alias("trend_stated"),
        F.col("k.target_stated.target_description").alias("target_description"),
        F.col("k.stated_metrics.comment").alias("comment"),
    )


def compare_kpis(mappings: DataFrame, kpis: DataFrame) -> DataFrame:
    """Changed trend, target or comment of each doc1 KPI against doc2's first KPI of that name.

    The first KPI per section and indicator is chosen before the join, with
    map-side combine; null against null is no change.
    """
    fields = ["time_series", "trend_stated", "target_description", "comment"]
    one = kpis.select(
        "document_id", "section_name", "pos", F.coalesce("indicator", F.lit("")).alias("indicator"),
        F.struct(*fields).alias("k1"),
    )
    two = kpis.where(F.col("indicator").isNotNull()).groupBy("document_id", "section_name", "indicator").agg(
        F.min_by(F.struct(*fields), F.col("pos")).alias("k2")
    )
    filled1, filled2 = F.size("k1.time_series") > 0, F.size("k2.time_series") > 0
    left = _sided(mappings, 1).join(one.where(filled1), ["document_id", "section_name"]).select(
        *MAPPING, F.col("section_name").alias("section"), "pos", "indicator", "k1"
    )
    right = _sided(mappings, 2).join(two.where(filled2), ["document_id", "section_name"]).select(
        *MAPPING, "indicator", "k2"
    )

    def change(kind: str, field: str, text: Column) -> Column:
        before, after = F.col(f"k1.{field}"), F.col(f"k2.{field}")
        return F.when(
            ~before.eqNullSafe(after),
            F.struct(
                F.lit(kind).alias("type"), before.alias("previous"), after.alias("current"),
                text.alias("description"),
            ),
        )

    trend = F.format_string(
        TREND_TEXT, F.coalesce("k1.trend_stated", F.lit("None")), F.coalesce("k2.trend_stated", F.lit("None"))
    )
    changes = F.array_compact(
        F.array(
            change("trend_stated_change", "trend_stated", trend),
            change("target_change", "target_description", F.lit(TARGET_TEXT)),
            change("comment_change", "comment", F.lit(COMMENT_TEXT)),
        )
    )
    return (
        left.join(right, [*MAPPING, "indicator"])
        .withColumn("changes", changes)
        .where(F.size("changes") > 0)
        .select(
            *MAPPING, "section", "pos", "indicator",
            F.col("k1.time_series").alias("time_series1"), F.col("k2.time_series").alias("time_series2"), "changes",
        )
    )


def relation_key(rel: Column) -> Column:
    """Identity of a relation: its kind and two fields, or the start of its quotation."""

    def part(name: str) -> Column:
        return F.coalesce(rel[name], F.lit(""))

    kind = part("relationship_type")
    chain = None
    for name, (first, second) in RELATION_FIELDS.items():
        value = F.concat_ws(":", kind, part(first), part(second))
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return chain.otherwise(F.concat_ws(":", kind, F.substring(part("original_text"), 1, KEY_CHARS)))


def explode_relations(content: DataFrame) -> DataFrame:
    return content.select(
        "document_id", "section_name",
        F.posexplode("extracted_content.logical_relationships").alias("pos", "relation"),
    )


def compare_relations(mappings: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations added, removed or modified between the two sections of a mapping.

    ``relations``: (document_id, section_name, pos, relation struct). The last
    relation of a key wins; that choice is made before the join. Relations move
    to their document without their key: the choice finds them there, and so
    does the join with the mappings where the document decides it.
    """
    last = (
        relations.repartition("document_id")
        .withColumn("relation_key", relation_key(F.col("relation")))
        .groupBy("document_id", "section_name", "relation_key")
        .agg(F.max_by("relation", "pos").alias("relation"))
    )

    def side(n: int) -> DataFrame:
        return _sided(mappings, n).join(last, ["document_id", "section_name"]).select(
            *MAPPING, "relation_key", F.col("section_name").alias(f"section{n}"), F.col("relation").alias(f"rel{n}")
        )

    both = side(1).join(side(2), [*MAPPING, "relation_key"], "full_outer")
    kind = (
        F.when(F.col("section1").isNull(), "added")
        .when(F.col("section2").isNull(), "removed")
        .when(~F.col("rel1.original_text").eqNullSafe(F.col("rel2.original_text")), "modified")
    )
    single = F.when(kind == "added", F.col("rel2")).when(kind == "removed", F.col("rel1"))
    return (
        both.withColumn("change_type", kind)
        .where(F.col("change_type").isNotNull())
        .select(
            *MAPPING, F.coalesce("section2", "section1").alias("section"), "change_type", "relation_key",
            single.alias("relationship"),
            F.when(F.col("change_type") == "modified", F.col("rel1")).alias("previous"),
            F.when(F.col("change_type") == "modified", F.col("rel2")).alias("current"),
        )
    )
