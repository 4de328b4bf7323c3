"""Sections of several documents that belong together: connected components of the pairwise mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filingdelta.session import materialise

GROUP = ["comparison_id"]


def section_families(edges: DataFrame) -> DataFrame:
    """``(comparison_id, section, family)`` of all sections that ``edges(comparison_id, one, two)`` name.

    A section is any comparable value that is unique in its comparison, such as struct(position, name); the family is the least
    section that mappings connect it with. Every round takes the least family of the neighbours and then that family's own,
    so paths shorten by half; it ends when no section changes. Rounds are tables, only one flag reaches the driver.
    """
    both = materialise(edges.select(*GROUP, "one", "two").unionByName(edges.select(*GROUP, F.col("two").alias("one"), F.col("one").alias("two"))).distinct(), "edges")
    families = materialise(both.groupBy(*GROUP, F.col("one").alias("section")).agg(F.least(F.min("two"), F.first("one")).alias("family")), "families")
    while True:
        near = both.join(families.select(*GROUP, F.col("section").alias("two"), F.col("family").alias("_other")), [*GROUP, "two"])
        least = near.groupBy(*GROUP, F.col("one").alias("section")).agg(F.min("_other").alias("_near"))
        nearer = materialise(families.join(least, [*GROUP, "section"]).withColumn("_best", F.least("family", "_near")), "nearer")
        above = nearer.select(*GROUP, F.col("section").alias("_best"), F.col("_best").alias("_above"))
        moved = materialise(nearer.join(above, [*GROUP, "_best"]).select(*GROUP, "section", F.col("_above").alias("family"), (F.col("_above") != F.col("family")).alias("moved")), "families")
        families = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return families


def family_rows(members: DataFrame) -> DataFrame:
    """One row per family: its least section stands for it; ``members`` as from ``section_families``, sections being struct(position, section_name)."""
    return members.groupBy(*GROUP, "family").agg(
        F.count(F.lit(1)).alias("n_sections"), F.count_distinct("section.position").alias("n_documents")
    ).select(*GROUP, F.col("family.position").alias("position"), F.col("family.section_name").alias("section_name"), "n_sections", "n_documents")
