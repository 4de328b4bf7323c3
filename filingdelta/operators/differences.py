"""Numeric differences between table cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from filingdelta.functions.numbers import TOLERANCE_PCT, extract_number_unit, normalise_unit, within_tolerance
from filingdelta.operators.mapping import of_documents


def with_numbers(cells: DataFrame) -> DataFrame:
    """Number and unit of each data cell; first-column and non-numeric cells are dropped before any join."""
    return (
        cells.where(F.col("col") >= 1)
        .withColumn("_n", extract_number_unit(F.col("text")))
        .where(F.col("_n.value").isNotNull())
        .withColumn("value", F.col("_n.value"))
        .withColumn("unit", F.col("_n.unit"))
        .drop("_n", "text")
    )


def compare_cells(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells at the same position whose values differ beyond the tolerance.

    Both sides hold ``keys`` (which name the compared tables), row, col,
    item_name, value, unit. Row and column are part of the join key, so a very
    large table is spread over many partitions.
    """
    on = [*keys, "row", "col"]
    a = left.select(*on, "item_name", F.col("value").alias("value1"), F.col("unit").alias("unit1"))
    b = right.select(*on, F.col("value").alias("value2"), F.col("unit").alias("unit2"))
    n1 = normalise_unit(F.col("value1"), F.col("unit1"))
    n2 = normalise_unit(F.col("value2"), F.col("unit2"))
    gap = F.col("_n1.value") - F.col("_n2.value")
    return (
        a.join(b, on)
        .withColumn("_n1", n1)
        .withColumn("_n2", n2)
        .where(~within_tolerance(F.col("_n1.value"), F.col("_n2.value")))
        .select(
            *on, "item_name", "value1", "value2",
            gap.alias("difference"),
            (F.try_divide(gap, F.abs(F.col("_n1.value"))) * 100).alias("difference_pct"),
            "unit1", "unit2",
            F.col("_n1.unit").alias("normalized_unit"),
            F.lit(True).alias("is_significant"),
            F.lit(TOLERANCE_PCT).alias("threshold"),
        )
    )


def compare_tables(grid_pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Differences for explicit table pairs.

    ``grid_pairs``: (pair_id, doc1_id, table1, doc2_id, table2);
    ``cells``: (document_id, table_id, row, col, item_name, text).
    """
    numbers = with_numbers(cells)
    key = ["pair_id", "table1", "table2"]
    left = grid_pairs.join(
        numbers.withColumnsRenamed({"document_id": "doc1_id", "table_id": "table1"}), ["doc1_id", "table1"]
    )
    right = grid_pairs.join(
        numbers.withColumnsRenamed({"document_id": "doc2_id", "table_id": "table2"}), ["doc2_id", "table2"]
    )
    return compare_cells(left, right, key)


def compare_numbers(
    mappings: DataFrame, cells: DataFrame, table_sections: DataFrame, scope: str = "section"
) -> DataFrame:
    """Numeric differences of every mapping, labelled with the doc1 section.

    ``mappings``: (pair_id, mapping_index, doc1_id, doc2_id, doc1_section,
    doc2_section); ``table_sections``: (document_id, section_name, table_id).
    With ``scope="section"`` a mapping compares every table of its one section with every table of the other.
    With ``scope="position"`` it compares the first table of the one with the first of the other and so on, in the order of
    table_id: one join of cells, whose number does not grow with the tables' product.
    ``scope="cross"`` compares every table of one document with every table of
    the other, and repeats each difference for every mapping of the pair; its
    result is quadratic in the number of tables by definition, so the cells are
    compared once per document pair and only the differences are multiplied.
    Only cells of mapped documents are numbered and moved.
    """
    cells, table_sections = (of_documents(df, mappings) for df in (cells, table_sections))
    if scope == "cross":
        tables = cells.select("document_id", "table_id").distinct()
        pairs = mappings.select("pair_id", "doc1_id", "doc2_id").distinct()
        grid_pairs = pairs.join(
            tables.withColumnsRenamed({"document_id": "doc1_id", "table_id": "table1"}), "doc1_id"
        ).join(tables.withColumnsRenamed({"document_id": "doc2_id", "table_id": "table2"}), "doc2_id")
        found = compare_tables(grid_pairs, cells)
        labels = mappings.select("pair_id", "mapping_index", F.col("doc1_section").alias("section"))
        return labels.join(found, "pair_id")
    if scope == "position":
        return _by_position(mappings, cells, table_sections)
    if scope != "section":
        raise ValueError(f"unknown scope: {scope}")
    one = table_sections.select(
        F.col("document_id").alias("doc1_id"), F.col("section_name").alias("doc1_section"),
        F.col("table_id").alias("table1"),
    )
    two = table_sections.select(
        F.col("document_id").alias("doc2_id"), F.col("section_name").alias("doc2_section"),
        F.col("table_id").alias("table2"),
    )
    linked = mappings.join(one, ["doc1_id", "doc1_section"]).join(two, ["doc2_id", "doc2_section"])
    # A table pair may serve several mappings; its cells are compared once.
    grid_pairs = linked.select("pair_id", "doc1_id", "table1", "doc2_id", "table2").distinct()
    found = compare_tables(grid_pairs, cells)
    labels = linked.select(
        "pair_id", "mapping_index", F.col("doc1_section").alias("section"), "table1", "table2"
    )
    return labels.join(found, ["pair_id", "table1", "table2"])


def _by_position(mappings: DataFrame, cells: DataFrame, table_sections: DataFrame) -> DataFrame:
    """Cells of a mapping's sections, joined on the place of their table in the section, row and column."""
    order = Window.partitionBy("document_id", "section_name").orderBy("table_id")
    placed = table_sections.select("document_id", "section_name", "table_id", F.row_number().over(order).alias("table_position"))
    numbers = with_numbers(cells).join(placed, ["document_id", "table_id"])

    def side(n: int) -> DataFrame:
        return mappings.select("pair_id", "mapping_index", F.col(f"doc{n}_id").alias("document_id"), F.col(f"doc{n}_section").alias("section_name")).join(
            numbers, ["document_id", "section_name"]
        )

    found = compare_cells(side(1), side(2), ["pair_id", "mapping_index", "table_position"])
    return mappings.select("pair_id", "mapping_index", F.col("doc1_section").alias("section")).join(found, ["pair_id", "mapping_index"])
