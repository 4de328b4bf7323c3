"""Table grids: normalisation, numeric test, lookup by page, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.functions.text import has_digit, joined, strip

NUMERIC_SHARE = 0.3
# Wording of a table preview.
NO_TABLES, TITLE = "テーブルなし", "テーブル%d (ページ%d): %d行 x %d列\n"
MORE_ROWS, MORE_TABLES, DOTS = "  ... 他 %d 行", "... 他 %d 個のテーブル", "\n..."
EXTRA_COLUMN = "column_"


def normalise_tables(raw: DataFrame) -> DataFrame:
    """Strip cells, split off the header row, key the records by header name.

    ``raw``: (document_id, page_number, table_index, grid array<array<string>>).
    Cells beyond the header are keyed ``column_<position>``; with a repeated
    header name the last cell wins (session setting mapKeyDedupPolicy).
    """
    clean = F.transform(
        "grid", lambda row: F.transform(row, lambda cell: strip(F.coalesce(cell, F.lit(""))))
    )

    def record(row: Column) -> Column:
        names = F.transform(
            row,
            lambda _, i: F.coalesce(F.get("header", i), F.concat(F.lit(EXTRA_COLUMN), i.cast("string"))),
        )
        return F.map_from_arrays(names, row)

    return (
        raw.where(F.size("grid") > 0)
        .withColumn("_grid", clean)
        .withColumn("header", F.element_at("_grid", 1))
        .withColumn("rows", F.slice("_grid", F.lit(2), F.greatest(F.size("_grid") - 1, F.lit(0))))
        .withColumn("records", F.transform("rows", record))
        .withColumn("row_count", F.size("rows"))
        .withColumn("column_count", F.size("header"))
        .drop("grid", "_grid")
    )


def is_numeric_table(rows: Column) -> Column:
    """More than 30 % of the non-empty cells hold a digit; the header does not count."""
    cells = F.filter(F.flatten(rows), lambda c: c.isNotNull() & (c != ""))
    share = F.try_divide(F.size(F.filter(cells, has_digit)), F.size(cells))
    return F.coalesce(share > NUMERIC_SHARE, F.lit(False))


def numeric_tables(grids: DataFrame) -> DataFrame:
    return grids.where(is_numeric_table(F.col("rows")))


def section_tables(section_pages: DataFrame, grids: DataFrame) -> DataFrame:
    """Tables on the pages of each section.

    ``section_pages`` is exploded (document_id, section_name, page_number), so the
    join key spreads a long document over many partitions.
    """
    return section_pages.select("document_id", "section_name", "page_number").distinct().join(
        grids, ["document_id", "page_number"]
    )


def table_preview(
    sections: DataFrame, tables: DataFrame, max_tables: int = 10, max_rows: int = 5, trailing_dots: bool = False
) -> DataFrame:
    """Readable preview of a section's first tables.

    ``tables``: section_tables output. ``trailing_dots`` gives the comparison
    side's wording, which ends every table with dots instead of a rest count.
    """
    keys = ["document_id", "section_name"]
    n_rows, n_cols = F.size("rows"), F.coalesce(F.size(F.get("rows", F.lit(0))), F.lit(0))
    head = F.array_join(
        F.transform(F.slice("rows", 1, max_rows), lambda r: joined(r, " | ")), "\n"
    )
    order = Window.partitionBy(*keys).orderBy("page_number", "table_index")
    small = tables.select(
        *keys, "page_number", "table_index", n_rows.alias("n_rows"), n_cols.alias("n_cols"), head.alias("head")
    )
    first = small.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_tables)
    title = F.format_string(
        TITLE, "position", "page_number", "n_rows", "n_cols"
    )
    rest = F.when(
        F.col("n_rows") > max_rows, F.format_string(MORE_ROWS, F.col("n_rows") - max_rows)
    )
    lines = (
        F.array(F.concat(title, "head", F.lit(DOTS)))
        if trailing_dots
        else F.array_compact(F.array(F.concat(title, "head"), rest))
    )
    text = F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "lines"))), lambda p: p["lines"])
    )
    previews = first.withColumn("lines", lines).groupBy(*keys).agg(text.alias("_parts"))
    counts = tables.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lead = "" if trailing_dots else "\n"
    more = F.when(
        F.col("_n") > max_tables,
        F.array(F.format_string(lead + MORE_TABLES, F.col("_n") - max_tables)),
    ).otherwise(F.array().cast("array<string>"))
    return (
        sections.select(*keys)
        .join(previews.join(counts, keys), keys, "left")
        .select(
            *keys,
            F.coalesce(F.array_join(F.concat("_parts", more), "\n\n"), F.lit(NO_TABLES)).alias("preview"),
        )
    )


def grid_cells(grids: DataFrame) -> DataFrame:
    """One row per cell, with the first cell of its row as the item name."""
    rows = grids.select(
        "document_id", "page_number", "table_index", F.posexplode("rows").alias("row", "_cells")
    )
    return rows.select(
        "document_id", "page_number", "table_index", "row",
        F.get("_cells", F.lit(0)).alias("item_name"),
        F.posexplode("_cells").alias("col", "text"),
    )
