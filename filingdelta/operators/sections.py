"""Section geometry: page windows, merging, parents, exclusive pages, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.functions.text import ancestors, path_prefixes, strip

# Window shape, text cuts and the path separator.
WINDOW_PAGES, PAGE_CHARS, WINDOW_CHARS, MIN_SECTION_CHARS = 10, 2_000, 15_000, 100
SEP = " - "
PAGE_HEAD, PAGE_TAIL = "=== ページ ", " ===\n"


# The tree is walked from its roots, level by level, until a level is empty.
TEMPLATE_PATHS = """
WITH RECURSIVE found AS (
  SELECT document_type, node_id, name AS path, required, array(ordinal) AS position, 1 AS depth FROM {named} WHERE parent_id IS NULL
  UNION ALL
  SELECT c.document_type, c.node_id, concat(p.path, ' - ', c.name), c.required, concat(p.position, array(c.ordinal)), p.depth + 1
  FROM found p JOIN {named} c ON p.document_type = c.document_type AND p.node_id = c.parent_id
)
SELECT * FROM found
"""


def template_paths(nodes: DataFrame) -> DataFrame:
    """Full path of every named template node, at any depth.

    ``nodes``: (document_type, node_id, parent_id, ordinal, name, required).
    Nodes below an unnamed one are left out.
    """
    named = nodes.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return nodes.sparkSession.sql(TEMPLATE_PATHS, named=named)


def leaves(paths: DataFrame) -> DataFrame:
    """Paths no other path of the type goes through: an anti join on the exploded ancestors."""
    parents = paths.select("document_type", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return paths.join(parents, ["document_type", "path"], "left_anti")


def _windows_of(page: Column, step: int) -> Column:
    """Indexes of the windows a page falls into; border pages fall into two."""
    at = page - 1
    last = F.floor(at / step).cast("int")
    return F.when((at % step == 0) & (at > 0), F.array(last - 1, last)).otherwise(F.array(last))


def page_batches(pages: DataFrame, size: int = WINDOW_PAGES, overlap: int = 1) -> DataFrame:
    """Assign each page to its one or two overlapping windows.

    Window membership is page arithmetic, so no page is joined to a page count.
    A window that holds its border page alone is dropped: the window before has
    that page too. Missing page rows count as empty pages, so a window ends at
    its highest page. All windows stay within ``size`` pages, however long a document is.
    """
    if overlap != 1:
        raise ValueError("windows share exactly one page")
    step = size - 1
    w = Window.partitionBy("document_id", "batch_index")
    return (
        pages.withColumn("batch_index", F.explode(_windows_of(F.col("page_number"), step)))
        .withColumn("batch_start", (F.col("batch_index") * step + 1).cast("int"))
        .withColumn("batch_end", F.max(F.col("page_number").cast("int")).over(w))
        .where((F.col("batch_index") == 0) | (F.col("batch_end") > F.col("batch_start")))
    )


def batch_text(pages: DataFrame, size: int = WINDOW_PAGES) -> DataFrame:
    """Text of each window: a heading and the start of each page, cut to the window limit.

    Pages are cut before the shuffle and the group key carries the window, so a
    long document is spread over many tasks.
    """
    member = _windows_of(F.col("page_number"), size - 1)
    piece = F.concat(
        F.lit(PAGE_HEAD), F.col("page_number").cast("string"), F.lit(PAGE_TAIL),
        F.coalesce(F.substring("text", 1, PAGE_CHARS), F.lit("")), F.lit("\n"),
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("page_number", "piece"))), lambda p: p["piece"]
    )
    return (
        pages.select("document_id", "page_number", piece.alias("piece"), F.explode(member).alias("batch_index"))
        .groupBy("document_id", "batch_index")
        .agg(
            F.count(F.lit(1)).alias("n_pages"), F.max("page_number").alias("_last"),
            F.substring(F.array_join(ordered, "\n"), 1, WINDOW_CHARS).alias("batch_text"),
        )
        .where((F.col("batch_index") == 0) | (F.col("_last") > F.col("batch_index") * (size - 1) + 1))
        .drop("_last")
    )


def merge_sections(candidates: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Fold the windows' candidates: widest range, first confidence, last continuation flag.

    With the documents' ``pages`` a section lists only pages that its document has, whatever ends a reply
    gives; start and end stay as they were told.
    """
    # One long instead of a struct keeps this a hash aggregation.
    position = F.col("batch_index").cast("long") * 2**32 + F.col("ordinal")
    merged = candidates.groupBy("document_id", "section_name").agg(
        F.min("start_page").alias("start_page"),
        F.max("end_page").alias("end_page"),
        F.min_by(F.coalesce("confidence", F.lit(0.0)), position).alias("confidence"),
        F.max_by(F.coalesce("is_continuing", F.lit(False)), position).alias("is_continuing"),
    )
    if pages is None:
        return merged.withColumn("pages", _page_list(F.col("start_page"), F.col("end_page")))
    ends = pages.groupBy("document_id").agg(F.min("page_number").alias("_low"), F.max("page_number").alias("_high"))
    listed = _page_list(F.greatest("start_page", "_low"), F.least("end_page", "_high"))
    return merged.join(ends, "document_id", "left").withColumn(
        "pages", F.when(F.col("_low").isNull(), F.array().cast("array<int>")).otherwise(listed)
    ).drop("_low", "_high")


def _page_list(start: Column, end: Column) -> Column:
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def section_pages(sections: DataFrame) -> DataFrame:
    """One row per section and page, in the section's page order."""
    return sections.select(
        "document_id", "section_name", F.posexplode("pages").alias("position", "page_number")
    )


def with_char_count(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Text length over the section's pages; the text itself is never shuffled.

    The section's other columns travel with its first page, so the sections are
    read once and not joined to themselves.
    """
    keys = ["document_id", "section_name"]
    rest = [c for c in sections.columns if c not in (*keys, "char_count")]
    lengths = pages.select("document_id", F.col("page_number").alias("_page"), F.length("text").alias("_chars"))
    return (
        sections.select(*keys, F.struct(*rest).alias("_own"), F.posexplode_outer("pages").alias("_pos", "_page"))
        .withColumn("_own", F.when(F.coalesce(F.col("_pos") == 0, F.lit(True)), F.col("_own")))
        .join(lengths, ["document_id", "_page"], "left")
        .groupBy(*keys)
        .agg(F.first("_own", ignorenulls=True).alias("_own"), F.sum("_chars").alias("_sum"))
        .select(*keys, "_own.*", F.coalesce("_sum", F.lit(0)).cast("long").alias("char_count"))
    )


def rebuild_parents(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Add or widen every ancestor section from its descendants.

    Pages are the union of the descendants' pages, confidence is their mean.
    A parent that was detected itself also keeps its own pages and char_count.

    One aggregation per section name: every section sends its pages to itself
    and to its ancestors, and its confidence with its first page only. Page sets
    are merged on the map side; a page's length travels instead of its text.
    """
    keys = ["document_id", "section_name"]
    own = F.struct("start_page", "end_page", "pages", "confidence", "is_continuing", "char_count")
    lengths = pages.select("document_id", F.col("page_number").alias("_page"), F.length("text").alias("_chars"))
    sent = (
        sections.select(
            "document_id", F.col("section_name").alias("_from"), own.alias("_own"),
            F.concat(F.array("section_name"), path_prefixes(F.col("section_name"))).alias("_names"),
            F.posexplode_outer("pages").alias("_pos", "_page"),
        )
        .withColumn("_first", F.coalesce(F.col("_pos") == 0, F.lit(True)))
        .withColumn("_own", F.when(F.col("_first"), F.col("_own")))
        .join(lengths, ["document_id", "_page"], "left")
        .withColumn("section_name", F.explode("_names"))
        .drop("_names")
    )
    self_row = F.col("_from") == F.col("section_name")
    child = F.when(~self_row & F.col("_first"), F.coalesce("_own.confidence", F.lit(0.0)))
    page = F.when(F.col("_page").isNotNull(), F.struct(F.col("_page").alias("page"), F.col("_chars").alias("chars")))
    merged = sent.groupBy(*keys).agg(
        F.first(F.when(self_row & F.col("_first"), F.col("_own")), ignorenulls=True).alias("o"),
        F.avg(child).alias("_mean"),
        F.max(F.when(~self_row, F.col("_page"))).alias("_below"),
        F.array_sort(F.collect_set(page)).alias("_set"),
    ).where(F.col("o").isNotNull() | F.col("_below").isNotNull())
    is_parent = F.col("_below").isNotNull()
    union = F.transform("_set", lambda p: p["page"])
    chars = F.aggregate("_set", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(p["chars"], F.lit(0)))

    def pick(new: Column, old: str) -> Column:
        return F.when(is_parent, new).otherwise(F.col(f"o.{old}")).alias(old)

    return merged.withColumn("_pages", union).select(
        *keys,
        pick(F.get("_pages", F.lit(0)), "start_page"), pick(F.get("_pages", F.size("_pages") - 1), "end_page"),
        pick(F.col("_pages"), "pages"), pick(F.col("_mean"), "confidence"), pick(F.lit(False), "is_continuing"),
        F.when(F.col("o").isNull(), chars).otherwise(F.col("o.char_count")).alias("char_count"),
    )


def parent_names(sections: DataFrame) -> DataFrame:
    return sections.select(
        "document_id", F.explode(ancestors(F.col("section_name"))).alias("section_name")
    ).distinct()


def with_has_children(sections: DataFrame) -> DataFrame:
    parents = parent_names(sections).withColumn("_parent", F.lit(True))
    return (
        sections.join(parents, ["document_id", "section_name"], "left")
        .withColumn("has_children", F.coalesce("_parent", F.lit(False)))
        .drop("_parent")
    )


def exclusive_pages(sections: DataFrame) -> DataFrame:
    """Pages each section has to itself: a leaf keeps all, a parent those no descendant covers.

    A parent left without pages does not appear; its content comes from its descendants.
    """
    below = (
        sections.select(
            "document_id", F.explode(ancestors(F.col("section_name"))).alias("section_name"), "pages"
        )
        .select("document_id", "section_name", F.explode("pages").alias("page_number"))
        .distinct()
    )
    return section_pages(sections).join(below, ["document_id", "section_name", "page_number"], "left_anti")


def with_exclusive_pages(sections: DataFrame) -> DataFrame:
    """Sections with their own page list in place of the full one."""
    lists = exclusive_pages(sections).groupBy("document_id", "section_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "page_number"))), lambda p: p["page_number"]
        ).alias("own_pages")
    )
    return sections.join(lists, ["document_id", "section_name"])


def section_text_parts(own: DataFrame, pages: DataFrame, part_pages: int = 256) -> DataFrame:
    """Text of a section in parts of at most ``part_pages`` pages.

    ``own``: (document_id, section_name, position, page_number). Nothing is cut:
    the parts of a section joined by newlines are its whole text.
    """
    texts = pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]
    )
    return (
        own.join(texts, ["document_id", "page_number"])
        .withColumn("part", F.floor(F.col("position") / part_pages).cast("int"))
        .groupBy("document_id", "section_name", "part")
        .agg(F.array_join(ordered, "\n").alias("text"))
    )


def section_text(own: DataFrame, pages: DataFrame) -> DataFrame:
    """Whole text per section. Parts are built first, so a final group has few rows."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]
    )
    return (
        section_text_parts(own, pages)
        .groupBy("document_id", "section_name")
        .agg(F.array_join(ordered, "\n").alias("text"))
    )


def extraction_eligible(texts: DataFrame, min_chars: int = MIN_SECTION_CHARS) -> DataFrame:
    return texts.where(F.length(strip(F.col("text"))) >= min_chars)
