"""Quality checks and lists that go with a comparison or a structured document."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.functions.numbers import TOLERANCE_PCT, normalise_unit, within_tolerance
from filingdelta.functions.text import any_contains, filled
from filingdelta.operators.classify import Lexicon
from filingdelta.operators.containment import with_needles
from filingdelta.operators.report import leading_page
from filingdelta.operators.sections import parent_names, section_pages
from filingdelta.operators.textdiff import text_match  # noqa: F401
from filingdelta.session import materialise

# Similarity bands and the confidence below which a section is flagged.
SIMILAR_FROM, DIFFERENT_BELOW, LOW_CONFIDENCE = 0.75, 0.3, 0.7
MINOR_RATIO, OUTLIER_FACTOR = 0.95, 10.0


def unmatched_sections(pairs: DataFrame, sections: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sections of either document that no mapping of the pair uses."""
    out = None
    for n in (1, 2):
        own = pairs.select("pair_id", F.col(f"doc{n}_id").alias("document_id")).join(
            sections.select("document_id", "section_name"), "document_id"
        )
        used = mappings.select("pair_id", F.col(f"doc{n}_section").alias("section_name"))
        left = own.join(used, ["pair_id", "section_name"], "left_anti").select(
            "pair_id", F.lit(n).alias("side"), "section_name"
        )
        out = left if out is None else out.unionByName(left)
    return out


def missing_numbers(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbers one table has and the other lacks at the same place; sides as for compare_cells."""
    on = [*keys, "row", "col"]
    a = left.select(*on, F.col("value").alias("value1"), F.col("item_name").alias("_i1"))
    b = right.select(*on, F.col("value").alias("value2"), F.col("item_name").alias("_i2"))
    lacks1 = F.col("value1").isNull()
    return (
        a.join(b, on, "full_outer")
        .where(lacks1 | F.col("value2").isNull())
        .select(
            *on, F.coalesce("_i1", "_i2").alias("item_name"), F.coalesce("value1", "value2").alias("value"),
            F.when(lacks1, 1).otherwise(2).alias("missing_in"),
        )
    )


def missing_values(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance_pct: float = TOLERANCE_PCT) -> DataFrame:
    """Numbers of one side that the other lacks wherever it stands, units unified and rounding allowed.

    Values fall into cells of half the tolerance on a logarithmic scale, by unit and sign; zero has a cell of its own. A cell
    is known by its least and greatest value, so a value meets a few rows whatever the other side repeats, and the nearest
    values around it are among them: the test against these is exact.
    """
    step = -math.log1p(-tolerance_pct / 100) / 2
    on = [*keys, "unit", "_sign", "_cell"]

    def placed(df: DataFrame) -> DataFrame:
        number = normalise_unit(F.col("value"), F.col("unit"))
        rows = df.withColumn("_n", number).withColumn("unit", F.col("_n.unit")).withColumn("_base", F.col("_n.value"))
        cell = F.when(F.col("_base") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("_base")) / step)).cast("long")
        return rows.withColumn("_sign", F.signum("_base").cast("int")).withColumn("_cell", cell).drop("_n")

    def lacking(own: DataFrame, other: DataFrame, side: int) -> DataFrame:
        cells = other.groupBy(*on).agg(F.min("_base").alias("_low"), F.max("_base").alias("_high"))
        near = F.explode(F.array(*[F.col("_cell") + k for k in range(-3, 4)]))
        asked = own.select(*on, "_base").distinct().withColumn("_cell", near)
        met = asked.join(cells, on).where(within_tolerance(F.col("_base"), F.col("_low"), tolerance_pct) | within_tolerance(F.col("_base"), F.col("_high"), tolerance_pct))
        known = [*keys, "unit", "_base"]
        return own.join(met.select(*known).distinct(), known, "left_anti").select(
            *keys, "row", "col", "item_name", "value", "unit", F.lit(side).alias("missing_in")
        )

    # Each side is read three times.
    one, two = materialise(placed(left), "numbers"), materialise(placed(right), "numbers")
    return lacking(one, two, 2).unionByName(lacking(two, one, 1))


def similarity_band(similarity: Column) -> Column:
    return (
        F.when(similarity >= SIMILAR_FROM, "similar")
        .when(similarity < DIFFERENT_BELOW, "important_difference")
        .otherwise("between")
    )


def _lines(pairs: DataFrame) -> DataFrame:
    """Paragraphs of both texts, tagged by side."""
    both = F.array(
        F.struct(F.lit(1).alias("side"), F.col("text1").alias("text")),
        F.struct(F.lit(2).alias("side"), F.col("text2").alias("text")),
    )
    return (
        pairs.select("pair_id", F.explode(both).alias("t"))
        .select("pair_id", "t.side", F.explode(F.split("t.text", "\n")).alias("line"))
        .withColumn("_low", F.lower("line"))
    )


def compare_topics(pairs: DataFrame, topics: Lexicon) -> DataFrame:
    """Characters of the paragraphs on each topic, per side, and the ratio of side 2 to side 1."""
    on = topics.matched(_lines(pairs), F.col("_low"))
    hits = F.array_distinct(F.transform("_hits", lambda h: h["kind"]))
    volume = on.select("pair_id", "side", F.length("line").alias("n"), F.explode(hits).alias("topic")).groupBy(
        "pair_id", "topic"
    ).agg(
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("chars1"),
        F.sum(F.when(F.col("side") == 2, F.col("n")).otherwise(0)).alias("chars2"),
    )
    return volume.withColumn(
        "presence",
        F.when(F.col("chars2") == 0, "only_first").when(F.col("chars1") == 0, "only_second").otherwise("both"),
    ).withColumn("volume_ratio", F.try_divide(F.col("chars2"), F.col("chars1")))


def compare_warnings(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """Strongest warning phrase of each side, and the side that warns more strongly; ``levels``: (phrase, level)."""
    phrases = levels.select(F.lower("phrase").alias("needle"), "level")
    on = with_needles(_lines(pairs), F.col("_low"), phrases, "_hits")
    level = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("_hits", lambda h: h["level"])), F.lit(0)))
    found = on.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 1, level)).alias("level1"), F.max(F.when(F.col("side") == 2, level)).alias("level2")
    )
    return found.withColumn(
        "stronger", F.when(F.col("level1") > F.col("level2"), 1).when(F.col("level2") > F.col("level1"), 2)
    )


def with_priority(differences: DataFrame, important: Sequence[str], focus: Sequence[str] = (), then: Sequence[str] = ()) -> DataFrame:
    """high for important or focused sections, low for minor wording, medium otherwise, sorted by priority, section and ``then``.

    Priorities and sections are few: columns that tell their rows apart let the sort spread over as many tasks as it needs.
    """
    section = F.col("section")
    priority = (
        F.when(section.isin(*important, *focus), "high")
        .when(F.coalesce(F.col("match_ratio") >= MINOR_RATIO, F.lit(False)), "low")
        .otherwise("medium")
    )
    return differences.withColumn("priority", priority).orderBy(priority_rank(F.col("priority")), "section", *then)


def priority_rank(value: Column) -> Column:
    return F.when(value == "high", 0).when(value == "medium", 1).otherwise(2)


def undetected_sections(docs: DataFrame, sections: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Template sections a document lacks; ``expected`` comes from the catalogue."""
    wanted = docs.select("document_id", F.explode(F.array(*[F.lit(e) for e in expected])).alias("section_name"))
    return wanted.join(sections.select("document_id", "section_name"), ["document_id", "section_name"], "left_anti")


def extra_sections(sections: DataFrame, expected: Sequence[str]) -> DataFrame:
    return sections.where(~F.col("section_name").isin(*expected)).select(
        "document_id", "section_name", "start_page", "end_page"
    )


def low_confidence(sections: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    return sections.where(F.coalesce("confidence", F.lit(0.0)) < below)


def overlapping_pages(sections: DataFrame) -> DataFrame:
    """Pages that several lowest-level sections claim: counted per page, no section pairs are built."""
    lowest = sections.join(parent_names(sections), ["document_id", "section_name"], "left_anti")
    return (
        section_pages(lowest)
        .groupBy("document_id", "page_number")
        .agg(
            F.count(F.lit(1)).alias("n_sections"), F.min("section_name").alias("first_section"),
            F.max("section_name").alias("last_section"),
        )
        .where(F.col("n_sections") > 1)
    )


def check_series(kpis: DataFrame) -> DataFrame:
    """Per KPI: are all values numeric, are the years in order, how many values are outliers.

    Works on each KPI's own list of points; an outlier differs from the median by
    more than a factor of ten.
    """
    values = F.transform("time_series", lambda p: F.replace(p["value"], F.lit(","), F.lit("")).try_cast("double"))
    years = F.filter(
        F.transform("time_series", lambda p: F.regexp_extract(p["period"], r"([0-9]{4})", 1).try_cast("int")),
        lambda y: y.isNotNull(),
    )
    numbers = F.array_sort(F.filter("_values", lambda v: v.isNotNull()))
    middle = F.get("_numbers", F.floor((F.size("_numbers") - 1) / 2).cast("int"))
    far = F.filter(
        "_numbers",
        lambda v: (F.abs(v) > F.abs(F.col("_middle")) * OUTLIER_FACTOR) | (F.abs(v) * OUTLIER_FACTOR < F.abs(F.col("_middle"))),
    )
    return (
        kpis.withColumn("_values", values)
        .withColumn("_years", years)
        .withColumn("_numbers", numbers)
        .withColumn("_middle", middle)
        .withColumn("all_numeric", F.size("_numbers") == F.size("_values"))
        .withColumn("years_in_order", F.col("_years") == F.array_sort("_years"))
        .withColumn("n_outliers", F.size(far))
        .drop("_values", "_years", "_numbers", "_middle")
    )


def unquoted_relations(relations: DataFrame) -> DataFrame:
    """Relations without a quotation."""
    return relations.where(filled(F.col("relation.original_text")).isNull())


def difference_counts(differences: DataFrame) -> DataFrame:
    """Differences per kind and section, with subtotals per kind and the total."""
    return differences.rollup("kind", "section").agg(F.count(F.lit(1)).alias("n"))


def difference_list(
    rows: DataFrame, importance: str | None = None, section: str | None = None, query: str = "", sort: str = "importance"
) -> DataFrame:
    """Reviews filtered and sorted by importance, page, name or time."""
    if importance:
        rows = rows.where(F.col("importance") == importance)
    if section:
        rows = rows.where(F.col("section_name") == section)
    if query:
        rows = rows.where(any_contains([F.col("section_name"), F.col("summary")], query))
    order = {
        "importance": priority_rank(F.col("importance")), "page": leading_page(F.col("doc1_page_range")),
        "name": F.col("section_name"), "time": F.col("finished_at"),
    }[sort]
    return rows.orderBy(order, "comparison_id", "mapping_index")
