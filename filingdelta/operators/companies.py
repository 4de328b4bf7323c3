"""Companies of a whole corpus by their names: which folded names contain which others."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filingdelta.functions.company import MIN_NAME_LENGTH, normalise_company
from filingdelta.functions.text import strip
from filingdelta.operators.containment import with_needles
from filingdelta.session import materialise

# Long names differ by runs this long; three characters alone are shared by too many.
NAME_GRAMS = (3, 8)


def fold_names(names: DataFrame) -> DataFrame:
    """``names(name_id, name)`` with ``company``: the folded name, or the trimmed one where that is too short to compare.

    Rows with the same ``company`` are the same company; null and empty names are no company.
    """
    folded = normalise_company(F.col("name"))
    company = F.when(F.length(folded) >= MIN_NAME_LENGTH, folded).otherwise(strip(F.col("name")))
    return names.select("name_id", "name", F.when(F.col("name") != "", company).alias("company"), (F.length(folded) >= MIN_NAME_LENGTH).alias("_long"))


def link_companies(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``(short, long, n_short, n_long)`` between different folded names, and members ``(name_id, name, company, n_links)``.

    A link says that the longer name contains the shorter one; the numbers count the rows of each. With the members this
    holds every pair of rows that the pairwise test calls the same company, without listing the pairs.
    """
    folded = materialise(fold_names(names), "names")
    sizes = folded.where("company IS NOT NULL").groupBy("company", "_long").agg(F.count("*").alias("n"))
    long = materialise(sizes.where("_long").select("company", "n"), "companies")
    found = with_needles(long, F.col("company"), long.select(F.col("company").alias("needle"), F.col("n").alias("n_short")), "_in", NAME_GRAMS)
    links = found.select(F.col("company").alias("long"), F.col("n").alias("n_long"), F.explode("_in").alias("_s")).select(
        F.col("_s.needle").alias("short"), "long", "_s.n_short", "n_long"
    ).where(F.col("short") != F.col("long"))
    links = materialise(links, "links")
    ends = links.select(F.col("short").alias("company")).unionByName(links.select(F.col("long").alias("company"))).groupBy("company").agg(F.count("*").alias("_n"))
    linked = F.when(F.col("_long"), F.coalesce("_n", F.lit(0))).otherwise(0).cast("long")
    return links, folded.join(ends, "company", "left").select("name_id", "name", "company", linked.alias("n_links"))
