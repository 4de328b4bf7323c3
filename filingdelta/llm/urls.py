"""URL filters: an allow and block list, then path templates judged by the purity of their labels."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.llm.common import written

# Segments that are variable by their form; the first that fits wins.
FORMS = (
    (r"^[0-9]+$", "{n}"),
    (r"^[0-9]+(\.[A-Za-z]{2,5})$", "{n}.ext"),
    (r"^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{hex}"),
    (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}"),
)
VARIABLE_CHILDREN, VARIABLE_SHARE = 20, 0.5
SIMILAR_Z, PRIOR_WEIGHT, REJECT_ABOVE = 2.0, 10.0, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and path up to ``?`` or ``#``; both empty if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(verdict, host/path)`` that fits, and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _form(segment: Column) -> Column:
    out = segment
    for pattern, name in reversed(FORMS):
        out = F.when(segment.rlike(pattern), name).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """A path's segments by form, however many there are."""
    return F.transform(F.split(F.ltrim(path, F.lit("/")), "/"), _form)


def templates(shapes: DataFrame) -> DataFrame:
    """Template of every ``(host, shape)`` of ``shapes(host, shape, n, labelled, bad)``: columns host, shape, template.

    Level by level under the template so far: all children become a wildcard where most are met about once;
    otherwise a child joins the wildcard if its share of bad labels does not differ from its siblings' (z below
    ``SIMILAR_Z`` standard errors), so only branches that stand out keep their name. The walk ends where no shape
    has a further segment; shapes that have ended take no part in deeper levels.
    """
    tree = shapes.withColumn("template", F.lit("").cast("string"))
    for level in range(shapes.agg(F.max(F.size("shape"))).first()[0] or 0):
        segment = F.get("shape", F.lit(level))
        child = tree.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        parent = child.groupBy("host", "template").agg(
            F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        pooled = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        rest = F.col("all_labelled") - F.col("labelled")
        gap = F.abs((F.col("bad") + 1) / (F.col("labelled") + 2) - (F.col("all_bad") - F.col("bad") + 1) / (rest + 2))
        error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 2) + 1 / (rest + 2)))
        variable = (F.col("children") > VARIABLE_CHILDREN) & (F.col("children") > VARIABLE_SHARE * F.col("all_n"))
        decided = child.join(parent, ["host", "template"]).select(
            "host", "template", "segment",
            F.when(variable | ((gap < SIMILAR_Z * error) & (F.col("children") > 1)), "*").otherwise(F.col("segment")).alias("name"),
        )
        # A level reads the tree three times, so each one is a table of one row per distinct shape.
        tree = tree.withColumn("segment", segment).join(decided, ["host", "template", "segment"], "left").select(
            "host", "shape", "n", "labelled", "bad",
            F.concat("template", F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit("/"), "name"))).alias("template"),
        )
        tree = written(tree, "tree")
    return tree


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, bad_share)`` per row of ``pages(page_id, url)``.

    ``labels(page_id, bad 0/1)`` may hold several rows of a page (any bad one counts); a null label or id counts for
    nothing. The verdict is the longest fitting rule's, else ``block`` where the template's smoothed share of bad labels
    is above ``REJECT_ABOVE``, else ``allow``. A null url, or one without ``://``, has an empty host and path and
    is judged with all others of that kind. Repeated rows are judged alike; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", shape(F.col("path")))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    shapes = rows.join(known, "page_id", "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    shapes = written(shapes, "shapes")
    tree = templates(shapes)
    total = known.agg(((F.sum("bad") + 1) / (F.count("*") + 2)).alias("prior"))
    purity = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # One row: the overall share of bad labels.
    purity = purity.join(F.broadcast(total)).select(
        "host", "template",
        ((F.col("bad") + PRIOR_WEIGHT * F.coalesce("prior", F.lit(0.5))) / (F.col("labelled") + PRIOR_WEIGHT)).alias("bad_share"))
    judged = tree.select("host", "shape", "template").join(purity, ["host", "template"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") > REJECT_ABOVE, "block").otherwise("allow")
    return rows.join(judged, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "bad_share")
