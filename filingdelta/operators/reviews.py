"""Section reviews: eligibility, reply handling, assembly, search gate, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.functions.json import is_reply
from filingdelta.functions.text import filled
from filingdelta.schemas import CONSISTENCY, REVIEW_REPLY

# Wording of failed replies, contradictions and search summaries.
FAILED_REASON, FAILED_SUMMARY = "分析失敗", "分析に失敗しました"
EMPTY_REASON, EMPTY_SUMMARY = "LLMレスポンスが空", "分析結果が取得できませんでした（空のレスポンス）"
NULL_REASON, NULL_SUMMARY = "LLMレスポンスがnull", "分析結果が取得できませんでした"
CONTRADICTIONS = "矛盾が%d件検出されました"
FOUND = "\n\n追加探索により、以下の情報が明らかになりました："
NOTHING_FOUND = "\n\n追加探索を実施しましたが、新たな重要な発見はありませんでした。"
FINDINGS_PER_ROUND, FINDINGS_TOTAL = 2, 3


def eligible(mappings: DataFrame, sections: DataFrame) -> DataFrame:
    """Mappings whose two sections exist and carry extracted content (has_content)."""
    ready = sections.where("has_content")
    one = ready.select(F.col("document_id").alias("doc1_id"), F.col("section_name").alias("doc1_section"))
    two = ready.select(F.col("document_id").alias("doc2_id"), F.col("section_name").alias("doc2_section"))
    return mappings.join(one, ["doc1_id", "doc1_section"], "left_semi").join(
        two, ["doc2_id", "doc2_section"], "left_semi"
    )


def _json_list(items: Column) -> Column:
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


def reviews_from_replies(replies: DataFrame, reply_col: str = "reply_json", search: bool = False) -> DataFrame:
    """Typed review of each reply; ``replies`` also carries ``mode``.

    Lists and maps keep their members as JSON text. A contradiction forces high
    importance, except with ``search`` (the path that may search further).
    Members are read one by one: one of another shape counts as missing, a number or flag may be written as text.
    Unreadable and missing replies give a low-importance review that says so.
    """
    text = F.col(reply_col)
    r = F.col("_r")
    ok = F.col("_ok")
    consistency = F.coalesce(F.col("mode") == CONSISTENCY, F.lit(False))
    packed = F.map_from_arrays(
        F.array(*[F.lit(k) for k in (
            "contradictions", "normal_differences", "complementary_info", "consistency_score", "consistency_reason",
        )]),
        F.array(
            _json_list(r["contradictions"]), _json_list(r["normal_differences"]), _json_list(r["complementary_info"]),
            F.coalesce(r["consistency_score"].try_cast("double"), F.lit(0.0)).cast("string"),
            F.coalesce(r["consistency_reason"], F.lit("")),
        ),
    )
    no_map = F.create_map().cast("map<string,string>")
    changes = F.when(consistency, packed).otherwise(F.coalesce(r["text_changes"], no_map))
    listed = F.when(consistency, r["contradictions"]).otherwise(
        F.from_json(r["text_changes"]["contradictions"], "array<string>")
    )
    n = F.greatest(F.coalesce(F.size(listed), F.lit(0)), F.lit(0))
    importance = F.coalesce(r["importance"], F.lit("medium"))
    reason = F.coalesce(r["importance_reason"], F.lit(""))
    if not search:
        prefix = F.format_string(CONTRADICTIONS, F.col("contradiction_count"))
        forced = F.col("contradiction_count") > 0
        importance = F.when(forced, "high").otherwise(importance)
        reason = (
            F.when(forced & (reason == ""), prefix)
            .when(forced, F.concat(prefix, F.lit("。"), reason))
            .otherwise(reason)
        )
    failure, failure_text = F.lit(FAILED_REASON), F.lit(FAILED_SUMMARY)
    if search:
        is_null = F.trim(text) == "null"
        is_empty = filled(text).isNull()
        failure = F.when(is_empty, EMPTY_REASON).when(is_null, NULL_REASON).otherwise(failure)
        failure_text = F.when(is_empty, EMPTY_SUMMARY).when(is_null, NULL_SUMMARY).otherwise(failure_text)
    no_list = F.array().cast("array<string>")
    ask = r["additional_search"]
    return (
        replies.withColumn("_r", F.from_json(text, REVIEW_REPLY))
        .withColumn("_ok", r.isNotNull() & is_reply(text, r["_corrupt_record"]))
        .withColumn("contradiction_count", F.when(ok, n).otherwise(0))
        .withColumn("text_changes", F.when(ok, changes).otherwise(no_map))
        .withColumn("numerical_changes", F.when(ok, F.coalesce(r["numerical_changes"], no_list)).otherwise(no_list))
        .withColumn("tone_analysis", F.when(ok, F.coalesce(r["tone_analysis"], no_map)).otherwise(no_map))
        .withColumn("importance", F.when(ok, importance).otherwise("low"))
        .withColumn("importance_reason", F.when(ok, reason).otherwise(failure))
        .withColumn("summary", F.when(ok, F.coalesce(r["summary"], F.lit(""))).otherwise(failure_text))
        .withColumn("search_needed", ok & F.coalesce(ask["needed"].try_cast("boolean"), F.lit(False)))
        .withColumn("search_phrases", F.when(ok, F.coalesce(ask["search_phrases"], no_list)).otherwise(no_list))
        .drop("_r", "_ok")
    )


def page_range_text(start: Column, end: Column) -> Column:
    return F.concat(
        F.coalesce(start.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?"))
    )


def assemble_reviews(mappings: DataFrame, reviews: DataFrame, sections: DataFrame) -> DataFrame:
    """Every mapping's review with its page ranges and mapping details, in mapping order.

    Mappings that are equal in all fields take the index of the first of them.
    """
    same = ["pair_id", "doc1_section", "doc2_section", "confidence_score", "mapping_method"]
    first = mappings.groupBy(*same).agg(F.min("mapping_index").alias("review_index"))

    def ranges(n: int) -> DataFrame:
        return sections.select(
            F.col("document_id").alias(f"doc{n}_id"), F.col("section_name").alias(f"doc{n}_section"),
            page_range_text(F.col("start_page"), F.col("end_page")).alias(f"doc{n}_page_range"),
        )

    return (
        mappings.join(first, same)
        .join(reviews, ["pair_id", "mapping_index"])
        .join(ranges(1), ["doc1_id", "doc1_section"])
        .join(ranges(2), ["doc2_id", "doc2_section"])
        .withColumn("section_name", F.col("doc1_section"))
        .withColumnsRenamed({"doc1_section": "doc1_section_name", "doc2_section": "doc2_section_name",
                             "confidence_score": "mapping_confidence"})
    )


def search_gate(needed: Column, importance: Column, phrases: Column, mode: str) -> Column:
    """Whether to search further: asked for, allowed by the mode, and with phrases to search."""
    if mode not in ("off", "high_only", "all"):
        raise ValueError(f"unknown search mode: {mode}")
    allowed = {
        "off": F.lit(False), "high_only": F.coalesce(importance == "high", F.lit(False)), "all": F.lit(True)
    }[mode]
    return F.coalesce(needed, F.lit(False)) & allowed & F.coalesce(F.size(phrases) > 0, F.lit(False))


def enhanced_summary(base: Column, findings: Column) -> Column:
    """Base summary plus the leading findings of the search rounds.

    ``findings``: array (one entry per round) of arrays of strings.
    """
    heads = F.flatten(
        F.transform(
            findings,
            lambda f: F.slice(F.coalesce(f, F.array().cast("array<string>")), 1, FINDINGS_PER_ROUND),
        )
    )
    text = F.array_join(F.slice(heads, 1, FINDINGS_TOTAL), "; ")
    return (
        F.when(F.coalesce(F.size(findings), F.lit(0)) <= 0, base)
        .when(F.size(heads) > 0, F.concat(base, F.lit(FOUND), text))
        .otherwise(F.concat(base, F.lit(NOTHING_FOUND)))
    )
