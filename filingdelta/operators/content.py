"""Extracted section content: reply parsing, embedding text, digest, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from filingdelta.functions.json import is_reply
from filingdelta.functions.text import filled, joined
from filingdelta.schemas import CONTENT

# The fact lists of a section, in their order.
GROUPS = (
    "financial_data", "accounting_notes", "factual_info", "messages", "kpi_time_series",
    "logical_relationships", "segment_time_series",
)
# Wording of the embedding text and the digest, and their limits.
SECTION_LABEL, FINANCE_LABEL, TOPIC_LABEL, FACT_LABEL = "セクション名: ", "財務指標: ", "会計トピック: ", "事実情報: "
TYPE_LABEL, MESSAGE_LABEL = "メッセージ種類: ", "メッセージ内容: "
FINANCE_HEAD, NOTES_HEAD, FACTS_HEAD = "【財務指標・数値情報】", "\n【会計処理上のコメント】", "\n【事実情報】"
MESSAGES_HEAD, SERIES_HEAD = "\n【主張・メッセージ】", "\n【時系列財務データ】"
RELATIONS_HEAD, SEGMENTS_HEAD = "\n【論理関係】", "\n【セグメント別時系列データ】"
CONTEXT, TONE, CONFIDENCE, REVENUE = "\n  補足: ", " (トーン: ", " (信頼度: ", " (売上): "
GROWTH, TREND, TARGET = "\n  CAGR: ", "\n  トレンド: ", "\n  目標: "
NO_FACTS = "（抽出された情報なし）"
MAX_ITEMS, MAX_TOPICS, MAX_PREVIEWS, PREVIEW_CHARS = 10, 5, 3, 100
MAX_PERIODS, MAX_RELATIONS, RELATION_CHARS, MAX_SEGMENTS, SEGMENT_PERIODS = 5, 5, 200, 3, 3


def parse_content_reply(sections: DataFrame, reply_col: str = "reply_json") -> DataFrame:
    """Seven fact lists from each JSON reply, missing lists empty; null when it is no JSON object.

    Each list is read on its own: one of another shape is empty, an entry that is no object is left out, a member of
    another shape is null, and all else of the reply is kept.

    The parsed reply is a column of its own, so every list reads the same parse.
    """
    raw = F.col("_raw")
    types = {f.name: f.dataType for f in T.StructType.fromDDL(CONTENT)}

    def entries(group: str) -> Column:
        objects = F.filter(raw[group], lambda x: F.startswith(x, F.lit("{")))
        return F.transform(objects, lambda x: F.from_json(x, types[group].elementType))

    groups = F.struct(*[F.coalesce(entries(g), F.array().cast(types[g])).alias(g) for g in GROUPS])
    return (
        sections.withColumn("_raw", F.from_json(F.col(reply_col), ", ".join(f"{g} array<string>" for g in GROUPS) + ", _corrupt_record string"))
        .withColumn("extracted_content", F.when(raw.isNotNull() & is_reply(F.col(reply_col), raw["_corrupt_record"]), groups))
        .drop("_raw")
    )


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _non_empty(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def _cut(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def embedding_text(name: Column, content: Column) -> Column:
    """Text to embed for a section: its name and the heads of its fact lists."""

    def line(label: str, group: str, n: int, item, sep: str = ", ") -> Column:
        items = content[group]
        return F.when(
            _non_empty(items), F.concat(F.lit(label), joined(F.transform(_cut(items, n), item), sep))
        )

    return F.concat_ws(
        "\n",
        F.concat(F.lit(SECTION_LABEL), name),
        line(FINANCE_LABEL, "financial_data", MAX_ITEMS, lambda x: x["item"]),
        line(TOPIC_LABEL, "accounting_notes", MAX_TOPICS, lambda x: x["topic"]),
        line(
            FACT_LABEL, "factual_info", MAX_ITEMS,
            lambda x: F.concat(_text(x["category"]), F.lit(": "), _text(x["item"])),
        ),
        line(TYPE_LABEL, "messages", MAX_ITEMS, lambda x: x["type"]),
        line(MESSAGE_LABEL, "messages", MAX_PREVIEWS, lambda x: F.substring(x["content"], 1, PREVIEW_CHARS), " | "),
    )


def content_digest(content: Column) -> Column:
    """Readable listing of the seven fact lists, a fixed note when all are empty."""

    def block(title: str, group: str, item, n: int | None = None) -> Column:
        items = content[group] if n is None else _cut(content[group], n)
        return F.when(
            _non_empty(items),
            F.concat(F.lit(title + "\n"), F.array_join(F.transform(items, item), "\n")),
        )

    def cat(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else _text(p) for p in parts])

    def optional(label: str, value: Column) -> Column:
        return F.when(filled(value).isNotNull(), F.concat(F.lit(label), value)).otherwise("")

    def series(points: Column, n: int, unit: Column | None = None) -> Column:
        tail = () if unit is None else (unit,)
        return F.array_join(
            F.transform(_cut(points, n), lambda p: cat(p["period"], ": ", p["value"], *tail)), ", "
        )

    def kpi(k: Column) -> Column:
        return F.concat(
            cat("- ", k["indicator"], " (", k["unit"], "): "),
            F.coalesce(series(k["time_series"], MAX_PERIODS, k["unit"]), F.lit("")),
            optional(GROWTH, k["stated_metrics"]["cagr_stated"]),
            optional(TREND, k["stated_metrics"]["trend_stated"]),
            optional(TARGET, k["target_stated"]["target_description"]),
        )

    text = F.concat_ws(
        "\n",
        block(
            FINANCE_HEAD, "financial_data",
            lambda x: F.concat(
                cat("- ", x["item"], ": ", x["value"], " ", x["unit"], " (", x["period"], ")"),
                optional(CONTEXT, x["context"]),
            ),
        ),
        block(
            NOTES_HEAD, "accounting_notes",
            lambda x: cat("- ", x["topic"], " (", x["type"], ")\n  ", x["content"]),
        ),
        block(
            FACTS_HEAD, "factual_info",
            lambda x: cat("- ", x["category"], " - ", x["item"], ": ", x["value"]),
        ),
        block(
            MESSAGES_HEAD, "messages",
            lambda x: cat("- ", x["type"], TONE, x["tone"], ")\n  ", x["content"]),
        ),
        block(SERIES_HEAD, "kpi_time_series", kpi),
        block(
            RELATIONS_HEAD, "logical_relationships",
            lambda x: cat(
                "- ", x["relationship_type"], CONFIDENCE, F.coalesce(x["confidence"], F.lit("medium")),
                ")\n  ", F.substring(x["original_text"], 1, RELATION_CHARS),
            ),
            MAX_RELATIONS,
        ),
        block(
            SEGMENTS_HEAD, "segment_time_series",
            lambda x: cat("- ", x["segment_name"], REVENUE, series(x["revenue_time_series"], SEGMENT_PERIODS)),
            MAX_SEGMENTS,
        ),
    )
    return F.coalesce(filled(text), F.lit(NO_FACTS))


def structured_summary(docs: DataFrame, pages: DataFrame, grids: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: extraction method, pages, tables, characters, sections with content.

    ``sections`` carries has_content. Each side is aggregated before it is joined.
    """
    text = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("characters"),
    )
    tables = grids.groupBy("document_id").agg(F.count(F.lit(1)).alias("table_count"))
    done = sections.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("section_count"),
        F.count_if(F.col("has_content")).alias("sections_processed"),
    )
    out = docs.select("document_id", "extraction_method")
    for part in (text, tables, done):
        out = out.join(part, "document_id", "left")
    return out.fillna(
        0, ["page_count", "characters", "table_count", "section_count", "sections_processed"]
    )
