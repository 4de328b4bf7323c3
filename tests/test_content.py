"""Grids, content replies, embedding text and digest."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from filingdelta.operators import content, grids

GRID = "document_id string, page_number int, table_index int, grid array<array<string>>"


def test_normalise_tables(spark):
    rows = [
        ("a", 1, 0, [["項目 ", " 金額"], ["売上高", "100", "extra"], ["利益", None]]), ("b", 1, 0, [["x", "x"], ["1", "2"]]),
        ("c", 1, 0, [["only header"]]), ("d", 1, 0, []),
    ]
    got = {r.document_id: r for r in grids.normalise_tables(spark.createDataFrame(rows, GRID)).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert a.header == ["項目", "金額"] and a.rows == [["売上高", "100", "extra"], ["利益", ""]]
    assert a.records == [{"項目": "売上高", "金額": "100", "column_2": "extra"}, {"項目": "利益", "金額": ""}]
    assert (a.row_count, a.column_count) == (2, 2)
    assert got["b"].records == [{"x": "2"}]
    assert (got["c"].row_count, got["c"].rows, got["c"].records) == (0, [], [])


def test_is_numeric_table(spark):
    tables = {"num": [["100", "200"], ["300", "x"]], "text": [["a", "b"]], "none": [], "edge": [["1", "2", "3"] + ["x"] * 7], "over": [["1", "2", "3", "4"] + ["x"] * 7],
              "blank": [["", None]], "wide": [["１", "x"]], "super": [["m²", "x"]]}
    df = spark.createDataFrame(list(tables.items()), "k string, rows array<array<string>>")
    got = {r.k: r.n for r in df.select("k", grids.is_numeric_table(F.col("rows")).alias("n")).collect()}
    assert got == {"num": True, "text": False, "none": False, "edge": False, "over": True, "blank": False, "wide": True, "super": True}


def plain_preview(tables, most, rows, dots):
    if not tables:
        return "テーブルなし"
    out = []
    for i, (page, data) in enumerate(tables[:most]):
        text = f"テーブル{i + 1} (ページ{page}): {len(data)}行 x {len(data[0]) if data else 0}列\n" + "\n".join(" | ".join(r) for r in data[:rows])
        out.append(text + ("\n..." if dots else ""))
        if len(data) > rows and not dots:
            out.append(f"  ... 他 {len(data) - rows} 行")
    if len(tables) > most:
        out.append(("" if dots else "\n") + f"... 他 {len(tables) - most} 個のテーブル")
    return "\n\n".join(out)


def test_table_preview(spark):
    tables = [(p, [[f"{p}-{r}", "v"] for r in range(r_count)]) for p, r_count in ((1, 2), (2, 7), (3, 0), (4, 1))]
    sections = spark.createDataFrame([("d", "S"), ("d", "T")], "document_id string, section_name string")
    table = spark.createDataFrame([("d", "S", p, 0, rows) for p, rows in tables], "document_id string, section_name string, page_number int, table_index int, rows array<array<string>>")
    for most, rows, dots in ((10, 5, False), (2, 5, False), (3, 3, True), (5, 3, True)):
        got = {r.section_name: r.preview for r in grids.table_preview(sections, table, most, rows, dots).collect()}
        assert got == {"S": plain_preview(tables, most, rows, dots), "T": "テーブルなし"}


def test_section_tables(spark):
    pages = spark.createDataFrame([("d", "S", 0, 1), ("d", "S", 1, 2), ("d", "T", 0, 2)], "document_id string, section_name string, position int, page_number int")
    table = spark.createDataFrame([("d", 2, 0), ("d", 3, 0), ("e", 1, 0)], "document_id string, page_number int, table_index int")
    assert {(r.section_name, r.page_number) for r in grids.section_tables(pages, table).collect()} == {("S", 2), ("T", 2)}


FULL = {
    "financial_data": [{"item": f"i{n}", "value": n, "unit": "円", "period": "2024"} for n in range(12)] + [{"item": "o", "value": {"a": 1}, "context": "note"}],
    "accounting_notes": [{"topic": f"t{n}", "content": "c", "type": "注記"} for n in range(6)],
    "factual_info": [{"category": "k", "item": "f", "value": "v"}],
    "messages": [{"type": f"m{n}", "content": "z" * 150, "tone": "neutral"} for n in range(4)],
    "kpi_time_series": [{"indicator": "売上", "unit": "円", "time_series": [{"period": str(y), "value": y} for y in range(2018, 2025)],
                         "stated_metrics": {"cagr_stated": "3%", "trend_stated": "up"}, "target_stated": {"target_description": "goal"}},
                        {"indicator": "x", "unit": "", "time_series": []}],
    "logical_relationships": [{"relationship_type": "causality", "original_text": "q" * 250, "confidence": "high"}] * 6 + [{}],
    "segment_time_series": [{"segment_name": f"s{n}", "revenue_time_series": [{"period": str(p), "value": p} for p in range(5)]} for n in range(4)],
}


def plain_embedding(name, c):
    parts = [f"セクション名: {name}"]
    if c.get("financial_data"):
        parts.append("財務指標: " + ", ".join(x.get("item", "") for x in c["financial_data"][:10]))
    if c.get("accounting_notes"):
        parts.append("会計トピック: " + ", ".join(x.get("topic", "") for x in c["accounting_notes"][:5]))
    if c.get("factual_info"):
        parts.append("事実情報: " + ", ".join(f"{x.get('category', '')}: {x.get('item', '')}" for x in c["factual_info"][:10]))
    if c.get("messages"):
        parts.append("メッセージ種類: " + ", ".join(x.get("type", "") for x in c["messages"][:10]))
        parts.append("メッセージ内容: " + " | ".join(x.get("content", "")[:100] for x in c["messages"][:3]))
    return "\n".join(parts)


def parse(spark, replies):
    df = spark.createDataFrame([(k, r) for k, r in replies.items()], "section_name string, reply_json string")
    return content.parse_content_reply(df)


def test_parse_content_reply(spark):
    got = {r.section_name: r.extracted_content for r in parse(spark, {
        "full": json.dumps(FULL), "empty": "{}", "bad": "{bad", "null": "null", "list": "[1]", "blank": "", "none": None}).collect()}
    for k in ("bad", "null", "list", "blank", "none"):
        assert got[k] is None, k
    assert got["empty"] == tuple([] for _ in content.GROUPS)
    assert [len(got["full"][g]) for g in content.GROUPS] == [13, 6, 1, 4, 2, 7, 4]
    assert got["full"].financial_data[12].value == '{"a":1}'


def test_embedding_text(spark):
    cases = {"full": FULL, "part": {"messages": [{"type": "only"}]}, "empty": {}}
    df = parse(spark, {**{k: json.dumps(v) for k, v in cases.items()}, "none": None})
    got = {r.section_name: r.t for r in df.select("section_name", content.embedding_text(F.col("section_name"), F.col("extracted_content")).alias("t")).collect()}
    assert got["full"] == plain_embedding("full", FULL)
    assert got["part"] == "セクション名: part\nメッセージ種類: only\nメッセージ内容: "
    assert got["empty"] == "セクション名: empty" and got["none"] == "セクション名: none"


def test_content_digest(spark):
    df = parse(spark, {"full": json.dumps(FULL), "empty": "{}", "none": None, "note": json.dumps({"accounting_notes": [{"topic": "t", "content": "c", "type": "k"}]})})
    got = {r.section_name: r.t for r in df.select("section_name", content.content_digest(F.col("extracted_content")).alias("t")).collect()}
    assert got["empty"] == got["none"] == "（抽出された情報なし）"
    assert got["note"] == "\n【会計処理上のコメント】\n- t (k)\n  c"
    lines = got["full"].split("\n")
    assert lines[:2] == ["【財務指標・数値情報】", "- i0: 0 円 (2024)"]
    assert lines[13:16] == ['- o: {"a":1}  ()', "  補足: note", ""]
    assert "- 売上 (円): 2018: 2018円, 2019: 2019円, 2020: 2020円, 2021: 2021円, 2022: 2022円" in lines
    at = lines.index("  CAGR: 3%")
    assert lines[at:at + 5] == ["  CAGR: 3%", "  トレンド: up", "  目標: goal", "- x (): ", ""]
    assert lines.count("- causality (信頼度: high)") == 5 and "  " + "q" * 200 in lines
    assert lines[-3:] == ["- s0 (売上): 0: 0, 1: 1, 2: 2", "- s1 (売上): 0: 0, 1: 1, 2: 2", "- s2 (売上): 0: 0, 1: 1, 2: 2"]


def test_members_of_another_shape(spark):
    """One odd member leaves the rest of the reply as it is."""
    good = [{"item": "a", "value": 1}]
    got = {r.section_name: r.extracted_content for r in parse(spark, {
        "strings": json.dumps({"financial_data": good, "messages": ["hello", {"type": "t"}]}),
        "object": json.dumps({"financial_data": good, "factual_info": {"category": "c"}}),
        "inner": json.dumps({"financial_data": good, "kpi_time_series": [{"indicator": "i", "stated_metrics": "none", "unit": "u"}]})}).collect()}
    assert all(c.financial_data[0].item == "a" and c.financial_data[0].value == "1" for c in got.values())
    assert got["object"].factual_info == [] and got["inner"].kpi_time_series[0].unit == "u"
    assert [m.type for m in got["strings"].messages] == ["t"]
