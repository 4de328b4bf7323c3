"""Validation, gating, overrides, routes, samples and classification."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from filingdelta.operators import intake, pages
from filingdelta.operators.classify import Lexicon, classify, classify_final, matched_keywords, parse_type_reply

PDF = b"%PDF-1.7 body"


def test_validate(spark):
    rows = [
        ("ok", "application/pdf", PDF), ("none", None, PDF), ("text", "text/plain", PDF), ("fake", "application/pdf", b"hello"),
        ("empty", "application/pdf", b""), ("limit", "x-PDF", PDF.ljust(2097152, b"x")), ("big", "application/pdf", PDF.ljust(2097153 + 10486, b"x")),
    ]
    df = spark.createDataFrame([(n, c, b, len(b)) for n, c, b in rows], "filename string, content_type string, content binary, size_bytes long")
    got = {r.filename: (r.status, r.processing_status, list(r.errors)) for r in intake.validate(df, 2).collect()}
    bad = "Only valid PDF documents can be uploaded."
    assert got["ok"] == got["none"] == got["limit"] == ("accepted", "queued", [])
    assert got["text"] == got["fake"] == ("rejected", "rejected", [bad])
    assert got["empty"][2] == ["The file is empty.", bad]
    assert got["big"][2] == ["File size 2.01MB exceeds the limit of 2MB."]


def test_batches(spark):
    uploads = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(6)], "batch_id string, f int")
    batches = spark.createDataFrame([("a",), ("b",), ("c",)], "batch_id string")
    got = {r.batch_id: (r.n_files, r.error is None) for r in intake.check_batches(batches, uploads).collect()}
    assert got == {"a": (5, True), "b": (6, False), "c": (0, False)}
    assert {r.batch_id for r in intake.uploads_in_valid_batches(uploads).collect()} == {"a"}


def docs_frame(spark, rows):
    return spark.createDataFrame(
        rows, "document_id string, detected_type string, manual_type string, detected_type_label string, manual_type_label string, processing_status string"
    )


def test_gate_and_overrides(spark):
    docs = docs_frame(spark, [
        ("1", "annual", None, "A", None, "x"), ("2", "annual", "", "A", "", "x"), ("3", "annual", "unknown", "A", "U", "x"),
        ("4", None, None, None, None, "x"), ("5", "unknown", "brief", "U", "B", "x"), ("6", "", None, "", None, "x"),
    ])
    gated = {r.document_id: r.processing_status for r in intake.gate(docs).collect()}
    assert gated == {"1": "queued", "2": "queued", "3": "pending_classification", "4": "pending_classification", "5": "queued", "6": "pending_classification"}
    asked = spark.createDataFrame([("1", "memo"), ("2", "unknown"), ("3", None), ("4", "brief")], "document_id string, requested_type string")
    kinds = spark.createDataFrame([("brief", "Brief"), ("annual", "Annual")], "document_type string, display_name string")
    got = {r.document_id: (r.manual_type, r.manual_type_label, r.processing_status, r.error is None) for r in intake.apply_overrides(docs, asked, kinds).collect()}
    assert got["1"] == (None, None, "x", False)
    assert got["2"] == ("unknown", "未判定", "x", True)
    assert got["3"] == (None, None, "queued", True)
    assert got["4"] == ("brief", "Brief", "queued", True)
    assert got["5"] == ("brief", "B", "x", True)


@pytest.fixture(scope="module")
def lexicon(spark):
    return Lexicon.of(spark, {"b": ["One", "two", "three", "four"], "a": ["one", "five", "six"], "c": []}, {"a": "Type A", "b": "Type B"})


def test_classify(spark, lexicon):
    rows = [(1, "one.pdf", ""), (2, "x", "TWO three"), (3, "x", "nothing"), (4, None, None), (5, "x", "one two five")]
    df = spark.createDataFrame(rows, "i int, filename string, text_sample string")
    got = {r.i: (r.detected_type, r.detection_confidence, r.matched_keywords, r.detected_type_label) for r in classify(df, lexicon).collect()}
    assert got[1] == ("a", 0.33, ["one"], "Type A")
    assert got[2] == ("b", 0.5, ["two", "three"], "Type B")
    assert got[3] == got[4] == (None, None, None, None)
    assert got[5] == ("a", 0.67, ["one", "five"], "Type A")


def test_intake_reads_page_text(spark, lexicon):
    """Page text, where an upload has it, is what is classified; files without are read as they are."""
    from filingdelta.streaming.intake import intake as take

    rows = [("a.pdf", PDF, "one five"), ("b.pdf", PDF + b" two three", None), ("c.txt", b"two", "one")]
    df = spark.createDataFrame([(n, c, len(c), "application/pdf", t) for n, c, t in rows], "filename string, content binary, size_bytes long, content_type string, text_sample string")
    got = {r.filename: (r.detected_type, r.status) for r in take(df, lexicon).collect()}
    assert got == {"a.pdf": ("a", "accepted"), "b.pdf": ("b", "accepted"), "c.txt": (None, "rejected")}


def test_replies(spark, lexicon):
    replies = {
        1: '{"document_type": "b", "confidence": 0.125, "reason": "r"}', 2: '{"document_type": "zzz", "confidence": 1}', 3: "{bad", 4: "null", 5: "",
        6: None, 7: "[1]", 8: '{"document_type": "unknown", "confidence": "0.9", "reason": 4}', 9: '{"document_type": "a", "confidence": 7}',
        10: '{"document_type": "a", "confidence": -1}', 11: '{"document_type": 3}', 12: '{"document_type": "a", "confidence": true}', 13: '{"document_type": "a", "confidence": null}',
    }
    df = spark.createDataFrame([(i, "one.pdf", "six", r) for i, r in replies.items()], "i int, filename string, text_sample string, reply_json string")
    got = {r.i: (r.reply_type, r.reply_confidence, r.reply_reason, r.reply_keywords) for r in parse_type_reply(df, lexicon).collect()}
    assert got[1] == ("b", 0.12, "r", ["one"])
    for i in (2, 3, 4, 5, 6, 7, 11):
        assert got[i] == (None, None, None, None), i
    assert got[8] == ("unknown", 0.5, None, [])
    assert got[9][1] == 1.0 and got[10][1] == 0.0 and got[12][1] == 1.0 and got[13][1] == 0.5
    final = {r.i: (r.detected_type, r.classified_by) for r in classify_final(df, lexicon).collect()}
    assert final[1] == ("b", "reply") and final[3] == ("a", "keywords")
    hit = matched_keywords(df.withColumn("document_type", F.lit("a")), lexicon).first()
    assert hit.matched_keywords == ["one", "six"]


def test_text_sufficiency_and_route(spark):
    docs = docs_frame(spark, [(str(i), "annual" if i != 3 else None, None, None, None, "x") for i in range(5)])
    page = spark.createDataFrame([("0", 1, "x" * 50), ("1", 1, "x" * 49), ("1", 2, "x" * 50), ("2", 1, "short"), ("3", 1, "x" * 90)], "document_id string, page_number int, text string")
    enough = pages.text_sufficiency(docs, page)
    got = {r.document_id: (r.avg_chars, r.sufficient) for r in enough.collect()}
    assert got == {"0": (50.0, True), "1": (50.0, True), "2": (5.0, False), "3": (90.0, True), "4": (0.0, False)}
    vision = spark.createDataFrame([("2", True), ("4", False)], "document_id string, success boolean")
    tables = spark.createDataFrame([("0", True)], "document_id string, success boolean")
    route = {r.document_id: (r.extraction_method, r.keep_pages, r.keep_tables, r.detect_sections) for r in
             pages.extraction_route(docs, enough.select("document_id", F.col("sufficient").alias("success")), vision, tables).collect()}
    assert route["0"] == ("text", True, True, True)
    assert route["2"] == ("vision", False, False, False)
    assert route["3"] == ("text", True, False, False)
    assert route["4"] == ("text", False, False, False)


def test_page_range_and_sample(spark):
    page = spark.createDataFrame([("d", n, "" if n == 2 else f"p{n}") for n in range(1, 9)], "document_id string, page_number int, text string")
    asked = spark.createDataFrame([("d", 3, 4)], "document_id string, start_page int, end_page int")
    found, errors = pages.page_range(page, asked)
    assert sorted(r.page_number for r in found.collect()) == [3, 4] and errors.count() == 0
    for s, e in ((0, 2), (5, 9), (4, 3)):
        found, errors = pages.page_range(page, spark.createDataFrame([("d", s, e)], asked.schema))
        assert found.count() == 0 and errors.first().error == f"Invalid page range: {s}-{e} (total: 8)"
    assert pages.text_sample(page).first().text_sample == "p1\np3\np4\np5"
    assert pages.text_sample(page, 5, 4).first().text_sample == "p1\np"
