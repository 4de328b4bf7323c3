"""Report tables, numbering in hot groups, sources, exports and checks."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from filingdelta.functions.ordinals import number_within
from filingdelta.operators import checks, report
from filingdelta.operators.classify import Lexicon
from filingdelta.sources import exports, records, templates


def test_number_within_hot_key(spark):
    """Half of the rows share one key; the numbers are those of a sort."""
    rng = random.Random(11)
    rows = [(("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}"), rng.randint(0, 50), i) for i in range(5000)]
    rows += [(None, 3, 9001), (None, 1, 9002)]
    df = spark.createDataFrame(rows, "k string, o int, i int").repartition(16)
    groups = {}
    for k, o, i in rows:
        groups.setdefault(k, []).append((o, i))
    want = {i: n for items in groups.values() for n, (_, i) in enumerate(sorted(items), 1)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for ranges in ("1", "8", "100"):
            spark.conf.set("spark.sql.shuffle.partitions", ranges)
            got = {r.i: r.n for r in number_within(df, ["k"], [F.col("o"), F.col("i")], "n").collect()}
            assert got == want, ranges
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    backward = {r.i: r.n for r in number_within(df.where("k = 'hot'"), ["k"], [F.desc("o"), F.desc("i")], "n").collect()}
    assert all(backward[i] == len(groups["hot"]) + 1 - want[i] for i in backward)


REVIEW = "comparison_id string, mapping_index long, section_name string, doc1_section_name string, doc2_section_name string, doc1_page_range string, doc2_page_range string, importance string, summary string, finished_at int"
ROWS = [
    ("c", 1, "Risk", "Risk", "Hazard", "10-12", "3-4", "high", "Sales fell", 3), ("c", 2, "Risk", "Risk", "Other", "2-3", "9-9", "low", "same", 1),
    ("c", 3, "Sales", "", "Sales", "?-?", None, "medium", None, 2), ("c", 4, "Risk", "Risk", "Third", "2-8", "1-1", "high", "x", 4), ("d", 1, "Risk", None, "Risk", "1-1", "1-1", "high", "y", 1),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, REVIEW)


def test_filter_order_and_index(rows):
    def ids(df):
        return [(r.comparison_id, r.mapping_index) for r in df.collect()]

    assert sorted(ids(report.filter_reviews(rows, "high"))) == [("c", 1), ("c", 4), ("d", 1)]
    assert sorted(ids(report.filter_reviews(rows, "all", "SALES"))) == [("c", 1), ("c", 3)]
    assert ids(report.filter_reviews(rows, "all", "hazard")) == [("c", 1)]
    assert ids(report.filter_reviews(rows, "all", "hazard", report.COUNTED_FIELDS)) == []
    assert ids(report.page_order(rows)) == [("c", 3), ("c", 4), ("c", 2), ("c", 1), ("d", 1)]
    got = {(r.comparison_id, r.mapping_index): (r.doc1_key, r.current_index, r.total_count, r.is_multi) for r in report.multi_index(rows).collect()}
    assert got == {("c", 4): ("Risk", 1, 3, True), ("c", 2): ("Risk", 2, 3, True), ("c", 1): ("Risk", 3, 3, True), ("c", 3): ("Sales", 1, 1, False), ("d", 1): ("Risk", 1, 1, False)}


def test_dashboard_progress_and_outcomes(spark, rows):
    ids = spark.createDataFrame([("c",), ("d",), ("e",)], "comparison_id string")
    numbers = spark.createDataFrame([("c",), ("c",)], "comparison_id string")
    got = {r.comparison_id: tuple(r)[1:] for r in report.dashboard(ids, rows, numbers).collect()}
    assert got == {"c": (4, 2, 1, 2), "d": (1, 1, 0, 0), "e": (0, 0, 0, 0)}
    done = rows.select("comparison_id", "finished_at", F.col("mapping_index").alias("section"))
    got = {(r.comparison_id, r.section): r.progress for r in report.progress(done).collect()}
    assert got == {("c", 2): 45, ("c", 3): 60, ("c", 1): 75, ("c", 4): 90, ("d", 1): 90}
    loading = spark.range(3).select(report.loading_progress(F.col("id"), F.lit(3)).alias("p"))
    assert [r.p for r in loading.collect()] == [10 + (i + 1) * 10 // 3 for i in range(3)]
    assert spark.range(1).select(report.analysis_progress(F.lit(0), F.lit(0)).alias("p")).first().p == 30
    docs = spark.createDataFrame([("1", "a", None, "structured"), ("2", "unknown", None, "structured"), ("3", "a", None, "failed"), ("4", None, "", None)],
                                 "document_id string, detected_type string, manual_type string, structure_status string")
    out = {r.document_id: (r.outcome, r.reason) for r in report.document_outcomes(docs).collect()}
    assert out == {"1": ("completed", None), "2": ("skipped", "unknown_type"), "3": ("failed", None), "4": ("skipped", "unknown_type")}


def test_large_exports_are_many_files(spark, tmp_path):
    """Quoted line breaks keep a file in one task, so no file holds more than its share, whatever the number of tasks."""
    rows = spark.range(0, 2 * exports.FILE_ROWS + 5, 1, 1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit('a "b"\n'), F.col("id").cast("string")).alias("text"))
    path = os.path.join(tmp_path, "csv")
    exports.write_csv(rows, path)
    back = exports.read_csv(spark, path, "id string, text string")
    sizes = sorted(r["count"] for r in back.groupBy(F.input_file_name()).count().collect())
    assert sizes == [5, exports.FILE_ROWS, exports.FILE_ROWS]
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "quoted", name', 1, None, 'line\nbreak'), ("", 2, 0.12345, " padded "), ("x", None, float("nan"), None)]
    df = spark.createDataFrame([("d", n, s, s, 7, c, t, None) for n, s, c, t in rows],
                               "document_id string, section_name string, start_page int, end_page int, char_count int, confidence double, summary string, extracted_content struct<a:string>")
    table = report.sections_csv(df)
    path = os.path.join(tmp_path, "csv")
    exports.write_csv(table, path)
    back = exports.read_csv(spark, path, ", ".join(f"{c} string" for c in table.columns))
    key = sorted(tuple(r) for r in back.collect())
    assert key == sorted(tuple(r) for r in table.collect())
    assert {r.confidence_pct for r in back.collect()} == {"", "12.3"}


def test_metadata_records(spark, tmp_path):
    for i in range(3):
        record = {"document_id": str(i), "filename": "f", "stored_path": "p", "size_bytes": 1, "created_at": f"2024-01-0{i + 1}T00:00:00Z", "structured_data": None}
        (tmp_path / f"{i}.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "bad.json").write_text('{"document_id": "9", ')
    (tmp_path / "part.json").write_text('{"document_id": "8"}')
    found = records.list_documents(records.read_metadata(spark, str(tmp_path)))
    assert [r.document_id for r in found.collect()] == ["2", "1", "0"]
    gone = spark.createDataFrame([("1",), ("7",)], "document_id string")
    assert {r.document_id for r in records.without(found, gone).collect()} == {"0", "2"}
    assert [r.document_id for r in records.unknown_ids(found, gone).collect()] == ["7"]
    done = spark.createDataFrame([("0", "data", "text", None)], "document_id string, structured_data string, extraction_method string, extraction_metadata map<string,string>")
    got = {r.document_id: (r.structured_data, r.extraction_metadata, r.updated_at) for r in records.apply_structured(found, done, "2024-05-01T00:00:00").collect()}
    assert got["0"] == ("data", {}, "2024-05-01T00:00:00Z") and got["1"] == (None, None, None)


def test_comparison_store(spark, tmp_path):
    path = os.path.join(tmp_path, "c")
    schema = "comparison_id string, created_at string, mode string"
    records.save_comparison(spark.createDataFrame([("x", "2024-01-01T0", "m"), ("y", "2024-01-02T0", "m")], schema), path)
    assert records.load_comparison(spark, path, "y").first().mode == "m"
    records.save_comparison(spark.createDataFrame([("y", "2024-01-03T0", "again")], schema), path)
    assert [tuple(r) for r in records.load_comparison(spark, path, "y").collect()] == [("y", "2024-01-03T0", "again")]
    assert records.read_comparisons(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        records.load_comparison(spark, path, "z")
    with pytest.raises(Exception, match="comparison_id is required"):
        records.save_comparison(spark.createDataFrame([("", "2024", "m")], schema), path)


def test_uploads_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    row = records.read_uploads(spark, str(tmp_path)).first()
    assert (row.filename, row.size_bytes, bytes(row.content)) == ("a.pdf", 6, b"%PDF-1")


def test_templates(spark, tmp_path):
    (tmp_path / "b_kind.yaml").write_text("display_name: 様式B\nkeywords_for_detection: [Alpha, 3, beta]\nsections:\n  - name: A\n    required: true\n    subsections:\n      - name: B\n        items: [text, {name: C}]\n    items:\n      - name: D\n  - id: nameless\n    items: [{name: E}]\n")
    (tmp_path / "a_kind.yaml").write_text("sections: []\n")
    (tmp_path / "other.txt").write_text("x")
    rows = templates.read_templates(spark, str(tmp_path))
    lexicon = templates.load_lexicon(rows)
    assert sorted(map(tuple, lexicon.keywords.collect())) == [("b_kind", 0, "alpha"), ("b_kind", 2, "beta")]
    assert sorted(map(tuple, lexicon.labels.collect())) == [("a_kind", "a_kind"), ("b_kind", "様式B")]
    from filingdelta.operators.sections import leaves, template_paths
    paths = template_paths(templates.nodes_of(rows))
    assert {(r.path, r.required) for r in paths.collect()} == {("A", True), ("A - B", False), ("A - B - C", False), ("A - D", False)}
    assert {r.path for r in leaves(paths).collect()} == {"A - B - C", "A - D"}
    assert templates.template(rows, "a_kind").count() == 1
    with pytest.raises(FileNotFoundError):
        templates.template(rows, "missing")


def test_checks(spark):
    text = spark.createDataFrame([("p", "risk is high\nrobot", "risk may be\nrisk again"), ("q", "same", "same")], "pair_id string, text1 string, text2 string")
    topics = Lexicon.of(spark, {"robot": ["robot"], "risk": ["risk"]})
    got = {(r.pair_id, r.topic): (r.chars1, r.chars2, r.presence) for r in checks.compare_topics(text, topics).collect()}
    assert got == {("p", "risk"): (12, 21, "both"), ("p", "robot"): (5, 0, "only_first")}
    got = {r.pair_id: (r.level1, r.level2, r.stronger) for r in checks.compare_warnings(text, spark.createDataFrame([("May be", 1), ("is high", 3)], "phrase string, level int")).collect()}
    assert got == {"p": (3, 1, 1), "q": (0, 0, None)}
    assert {r.pair_id: r.match for r in checks.text_match(text).collect()} == {"p": "none", "q": "exact"}
    sections = spark.createDataFrame([("d", "A", [1, 2, 3], 0.9), ("d", "A - B", [2], 0.5), ("d", "C", [2, 3], None)], "document_id string, section_name string, pages array<int>, confidence double")
    got = {r.page_number: (r.n_sections, r.first_section, r.last_section) for r in checks.overlapping_pages(sections).collect()}
    assert got == {2: (2, "A - B", "C")}
    assert {r.section_name for r in checks.low_confidence(sections).collect()} == {"A - B", "C"}
    docs = spark.createDataFrame([("d",)], "document_id string")
    assert [r.section_name for r in checks.undetected_sections(docs, sections, ["A", "Z"]).collect()] == ["Z"]
    points = lambda *v: [{"period": f"{y}年3月期", "value": x} for y, x in v]
    series = spark.createDataFrame([("ok", points((2020, "1"), (2021, "2"), (2022, "3"))), ("bad", points((2021, "1,000"), (2020, "x"), (2022, "900"), (2023, "1")))],
                                   "k string, time_series array<struct<period:string,value:string>>")
    got = {r.k: (r.all_numeric, r.years_in_order, r.n_outliers) for r in checks.check_series(series).collect()}
    assert got == {"ok": (True, True, 0), "bad": (False, False, 1)}
