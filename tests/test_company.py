"""Company folding and comparison modes."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from filingdelta.functions.company import normalise_company, same_company
from filingdelta.operators.mapping import TOO_FEW_DOCUMENTS, determine_modes

FOLDED = [
    ("富士フイルムホールディングス株式会社", "富士ふいるむ"), ("ソニー（株）", "そに(株)"), ("ABC Corp.", "abc"), ("abc corporation", "abc"),
    ("Acme (Japan) Holdings", "acme"), ("ＡＢＣ　Ltd.", "abc"), ("ヴィーナス", "ゔぃなす"), (None, None), ("ﾃｽﾄ", "てすと"), ("A-B, C。", "abc"),
]


def test_normalise_company(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(FOLDED)], "i int, n string")
    got = {r.i: r.f for r in df.select("i", normalise_company(F.col("n")).alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(FOLDED)}


@pytest.mark.parametrize("a,b,same", [
    ("富士フイルムホールディングス株式会社", "富士フイルム", True), ("AB", "AB Ltd.", False), ("AB", " AB ", True), (None, "X", False), ("", "", False),
    ("ABC Corp.", "abc corporation", True), ("Alpha Inc.", "Beta Inc.", False),
])
def test_same_company(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        "a", "b", normalise_company(F.col("a")).alias("x"), normalise_company(F.col("b")).alias("y")
    )
    assert df.select(same_company(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("s")).first().s is same


def expected_mode(company, kind, year):
    if company and not kind:
        return "consistency_check"
    if company and kind and not year:
        return "diff_analysis_year"
    return "diff_analysis_company"


def test_modes(spark):
    docs, requests, want = [], [], {}
    for i, (company, kind, year) in enumerate(itertools.product([True, False], [True, False, None], [True, False, None])):
        docs.append((f"{i}a", "Alpha Works", "annual" if kind is not None else None, 2020))
        docs.append((f"{i}b", "Alpha Works Inc." if company else "Beta Mills", {True: "annual", False: "other", None: None}[kind], {True: 2020, False: 2021, None: None}[year]))
        requests += [(f"c{i}", 1, f"{i}a"), (f"c{i}", 2, f"{i}b")]
        want[f"c{i}"] = (expected_mode(company, bool(kind), bool(year)), None)
    requests += [("one", 1, "0a"), ("three", 1, "0a"), ("three", 2, "0b"), ("three", 3, "1b")]
    want |= {"one": (None, TOO_FEW_DOCUMENTS), "three": ("multi_document", None)}
    got = determine_modes(
        spark.createDataFrame(requests, "comparison_id string, position int, document_id string"),
        spark.createDataFrame(docs, "document_id string, company_name string, document_type string, fiscal_year int"),
    ).collect()
    assert {r.comparison_id: (r.mode, r.error) for r in got} == want


def test_unknown_documents_fail_the_request(spark):
    docs = spark.createDataFrame([("a", "A", "t", 2023), ("b", "B", "t", 2024)], "document_id string, company_name string, document_type string, fiscal_year int")
    requests = [(1, 0, "a"), (1, 1, "zz"), (2, 0, "x"), (2, 1, "y"), (3, 0, "a"), (3, 1, "b"), (3, 2, "q"), (4, 0, "a"), (4, 1, "b")]
    rows = determine_modes(spark.createDataFrame(requests, "comparison_id int, position int, document_id string"), docs).collect()
    got = {r.comparison_id: (r.n_documents, r.mode is None, r.error) for r in rows}
    assert got == {
        1: (2, True, "ドキュメント zz が見つかりません"), 2: (2, True, "ドキュメント x が見つかりません"),
        3: (3, True, "ドキュメント q が見つかりません"), 4: (2, False, None),
    }
