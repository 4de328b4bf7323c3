"""Every registered query: SQL twin at the smallest scale, and the shape of its plan."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as spark_entry  # noqa: E402
import check_oracle  # noqa: E402
from filingdelta.plans import registry  # noqa: E402

# The training-data queries have tests of their own, in tests/llm.
QUERIES = {name: query for name, query in spark_entry.queries().items() if name in registry.QUERIES}
ORACLE = {name: sql for name, sql in spark_entry.oracle_sql().items() if name in registry.QUERIES}
# Files read as bytes, character alignment, and ordered alignment (tests/test_alignment.py holds it against a plain form).
WITHOUT_TWIN = {"a2_read_uploads", "e13_text_match_ratio", "e13_ordered_alignment", "e13_ordered_changes", "e13_sentence_changes"}


@pytest.fixture(scope="module")
def con(smoke_dir):
    return check_oracle.connect(smoke_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_TWIN and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, smoke_dir, name):
    df = QUERIES[name](spark, smoke_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan
    left = check_oracle.digest(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        cursor = con.execute(ORACLE[name])
        right = check_oracle.digest([d[0] for d in cursor.description], cursor.fetchall())
        assert left[0] == right[0]
        assert left[2] == right[2]


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns[:2] == ["pair_id", "table_id"] and df.count() > 0


def test_compare_results_agree_with_their_parts(spark, smoke_dir):
    """Two-document requests only get results; every mapping keeps its review."""
    res = registry.comparison_results(registry.Tables(spark, smoke_dir))
    modes = res["comparisons"].collect()
    assert {m.n_documents == 2 for m in modes if m.error is None} == {True}
    assert all(m.error for m in modes if m.n_documents != 2)
    pairs = {str(m.comparison_id) for m in modes if m.n_documents == 2}
    for name, df in res.items():
        if name != "comparisons":
            assert {r.pair_id for r in df.select("pair_id").distinct().collect()} <= pairs, name
    mapped = res["mappings"].count()
    assert res["text_diffs"].count() == mapped
    assert res["section_reviews"].count() <= mapped
