"""Keep-latest stores, section families and comparisons of several documents."""

from __future__ import annotations

import os
import random
import re

import pytest

from filingdelta.operators.families import section_families
from filingdelta.operators.search import search_rounds
from filingdelta.plans.compare import Corpus, TOO_MANY_DOCUMENTS, compare_many
from filingdelta.operators import changes, content
from filingdelta.sources.store import ResultStore, Store

ROW = "document_id string, n int, tags map<string,string>, at string"


def test_store_keeps_the_latest(spark, tmp_path):
    store = Store(os.path.join(tmp_path, "s"), "document_id", 8)
    with pytest.raises(FileNotFoundError):
        store.latest(spark)
    rows = [(f"d{k}", k, {"k": str(k)}, "2024") for k in range(40)]
    assert store.save(spark.createDataFrame(rows, ROW)) == 1
    # Two rows of one id in one save: the later one by the order counts, of equal ones the greater text, in any order of the rows.
    twice = [("d1", 7, None, "2025"), ("d1", 9, None, "2023"), ("d2", 5, None, "x"), ("d2", 6, None, "x"), ("new", 0, {}, "y")]
    before = {p for p, _, f in os.walk(tmp_path / "s") if f}
    assert store.save(spark.createDataFrame(twice, ROW), ["at"]) == 2
    store.save(spark.createDataFrame(twice[::-1], ROW), ["at"])
    got = {r.document_id: r.n for r in store.latest(spark).collect()}
    assert got == {f"d{k}": k for k in range(40)} | {"d1": 7, "d2": 6, "new": 0}
    # A save writes below its own folder only, in the buckets of its ids.
    later = {p for p, _, f in os.walk(tmp_path / "s") if f} - before
    assert all("save=1" not in p for p in later) and len([p for p in later if "save=2/bucket" in p]) <= 3
    with pytest.raises(Exception, match="document_id is required"):
        store.save(spark.createDataFrame([("", 1, None, "x")], ROW))


def test_point_read_lists_one_bucket(spark, tmp_path):
    store = Store(os.path.join(tmp_path, "s"), "document_id", 8)
    store.save(spark.createDataFrame([(f"d{k}", k, None, "x") for k in range(100)], ROW))
    store.save(spark.createDataFrame([("d3", -3, None, "x")], ROW))
    one = store.get(spark, "d3")
    assert [(r.document_id, r.n) for r in one.collect()] == [("d3", -3)] and store.get(spark, "zz").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*\(bucket#\d+ = \d\)", plan), plan


def test_whole_results_are_replaced(spark, tmp_path):
    store = ResultStore(os.path.join(tmp_path, "r"), buckets=4)
    head = lambda *rows: spark.createDataFrame(rows, "comparison_id string, mode string")
    part = lambda *rows: spark.createDataFrame(rows, "comparison_id string, value int")
    store.save(head(("a", "m"), ("b", "m")), {"diffs": part(("a", 1), ("a", 2), ("b", 3)), "reviews": part(("a", 9))})
    store.save(head(("a", "again")), {"diffs": part(), "reviews": part(("a", 8), ("a", 8))})
    found = store.load(spark, "a", ["diffs", "reviews"])
    assert [r.mode for r in found["header"].collect()] == ["again"]
    # Saved again without differences it has none, and equal rows stay as they are.
    assert found["diffs"].count() == 0 and [r.value for r in found["reviews"].collect()] == [8, 8]
    assert sorted(tuple(r) for r in store.current(spark, "diffs").collect()) == [("b", 3)]
    with pytest.raises(FileNotFoundError):
        store.load(spark, "zz", ["diffs"])


def test_families(spark):
    rng, edges = random.Random(9), []
    for c in ("x", "y"):
        edges += [(c, (rng.randrange(3), f"s{rng.randrange(60)}"), (rng.randrange(3), f"s{rng.randrange(60)}")) for _ in range(45)]
    edges += [("chain", (0, f"s{k:02d}"), (0, f"s{k + 1:02d}")) for k in range(40)]
    node = "struct<position:int,section_name:string>"
    found = section_families(spark.createDataFrame(edges, f"comparison_id string, one {node}, two {node}"))
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for c, a, b in edges:
        low, high = sorted((root((c, a)), root((c, b))))
        parent[high] = low
    assert {(r.comparison_id, tuple(r.section)): tuple(r.family) for r in found.collect()} == {x: root(x)[1] for x in list(parent)}
    assert section_families(spark.createDataFrame([], f"comparison_id string, one {node}, two {node}")).count() == 0


def test_comparing_several_documents(spark):
    docs = [("a", "t", "Alpha", 2020), ("b", "t", "Alpha", 2021), ("c", "u", "Beta", 2020), ("d", "t", "Alpha", 2022), ("e", None, None, None), ("f", "t", None, None)]
    requests = [("three", k, d) for k, d in enumerate("abc")] + [("five", k, d) for k, d in enumerate("abcde")] + [("six", k, d) for k, d in enumerate("abcdef")] + [("bad", 0, "a"), ("bad", 1, "zz"), ("bad", 2, "b")]
    sections = [(d, s, 1, 1, True) for d in "abd" for s in ("S", "T")] + [("c", "Z", 1, 1, True), ("a", "only", 1, 1, True)]
    vectors = [(d, i, s, v) for d in "abd" for i, (s, v) in enumerate((("S", [1.0, 0.0]), ("T", [0.0, 1.0])))] + [("c", 0, "Z", [0.9, 0.1])]
    empty = lambda schema: spark.createDataFrame([], schema)
    facts = content.parse_content_reply(empty("document_id string, section_name string, reply_json string"))
    corpus = Corpus(
        documents=spark.createDataFrame(docs, "document_id string, document_type string, company_name string, fiscal_year int"),
        sections=spark.createDataFrame(sections, "document_id string, section_name string, start_page int, end_page int, has_content boolean"),
        section_texts=spark.createDataFrame([(d, s, f"{s}\n{d}") for d, s, *_ in sections], "document_id string, section_name string, text string"),
        vectors=spark.createDataFrame(vectors, "document_id string, ordinal long, section_name string, vector array<double>"),
        cells=empty("document_id string, table_id string, row int, col int, item_name string, text string"),
        table_sections=empty("document_id string, section_name string, table_id string"),
        kpis=changes.explode_kpis(facts), relations=changes.explode_relations(facts),
    )
    found = compare_many(spark.createDataFrame(requests, "comparison_id string, position int, document_id string"), corpus, empty("pair_id string, mapping_index long, reply_json string"), dimension=2)
    errors = {r.comparison_id: r.error for r in found["comparisons"].collect()}
    assert errors["three"] is errors["five"] is None and errors["six"] == TOO_MANY_DOCUMENTS and "zz" in errors["bad"]
    pairs = {r.pair_id: (r.doc1_id, r.doc2_id, r.mode) for r in found["pairs"].collect()}
    assert len(pairs) == 3 + 10 and pairs["three/0-1"] == ("a", "b", "diff_analysis_year") and pairs["five/2-4"][:2] == ("c", "e")
    families = {(r.comparison_id, r.position, r.section_name): (r.n_sections, r.n_documents) for r in found["families"].collect()}
    assert families == {("three", 0, "S"): (3, 3), ("three", 0, "T"): (2, 2), ("five", 0, "S"): (4, 4), ("five", 0, "T"): (3, 3)}
    members = {(r.comparison_id, r.document_id, r.section_name): r.family_section for r in found["members"].collect()}
    assert members["three", "c", "Z"] == "S" and ("three", "a", "only") not in members and len(members) == 12
    texts = {(r.pair_id, r.section): (r.matched, r.n_changed) for r in found["text_diffs"].collect()}
    assert texts["three/0-1", "S"] == (1, 1) and texts["three/0-2", "S"] == (0, 1)


def test_search_rounds(spark):
    vectors = spark.createDataFrame([("d", k, f"s{k}", [1.0, k / 10]) for k in range(9)], "document_id string, ordinal long, section_name string, vector array<double>")
    ask = lambda i, importance="high", needed=True, phrases=("w",): ("p", i, "d", "s0", importance, needed, list(phrases), "Base")
    reviews = spark.createDataFrame([ask(1), ask(2, "low"), ask(3, needed=False), ask(4, phrases=()), ask(5), ask(6)],
                                    "pair_id string, mapping_index long, doc1_id string, doc1_section_name string, importance string, search_needed boolean, search_phrases array<string>, summary string")
    told = [("p", i, 1, ["w"], [1.0, 0.0], ["f1", "f2", "f3"]) for i in (1, 2, 3, 4, 5)] + [("p", 1, 2, ["x"], [1.0, 0.0], []), ("p", 2, 2, [], [1.0, 0.0], ["no"])]
    rounds = spark.createDataFrame(told, "pair_id string, mapping_index long, iteration int, phrases array<string>, vector array<double>, new_findings array<string>")

    def run(mode):
        rows = search_rounds(reviews, rounds, vectors, mode, dimension=2).collect()
        assert all(r.has_additional_context == bool(r.additional_searches) for r in rows)
        return {r.mapping_index: [[f.section_name for f in s.found_sections] for s in r.additional_searches] for r in rows}, {r.mapping_index: r.summary for r in rows}

    found, summary = run("all")
    assert found == {1: [["s1", "s2", "s3"], ["s4", "s5", "s6"]], 2: [["s1", "s2", "s3"]], 3: [], 4: [], 5: [["s1", "s2", "s3"]], 6: []}
    assert summary[3] == "Base" and summary[1].endswith("f1; f2") and summary[1] == summary[2]
    found, _ = run("high_only")
    assert found[2] == [] and len(found[1]) == 2
    assert set(map(tuple, run("off")[0].values())) == {()}
    with pytest.raises(ValueError):
        run("sometimes")
