"""Mapping, differences, changes, reviews and search, against plain Python."""

from __future__ import annotations

import difflib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingdelta.functions.ordinals import number_within
from filingdelta.functions.vectors import cosine
from filingdelta.operators import changes, differences, mapping, related, reviews, textdiff, vectorblocks

VEC = "document_id string, ordinal long, section_name string, vector array<double>"
PAIRS = "pair_id string, doc1_id string, doc2_id string"


def plain_cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na == 0 or nb == 0 else float(np.dot(a, b) / (na * nb))


def plain_mapping(one, two, threshold):
    out = {}
    for name, a in one:
        best, match = threshold, None
        for other, b in two:
            if plain_cosine(a, b) > best:
                best, match = plain_cosine(a, b), other
        if match:
            out[name] = match
    return out


def test_map_semantic_edges(spark):
    rows = [
        ("a", 0, "tie", [1.0, 0.0]), ("a", 1, "zero", [0.0, 0.0]), ("a", 2, "limit", [7.0, 51.0 ** 0.5]), ("a", 3, "same", [0.9, 0.1]),
        ("b", 0, "first", [2.0, 0.0]), ("b", 1, "second", [4.0, 0.0]), ("b", 2, "nothing", [0.0, 0.0]),
    ]
    pairs = spark.createDataFrame([("p", "a", "b")], PAIRS)
    vectors = spark.createDataFrame(rows, VEC)
    got = {r.doc1_section: (r.doc2_section, r.mapping_method) for r in mapping.map_semantic(pairs, vectors, 0.7, 2).collect()}
    assert got == {"tie": ("first", "semantic_embedding"), "same": ("first", "semantic_embedding")}


def test_map_semantic_blocks(spark, monkeypatch):
    """Many small blocks give what one nested loop gives."""
    monkeypatch.setattr(vectorblocks, "BLOCK_VALUES", 32)
    rng = np.random.default_rng(3)
    docs = {d: [(f"{d}{i}", rng.normal(size=4).round(1)) for i in range(n)] for d, n in (("a", 50), ("b", 41), ("c", 1))}
    vectors = spark.createDataFrame([(d, i, n, [float(x) for x in v]) for d, items in docs.items() for i, (n, v) in enumerate(items)], VEC)
    pairs = spark.createDataFrame([("ab", "a", "b"), ("ba", "b", "a"), ("ca", "c", "a")], PAIRS)
    rows = mapping.map_semantic(pairs, vectors, 0.5, 4).collect()
    for p in ("ab", "ba", "ca"):
        want = plain_mapping(docs[p[0]], docs[p[1]], 0.5)
        got = {r.doc1_section: r for r in rows if r.pair_id == p}
        assert set(got) == set(want)
        vec = {n: v for items in docs.values() for n, v in items}
        for name, r in got.items():
            assert abs(plain_cosine(vec[name], vec[r.doc2_section]) - plain_cosine(vec[name], vec[want[name]])) < 1e-12


def test_pruned_blocks(spark, monkeypatch):
    """On clustered vectors under half of the block pairs are shipped, blocks are full, and nothing is lost."""
    monkeypatch.setattr(vectorblocks, "BLOCK_VALUES", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    docs = {d: [(f"{d}{i}", centres[rng.integers(6)] + 0.05 * rng.normal(size=8)) for i in range(n)] for d, n in (("a", 203), ("b", 150))}
    docs["a"][5], docs["b"][7] = ("a5", np.zeros(8)), ("b7", np.zeros(8))
    # Ordinals have gaps of any size.
    vectors = spark.createDataFrame([(d, i * 1_000 + i % 7, n, [float(x) for x in v]) for d, items in docs.items() for i, (n, v) in enumerate(items)], VEC)
    pairs = spark.createDataFrame([("ab", "a", "b"), ("bb", "b", "b")], PAIRS)
    report = mapping.pruning_report(pairs, vectors, 0.9, 8).first()
    assert report.shipped < report.block_pairs / 2 and report.fill > 0.9
    for threshold in (0.9, -0.5):
        got = {(r.pair_id, r.doc1_section): r.doc2_section for r in mapping.map_semantic(pairs, vectors, threshold, 8).collect()}
        assert got == {(p, one): two for p in ("ab", "bb") for one, two in plain_mapping(docs[p[0]], docs[p[1]], threshold).items()}
    asked = spark.createDataFrame([(n, "b", i, [float(x) for x in v], [f"b{i}", f"b{(i + 1) % 150}"]) for i, (n, v) in enumerate(docs["a"])],
                                  "query_id string, document_id string, ordinal long, vector array<double>, exclude array<string>")
    found = {}
    for r in related.related_topk(asked, vectors, 4, 8).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.section_name, round(r.similarity, 9))
    for i, (n, v) in enumerate(docs["a"]):
        free = [(m, plain_cosine(v, w)) for m, w in docs["b"] if m not in (f"b{i}", f"b{(i + 1) % 150}")]
        best = sorted(free, key=lambda x: -x[1])[:4]
        assert [found[n][k][1] for k in (1, 2, 3, 4)] == [round(s, 9) for _, s in best], n


def test_map_exact_and_dispatch(spark):
    sections = spark.createDataFrame(
        [("a", "S2", True), ("a", "S1", True), ("a", "S3", True), ("a", "only", True), ("b", "S1", True), ("b", "S2", True), ("b", "S3", False)],
        "document_id string, section_name string, has_content boolean",
    )
    pairs = spark.createDataFrame([("p", "a", "b", None, None), ("q", "a", "b", "x", None)], PAIRS + ", doc1_type string, doc2_type string")
    vectors = spark.createDataFrame([("a", 0, "S1", [1.0]), ("b", 0, "S9", [1.0])], VEC)
    got = {(r.pair_id, r.mapping_index, r.doc1_section, r.doc2_section) for r in mapping.map_sections(pairs, sections, vectors, 0.7, 1).collect()}
    assert got == {("p", 1, "S1", "S1"), ("p", 2, "S2", "S2"), ("q", 0, "S1", "S9")}
    counts = mapping.exact_mapping_counts(pairs, sections).collect()
    assert all((r.mapped, r.skipped) == (2, 1) for r in counts)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = [round(r.c, 9) for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_related_topk_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(vectorblocks, "BLOCK_VALUES", 32)
    rng = np.random.default_rng(4)
    names = [f"s{i:02d}" for i in range(40)]
    vec = {n: rng.normal(size=4) for n in names}
    vectors = spark.createDataFrame([("d", i, n, [float(x) for x in vec[n]]) for i, n in enumerate(names)], VEC)
    asked = [(n, "d", i, [float(x) for x in vec[n]], [n], 1) for i, n in enumerate(names)]
    second = [(n, "d", i, [float(-x) for x in vec[n]], [n], 2) for i, n in enumerate(names) if i % 3]
    queries = spark.createDataFrame(asked + second, "query_id string, document_id string, ordinal long, vector array<double>, exclude array<string>, iteration int")
    got = {}
    for r in related.iterative_search(queries, vectors, 3, 2, 4).collect():
        got.setdefault((r.query_id, r.iteration), {})[r["rank"]] = r.section_name
    for i, n in enumerate(names):
        seen = {n}
        for iteration, v in ((1, vec[n]), (2, -vec[n])):
            if iteration == 2 and i % 3 == 0:
                assert (n, 2) not in got
                continue
            order = sorted((m for m in names if m not in seen), key=lambda m: -plain_cosine(v, vec[m]))[:3]
            assert [got[n, iteration][k] for k in (1, 2, 3)] == order
            seen |= set(order)


CELL = "document_id string, table_id string, row int, col int, item_name string, text string"


def plain_tables(one, two):
    out = []
    for i, (a, b) in enumerate(zip(one, two)):
        for j in range(1, min(len(a), len(b))):
            x, y = (float(c.replace(",", "")) if c.replace(",", "").lstrip("-").isdigit() else None for c in (a[j], b[j]))
            if x is None or y is None or (x == 0 and y == 0):
                continue
            if (x == 0) != (y == 0) or abs(x - y) / max(abs(x), abs(y)) * 100 > 0.01:
                out.append((i, j, a[0], x, y, x - y))
    return sorted(out)


def cells(tables):
    return [(d, t, i, j, row[0], c) for (d, t), rows in tables.items() for i, row in enumerate(rows) for j, c in enumerate(row)]


def test_compare_numbers(spark):
    rng = random.Random(7)

    def table():
        return [[f"item{i}"] + [rng.choice(["1", "2,000", "0", "x", "-5", "2000"]) for _ in range(rng.randint(1, 4))] for i in range(rng.randint(1, 5))]

    tables = {(d, t): table() for d in "ab" for t in ("t1", "t2", "t3")}
    frame = spark.createDataFrame(cells(tables), CELL)
    places = spark.createDataFrame([("a", "S", "t1"), ("a", "S", "t2"), ("a", "T", "t1"), ("b", "S", "t1"), ("b", "T", "t3"), ("b", "T", "t1")],
                                   "document_id string, section_name string, table_id string")
    mappings = spark.createDataFrame([("p", 1, "a", "b", "S", "S"), ("p", 2, "a", "b", "T", "T")],
                                     "pair_id string, mapping_index long, doc1_id string, doc2_id string, doc1_section string, doc2_section string")

    def run(scope):
        return sorted((r.mapping_index, r.section, r.table1, r.table2, r["row"], r.col, r.item_name, r.value1, r.value2, r.difference)
                      for r in differences.compare_numbers(mappings, frame, places, scope).collect())

    def want(links):
        return sorted((i, s, t1, t2, *d) for i, s, t1, t2 in links for d in plain_tables(tables["a", t1], tables["b", t2]))

    assert run("section") == want([(1, "S", "t1", "t1"), (1, "S", "t2", "t1"), (2, "T", "t1", "t3"), (2, "T", "t1", "t1")])
    names = ("t1", "t2", "t3")
    assert run("cross") == want([(i, s, x, y) for i, s in ((1, "S"), (2, "T")) for x in names for y in names])
    # By position: the n-th table of the one section with the n-th of the other.
    got = sorted((r.mapping_index, r.section, r.table_position, r["row"], r.col, r.item_name, r.value1, r.value2, r.difference)
                 for r in differences.compare_numbers(mappings, frame, places, "position").collect())
    assert got == sorted((i, s, n, *d) for i, s, n, t1, t2 in [(1, "S", 1, "t1", "t1"), (2, "T", 1, "t1", "t1")] for d in plain_tables(tables["a", t1], tables["b", t2]))
    with pytest.raises(ValueError):
        differences.compare_numbers(mappings, frame, places, "all")


def test_difference_fields(spark):
    frame = spark.createDataFrame([("a", "t", 0, 1, "売上", "1,000千円"), ("b", "t", 0, 1, "x", "2百万円"), ("a", "t", 1, 1, "零", "0"), ("b", "t", 1, 1, "x", "5%")], CELL)
    pairs = spark.createDataFrame([("p", "a", "t", "b", "t")], "pair_id string, doc1_id string, table1 string, doc2_id string, table2 string")
    got = {r["row"]: r for r in differences.compare_tables(pairs, frame).collect()}
    r = got[0]
    assert (r.value1, r.value2, r.difference, r.difference_pct, r.unit1, r.unit2, r.normalized_unit) == (1000.0, 2.0, -1e6, -100.0, "千円", "百万円", "円")
    assert (r.is_significant, r.threshold) == (True, 0.01)
    assert got[1].difference_pct is None and got[1].normalized_unit == "円"


TEXT = "pair_id string, text1 string, text2 string"


def test_text_diff_chars(spark):
    rng = random.Random(8)
    rows = [(str(i), "".join(rng.choice("abc d\n") for _ in range(rng.randint(1, 300))), "".join(rng.choice("abc d\n") for _ in range(rng.randint(1, 300)))) for i in range(20)]
    rows += [("long", "ab" * 4000, "ba" * 4000), ("empty", "", "x"), ("null", None, "x")]
    got = {r.pair_id: r for r in textdiff.text_diff_chars(spark.createDataFrame(rows, TEXT)).collect()}
    assert "empty" not in got and "null" not in got
    for key, a, b in rows[:21]:
        m = difflib.SequenceMatcher(None, a[:5000], b[:5000])
        ops = m.get_opcodes()
        r = got[key]
        assert r.match_ratio == m.ratio()
        assert r.added_text == [b[j1:j2] for t, _, _, j1, j2 in ops if t == "insert"][:10]
        assert r.removed_text == [a[i1:i2] for t, i1, i2, _, _ in ops if t == "delete"][:10]
        assert [(c.before, c.after) for c in r.changed_text] == [(a[i1:i2], b[j1:j2]) for t, i1, i2, j1, j2 in ops if t == "replace"][:10]
    whole = {r.pair_id: r.match_ratio for r in textdiff.text_diff_chars(spark.createDataFrame(rows[20:21], TEXT), None).collect()}
    assert whole["long"] == difflib.SequenceMatcher(None, *rows[20][1:]).ratio()


def test_text_diff_lines(spark):
    rows = [("p", "a\na\nb\nc、", "a\nb\nb\nc"), ("q", "x", "x")]
    df = spark.createDataFrame(rows, TEXT)
    got = {r.pair_id: (r.common_lines, r.added_lines, r.removed_lines, r.match_ratio) for r in textdiff.text_diff_lines(df).collect()}
    assert got == {"p": (2, 2, 2, 0.5), "q": (1, 0, 0, 1.0)}
    assert {(r.line, r.change, r.copies) for r in textdiff.line_changes(df, ignore_punctuation=True).collect()} == {("a", "removed", 1), ("b", "added", 1)}


MAPPING = "pair_id string, mapping_index long, doc1_id string, doc2_id string, doc1_section string, doc2_section string"


def test_compare_kpis(spark):
    point = [{"period": "2024", "value": "1", "note": None}]
    rows = [
        ("a", "S", 0, "sales", point, "up", "t", None), ("a", "S", 1, "profit", point, None, None, None), ("a", "S", 2, "bare", [], "up", None, None), ("a", "S", 3, "sales", point, "down", "t", "c"),
        ("b", "S", 0, "sales", point, "down", "t", "c"), ("b", "S", 1, "sales", point, "up", "t", None), ("b", "S", 2, "profit", point, None, None, None), ("b", "S", 3, "bare", point, "x", None, None),
        ("b", "S", 4, None, point, "x", None, None), ("a", "S", 4, None, point, "y", None, None),
    ]
    kpis = spark.createDataFrame(rows, "document_id string, section_name string, pos int, indicator string, time_series array<struct<period:string,value:string,note:string>>, trend_stated string, target_description string, comment string")
    got = changes.compare_kpis(spark.createDataFrame([("p", 1, "a", "b", "S", "S")], MAPPING), kpis).collect()
    assert [(r.pos, r.indicator, [(c.type, c.previous, c.current) for c in r.changes]) for r in got] == [
        (0, "sales", [("trend_stated_change", "up", "down"), ("comment_change", None, "c")])
    ]
    assert got[0].changes[0].description == "トレンド表現が「up」から「down」に変化"


FIELDS = ("relationship_type", "original_text", "subject", "reason", "condition", "consequence", "problem", "solution", "premise", "conclusion")


def plain_key(rel):
    kind = rel.get("relationship_type") or ""
    names = {"causality": ("subject", "reason"), "condition_consequence": ("condition", "consequence"), "problem_solution": ("problem", "solution"), "premise_conclusion": ("premise", "conclusion")}
    if kind in names:
        return ":".join([kind, *[rel.get(n) or "" for n in names[kind]]])
    return f"{kind}:{(rel.get('original_text') or '')[:100]}"


def test_blocks_reach_python_in_small_batches(spark):
    """A batch of blocks is bounded in bytes: a worker holds a few blocks, however many its task has."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    block = F.transform(F.sequence(F.lit(1), F.lit(131_072)), lambda x: x.cast("double") + F.col("id"))
    found = spark.range(0, 40, 1, 1).select(block.alias("items")).mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in found) == 40 and max(r.size for r in found) <= 18 << 20


def test_matcher_is_the_librarys(spark):
    """Long and short texts, with and without left-out characters: the pieces are difflib's, and equal texts need no search."""
    rng = random.Random(8)

    def text(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    def changed(t):
        for _ in range(rng.randrange(1, 9)):
            at, n = rng.randrange(len(t) + 1), rng.randrange(0, 60)
            t = t[:at] + rng.choice(["", text("xyz é", n), t[:n]]) + t[at + rng.randrange(0, 40):]
        return t

    many = "".join(map(chr, range(0x4E00, 0x4E00 + 220))) + "🎉 e"
    pairs = []
    for letters, n in [("ab", 150), ("abc\n", 1_500), (many, 900), (many, 4_000), (many + "e" * 400, 3_000), ("a", 1_200)]:
        for _ in range(3):
            one = text(letters, n)
            pairs += [(one, changed(one)), (one, text(letters, n)), (one, one), (one, text("q", 50))]
    used = 0
    for one, two in pairs:
        mine, library = textdiff._Matcher(None, one, two), difflib.SequenceMatcher(None, one, two)
        assert (mine.get_opcodes(), mine.ratio()) == (library.get_opcodes(), library.ratio())
        used += mine.pairs is not None
    assert used > 20
    rows = {r.pair_id: r for r in textdiff.text_diff_chars(spark.createDataFrame([(str(k), *p) for k, p in enumerate(pairs)], "pair_id string, text1 string, text2 string")).collect()}
    for k, (one, two) in enumerate(pairs):
        library = difflib.SequenceMatcher(None, one, two)
        parts = [(one[a:b], two[c:d]) for tag, a, b, c, d in library.get_opcodes() if tag == "replace"][:10]
        assert rows[str(k)].match_ratio == library.ratio() and [tuple(x) for x in rows[str(k)].changed_text] == parts


def test_compare_relations(spark):
    rng = random.Random(9)

    def relation():
        rel = {"relationship_type": rng.choice(["causality", "problem_solution", "premise_conclusion", "condition_consequence", "else", None]), "original_text": rng.choice(["x", "y", "z" * 120])}
        return rel | {f: rng.choice(["1", None]) for f in FIELDS[2:]}

    docs = {d: [relation() for _ in range(25)] for d in "ab"}
    schema = f"document_id string, section_name string, pos int, relation struct<{','.join(f + ':string' for f in FIELDS)}>"
    frame = spark.createDataFrame([(d, "S" + d, i, tuple(r[f] for f in FIELDS)) for d, rels in docs.items() for i, r in enumerate(rels)], schema)
    one, two = ({plain_key(r): r for r in docs[d]} for d in "ab")
    want = {("added", k, "Sb") for k in two if k not in one} | {("removed", k, "Sa") for k in one if k not in two}
    want |= {("modified", k, "Sb") for k in one if k in two and one[k]["original_text"] != two[k]["original_text"]}
    got = changes.compare_relations(spark.createDataFrame([("p", 1, "a", "b", "Sa", "Sb")], MAPPING), frame).collect()
    assert {(r.change_type, r.relation_key, r.section) for r in got} == want and len(got) == len(want)
    for r in got:
        if r.change_type == "modified":
            assert (r.previous.original_text, r.current.original_text) == (one[r.relation_key]["original_text"], two[r.relation_key]["original_text"])
        else:
            assert r.relationship.original_text == (two if r.change_type == "added" else one)[r.relation_key]["original_text"]


REPLY = "k string, mode string, reply_json string"


def test_reviews_from_replies(spark):
    rows = [
        ("plain", "diff_analysis_year", json.dumps({"importance": "low", "summary": "s", "text_changes": {"added": ["a"]}, "numerical_changes": [{"x": 1}]})),
        ("default", "diff_analysis_year", "{}"),
        ("contra", "consistency_check", json.dumps({"importance": "low", "importance_reason": "why", "contradictions": [{"a": 1}, "b"], "consistency_score": 3})),
        ("inner", "diff_analysis_company", json.dumps({"text_changes": {"contradictions": ["x"]}})),
        ("bad", "diff_analysis_year", "{bad"), ("empty", "diff_analysis_year", ""), ("null", "diff_analysis_year", "null"), ("none", "diff_analysis_year", None),
    ]
    df = spark.createDataFrame(rows, REPLY)
    got = {r.k: r for r in reviews.reviews_from_replies(df).collect()}
    assert (got["plain"].importance, got["plain"].summary, got["plain"].text_changes) == ("low", "s", {"added": '["a"]'})
    assert got["plain"].numerical_changes == ['{"x":1}']
    assert (got["default"].importance, got["default"].text_changes) == ("medium", {})
    assert (got["contra"].importance, got["contra"].importance_reason) == ("high", "矛盾が2件検出されました。why")
    assert json.loads(got["contra"].text_changes["contradictions"]) == ['{"a":1}', "b"]
    assert (got["inner"].importance, got["inner"].importance_reason) == ("high", "矛盾が1件検出されました")
    for k in ("bad", "empty", "null", "none"):
        assert (got[k].importance, got[k].importance_reason) == ("low", "分析失敗"), k
    odd = spark.createDataFrame([
        ("score", "consistency_check", json.dumps({"contradictions": ["x"], "consistency_score": "8", "tone_analysis": "calm", "summary": "s"})),
        ("needed", "diff_analysis_year", json.dumps({"importance": "low", "numerical_changes": {"a": 1}, "additional_search": {"needed": "true", "search_phrases": ["p"]}})),
    ], REPLY)
    read = {r.k: r for r in reviews.reviews_from_replies(odd).collect()}
    assert (read["score"].importance, read["score"].summary, read["score"].text_changes["consistency_score"]) == ("high", "s", "8.0")
    assert (read["needed"].importance, read["needed"].search_needed, read["needed"].search_phrases) == ("low", True, ["p"])
    again = {r.k: r for r in reviews.reviews_from_replies(df, search=True).collect()}
    assert again["contra"].importance == "low" and again["inner"].importance == "medium"
    assert again["empty"].importance_reason == again["none"].importance_reason == "LLMレスポンスが空"
    assert again["null"].importance_reason == "LLMレスポンスがnull" and again["bad"].importance_reason == "分析失敗"


def test_assemble_reviews(spark):
    """One section mapped to several, several to one, and exact copies: every review is kept, in order."""
    full = MAPPING + ", confidence_score double, mapping_method string"
    rows = [("p", 1, "a", "b", "X", "Y1", 0.9, "m"), ("p", 2, "a", "b", "X", "Y2", 0.8, "m"), ("p", 3, "a", "b", "W", "Y2", 0.7, "m"), ("p", 4, "a", "b", "X", "Y1", 0.9, "m")]
    sections = spark.createDataFrame([("a", "X", 1, 5), ("a", "W", None, 9), ("b", "Y1", 2, 3), ("b", "Y2", 4, None)], "document_id string, section_name string, start_page int, end_page int")
    answers = spark.createDataFrame([("p", i, "medium") for i in range(1, 5)], "pair_id string, mapping_index long, importance string")
    got = reviews.assemble_reviews(spark.createDataFrame(rows, full), answers, sections).orderBy("review_index", "mapping_index").collect()
    assert [(r.review_index, r.mapping_index, r.doc1_section_name, r.doc2_section_name, r.doc1_page_range, r.doc2_page_range, r.mapping_confidence) for r in got] == [
        (1, 1, "X", "Y1", "1-5", "2-3", 0.9), (1, 4, "X", "Y1", "1-5", "2-3", 0.9), (2, 2, "X", "Y2", "1-5", "4-?", 0.8), (3, 3, "W", "Y2", "?-9", "4-?", 0.7),
    ]


def test_search_gate_and_summary(spark):
    df = spark.createDataFrame([(True, "high", ["p"]), (True, "low", ["p"]), (False, "high", ["p"]), (True, "high", []), (None, None, None)], "n boolean, i string, p array<string>")
    for mode, want in (("off", [False] * 5), ("high_only", [True, False, False, False, False]), ("all", [True, True, False, False, False])):
        assert [r.g for r in df.select(reviews.search_gate(F.col("n"), F.col("i"), F.col("p"), mode).alias("g")).collect()] == want
    with pytest.raises(ValueError):
        reviews.search_gate(F.col("n"), F.col("i"), F.col("p"), "some")
    found = "\n\n追加探索により、以下の情報が明らかになりました："
    cases = [([], "base"), (None, "base"), ([[]], "base\n\n追加探索を実施しましたが、新たな重要な発見はありませんでした。"),
             ([["a", "b", "c"], ["d", "e"]], f"base{found}a; b; d"), ([None, ["d"]], f"base{found}d")]
    rows = spark.createDataFrame([(i, "base", f) for i, (f, _) in enumerate(cases)], "i int, b string, f array<array<string>>")
    got = {r.i: r.s for r in rows.select("i", reviews.enhanced_summary(F.col("b"), F.col("f")).alias("s")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_relations_move_to_their_document_once(spark):
    """The last relation of a key is chosen, and joined with the mappings, where its document is."""
    fields = ("subject", "reason", "condition", "consequence", "problem", "solution", "premise", "conclusion")
    told = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 3, "c"), (3, 1, "a"), (3, 2, "a"), (None, 1, "a")]
    relation = F.struct(
        F.lit("other").alias("relationship_type"), F.col("text").alias("original_text"), *[F.lit(None).cast("string").alias(name) for name in fields]
    )
    relations = spark.createDataFrame(told, "document_id long, pos int, text string").select("document_id", F.lit("items").alias("section_name"), "pos", relation.alias("relation"))
    mappings = spark.createDataFrame([("p", 1, 1, 2), ("q", 1, 2, 3)], "pair_id string, mapping_index long, doc1_id long, doc2_id long").select(
        "*", F.lit("items").alias("doc1_section"), F.lit("items").alias("doc2_section")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changes.compare_relations(mappings, relations)
        moves = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        rows = sorted((r.pair_id, r.change_type, r.relationship.original_text) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Both sides: the relations, the mappings, and what they give; a relation does not move between its choice and its join.
    assert moves == 6
    assert rows == [("p", "added", "c"), ("p", "removed", "b"), ("q", "removed", "c")]


def test_numbering_keeps_every_row_of_a_large_table(spark):
    """Bounds of ranges are sampled: beyond the sample, two dealings of one table need not agree."""
    df = spark.range(60_000).select((F.col("id") % 30_000).alias("k"), F.col("id").alias("at"), F.concat(F.lit("text "), "id").alias("carried"))
    got = number_within(df, ["k"], [F.col("at")], "n")
    assert got.agg(F.count("*"), F.countDistinct("carried"), F.sum("n")).collect() == [(60_000, 60_000, 90_000)]
    assert got.where(F.col("n") != F.when(F.col("at") < 30_000, 1).otherwise(2)).count() == 0


def test_parts_of_documents_without_a_pair_are_left_out_first(spark, monkeypatch):
    given = []
    monkeypatch.setattr(mapping, "vector_blocks", lambda vectors, *rest: given.append(vectors) or vectorblocks.vector_blocks(vectors, *rest))
    pairs = spark.createDataFrame([("p", 1, 2)], "pair_id string, doc1_id long, doc2_id long")
    vectors = spark.createDataFrame([(d, 1, f"s{d}", [1.0, (d or 0) / 10]) for d in (1, 2, 3, None)], "document_id long, ordinal long, section_name string, vector array<double>")
    found = mapping.map_semantic(pairs, vectors, 0.5, 2).collect()
    assert [(r.doc1_section, r.doc2_section) for r in found] == [("s1", "s2")]
    assert sorted(r.document_id for r in given[0].collect()) == [1, 2]
    mappings = pairs.select("*", F.lit(1).cast("long").alias("mapping_index"), F.lit("s").alias("doc1_section"), F.lit("s").alias("doc2_section"))
    cells = spark.createDataFrame([(d, "t", 1, 1, "i", str(100 * (d or 0))) for d in (1, 2, 3, None)], "document_id long, table_id string, row int, col int, item_name string, text string")
    places = cells.select("document_id", F.lit("s").alias("section_name"), "table_id")
    for scope in ("section", "position", "cross"):
        found = differences.compare_numbers(mappings, cells, places, scope)
        assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
        assert [(r.value1, r.value2) for r in found.collect()] == [(100.0, 200.0)]
