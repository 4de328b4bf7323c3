"""Page windows, merging, parents and texts, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from filingdelta.functions.text import ancestors
from filingdelta.operators import sections as S

PAGE = "document_id string, page_number int, text string"


def plain_windows(n, size=10):
    out, i = [], 0
    while i < n:
        end = min(i + size, n)
        out.append((i + 1, end))
        if end >= n:
            break
        i = end - 1
    return out


def test_page_batches(spark):
    sizes = [1, 2, 9, 10, 11, 18, 19, 20, 28, 29, 100]
    page = spark.createDataFrame([(str(n), p, "t") for n in sizes for p in range(1, n + 1)], PAGE)
    rows = S.page_batches(page).collect()
    for n in sizes:
        mine = [r for r in rows if r.document_id == str(n)]
        want = {(i, s, e, p) for i, (s, e) in enumerate(plain_windows(n)) for p in range(s, e + 1)}
        assert {(r.batch_index, r.batch_start, r.batch_end, r.page_number) for r in mine} == want
        assert len(mine) == len(want)


def test_page_batches_with_gaps(spark):
    """No page is lost when page rows are missing; a border page alone stays in the window before only."""
    page = spark.createDataFrame([("d", p, "t") for p in [*range(1, 10), 12]] + [("e", p, "t") for p in (1, 10)], PAGE)
    rows = {(r.document_id, r.batch_index, r.batch_start, r.batch_end, r.page_number) for r in S.page_batches(page).collect()}
    assert rows == {("d", 0, 1, 9, p) for p in range(1, 10)} | {("d", 1, 10, 12, 12)} | {("e", 0, 1, 10, p) for p in (1, 10)}
    texts = {(r.document_id, r.batch_index): r.n_pages for r in S.batch_text(page).collect()}
    assert texts == {("d", 0): 9, ("d", 1): 1, ("e", 0): 2}


def test_batch_text(spark):
    page = spark.createDataFrame([("d", p, str(p) * 3000) for p in range(1, 12)], PAGE)
    got = {r.batch_index: r.batch_text for r in S.batch_text(page).collect()}
    for i, (s, e) in enumerate(plain_windows(11)):
        text = "\n".join(f"=== ページ {p} ===\n{(str(p) * 3000)[:2000]}\n" for p in range(s, e + 1))
        assert got[i] == text[:15000]
    assert len(got) == 2


def plain_merge(candidates):
    out = {}
    for name, start, end, conf, cont in candidates:
        if name in out:
            o = out[name]
            o["start"], o["end"], o["cont"] = min(o["start"], start), max(o["end"], end), cont
        else:
            out[name] = {"start": start, "end": end, "conf": conf or 0.0, "cont": cont}
        out[name]["pages"] = list(range(out[name]["start"], out[name]["end"] + 1))
    return out


def plain_parents(found, n_pages):
    """Page lengths equal their numbers."""
    def chars(pages):
        return sum(p for p in pages if 1 <= p <= n_pages)

    for o in found.values():
        o["chars"] = chars(o["pages"])
    result = {k: dict(v) for k, v in found.items()}
    names = {" - ".join(k.split(" - ")[:i]) for k in found for i in range(1, len(k.split(" - ")))}
    for name in names:
        below = [o for k, o in found.items() if k.startswith(name + " - ")]
        pages = [p for o in below for p in o["pages"]]
        if not pages:
            continue
        mean = sum(o["conf"] for o in below) / len(below)
        if name in found:
            union = sorted(set(found[name]["pages"]) | set(pages))
            result[name] |= {"pages": union, "conf": mean, "cont": False, "start": union[0], "end": union[-1]}
        else:
            union = sorted(set(pages))
            result[name] = {"pages": union, "conf": mean, "cont": False, "start": union[0], "end": union[-1], "chars": chars(union)}
    return result


def random_candidates(rng):
    names = ["A", "A - B", "A - B - C", "A - D", "E - F", "E - F - G", "H"]
    rows = []
    for batch in range(3):
        for ordinal in range(rng.randint(0, 4)):
            start = rng.randint(1, 12)
            rows.append((batch, ordinal, rng.choice(names), start, start + rng.randint(-1, 4), rng.choice([None, 0.25, 0.5, 0.75]), rng.random() < 0.5))
    return rows


CANDIDATE = "document_id string, batch_index int, ordinal int, section_name string, start_page int, end_page int, confidence double, is_continuing boolean"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs = {str(d): random_candidates(rng) for d in range(60)}
    cands = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], CANDIDATE)
    page = spark.createDataFrame([(d, p, "x" * p) for d in docs for p in range(1, 15)], PAGE)
    return docs, cands, page


def test_merge_and_parents(corpus):
    docs, cands, page = corpus
    merged = S.with_char_count(S.merge_sections(cands), page)
    rebuilt = S.rebuild_parents(merged, page).collect()
    flat = merged.collect()
    for d, rows in docs.items():
        found = plain_merge([(n, s, e, c, k) for _, _, n, s, e, c, k in sorted(rows, key=lambda r: (r[0], r[1]))])
        want = plain_parents(found, 14)
        got = {r.section_name: (r.start_page, r.end_page, list(r.pages), r.confidence, r.is_continuing, r.char_count) for r in flat if r.document_id == d}
        assert got == {k: (o["start"], o["end"], o["pages"], o["conf"], o["cont"], o["chars"]) for k, o in found.items()}
        got = {r.section_name: (r.start_page, r.end_page, list(r.pages), round(r.confidence, 9), r.is_continuing, r.char_count) for r in rebuilt if r.document_id == d}
        assert got == {k: (o["start"], o["end"], o["pages"], round(o["conf"], 9), o["cont"], o["chars"]) for k, o in want.items()}


def test_pages_end_with_the_document(corpus):
    """A reply that tells an absurd end costs no more than its document has pages."""
    docs, cands, page = corpus
    far = cands.withColumn("end_page", F.lit(2_000_000_000)).withColumn("start_page", F.lit(-5))
    last = {r.document_id: (r.low, r.high) for r in page.groupBy("document_id").agg(F.min("page_number").alias("low"), F.max("page_number").alias("high")).collect()}
    for r in S.merge_sections(far, page).collect():
        low, high = last.get(r.document_id, (1, 0))
        assert (r.start_page, r.end_page, list(r.pages)) == (-5, 2_000_000_000, list(range(low, high + 1)))


def test_children_and_exclusive_pages(corpus):
    docs, cands, page = corpus
    merged = S.merge_sections(cands)
    flags = S.with_has_children(merged).collect()
    own = {(r.document_id, r.section_name): list(r.own_pages) for r in S.with_exclusive_pages(merged).collect()}
    texts = {(r.document_id, r.section_name): r.text for r in S.section_text(S.exclusive_pages(merged), page).collect()}
    by_doc = {}
    for r in flags:
        by_doc.setdefault(r.document_id, {})[r.section_name] = r
    for d, found in by_doc.items():
        for name, r in found.items():
            below = [o for k, o in found.items() if k.startswith(name + " - ")]
            assert r.has_children == bool(below)
            want = [p for p in r.pages if p not in {q for o in below for q in o.pages}]
            assert own.get((d, name), []) == want
            inside = [p for p in want if p <= 14]
            assert texts.get((d, name), None) == ("\n".join("x" * p for p in inside) if inside else None)


def test_section_text_parts_keep_everything(spark):
    page = spark.createDataFrame([("d", p, f"t{p}") for p in range(1, 1001)], PAGE)
    own = spark.createDataFrame([("d", "S", p - 1, p) for p in range(1, 1001)], "document_id string, section_name string, position int, page_number int")
    assert S.section_text_parts(own, page, 64).count() == 16
    assert S.section_text(own, page).first().text == "\n".join(f"t{p}" for p in range(1, 1001))


def test_extraction_eligible(spark):
    df = spark.createDataFrame([("a", "x" * 100), ("b", "　" + "x" * 99 + "　\n")], "k string, text string")
    assert [r.k for r in S.extraction_eligible(df).collect()] == ["a"]


@pytest.mark.parametrize("path", ["A", "A - B", "A - B - C", "A - - B", " - A", "A - ", "A -  - B", "x - - - y", ""])
def test_ancestors(spark, path):
    got = spark.createDataFrame([(path,)], "p string").select(ancestors(F.col("p")).alias("a")).first().a
    want = [path[:i] for i in range(len(path)) if path[i:i + 3] == " - "]
    assert sorted(got) == sorted(want)


def test_template_paths_and_leaves(spark):
    nodes = spark.createDataFrame(
        [("t", "1", None, 0, "A", True), ("t", "2", "1", 0, "B", False), ("t", "3", "2", 0, "C", False), ("t", "4", None, 1, None, False),
         ("t", "5", "4", 0, "D", False), ("u", "1", None, 0, "A", True)],
        "document_type string, node_id string, parent_id string, ordinal int, name string, required boolean",
    )
    paths = S.template_paths(nodes)
    assert {(r.document_type, r.path) for r in paths.collect()} == {("t", "A"), ("t", "A - B"), ("t", "A - B - C"), ("u", "A")}
    assert {(r.document_type, r.path) for r in S.leaves(paths).collect()} == {("t", "A - B - C"), ("u", "A")}


def test_template_paths_of_any_depth(spark):
    """A chain of twelve nodes has twelve paths; what hangs below an unnamed node has none."""
    rows = [("t", k, k - 1 if k else None, 0, f"n{k}", True) for k in range(12)]
    rows += [("t", 50, 0, 1, "", True), ("t", 51, 50, 0, "lost", True), ("u", 0, None, 0, "root", False)]
    nodes = spark.createDataFrame(rows, "document_type string, node_id long, parent_id long, ordinal int, name string, required boolean")
    found = {(r.document_type, r.node_id): (r.path, r.depth, list(r.position)) for r in S.template_paths(nodes).collect()}
    wanted = {("t", k): (" - ".join(f"n{i}" for i in range(k + 1)), k + 1, [0] * (k + 1)) for k in range(12)}
    assert found == wanted | {("u", 0): ("root", 1, [0])}
    deepest = {(r.document_type, r.node_id) for r in S.leaves(S.template_paths(nodes)).collect()}
    assert deepest == {("t", 11), ("u", 0)}
