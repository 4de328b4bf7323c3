"""Keyword tables, company links and value matching against all-pairs forms."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from filingdelta.functions.company import normalise_company, same_company
from filingdelta.operators.checks import missing_values
from filingdelta.operators.classify import Lexicon, classify
from filingdelta.operators.companies import link_companies
from filingdelta.operators.containment import with_needles


def crossing_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan
    return df


@pytest.mark.parametrize("sizes", [(1, 2, 3), (1, 4)])
def test_needles(spark, sizes):
    rng = random.Random(2)
    letters = "aab\nc é日🎉😀.*"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [word(rng.randrange(0, 60)) for _ in range(150)] + ["", "a" * 5_000, None, "x", "x", "x" * 3]
    needles = [(k, word(rng.randrange(0, 6))) for k in range(200)] + [(500, "x"), (501, "x"), (502, ""), (503, None), (504, "a" * 4_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = crossing_free(with_needles(df, F.col("t"), spark.createDataFrame(needles, "n int, needle string"), "hits", sizes))
    got = {r.i: sorted((h.n, h.needle) for h in r.hits) for r in found.collect()}
    assert got == {i: sorted((k, n) for k, n in needles if t is not None and n and n in t) for i, t in enumerate(texts)}
    assert with_needles(df.limit(0), F.col("t"), spark.createDataFrame(needles, "n int, needle string"), "hits", sizes).count() == 0
    assert {len(r.hits) for r in with_needles(df, F.col("t"), spark.createDataFrame([], "n int, needle string"), "hits", sizes).collect()} == {0}


@pytest.mark.parametrize("few", [0, 1_000])
def test_needles_of_a_catalogue(spark, few):
    """Sentences, parts of them and short words in long texts and lines; few needles move no row, any number gives the same."""
    rng = random.Random(5)
    words = ["rente", "été", "日本", "profit", "a", "the", "margin🎉", "x" * 90]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [said(rng.randrange(0, 400)) for _ in range(80)] + [said(3) for _ in range(300)] + ["", None, "été", "the margin" * 30_000]
    needles = list(enumerate([said(rng.randrange(1, 7)) for _ in range(120)] + words + ["é", "t", "本 p", "e th", None, "", "the", "nowhere at all"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    found = with_needles(df, F.col("t"), spark.createDataFrame(needles, "n int, needle string"), "hits", few=few)
    got = {r.i: sorted((h.n, h.needle) for h in r.hits) for r in found.collect()}
    assert got == {i: sorted((k, n) for k, n in needles if t is not None and n and n in t) for i, t in enumerate(texts)}
    if few:
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_keywords(spark):
    """100,000 keywords: no plan grows with them and none is left out."""
    words = spark.range(100_000).select(F.concat(F.lit("kind"), (F.col("id") % 5_000).cast("string")).alias("kind"), (F.col("id") / 5_000).cast("int").alias("ordinal"), F.concat(F.lit("Wort "), F.hex("id"), F.lit("!")).alias("keyword"))
    labels = words.select("kind", F.lower("kind").alias("label")).distinct()
    docs = spark.range(300).select("id", F.lit("f.pdf").alias("filename"), F.concat_ws(" ", *[F.concat(F.lit("WORT "), F.hex(F.col("id") * 331 + k * 5_000), F.lit("!")) for k in (0, 1, 1)]).alias("text_sample"))
    rows = classify(docs, Lexicon(words, labels)).collect()
    assert len(rows) == 300
    for r in rows:
        held = [f"wort {r.id * 331 + k * 5_000:x}!" for k in (0, 1) if r.id * 331 + k * 5_000 < 100_000]
        assert (r.detected_type, r.detection_confidence, r.matched_keywords) == (f"kind{r.id * 331 % 5_000}", len(held) / 20, held)


def test_company_links(spark):
    rng = random.Random(4)
    cores = ["alpha", "alphabet", "beta works", "ab", "AB", "ソニー", "ソニーグループ", "富士フイルム", "x", "gamma 12", "gamma 1"]
    names = [(k, rng.choice(["", "The "]) + rng.choice(cores) + rng.choice(["", " Inc.", " Limited", "株式会社", " (old)", " Holdings", "  "])) for k in range(120)] + [(900, None), (901, ""), (902, "Ltd."), (903, "Ltd.")]
    links, members = link_companies(spark.createDataFrame(names, "name_id int, name string"))
    joined = {(r.short, r.long) for r in crossing_free(links).collect()}
    of = {r.name_id: r for r in members.collect()}
    assert len(of) == len(names)
    pairs = spark.createDataFrame([(*a, *b) for a, b in itertools.product(names, names)], "i int, a string, j int, b string")
    norm = pairs.withColumn("x", normalise_company(F.col("a"))).withColumn("y", normalise_company(F.col("b")))
    for r in norm.select("i", "j", same_company(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("same")).collect():
        one, two = of[r.i], of[r.j]
        same = one.company is not None and one.company == two.company
        linked = (one.company, two.company) in joined or (two.company, one.company) in joined
        assert bool(r.same) == (same or linked), (one, two)
    for row in of.values():
        assert row.n_links == sum(row.company in pair for pair in joined if len(row.company or "") >= 3)


def test_missing_values(spark):
    rng = random.Random(6)
    units = [None, "千円", "百万円", "%", "円"]

    def side():
        rows = []
        for k in range(400):
            base = rng.choice([0.0, 1.0, 12_345.0, 99_999_999.0, 1e-7]) * (1 + rng.randrange(-30, 31) * 1e-5) * rng.choice([1, 1, -1])
            unit = rng.choice(units)
            rows.append((rng.choice("pq"), k, 1, f"r{k}", base / {"千円": 1e3, "百万円": 1e6}.get(unit, 1), unit))
        return rows

    left, right = side(), side() + [("only right", 1, 1, "z", 5.0, "円")] * 3
    schema = "pair_id string, row int, col int, item_name string, value double, unit string"
    found = crossing_free(missing_values(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["pair_id"]))
    scaled = lambda r: (r[0], "円" if r[5] in (None, "千円", "百万円") else r[5], r[4] * {"千円": 1_000.0, "百万円": 1_000_000.0}.get(r[5], 1))

    def lacks(row, others):
        pair, unit, a = scaled(row)
        near = lambda b: a == b == 0 or (a != 0 != b and abs(a - b) / max(abs(a), abs(b)) * 100 <= 0.01)
        return not any(p == pair and u == unit and near(b) for p, u, b in map(scaled, others))

    expected = [(r[0], r[1], 2) for r in left if lacks(r, right)] + [(r[0], r[1], 1) for r in right if lacks(r, left)]
    got = sorted((r.pair_id, r.row, r.missing_in) for r in found.collect())
    assert got == sorted(expected) and 50 < len(got) < 750


def test_moved_rows_are_not_missing(spark):
    schema = "t string, row int, col int, item_name string, value double, unit string"
    left = spark.createDataFrame([("t", 1, 1, "a", 1_234.0, "百万円"), ("t", 2, 1, "b", 7.0, None)], schema)
    right = spark.createDataFrame([("t", 5, 3, "b", 7.0, "円"), ("t", 9, 2, "a", 1_234_050.0, "千円")], schema)
    assert missing_values(left, right, ["t"]).count() == 0
    assert missing_values(left.limit(0), right, ["t"]).count() == 2
