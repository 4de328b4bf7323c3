"""Numbers, units, tolerance and rounding, against plain Python."""

from __future__ import annotations

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from filingdelta.functions.numbers import (
    extract_number_unit, normalise_unit, round_half_even, to_fixed, within_tolerance,
)


def plain_extract(text):
    if text is None:
        return None, None
    clean = text.replace(",", "").strip()
    found = re.search(r"-?\d+(?:\.\d+)?", clean)
    if not found:
        return None, None
    return float(found.group()), clean[found.end():].strip() or None


EDGES = ["1,234千円", "１２３", "△100", "(100)", "-5.5%", "2024年3月期", "", None, "abc", "--5", "5-5", "　７.５　百万円　", "٣٤ kg", "1.", "-.5"]


def test_extract_number_unit(spark):
    rng = random.Random(1)
    texts = EDGES + ["".join(rng.choice("0123456789.,-千百万円 %x　５") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extract_number_unit(F.col("t")).alias("n")).collect()
    got = {r.i: (r.n.value, r.n.unit) for r in rows}
    assert got == {i: plain_extract(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("unit,factor,name", [
    (None, 1, "円"), ("", 1, "円"), ("千円", 1e3, "円"), ("百万円", 1e6, "円"), ("十億円", 1e9, "円"), ("千株", 1e3, "円"),
    ("億円", 1, "億円"), ("%", 1, "%"), ("百 万 円", 1e6, "円"), ("千百万", 1e3, "円"),
])
def test_normalise_unit(spark, unit, factor, name):
    df = spark.createDataFrame([(2.0, unit)], "v double, u string")
    u = df.select(normalise_unit(F.col("v"), F.col("u")).alias("u")).first().u
    assert (u.value, u.unit) == (2.0 * factor, name)


def test_within_tolerance(spark):
    cases = [(0.0, 0.0, True), (0.0, 1.0, False), (10000.0, 10001.0, True), (10000.0, 10002.0, False), (-5.0, 5.0, False), (-7.0, -7.0, True)]
    rows = spark.createDataFrame(cases, "a double, b double, e boolean").select("e", within_tolerance(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.e == r.g for r in rows)


def test_rounding_is_exact(spark):
    rng = random.Random(2)
    values = [0.285, 1.005, 0.145, 2.675, 0.125, 0.375, 0.015, 0.045, 0.5, 0.0, 1.0, 0.285714] + [rng.randint(0, 1000) / rng.choice([8, 40, 200, 1000, 7, 3]) for _ in range(2000)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select(
        "v", round_half_even(F.col("v"), 2).alias("r"), to_fixed(F.col("v"), 1).alias("f")
    ).collect()
    for r in rows:
        assert r.r == round(r.v, 2), r
        assert r.f == str(Decimal(r.v).quantize(Decimal("0.1"), ROUND_HALF_UP)), r


def test_to_fixed_of_unusual_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-3.25,)], "v double").select(to_fixed(F.col("v"), 1).alias("f")).collect()
    assert [r.f for r in rows] == [None, None, None, "-3.3"]
