"""Vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0.0 when either vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = _sum(F.zip_with(x, y, lambda p, q: p * q))
    norms = F.sqrt(_sum(F.transform(x, lambda p: p * p))) * F.sqrt(_sum(F.transform(y, lambda p: p * p)))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot, norms))
