"""Numbers with units, tolerance and exact decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filingdelta.functions.text import filled, strip, to_ascii_digits

NUMBER = r"(?U)-?\d+(?:\.\d+)?"

# Unit marks in the order they are tried, with their factors, and the base unit.
UNIT_FACTORS = (("千", 1_000.0), ("百万", 1_000_000.0), ("十億", 1_000_000_000.0))
BASE_UNIT = "円"
TOLERANCE_PCT = 0.01


def extract_number_unit(text: Column) -> Column:
    """First number in the text and the trimmed rest after it: struct(value, unit)."""
    clean = strip(F.replace(text, F.lit(","), F.lit("")))
    number = filled(F.regexp_extract(clean, NUMBER, 0))
    rest = F.substr(clean, F.instr(clean, number) + F.length(number))
    return F.struct(
        to_ascii_digits(number).try_cast("double").alias("value"),
        filled(strip(rest)).alias("unit"),
    )


def normalise_unit(value: Column, unit: Column) -> Column:
    """Scale thousand / million / billion units to the base unit: struct(value, unit)."""
    mark = F.replace(F.lower(unit), F.lit(" "), F.lit(""))
    scaled, name = F.when(filled(unit).isNull(), value), F.when(filled(unit).isNull(), F.lit(BASE_UNIT))
    for token, factor in UNIT_FACTORS:
        hit = F.contains(mark, F.lit(token))
        scaled, name = scaled.when(hit, value * factor), name.when(hit, F.lit(BASE_UNIT))
    return F.struct(scaled.otherwise(value).alias("value"), name.otherwise(unit).alias("unit"))


def within_tolerance(a: Column, b: Column, tolerance_pct: float = TOLERANCE_PCT) -> Column:
    gap = F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))) * 100
    return (
        F.when((a == 0) & (b == 0), True)
        .when((a == 0) | (b == 0), False)
        .otherwise(gap <= tolerance_pct)
    )


def _scaled_parts(x: Column, digits: int) -> tuple[Column, Column]:
    """floor(x * 10**digits) and the exact remainder minus one half.

    The product's rounding error is recovered with an exact two-part
    multiplication, so ties are told from near-ties as in decimal arithmetic.
    """
    factor = float(10**digits)
    p = x * factor
    spread = x * 134217729.0
    high = spread - (spread - x)
    error = (high * factor - p) + (x - high) * factor
    whole = F.floor(p).cast("double")
    return whole, (p - whole - 0.5) + error


def round_half_even(x: Column, digits: int) -> Column:
    """Round the exact binary value, ties to the even neighbour."""
    whole, rest = _scaled_parts(x, digits)
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    up = F.when((rest > 0) | ((rest == 0) & odd), 1.0).otherwise(0.0)
    return (whole + up) / float(10**digits)


def to_fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to the larger value; null when not finite."""
    whole, rest = _scaled_parts(F.abs(x), digits)
    n = (whole + F.when(rest >= 0, 1.0).otherwise(0.0)).cast("long")
    base = 10**digits
    body = F.concat(
        F.floor(n / base).cast("string"), F.lit("."), F.lpad((n % base).cast("string"), digits, "0")
    )
    text = F.concat(F.when(x < 0, "-").otherwise(""), body)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, text)
