"""Unicode-aware string helpers that stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# White space and digits are all assigned below this code point.
_CODE_POINTS = [chr(c) for c in range(0x20000)]

# Every character that counts as white space, derived from the Unicode database.
WHITESPACE = "".join(c for c in _CODE_POINTS if c.isspace())

# Decimal digits of all scripts and the ASCII digits they stand for.
SCRIPT_DIGITS = "".join(c for c in _CODE_POINTS if unicodedata.category(c) == "Nd" and not c.isascii())
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in SCRIPT_DIGITS)

# Superscripts, circled figures and the like: digits that are no decimal digits.
SPECIAL_DIGITS = "".join(c for c in _CODE_POINTS if c.isdigit() and unicodedata.category(c) != "Nd")

DIGIT_CLASS = rf"(?U)[\d{SPECIAL_DIGITS}]"
SPACE_CLASS = r"\s\x1c-\x1f"

del _CODE_POINTS


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.trim(col, F.lit(WHITESPACE))


def filled(col: Column) -> Column:
    """Null for an empty string, the string otherwise."""
    return F.nullif(col, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First argument that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[filled(c) for c in cols[:-1]], cols[-1])


def to_ascii_digits(col: Column) -> Column:
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, SCRIPT_DIGITS, ASCII_DIGITS)).otherwise(col)


def has_digit(col: Column) -> Column:
    return col.rlike(DIGIT_CLASS)


def joined(parts: Column, sep: str) -> Column:
    """Join an array of strings; null elements count as empty strings."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), sep)


def path_prefixes(path: Column, sep: str = " - ") -> Column:
    """Proper prefixes of a path by its parts, shortest first."""
    parts = F.split(path, re.escape(sep))
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep),
    )


def ancestors(path: Column, sep: str = " - ") -> Column:
    """All prefixes of a path that a separator follows, also where separators overlap."""
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))),
        lambda i: F.substr(path, i, F.lit(len(sep))) == sep,
    )
    by_position = F.transform(starts, lambda i: F.substr(path, F.lit(1), i - 1))
    return F.when(F.contains(path, F.lit(sep + sep[1:])), by_position).otherwise(path_prefixes(path, sep))


def any_contains(cols: Sequence[Column], needle: str) -> Column:
    """True when one of the columns contains the needle, ignoring case; nulls never match."""
    low = needle.lower()
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return hit
