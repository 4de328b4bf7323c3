"""Company name folding and matching."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from filingdelta.functions.text import SPACE_CLASS, strip

# Legal-form words and marks dropped from a company name.
LEGAL_FORMS = (
    "株式会社", "有限会社", "合同会社", r"Corporation", r"Corp\.", r"Inc\.", r"Ltd\.",
    "Limited", "Holdings", "ホールディングス", "holding",
)
KATAKANA_FIRST, KATAKANA_LAST, KANA_SHIFT = "ァ", "ヴ", 96
MIN_NAME_LENGTH = 3

_KATAKANA = "".join(chr(c) for c in range(ord(KATAKANA_FIRST), ord(KATAKANA_LAST) + 1))
_HIRAGANA = "".join(chr(ord(c) - KANA_SHIFT) for c in _KATAKANA)


@F.pandas_udf(T.StringType())
def _compatibility_form(names: pd.Series) -> pd.Series:
    """NFKC, which Spark has no built-in for; each distinct name of a batch is folded once."""
    codes, distinct = pd.factorize(names)
    folded = [unicodedata.normalize("NFKC", n) for n in distinct]
    return pd.Series([folded[c] if c >= 0 else None for c in codes])


def normalise_company(name: Column) -> Column:
    """Drop brackets, legal forms and marks, fold width and kana, lower-case."""
    bare = F.regexp_replace(name, r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, "(?iu)" + "|".join(LEGAL_FORMS), "")
    bare = F.regexp_replace(bare, rf"(?U)[{SPACE_CLASS}\-\.,ー、。]", "")
    return F.lower(strip(F.translate(_compatibility_form(bare), _KATAKANA, _HIRAGANA)))


def same_company(name1: Column, name2: Column, norm1: Column, norm2: Column) -> Column:
    """Equal as written, or one folded name contains the other (three characters at least)."""
    present = F.coalesce((name1 != "") & (name2 != ""), F.lit(False))
    long_enough = (F.length(norm1) >= MIN_NAME_LENGTH) & (F.length(norm2) >= MIN_NAME_LENGTH)
    overlap = F.contains(norm1, norm2) | F.contains(norm2, norm1)
    return present & ((strip(name1) == strip(name2)) | F.coalesce(long_enough & overlap, F.lit(False)))
