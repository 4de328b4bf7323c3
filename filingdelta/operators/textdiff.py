"""Text differences: character alignment per pair, line multisets at scale."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Compared leading characters and listed pieces per kind.
COMPARED_CHARS, LISTED_PIECES = 5_000, 10
_DIFF = (
    "pair_id string, match_ratio double, added_text array<string>, removed_text array<string>, "
    "changed_text array<struct<before:string,after:string>>"
)
# Windows with fewer equal pairs of characters, and short ones, are searched one by one.
FEW_EQUAL, SHORT = 300, 1_000


class _Matcher(difflib.SequenceMatcher):
    """The library's matcher; large windows are searched over arrays of their equal pairs, with the same result."""

    def set_seq1(self, a: str) -> None:
        super().set_seq1(a)
        self.pairs = None

    def _equal_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of equal characters in both texts by diagonal, without those the library leaves out, and their number up to each place of a."""
        codes = np.frombuffer(self.a.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        order = np.argsort(codes, kind="stable")
        ranked, at_a, at_b = codes[order], [], []
        for char, places in self.b2j.items():
            own = order[np.searchsorted(ranked, ord(char), "left") : np.searchsorted(ranked, ord(char), "right")]
            if len(own):
                at_a.append(np.repeat(own, len(places)))
                at_b.append(np.tile(places, len(own)))
        one, two = (np.concatenate([np.empty(0, "i8"), *x]) for x in (at_a, at_b))
        before = np.concatenate([[0], np.cumsum(np.bincount(one, minlength=len(codes)))])
        by = np.argsort((two - one) * (len(codes) + 1) + one)
        return one[by].astype("i4"), two[by].astype("i4"), before

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, b = self.a, self.b
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        if self.pairs is None and ahi - alo < SHORT:
            return super().find_longest_match(alo, ahi, blo, bhi)
        if self.pairs is None:
            self.pairs = self._equal_pairs()
        one, two, before = self.pairs
        if before[ahi] - before[alo] < max(FEW_EQUAL, len(one) // 75):
            return super().find_longest_match(alo, ahi, blo, bhi)
        inside = (one >= alo) & (one < ahi) & (two >= blo) & (two < bhi)
        i, j = one[inside], two[inside]
        if not len(i):
            return super().find_longest_match(alo, ahi, blo, bhi)
        ends = np.append(np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)), len(i) - 1)
        sizes = np.diff(ends, prepend=-1)
        size = int(sizes.max())
        # Of equally long ones the first in a, then in b.
        ends = ends[sizes == size]
        best = ends[np.lexsort((j[ends], i[ends]))[0]]
        besti, bestj = int(i[best]) - size + 1, int(j[best]) - size + 1
        while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
            besti, bestj, size = besti - 1, bestj - 1, size + 1
        while besti + size < ahi and bestj + size < bhi and a[besti + size] == b[bestj + size]:
            size += 1
        return difflib.Match(besti, bestj, size)


def _align(listed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pair_id, a, b in zip(batch["pair_id"], batch["text1"], batch["text2"]):
                if a == b:  # one equal block, found without a search
                    rows.append((pair_id, 1.0, [], [], []))
                    continue
                matcher = _Matcher(None, a, b)
                pieces = {"insert": [], "delete": [], "replace": []}
                for tag, i1, i2, j1, j2 in matcher.get_opcodes():
                    if tag != "equal":
                        pieces[tag].append((a[i1:i2], b[j1:j2]))
                rows.append(
                    (
                        pair_id, matcher.ratio(),
                        [new for _, new in pieces["insert"][:listed]],
                        [old for old, _ in pieces["delete"][:listed]],
                        [{"before": old, "after": new} for old, new in pieces["replace"][:listed]],
                    )
                )
            yield pd.DataFrame(
                rows, columns=["pair_id", "match_ratio", "added_text", "removed_text", "changed_text"]
            )

    return run


def text_diff_chars(pairs: DataFrame, max_chars: int | None = COMPARED_CHARS, listed: int = LISTED_PIECES) -> DataFrame:
    """Character alignment of each text pair: (pair_id, text1, text2).

    The operator compares the leading characters only, by definition; pass
    ``max_chars=None`` for whole texts. Pairs with an empty text are skipped.
    Every pair is aligned once, whatever the number of its mappings.
    """
    text1, text2 = F.col("text1"), F.col("text2")
    if max_chars is not None:
        text1, text2 = F.substring(text1, 1, max_chars), F.substring(text2, 1, max_chars)
    ready = pairs.where((F.col("text1") != "") & (F.col("text2") != "")).select(
        F.col("pair_id").cast("string").alias("pair_id"), text1.alias("text1"), text2.alias("text2")
    )
    # Alignment is the costly step: an even spread by pair keeps a few long inputs from sharing a task.
    return ready.repartition("pair_id").mapInPandas(_align(listed), _DIFF)


def _line_counts(pairs: DataFrame, ignore_punctuation: bool) -> DataFrame:
    """Copies of every line on both sides, and whether the pair's texts are equal; the pairs are read once."""
    def lines(text: str, flag1: int, flag2: int) -> Column:
        source = F.col(text)
        if ignore_punctuation:
            source = F.regexp_replace(source, r"(?U)[\p{Punct}、。]", "")
        return F.transform(F.split(source, "\n"), lambda line: F.struct(line.alias("line"), F.lit(flag1).alias("one"), F.lit(flag2).alias("two")))

    both = pairs.where((F.col("text1") != "") & (F.col("text2") != "")).select(
        "pair_id", (F.col("text1") == F.col("text2")).alias("_same"), F.explode(F.concat(lines("text1", 1, 0), lines("text2", 0, 1))).alias("_l")
    )
    return both.groupBy("pair_id", F.col("_l.line").alias("line")).agg(
        F.sum("_l.one").alias("n1"), F.sum("_l.two").alias("n2"), F.max("_same").alias("same")
    )


def line_changes(pairs: DataFrame, ignore_punctuation: bool = False) -> DataFrame:
    """Lines added to or removed from text2 against text1, with how many copies.

    Both sides are counted in one aggregation keyed by pair and line, with
    map-side combine: a line repeated millions of times is one partial count.
    """
    n1, n2 = F.col("n1"), F.col("n2")
    return (
        _line_counts(pairs, ignore_punctuation)
        .where(n1 != n2)
        .select("pair_id", "line", F.when(n2 > n1, "added").otherwise("removed").alias("change"),
                F.abs(n2 - n1).alias("copies"))
    )


def text_diff_lines(pairs: DataFrame, ignore_punctuation: bool = False) -> DataFrame:
    """Per pair: common, added and removed line counts and the ratio 2 * common / total."""
    return _line_totals(pairs, ignore_punctuation).drop("same")


def _line_totals(pairs: DataFrame, ignore_punctuation: bool) -> DataFrame:
    n1, n2 = F.col("n1"), F.col("n2")
    return (
        _line_counts(pairs, ignore_punctuation)
        .groupBy("pair_id")
        .agg(
            F.sum(F.least(n1, n2)).alias("common_lines"),
            F.sum(F.greatest(n2 - n1, F.lit(0))).alias("added_lines"),
            F.sum(F.greatest(n1 - n2, F.lit(0))).alias("removed_lines"),
            F.sum(n1 + n2).alias("_total"), F.max("same").alias("same"),
        )
        .withColumn("match_ratio", F.try_divide(F.col("common_lines") * 2.0, F.col("_total")))
        .drop("_total")
    )


def text_match(pairs: DataFrame) -> DataFrame:
    """Exact or partial match of each text pair, with the ratio of common lines."""
    return _line_totals(pairs, False).select(
        "pair_id",
        F.when(F.col("same"), "exact").when(F.col("match_ratio") > 0, "partial").otherwise("none").alias("match"),
        F.when(F.col("same"), 1.0).otherwise(F.col("match_ratio")).alias("match_ratio"),
    )
