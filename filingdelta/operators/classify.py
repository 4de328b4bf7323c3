"""Keyword classification of documents and model-reply handling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filingdelta.functions import json as J
from filingdelta.functions.numbers import round_half_even
from filingdelta.operators.containment import with_needles
from filingdelta.schemas import UNKNOWN_LABEL, UNKNOWN_TYPE

DEFAULT_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Lexicon:
    """A catalogue as tables: detection keywords ``(kind, ordinal, keyword)`` and every type once, ``(kind, label)``.

    Types stand in the order of their names, keywords in that of their ordinals; neither has a greatest number.
    """

    keywords: DataFrame
    labels: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, keywords: Mapping[str, Sequence[str]], labels: Mapping[str, str] | None = None) -> Lexicon:
        words = [(kind, i, word) for kind, listed in keywords.items() for i, word in enumerate(listed)]
        names = {kind: kind for kind in keywords} | dict(labels or {})
        return cls(
            spark.createDataFrame(words, "kind string, ordinal int, keyword string"),
            spark.createDataFrame(list(names.items()), "kind string, label string"),
        )

    def needles(self) -> DataFrame:
        """The keywords in lower case, each with its type's label and number of keywords."""
        totals = self.keywords.groupBy("kind").agg(F.count("*").cast("int").alias("total"))
        words = self.keywords.join(totals, "kind").join(self.labels, "kind", "left")
        return words.select("kind", "ordinal", F.lower("keyword").alias("needle"), "total", F.coalesce("label", "kind").alias("label"))

    def matched(self, df: DataFrame, text: Column, out: str = "_hits") -> DataFrame:
        """``df`` with the keywords in ``text``, ordered by type and ordinal."""
        return with_needles(df, text, self.needles(), out).withColumn(out, F.array_sort(out))

    def labelled(self, df: DataFrame, kind_col: str, out: str, known: str | None = None) -> DataFrame:
        """``df`` with the label of a type, the type itself where it has none, and whether the catalogue knows it."""
        names = self.labels.select(F.col("kind").alias("_kind"), F.col("label").alias("_label"))
        kind = F.col(kind_col)
        label = F.coalesce("_label", F.when(kind == UNKNOWN_TYPE, F.lit(UNKNOWN_LABEL)), kind)
        joined = df.join(names, kind == F.col("_kind"), "left").withColumn(out, label)
        if known:
            joined = joined.withColumn(known, F.coalesce(F.col("_kind").isNotNull() | (kind == UNKNOWN_TYPE), F.lit(False)))
        return joined.drop("_kind", "_label")


def haystack(filename: Column, sample: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(filename, F.lit("")), F.coalesce(sample, F.lit(""))))


def _document_text() -> Column:
    return haystack(F.col("filename"), F.col("text_sample"))


def _of_kind(hits: Column, kind: Column) -> Column:
    return F.filter(hits, lambda h: h["kind"] == kind)


def _words(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["needle"])


def _best_kind(df: DataFrame) -> DataFrame:
    """The type with the most of the row's ``_hits``; the first one in catalogue order wins a tie."""
    hits = F.filter("_hits", lambda h: h["kind"] != UNKNOWN_TYPE)
    by_kind = F.transform(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["kind"]))), lambda k: _of_kind(F.col("_hits"), k))
    best = F.aggregate(by_kind, F.filter("_hits", lambda h: F.lit(False)), lambda acc, h: F.when(F.size(h) > F.size(acc), h).otherwise(acc))
    found = F.size("_best") > 0
    first = F.get("_best", F.lit(0))
    ratio = F.least(F.lit(1.0), F.size("_best") / first["total"])
    return (
        df.withColumn("_best", best)
        .withColumn("detected_type", F.when(found, first["kind"]))
        .withColumn("detected_type_label", F.when(found, first["label"]))
        .withColumn("detection_confidence", F.when(found, round_half_even(ratio, 2)))
        .withColumn("matched_keywords", F.when(found, _words(F.col("_best"))))
        .drop("_best")
    )


def classify(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Type with the most matching keywords; the first type in catalogue order wins a tie.

    Adds detected_type, detected_type_label, detection_confidence and
    matched_keywords, all null when no keyword matches.
    """
    return _best_kind(lexicon.matched(docs, _document_text())).drop("_hits")


def matched_keywords(docs: DataFrame, lexicon: Lexicon, type_col: str = "document_type") -> DataFrame:
    """Keywords of the given type found in the text, in catalogue order."""
    out = lexicon.matched(docs, _document_text())
    return out.withColumn("matched_keywords", _words(_of_kind(F.col("_hits"), F.col(type_col)))).drop("_hits")


def _read_reply(docs: DataFrame, lexicon: Lexicon, reply_col: str) -> DataFrame:
    """Columns of a reply, from a row that has its ``_hits``."""
    doc = docs.withColumn("_doc", J.parsed(F.col(reply_col))).withColumn("_named", J.text_member(F.col("_doc"), "document_type"))
    known = lexicon.labelled(doc, "_named", "reply_label", known="_known")
    confidence = F.coalesce(J.number_member(F.col("_doc"), "confidence"), F.lit(DEFAULT_CONFIDENCE))
    clamped = F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0)))
    usable = F.col("reply_type").isNotNull()
    return (
        known.withColumn("reply_type", F.when(J.is_object(F.col("_doc")) & F.col("_known"), F.col("_named")))
        .withColumn("reply_label", F.when(usable, F.col("reply_label")))
        .withColumn("reply_confidence", F.when(usable, round_half_even(clamped, 2)))
        .withColumn("reply_reason", F.when(usable, J.text_member(F.col("_doc"), "reason")))
        .withColumn("reply_keywords", F.when(usable, _words(_of_kind(F.col("_hits"), F.col("reply_type")))))
        .drop("_doc", "_named", "_known")
    )


def parse_type_reply(docs: DataFrame, lexicon: Lexicon, reply_col: str = "reply_json") -> DataFrame:
    """Read a classification reply; reply_type is null when the reply is not usable."""
    return _read_reply(lexicon.matched(docs, _document_text()), lexicon, reply_col).drop("_hits", "reply_label")


def classify_final(docs: DataFrame, lexicon: Lexicon, reply_col: str = "reply_json") -> DataFrame:
    """The reply's result when it is usable, the keyword result otherwise; the text is searched once for both."""
    both = _read_reply(_best_kind(lexicon.matched(docs, _document_text())), lexicon, reply_col)
    usable = F.col("reply_type").isNotNull()

    def pick(reply: str, other: str) -> Column:
        return F.when(usable, F.col(reply)).otherwise(F.col(other))

    return (
        both.withColumn("classified_by", F.when(usable, "reply").when(F.col("detected_type").isNotNull(), "keywords"))
        .withColumn("matched_keywords", pick("reply_keywords", "matched_keywords"))
        .withColumn("detection_confidence", pick("reply_confidence", "detection_confidence"))
        .withColumn("detection_reason", F.col("reply_reason"))
        .withColumn("detected_type_label", pick("reply_label", "detected_type_label"))
        .withColumn("detected_type", pick("reply_type", "detected_type"))
        .drop("_hits", "reply_type", "reply_label", "reply_confidence", "reply_reason", "reply_keywords")
    )
