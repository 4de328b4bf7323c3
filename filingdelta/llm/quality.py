"""Quality rules as a short-circuit cascade, in SQL functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINES, MAX_WORD_CHARS, MIN_WORD_CHARS = 0.3, 0.5, 15.0, 2.0
SAMPLE_ROWS = 1000


Metrics = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """A named test over measured columns; ``metrics`` names those that it reads."""

    name: str
    metrics: tuple[str, ...]
    failed: Callable[[Metrics], Column]


RULES = (
    Rule("too_few_words", ("n_words",), lambda m: m["n_words"] < MIN_WORDS),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: m["n_symbols"] > MAX_SYMBOLS_PER_WORD * m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: ~m["word_chars"].between(MIN_WORD_CHARS * m["n_words"], MAX_WORD_CHARS * m["n_words"])),
)


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words of a text, none for an empty one."""
    trimmed = _trimmed(text)
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_repeat_words(word_list: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text.

    Windows are 64-bit hashes with their place, sorted once; a window is repeated if a neighbour in that
    order has its hash. The places of repeated windows, sorted again, add the words not yet covered.
    Time is n log n in the words of one text.
    """
    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        ))

    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    # A one-element array binds its element to a lambda's variable, so that it is computed once.
    places = F.flatten(F.transform(F.transform(F.array(word_list), windows), repeated))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        places, start,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(word_list) < 4, F.lit(0).cast("long")).otherwise(covered)


def metric_columns(text: Column, word_list: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    full = F.filter(lines, lambda x: F.length(_trimmed(x)) > 0)
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(word_list)),
        "word_chars": long(F.length(F.translate(text, BLANKS, ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_lines": long(F.size(full)),
        "n_dup_lines": long(F.size(full) - F.size(F.array_distinct(full))),
        "n_repeat_words": n_repeat_words(word_list),
    }


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("_text")).withColumn("_words", words(F.col("_text")))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all measured columns, one row per row of ``docs(doc_id, text)``.

    A null text is empty and has zero everywhere. Other columns are not read.
    """
    df = _with_words(docs)
    return df.select("doc_id", *(c.alias(m) for m, c in metric_columns(F.col("_text"), F.col("_words")).items()))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejection per cost, both estimated on at most ``sample_rows`` rows.

    Cost is the time to measure a rule's columns over the sample; rejection is the smoothed share of failing
    rows. Only the order of evaluation depends on them, never whether a row is kept.
    """
    sample = _with_words(docs.select("doc_id", "text").limit(sample_rows)).persist()
    try:
        columns = metric_columns(F.col("_text"), F.col("_words"))
        n, scored = sample.count(), []
        for rule in rules:
            began = time.perf_counter()
            failed = sample.where(rule.failed(columns)).count()
            cost = time.perf_counter() - began
            scored.append(((failed + 1) / (n + 2) / max(cost, 1e-3), rule))
    finally:
        sample.unpersist()
    return tuple(rule for _, rule in sorted(scored, key=lambda x: -x[0]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Measured columns, ``failed_rule`` (the first to fail in the cascade's order) and ``kept`` per row.

    ``kept`` is true if no rule fails. Repeated rows are judged alike; an empty table has no rows.
    """
    rules = order_rules(docs) if rules is None else rules
    measured = measure(docs)
    columns = {c: F.col(c) for c in measured.columns}
    first = F.coalesce(*(F.when(r.failed(columns), F.lit(r.name)) for r in rules), F.lit(None).cast("string"))
    return measured.withColumn("failed_rule", first).withColumn("kept", F.col("failed_rule").isNull())


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass all rules, unchanged, with all their columns.

    The rules are one chain of conditions in the cascade's order: what a rule measures is computed only for
    rows that passed the rules before it.
    """
    rules = order_rules(docs) if rules is None else rules
    text = F.coalesce(docs["text"], F.lit(""))
    columns = metric_columns(text, words(text))
    passed = F.lit(True)
    for rule in reversed(rules):
        passed = F.when(rule.failed(columns), False).otherwise(passed)
    return docs.where(passed)
