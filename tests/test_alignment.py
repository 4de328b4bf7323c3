"""Ordered alignment against a plain recursive form, with every stretch limit giving the same."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filingdelta.operators import alignment


def longest_chain(places):
    """By the quadratic rule; of equal ends the one whose last place is least is gone on from."""
    tails, before = [], [-1] * len(places)
    for i, p in enumerate(places):
        k = sum(places[t] < p for t in tails)
        before[i] = tails[k - 1] if k else -1
        tails[k:k + 1] = [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out, i = [i, *out], before[i]
    return out


def plain_matches(a, b, p=0, q=0):
    out, n = [], min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    out += [(p + k, q + k) for k in range(head)]
    a, b, p, q, n = a[head:], b[head:], p + head, q + head, n - head
    tail = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    out += [(p + len(a) - 1 - k, q + len(b) - 1 - k) for k in range(tail)]
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    c1, c2 = Counter(a), Counter(b)
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if c1[x] == 1 and c2.get(x) == 1]
    if not anchors:
        return out
    i0 = j0 = 0
    for k in longest_chain([j for _, j in anchors]):
        i, j = anchors[k]
        out += [(p + i, q + j), *plain_matches(a[i0:i], b[j0:j], p + i0, q + j0)]
        i0, j0 = i + 1, j + 1
    return out + plain_matches(a[i0:], b[j0:], p + i0, q + j0)


def plain_changes(a, b):
    marks = [*sorted(plain_matches(a, b)), (len(a), len(b))]
    i = j = 0
    for p, q in marks:
        if p > i or q > j:
            kind = "added" if p == i else "removed" if q == j else "changed"
            yield kind, i, p - i, j, q - j, "\n".join(a[i:p]) if p > i else None, "\n".join(b[j:q]) if q > j else None
        i, j = p + 1, q + 1


def random_pairs():
    rng, pairs = random.Random(11), []
    for n in range(120):
        words = rng.choice([3, 8, 40, 400])
        a = [rng.choice(["", "x" * rng.randrange(4), f"line {rng.randrange(words)}"]) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            at, what = rng.randrange(len(b) + 1), rng.randrange(4)
            if what == 0:
                b.insert(at, f"new {rng.randrange(9)}")
            elif what == 1 and b:
                del b[min(at, len(b) - 1)]
            elif what == 2 and b:
                b[min(at, len(b) - 1)] = f"line {rng.randrange(words)}"
            else:
                cut = rng.randrange(len(b) + 1)
                b = b[cut:] + b[:cut]
        pairs.append((f"p{n}", "\n".join(a), "\n".join(b)))
    pairs += [("same", "a\nb\na", "a\nb\na"), ("none", "a\nb", "c\nd\ne"), ("empty", "", "a"), ("null", None, "a"), ("one", "a", "a\nb"), ("moved", "1\n2\n3\n4\n5", "4\n5\n1\n2\n3")]
    return pairs


@pytest.mark.parametrize("limit", [20_000, 12])
def test_changes(spark, limit):
    pairs = random_pairs()
    df = spark.createDataFrame(pairs, "pair_id string, text1 string, text2 string")
    got = {}
    for r in alignment.text_changes(df, limit=limit).orderBy("pair_id", "change").collect():
        got.setdefault(r.pair_id, []).append((r.kind, r.start1, r.n1, r.start2, r.n2, r.before, r.after))
    expected = {i: list(plain_changes(a.split("\n"), b.split("\n"))) for i, a, b in pairs if a and b}
    assert got == {i: c for i, c in expected.items() if c}
    assert alignment.text_changes(df.limit(0), limit=limit).count() == 0


def test_changes_rebuild_the_second_text(spark, smoke_dir):
    """Whole given texts: the first text with its changes applied is the second; nothing is read only in part."""
    from filingdelta.plans.tables import Tables

    pairs = Tables(spark, smoke_dir).text_pairs().where((F.col("text1") != "") & (F.col("text2") != "")).cache()
    changes = {}
    for r in alignment.text_changes(pairs, limit=50).orderBy("pair_id", "change").collect():
        changes.setdefault(r.pair_id, []).append(r)
    rows = pairs.collect()
    assert max(len(r.text1) for r in rows) > 5_000
    for r in rows:
        a, b, at = r.text1.split("\n"), [], 0
        for c in changes.get(r.pair_id, []):
            b += a[at:c.start1] + ([] if c.after is None else c.after.split("\n"))
            assert c.before == ("\n".join(a[c.start1:c.start1 + c.n1]) if c.n1 else None) and len(b) == c.start2 + c.n2
            at = c.start1 + c.n1
        assert "\n".join(b + a[at:]) == r.text2


def test_summary_counts_and_lists(spark):
    df = spark.createDataFrame([("p", 1, "Same. Old one! Kept?  Gone. End", "Same. New one! Kept?  End\nMore。也"), ("p", 2, "a", "a")], "pair_id string, n int, text1 string, text2 string")
    rows = {r.n: r for r in alignment.text_alignment(df, ["pair_id", "n"], "sentence").collect()}
    assert (rows[2].match_ratio, rows[2].n_added, rows[2].added_text) == (1.0, 0, [])
    one = rows[1]
    assert (one.n1, one.n2, one.matched) == (5, 6, 3) and one.match_ratio == 6 / 11
    assert [tuple(c) for c in one.changed_text] == [("Old one!", "New one!")] and one.removed_text == ["Gone."] and one.added_text == ["More。 也"]
    assert re.match(r"array<struct<before", df.sparkSession.createDataFrame([], alignment.text_alignment(df, ["n"]).schema).schema["changed_text"].dataType.simpleString())


def test_a_long_pair_is_cut(spark):
    """8,000 lines a side, a third of them blank; only stretches of up to 400 lines are aligned by one task."""
    a = [f"line {k}" if k % 3 else "" for k in range(8_000)]
    b = [x for k, x in enumerate(a) if k % 1_000] + ["the end"]
    b[500] = "other"
    df = spark.createDataFrame([("long", "\n".join(a), "\n".join(b))], "pair_id string, text1 string, text2 string")
    row = alignment.text_alignment(df, limit=400).first()
    got = [(r.kind, r.start1, r.n1, r.start2, r.n2) for r in alignment.text_changes(df, limit=400).orderBy("change").collect()]
    assert got == [c[:5] for c in plain_changes(a, b)]
    assert row.matched == row.n1 - sum(c[2] for c in got)
