"""Ordered alignment of whole texts: parts that are added, removed or changed, and where.

The rule: equal parts at both ends of a stretch match; of what is left, parts that stand once on each side match
along a longest chain that ascends on both sides; the stretches between are aligned in the same way. A stretch
without such a part is a change. Short pairs are aligned where they are; long ones are cut at their chain, and the
stretches are aligned apart from each other, whatever pair they belong to.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from filingdelta.session import materialise

# Parts of both sides that one task aligns at once; longer stretches are cut first.
STRETCH_PARTS = 20_000
# Neighbouring parts that look for the match before them in one task.
NEIGHBOURS = 12
LISTED_PIECES = 10
# Ends of sentences, with or without a blank behind them.
BREAKS = {"line": r"\n", "sentence": r"\n+|(?<=[。！？])|(?<=[.!?])\s+"}

BLOCKS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("pos1", "pos2", "length")]))


def ascending(places: np.ndarray) -> list[int]:
    """Indices of a longest ascending chain among different numbers."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places.tolist()):
        k = bisect_left(tails, place)
        before[i] = ends[k - 1] if k else -1
        tails[k:k + 1], ends[k:k + 1] = [place], [i]
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def single(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur once, in order of the code, and where."""
    found, at, n = np.unique(codes, return_index=True, return_counts=True)
    return found[n == 1], at[n == 1]


def matches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Matching blocks (start in a, start in b, length) of two sequences of codes."""
    out, open_stretches = [], [(0, len(a), 0, len(b))]
    while open_stretches:
        a0, a1, b0, b1 = open_stretches.pop()
        n = min(a1 - a0, b1 - b0)
        other = np.flatnonzero(a[a0:a0 + n] != b[b0:b0 + n])
        head = int(other[0]) if len(other) else n
        if head:
            out.append((a0, b0, head))
            a0, b0, n = a0 + head, b0 + head, n - head
        other = np.flatnonzero(a[a1 - n:a1][::-1] != b[b1 - n:b1][::-1])
        tail = int(other[0]) if len(other) else n
        if tail:
            a1, b1 = a1 - tail, b1 - tail
            out.append((a1, b1, tail))
        (codes1, at1), (codes2, at2) = single(a[a0:a1]), single(b[b0:b1])
        _, i, j = np.intersect1d(codes1, codes2, assume_unique=True, return_indices=True)
        if len(i):
            order = np.argsort(at1[i])
            left, right = at1[i][order] + a0, at2[j][order] + b0
            for k in ascending(right):
                out.append((int(left[k]), int(right[k]), 1))
                open_stretches.append((a0, out[-1][0], b0, out[-1][1]))
                a0, b0 = out[-1][0] + 1, out[-1][1] + 1
            open_stretches.append((a0, a1, b0, b1))
    return joined_blocks(sorted(out))


def joined_blocks(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for p, q, n in blocks:
        if out and out[-1][0] + out[-1][2] == p and out[-1][1] + out[-1][2] == q:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((p, q, n))
    return out


def _listed(rows: list[list[tuple[int, ...]]], names: Sequence[str]) -> pa.ListArray:
    flat = np.array([x for row in rows for x in row], dtype=np.int32).reshape(-1, len(names))
    offsets = np.append(0, np.cumsum([len(row) for row in rows]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names=list(names)))


@F.arrow_udf(BLOCKS)
def _matching_blocks(a1: pa.Array, a2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
    rows = []
    for k in range(len(a1)):
        halves = [np.concatenate([x[k].values.to_numpy(), y[k].values.to_numpy()]) for x, y in ((a1, b1), (a2, b2))]
        codes = np.unique(np.stack(halves, axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        n = len(a1[k].values)
        rows.append(matches(codes[:n], codes[n:]))
    return _listed(rows, ("pos1", "pos2", "length"))


@F.arrow_udf(BLOCKS)
def _chain(pos1: pa.Array, pos2: pa.Array) -> pa.Array:
    """The longest ascending chain through places that are in order of the first side."""
    rows = []
    for one, two in zip(pos1, pos2):
        p, q = one.values.to_numpy(), two.values.to_numpy()
        rows.append([(int(p[i]), int(q[i]), 1) for i in ascending(q)])
    return _listed(rows, ("pos1", "pos2", "length"))


def parts_of(text: Column, unit: str) -> Column:
    """The lines (blank ones too) or the sentences of a text."""
    parts = F.split(text, BREAKS[unit])
    return parts if unit == "line" else F.filter(parts, lambda p: p != "")


def _hashed(pairs: DataFrame) -> DataFrame:
    """Two hashes of every part, 128 bits together, in place of the parts."""
    two = lambda parts: [F.transform(parts, lambda p: F.xxhash64(p)), F.transform(parts, lambda p: F.xxhash64(F.lit(7), p))]
    (a1, a2), (b1, b2) = two("_parts1"), two("_parts2")
    return pairs.withColumn("_a1", a1).withColumn("_a2", a2).withColumn("_b1", b1).withColumn("_b2", b2)


def _preceding(parts: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``parts`` with the stretch they are in after ``found`` matched: the place on side 1 of the match before them.

    Matches ascend on both sides, so that is the greatest one before. It is looked up among neighbours, with what earlier
    neighbourhoods have carried in: no task holds a whole stretch.
    """
    group = [*keys, "stretch", "side"]
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("pos1").alias("pos")), F.struct(F.lit(2).alias("side"), F.col("pos2").alias("pos")))).alias("s")
    marks = found.select(*keys, "stretch", sides, F.col("pos1").alias("_mark")).select(*keys, "stretch", "s.side", "s.pos", "_mark")
    rows = parts.join(marks, [*group, "pos"], "left").withColumn("_near", F.shiftright("pos", NEIGHBOURS))
    near = rows.groupBy(*group, "_near").agg(F.max("_mark").alias("_last"))
    earlier = Window.partitionBy(*group).orderBy("_near").rowsBetween(Window.unboundedPreceding, -1)
    carried = near.select(*group, "_near", F.max("_last").over(earlier).alias("_carried"))
    here = Window.partitionBy(*group, "_near").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(carried, [*group, "_near"]).withColumn("_stretch", F.coalesce(F.max("_mark").over(here), "_carried", "stretch"))
    return placed.where(F.col("_mark").isNull()).withColumn("stretch", F.col("_stretch")).select(*parts.columns)


def _cut(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matches ``(keys, stretch, pos1, pos2)`` of long stretches: both ends, and the chain of parts that stand once on each side."""
    group = [*keys, "stretch"]
    one, two = F.col("side") == 1, F.col("side") == 2
    sizes = parts.groupBy(*group).agg(
        F.min(F.when(one, F.col("pos"))).alias("_s1"), F.count_if(one).cast("int").alias("_n1"),
        F.min(F.when(two, F.col("pos"))).alias("_s2"), F.count_if(two).cast("int").alias("_n2"),
    )
    rows = parts.join(sizes, group).withColumn("_head", F.col("pos") - F.when(one, F.col("_s1")).otherwise(F.col("_s2")))
    rows = rows.withColumn("_tail", F.when(one, F.col("_n1")).otherwise(F.col("_n2")) - 1 - F.col("_head"))

    def equal_from(place: str, out: str) -> DataFrame:
        same = (F.count("*") == 2) & (F.min("h1") == F.max("h1")) & (F.min("h2") == F.max("h2"))
        met = rows.groupBy(*group, place).agg(same.alias("_same"))
        least = F.coalesce(F.min(F.when(~F.col("_same"), F.col(place))), F.max(place) + 1)
        return met.groupBy(*group).agg(least.cast("int").alias(out))

    ends = sizes.join(equal_from("_head", "_heads"), group).join(equal_from("_tail", "_tails"), group)
    ends = ends.withColumn("_tails", F.least("_tails", F.least("_n1", "_n2") - F.col("_heads")))
    heads = ends.where("_heads > 0").select(*group, F.explode(F.transform(F.sequence(F.lit(0), F.col("_heads") - 1), lambda i: F.struct((F.col("_s1") + i).alias("pos1"), (F.col("_s2") + i).alias("pos2")))).alias("m"))
    tails = ends.where("_tails > 0").select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.col("_tails")), lambda i: F.struct((F.col("_s1") + F.col("_n1") - i).alias("pos1"), (F.col("_s2") + F.col("_n2") - i).alias("pos2")))).alias("m"))
    inner = rows.join(ends.select(*group, "_heads", "_tails"), group).where("_head >= _heads AND _tail >= _tails")
    anchors = inner.groupBy(*group, "h1", "h2").agg(F.count_if(one).alias("_c1"), F.count_if(two).alias("_c2"), F.max(F.when(one, F.col("pos"))).alias("pos1"), F.max(F.when(two, F.col("pos"))).alias("pos2"))
    ordered = anchors.where("_c1 = 1 AND _c2 = 1").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pos1", "pos2"))).alias("_places"))
    chain = ordered.select(*group, F.explode(_chain(F.col("_places.pos1"), F.col("_places.pos2"))).alias("m"))
    return heads.unionByName(tails).select(*group, "m.pos1", "m.pos2").unionByName(chain.select(*group, "m.pos1", "m.pos2"))


def _long_blocks(pairs: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``(keys, _blocks)`` of the pairs that are cut; rounds go on while a stretch is long and the last round cut it."""
    side = lambda n, x: pairs.select(*keys, F.lit(n).alias("side"), F.posexplode(F.arrays_zip(F.col(f"_{x}1").alias("h1"), F.col(f"_{x}2").alias("h2"))).alias("pos", "_h")).select(*keys, F.lit(-1).alias("stretch"), "side", "pos", "_h.h1", "_h.h2")
    group = [*keys, "stretch"]
    long = materialise(side(1, "a").unionByName(side(2, "b")), "parts")
    blocks = []
    while not long.isEmpty():
        found = materialise(_cut(long, keys), "cuts")
        blocks.append(found.select(*keys, "pos1", "pos2", F.lit(1).alias("length")))
        cut = long.join(found.select(*group).distinct(), group, "left_semi")
        left = materialise(_preceding(cut, found, keys), "stretches")
        sizes = left.groupBy(*group).agg(F.count_if(F.col("side") == 1).alias("_n1"), F.count_if(F.col("side") == 2).alias("_n2")).where("_n1 > 0 AND _n2 > 0")
        short = left.join(sizes.where(F.col("_n1") + F.col("_n2") <= limit).select(*group), group, "left_semi")
        listed = lambda n: F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("pos", "h1", "h2"))))
        held = short.groupBy(*group).agg(listed(1).alias("_one"), listed(2).alias("_two"))
        inside = held.select(*keys, F.col("_one.pos")[0].alias("_s1"), F.col("_two.pos")[0].alias("_s2"), F.explode(_matching_blocks(F.col("_one.h1"), F.col("_one.h2"), F.col("_two.h1"), F.col("_two.h2"))).alias("m"))
        blocks.append(materialise(inside.select(*keys, (F.col("m.pos1") + F.col("_s1")).alias("pos1"), (F.col("m.pos2") + F.col("_s2")).alias("pos2"), "m.length"), "blocks"))
        long = left.join(sizes.where(F.col("_n1") + F.col("_n2") > limit).select(*group), group, "left_semi")
    rows = reduce(DataFrame.unionByName, blocks) if blocks else pairs.select(*keys, F.lit(0).alias("pos1"), F.lit(0).alias("pos2"), F.lit(0).alias("length"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos1", "pos2", "length"))).alias("_blocks"))


def _runs() -> tuple[Column, Column]:
    """The blocks between two ends, and what lies between them, in order: starts and numbers of parts on both sides."""
    nothing = F.struct(F.lit(0).alias("pos1"), F.lit(0).alias("pos2"), F.lit(0).alias("length"))
    end = F.struct(F.size("_parts1").alias("pos1"), F.size("_parts2").alias("pos2"), F.lit(0).alias("length"))
    empty = F.array().cast(BLOCKS)
    marks = F.concat(F.array(nothing), F.coalesce(F.col("_blocks"), empty), F.array(end))

    def between(p: Column, q: Column) -> Column:
        start1, start2 = p["pos1"] + p["length"], p["pos2"] + p["length"]
        return F.struct(start1.alias("start1"), (q["pos1"] - start1).alias("n1"), start2.alias("start2"), (q["pos2"] - start2).alias("n2"))

    gaps = F.zip_with(F.slice("_marks", F.lit(1), F.size("_marks") - 1), F.slice("_marks", F.lit(2), F.size("_marks") - 1), between)
    return marks, F.filter(gaps, lambda r: (r["n1"] > 0) | (r["n2"] > 0))


def _aligned(pairs: DataFrame, keys: Sequence[str], unit: str, limit: int) -> DataFrame:
    """Pairs with their parts and ``_runs``, the stretches that do not match."""
    ready = pairs.where((F.col("text1") != "") & (F.col("text2") != "")).select(
        *keys, parts_of(F.col("text1"), unit).alias("_parts1"), parts_of(F.col("text2"), unit).alias("_parts2")
    )
    fits = F.size("_parts1") + F.size("_parts2") <= limit
    short = _hashed(ready.where(fits)).withColumn("_blocks", _matching_blocks("_a1", "_a2", "_b1", "_b2")).drop("_a1", "_a2", "_b1", "_b2")
    long = ready.where(~fits)
    cut = _long_blocks(_hashed(long).drop("_parts1", "_parts2"), keys, limit)
    marks, runs = _runs()
    return short.unionByName(long.join(cut, list(keys), "left")).withColumn("_marks", marks).withColumn("_runs", runs).drop("_marks", "_blocks")


def _pieces(unit: str) -> Column:
    sep = "\n" if unit == "line" else " "
    kind = lambda r: F.when(r["n1"] == 0, "added").when(r["n2"] == 0, "removed").otherwise("changed")
    text = lambda parts, start, n: F.array_join(F.slice(F.col(parts), start + 1, n), sep)
    return F.transform("_runs", lambda r: F.struct(
        kind(r).alias("kind"), r["start1"].alias("start1"), r["n1"].alias("n1"), r["start2"].alias("start2"), r["n2"].alias("n2"),
        F.when(r["n1"] > 0, text("_parts1", r["start1"], r["n1"])).alias("before"), F.when(r["n2"] > 0, text("_parts2", r["start2"], r["n2"])).alias("after"),
    ))


def text_changes(pairs: DataFrame, keys: Sequence[str] = ("pair_id",), unit: str = "line", limit: int = STRETCH_PARTS) -> DataFrame:
    """One row per change of each text pair ``(keys, text1, text2)``: keys, change, kind, start1, n1, start2, n2, before, after.

    ``kind`` is added, removed or changed; starts count lines or sentences from 0; ``before`` or ``after`` is null where
    that side has nothing. Whole texts are compared; pairs with an empty or null text are left out. The keys identify a pair.
    """
    found = _aligned(pairs, keys, unit, limit)
    return found.select(*keys, F.posexplode(_pieces(unit)).alias("change", "_p")).select(*keys, "change", "_p.*")


def text_alignment(pairs: DataFrame, keys: Sequence[str] = ("pair_id",), unit: str = "line", limit: int = STRETCH_PARTS, listed: int = LISTED_PIECES) -> DataFrame:
    """One row per text pair: parts on each side, matched ones, ``match_ratio`` (2 * matched / all), counts by kind and the first pieces of each."""
    found = _aligned(pairs, keys, unit, limit)
    gone = lambda n: F.aggregate("_runs", F.lit(0), lambda acc, r: acc + r[n])
    sized = found.withColumn("n1", F.size("_parts1")).withColumn("n2", F.size("_parts2")).withColumn("matched", F.col("n1") - gone("n1")).withColumn("_pieces", _pieces(unit))
    of = lambda kind: F.filter("_pieces", lambda p: p["kind"] == kind)
    return sized.select(
        *keys, "n1", "n2", "matched", F.try_divide(2.0 * F.col("matched"), F.col("n1") + F.col("n2")).alias("match_ratio"),
        *[F.size(of(k)).alias(f"n_{k}") for k in ("added", "removed", "changed")],
        F.slice(F.transform(of("added"), lambda p: p["after"]), 1, listed).alias("added_text"),
        F.slice(F.transform(of("removed"), lambda p: p["before"]), 1, listed).alias("removed_text"),
        F.slice(F.transform(of("changed"), lambda p: F.struct(p["before"].alias("before"), p["after"].alias("after"))), 1, listed).alias("changed_text"),
    )
