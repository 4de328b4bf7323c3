"""SimHash near-duplicates: segment popcounts, a grid range join under Manhattan distance, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from filingdelta.llm.common import arrow_map, written
from filingdelta.llm.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
HASHES_AT_ONCE = 1 << 16
# Segments of two bits: their counts 0, 1, 2 lie side by side in one 64-bit number.
SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half of the shingles' XXH64; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    width = min(shingle, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), stops[width - 1:].tolist())
    digest, n, counts = xxhash.xxh64_intdigest, len(words) - width + 1, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    for at in range(0, n, HASHES_AT_ONCE):
        part = np.ascontiguousarray(hashes[at:at + HASHES_AT_ONCE]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long)`` per row of ``docs(doc_id, text)``; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), dtype=np.uint64)
            yield {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64)}

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, run, schema, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bits set in each two-bit segment, packed in place."""
    low = F.lit(LOW_BITS)
    first, second = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return first.bitwiseXOR(second).bitwiseOR(F.shiftleft(first.bitwiseAND(second), 1))


def grid_cells(fp: Column) -> Column:
    """The point of the segment counts and all points one step from it.

    Two fingerprints that differ in at most two bits have counts at a Manhattan distance of at most two, so some point is at most
    one step from both: they meet in a cell. Points outside the grid are left out; no meeting point lies there.
    """
    point = segment_counts(fp)
    count = lambda i: F.shiftrightunsigned(point, 2 * i).bitwiseAND(F.lit(3))
    step = lambda bits, i: point.bitwiseXOR(F.lit(_signed(bits << 2 * i)))
    # Between counts 0 and 1 the segment's low bit changes, between 1 and 2 both bits.
    lower = [F.when(count(i) < 2, step(1, i)) for i in range(SEGMENTS)]
    upper = [F.when(count(i) > 0, step(3, i)) for i in range(SEGMENTS)]
    return F.array(point, *lower, *upper)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def one_bit_cells(fp: Column) -> Column:
    """The fingerprint and its neighbours at one bit: fingerprints with a common cell differ in at most two bits."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))


def links(distinct_fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints ``fp`` at most two bits apart that connect all such fingerprints.

    Cells with two fingerprints give a pair, kept if its exact distance is at most two. Cells with more are crowded: their
    members, each once, go to cells of one-bit steps, where all members are within the distance of each other and there are
    at most 65 of them, so each is linked to the least one and no pair needs to be formed. Every linked pair meets in one of
    the two kinds of cells, so the components are those of all links.
    """
    cells = distinct_fps.select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell")).where("cell IS NOT NULL")
    held = written(cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    pairs = held.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b").distinct()
    crowded = cells.join(held.where("n > 2").select("cell"), "cell", "left_semi").select("fp").distinct()
    fine = crowded.select("fp", F.explode(one_bit_cells(F.col("fp"))).alias("cell"))
    stars = fine.groupBy("cell").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs(doc_id, text)``.

    ``component_id`` is the least doc_id that can be reached over fingerprints at most two bits apart, equal ones
    included. Texts without words share the fingerprint zero and are linked like any others. A null doc_id takes part but
    is never the least (a component of null ids only has a null one). Repeated rows repeat. Copies are collapsed to
    one fingerprint before any join, so a group of copies of any size is one point.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(points.select("fp")))
    placed = points.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "roots")
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's least, with all columns; of repeated ids one row stays.

    Rows with a null doc_id stay only where their component has no other id, one row per component. Decisions are made on
    ids; whole rows meet them once, in an anti-join with the ids that go. Rows are compared only where ids repeat.
    """
    found = written(near_duplicates(docs, shingle), "components")
    counted = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("_kept"))
    # Not the ids that simply stay, which are most.
    ids = written(counted.where("_rows > 1 OR NOT _kept"), "ids")
    stay = docs.where("doc_id IS NOT NULL").join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("_kept").select("doc_id")
    if not again.isEmpty():
        repeated = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row"))
        stay = stay.unionByName(repeated.select("_row.*"))
    orphans = found.where("component_id IS NULL").select("fp").distinct()
    if orphans.isEmpty():
        return stay
    lost = docs.where("doc_id IS NULL")
    prints = fingerprints(lost.select(F.xxhash64("text").alias("doc_id"), "text"), shingle).distinct()
    first = prints.join(orphans, "fp").groupBy("fp").agg(F.min("doc_id").alias("_text"))
    alone = lost.withColumn("_text", F.xxhash64("text")).join(first.select("_text"), "_text").groupBy("_text").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return stay.unionByName(alone)
