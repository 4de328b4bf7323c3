"""Line dedup: two Bloom filters find lines that may repeat; only those are counted exactly and lose their copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from filingdelta.llm.common import BLANKS, arrow_map, written

MIN_CHARS, MIN_DOCS = 20, 3
# Expected sightings a task's pair of filters takes, bits for each, and places a sighting sets.
FILTER_KEYS, KEY_BITS, PLACES = 2_000_000, 12, 4


class SeenTwice:
    """One filter of keys seen once, one of keys seen twice: tells, without keeping keys, which may be seen a third time.

    A key that was seen ``wanted`` times is always told; some others are told by chance, so what it tells is suspected only.
    """

    def __init__(self, keys: int, wanted: int):
        self.size = max(1024, keys * KEY_BITS)
        self.once, self.twice = np.zeros(self.size, dtype=bool), np.zeros(self.size, dtype=bool)
        self.wanted = wanted

    def add(self, keys: np.ndarray, sightings: np.ndarray) -> np.ndarray:
        """The suspects among different ``keys`` (64 bits), each with its number of new sightings."""
        step = (keys >> np.uint64(32)) | np.uint64(1)
        at = [((keys + np.uint64(k) * step) % np.uint64(self.size)).astype(np.int64) for k in range(PLACES)]
        before = np.zeros(len(keys), dtype=np.int64)
        for held in (self.once, self.twice):
            inside = np.ones(len(keys), dtype=bool)
            for places in at:
                inside &= held[places]
            before = np.where(inside, before + 1, before)
        after = before + sightings
        for places in at:
            self.once[places] = True
            self.twice[places[after >= 2]] = True
        return keys[after >= self.wanted]


def line_keys(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """For the lines of the texts: 128-bit key digests of the long enough ones, their lines' numbers, every line's text, all lines, their counts."""
    lines = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(lines)
    keys = pc.ascii_lower(pc.utf8_trim(flat, characters=BLANKS))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
    digest = xxhash.xxh3_128_digest
    held = b"".join([digest(key) for key in keys.take(pa.array(long)).cast(pa.binary()).to_pylist()])
    return np.frombuffer(held, dtype=">u8").astype(np.uint64).reshape(-1, 2), long, pc.list_parent_indices(lines).to_numpy(), flat, pc.list_value_length(lines)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(key, high, doc_ids)``: in each batch of documents, every key once, with the ids of the documents that hold it.

    ``key`` and ``high`` are the two halves of a line key's 128-bit digest, by which keys are told apart. A line that every
    document holds is one row a batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            digests, long, parents, _, _ = line_keys(batch.column("text"), min_chars)
            rows = parents[long]
            order = np.lexsort((rows, digests[:, 0], digests[:, 1]))
            digests, rows = digests[order], rows[order]
            new_key = np.ones(len(rows), dtype=bool)
            new_key[1:] = (digests[1:] != digests[:-1]).any(axis=1)
            new_row = new_key.copy()
            new_row[1:] |= rows[1:] != rows[:-1]
            first = np.flatnonzero(new_key[new_row])
            ids = batch.column("doc_id").take(pa.array(rows[new_row]))
            halves = digests[new_key].view(np.int64)
            offsets = pa.array(np.append(first, len(ids)), type=pa.int32())
            yield {"key": pa.array(halves[:, 1]), "high": pa.array(halves[:, 0]), "doc_ids": pa.ListArray.from_arrays(offsets, ids)}

    schema = pa.schema([("key", pa.int64()), ("high", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(texts, run, schema, "key long, high long, doc_ids array<long>")


def suspects(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key`` of all postings that may be held by ``min_docs`` documents, and of some others.

    Of a posting only its 8 bytes of key and a number below ``min_docs`` are dealt, by key; each task streams them through two Bloom
    filters of a fixed size and keeps no keys. There are as many tasks as the filters' capacity asks for.
    """
    spark = found.sparkSession
    n = found.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILTER_KEYS))
    # At most three sightings matter; two filters tell a third one.
    wanted = min(min_docs, 3)
    expected = -(-n // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        filters = None
        for batch in batches:
            keys, seen = batch.column("key").to_numpy().view(np.uint64), batch.column("seen").to_numpy()
            if filters is None:
                filters = SeenTwice(expected, wanted)
            different, where = np.unique(keys, return_inverse=True)
            yield {"key": filters.add(different, np.bincount(where, weights=seen).astype(np.int64)).view(np.int64)}

    sightings = found.select("key", F.least(F.size("doc_ids"), F.lit(wanted)).cast("byte").alias("seen")).repartition(parts, "key")
    return arrow_map(sightings, run, pa.schema([("key", pa.int64())]), "key long").distinct()


def repeated_keys(suspected: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(key, high, keeper)`` of the keys that at least ``min_docs`` different doc_ids hold, exactly counted; the largest one keeps its lines."""
    # The ids that a posting adds to a count up to min_docs, the largest first: a hot key is some rows a batch.
    few = F.slice(F.sort_array(F.array_distinct("doc_ids"), asc=False), 1, min_docs)
    held = suspected.select("key", "high", F.explode(few).alias("doc_id")).distinct()
    return held.groupBy("key", "high").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")


def drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, dropped)``: for each document that loses lines, the digests of their keys, 16 bytes each."""
    found = written(postings(docs, min_chars), "postings")
    suspected = written(found.join(suspects(found, min_docs), "key", "left_semi"), "suspected")
    losing = suspected.join(repeated_keys(suspected, min_docs), ["key", "high"]).select("key", "high", "keeper", F.explode("doc_ids").alias("doc_id"))
    losing = losing.where(F.coalesce(F.col("doc_id") != F.col("keeper"), F.lit(True)))
    digest = F.unhex(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("key"), 16, "0")))
    return losing.groupBy("doc_id").agg(F.collect_set(digest).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)`` with repeated lines gone from ``text``, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of at least ``min_chars`` code points that
    at least ``min_docs`` different doc_ids hold stay in the largest of these ids only. A null text is one empty line.
    Rows of one doc_id are one document, null ids too (the least id there is). No rows give no rows; the names ``n_lines``,
    ``n_dropped`` and ``text`` are replaced, other columns stay.
    """
    lost = drops(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "_lost_id", "dropped": "_dropped_keys"})
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    joined = docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("_lost_id")), "left").drop("_lost_id")
    kept_schema = joined.drop("_dropped_keys", "text").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            digests, long, parents, flat, counts = line_keys(texts, min_chars)
            gone = np.zeros(len(flat), dtype=bool)
            listed = batch.column("_dropped_keys")
            sets = [None if held is None else set(held) for held in listed.to_pylist()]
            raw = digests.astype(">u8").tobytes()
            for k, (line, row) in enumerate(zip(long.tolist(), parents[long].tolist())):
                if sets[row] is not None and raw[16 * k:16 * k + 16] in sets[row]:
                    gone[line] = True
            stay = np.flatnonzero(~gone)
            sizes = np.bincount(parents[stay], minlength=len(texts))
            offsets = pa.array(np.append(0, np.cumsum(sizes)), type=pa.int32())
            kept = pc.binary_join(pa.ListArray.from_arrays(offsets, flat.take(pa.array(stay))), "\n")
            counts = counts.cast(pa.int64())
            columns = [batch.column(c) for c in rest] + [kept, counts, pc.subtract(counts, pa.array(sizes, type=pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, kept_schema)
