"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from filingdelta.llm.common import arrow_map
from filingdelta.llm.wordscan import Scanner

WINDOW, CONTAMINATED_SHARE = 13, 20
# Words of test items that one pass over the documents holds; a larger benchmark takes several passes.
BLOCK_WORDS = 4_000_000


def word_bytes() -> np.ndarray:
    """Bytes of words: digits, a-z and every byte of a character beyond ASCII (A-Z are lowered before)."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table


@dataclass
class TestBlock:
    """Test items as numbers of their distinct words, each item followed by a zero."""

    items: list[str]
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    words: list[bytes]


def make_block(rows: list[tuple[str, str]]) -> TestBlock | None:
    """The block of ``(item_id, text)``; items without words are left out."""
    data, starts, stops, hashes, firsts = Scanner(word_bytes()).scan(pa.array([t for _, t in rows], type=pa.string()))
    counts = np.diff(firsts)
    if not counts.sum():
        return None
    vocabulary, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    words = [data[starts[k]:stops[k]].tobytes() for k in first]
    if len({data[a:b].tobytes() for a, b in zip(starts, stops)}) != len(words):
        raise ValueError("two test words have one hash")
    held = np.flatnonzero(counts)
    shift = np.cumsum(counts > 0) - (counts > 0)
    tokens = np.zeros(len(hashes) + len(held), dtype=np.int64)
    tokens[np.arange(len(hashes)) + np.repeat(shift, counts)] = numbers + 1
    return TestBlock([rows[k][0] for k in held], tokens, firsts[:-1][held] + shift[held], counts[held], vocabulary, words)


def test_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """The test items in blocks of a bounded number of words, one block at a time on the driver."""
    rows, size = [], 0
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
        if size >= block_words:
            if block := make_block(rows):
                yield block
            rows, size = [], 0
    if rows and (block := make_block(rows)):
        yield block


class Shard:
    """A suffix array over the words of some documents.

    Words that no test item has are zeros, where every match ends, and so is the end of a document. Stretches between
    zeros that are shorter than the shortest window hold no match and are left out. The order is exact up to the
    longest test item's length, beyond which no comparison goes: packed words first, then doubling among suffixes still tied.
    """

    def __init__(self, tokens: np.ndarray, n_words: int, shortest: int, longest: int):
        self.tokens = np.concatenate([tokens, np.zeros(1, dtype=np.int64)])
        zeros = np.flatnonzero(self.tokens == 0)
        gaps = np.diff(zeros, prepend=-1) - 1
        # Per suffix: words up to the next zero, for suffixes in stretches that are long enough.
        kept = np.repeat(gaps >= shortest, gaps + 1) & (self.tokens > 0)
        at = np.flatnonzero(kept)
        left = zeros[np.searchsorted(zeros, at)] - at
        bits = int(n_words).bit_length()
        height = max(1, 62 // bits)
        key = np.zeros(len(at), dtype=np.int64)
        for j in range(height):
            key = (key << bits) | np.where(left > j, self.tokens[np.minimum(at + j, len(self.tokens) - 1)], 0)
        order = np.argsort(key, kind="stable")
        at, key, left = at[order], key[order], left[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank = np.zeros(len(self.tokens), dtype=np.int64)
        while len(at):
            place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            rank[at] = place + 1
            alone = new & np.append(new[1:], True)
            k = np.flatnonzero(~alone & (left >= height))
            if height >= longest or not len(k):
                break
            behind = rank[at[k] + height]
            order = np.lexsort((behind, place[k]))
            behind, places = behind[order], place[k][order]
            at[k], left[k] = at[k][order], left[k][order]
            new[k[1:]] |= (places[1:] != places[:-1]) | (behind[1:] != behind[:-1])
            height *= 2
        self.suffixes = at

    def search(self, block: TestBlock, window: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Binary search of all test suffixes, one word further each round, while their range is not empty.

        Yields ``(depth, item, start, low, high)`` of the suffixes that match at this depth.
        """
        item = np.repeat(np.arange(len(block.items)), block.lengths)
        start = np.arange(len(item)) - np.repeat(np.cumsum(block.lengths) - block.lengths, block.lengths)
        low, high = np.zeros(len(item), dtype=np.int64), np.full(len(item), len(self.suffixes), dtype=np.int64)
        depth = 0
        while len(item):
            word = block.tokens[block.starts[item] + start + depth]
            low, high = self._bound(low, high, depth, word), self._bound(low, high, depth, word + 1)
            depth += 1
            met = low < high
            item, start, low, high = item[met], start[met], low[met], high[met]
            yield depth, item, start, low, high
            more = start + depth < block.lengths[item]
            item, start, low, high = item[more], start[more], low[more], high[more]

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """First suffix of each range whose word at ``depth`` is not below ``word``."""
        low, high = low.copy(), high.copy()
        last = len(self.tokens) - 1
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            below = self.tokens[np.minimum(self.suffixes[np.minimum(middle, len(self.suffixes) - 1)] + depth, last)] < word
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and the range each comes from."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - low, sizes), owner


def _shard(block: TestBlock, scanner: Scanner, texts: pa.StringArray, window: int) -> tuple[Shard, np.ndarray]:
    """The shard of some texts and the place of every text's first word in it."""
    data, starts, stops, hashes, firsts = scanner.scan(texts)
    number = np.searchsorted(block.hashes, hashes)
    known = block.hashes[np.minimum(number, len(block.hashes) - 1)] == hashes
    number = np.where(known, number + 1, 0)
    counts = np.diff(firsts)
    tokens = np.zeros(len(hashes) + len(counts), dtype=np.int64)
    places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    tokens[places] = number
    while True:
        shard = Shard(tokens, len(block.hashes), int(np.minimum(block.lengths, window).min()), int(block.lengths.max()))
        # A hash only proposes a word: what entered the array is compared byte by byte.
        words = np.searchsorted(places, shard.suffixes)
        wrong = [w for w in words.tolist() if data[starts[w]:stops[w]].tobytes() != block.words[number[w] - 1]]
        if not wrong:
            return shard, firsts[:-1] + np.arange(len(counts))
        tokens[places[wrong]] = 0


def _hits(block: TestBlock, scanner: Scanner, texts: pa.StringArray, window: int) -> tuple[np.ndarray, list[list[list[int]]], list[list[str]]]:
    """Per text: number of words, stretches of hit words, and items with a window in it."""
    shard, firsts = _shard(block, scanner, texts, window)
    n_words = np.diff(np.append(firsts, len(shard.tokens) - 1)) - 1
    edge = np.zeros(len(shard.tokens) + 1, dtype=np.int64)
    pairs = [np.zeros(0, dtype=np.int64)]
    widths = np.minimum(block.lengths, window)
    for depth, item, start, low, high in shard.search(block, window) if len(shard.suffixes) else ():
        full = widths[item] == depth
        if full.any():
            at, owner = ranges(low[full], high[full])
            places = shard.suffixes[at]
            np.add.at(edge, places, 1)
            np.add.at(edge, places + depth, -1)
            text = np.searchsorted(firsts, places, side="right") - 1
            pairs.append(np.unique(text * len(block.items) + item[full][owner]))
        if depth >= window:
            break
    inside = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    spans, found = [[] for _ in firsts], [[] for _ in firsts]
    for a, b in zip(turns[::2], turns[1::2]):
        k = int(np.searchsorted(firsts, a, side="right")) - 1
        spans[k].append([int(a - firsts[k]), int(b - firsts[k])])
    for pair in np.unique(np.concatenate(pairs)):
        found[pair // len(block.items)].append(block.items[pair % len(block.items)])
    return n_words, spans, found


SPAN = pa.list_(pa.list_(pa.int32()))


def _merged(spans: str) -> Column:
    """Stretches in order, those of several blocks that overlap or touch joined in one pass."""
    def add(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), s[1]))))
        return F.when((F.size(acc) > 0) & (F.get(last, F.lit(1)) >= s[0]), longer).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<array<int>>"), add)


def with_windows(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with ``n_words``, ``spans`` and ``items`` against ``items(item_id, text)``.

    ``spans`` are the stretches ``[first, end)`` of words inside occurrences of test windows, disjoint and in order, ``items``
    the ids (as strings, sorted, once each) of items with an occurring window. A window is ``window`` consecutive words
    of an item, or the whole of a shorter one. Null texts have no words; items without id or words match nothing;
    repeated rows and items with equal texts each count; no column of ``docs`` can clash. Documents are never split and
    never shuffled: each Arrow batch is a shard with a suffix array of its own, and blocks of test items are sent to it one
    after the other.
    """
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast("long").alias("n_words"),
                      F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = to_arrow_schema(out.schema)

    def step(sent) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            scanner, block = Scanner(word_bytes()), TestBlock(**sent.value)
            for batch in batches:
                rows = batch.column("row")
                n_words, spans, found = _hits(block, scanner, rows.field("text").fill_null(""), window)
                yield {
                    "row": rows, "n_words": n_words,
                    "spans": [a + b for a, b in zip(batch.column("spans").to_pylist(), spans)],
                    "items": [a + b for a, b in zip(batch.column("items").to_pylist(), found)],
                }

        return arrow_map(out, run, schema, out.schema)

    blocks = 0
    for block in test_blocks(items, block_words):
        out, blocks = step(spark.sparkContext.broadcast(vars(block))), blocks + 1
    if not blocks:
        empty = TestBlock(["-"], np.array([1, 0]), np.array([0]), np.array([1]), np.array([0], dtype=np.uint64), [b"\0"])
        out = step(spark.sparkContext.broadcast(vars(empty)))
    spans = _merged("spans") if blocks > 1 else F.col("spans")
    return out.select("row", "n_words", spans.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def find_windows(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` of ``with_windows``, one row per row of ``docs(doc_id, text)``."""
    found = with_windows(spark, docs.select("doc_id", "text"), items, window, block_words)
    return found.select("row.doc_id", "n_words", "spans", "items")


def clean_rows(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = with_windows(spark, docs, items, window)
    return found.where(~contaminated(n_hit("spans"), F.col("n_words"))).select("row.*")


def n_hit(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(hits: Column, n_words: Column) -> Column:
    """Whether test windows cover a twentieth of the words or more."""
    return (hits > 0) & (CONTAMINATED_SHARE * hits >= n_words)


def longest_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, min_words: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(item_id, start, length, doc_id, word)``: per test suffix, its longest verbatim match of at least ``min_words`` words.

    One place is given, the least ``(doc_id, word)`` among those of the greatest length. Each shard reports the longest range of
    its suffix array per suffix; the best of all shards is a grouped maximum.
    """
    schema = pa.schema([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []

    def step(sent) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            scanner, block = Scanner(word_bytes()), TestBlock(**sent.value)
            for batch in batches:
                shard, firsts = _shard(block, scanner, batch.column("text"), min_words)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                for depth, item, start, low, high in shard.search(block, min_words) if len(shard.suffixes) else ():
                    if depth >= min_words:
                        best |= {(i, s): (depth, a, b) for i, s, a, b in zip(item.tolist(), start.tolist(), low.tolist(), high.tolist())}
                ids = batch.column("doc_id").to_pylist()
                out = []
                for (i, s), (depth, a, b) in best.items():
                    places = shard.suffixes[a:b]
                    text = np.searchsorted(firsts, places, side="right") - 1
                    out.append(min(((block.items[i], s, depth, ids[t], int(p - firsts[t])) for p, t in zip(places, text)), key=lambda x: (x[3] is None, x[3] or 0, x[4])))
                yield {n: [r[k] for r in out] for k, n in enumerate(schema.names)}

        return arrow_map(rows, run, schema, "item_id string, start long, length long, doc_id long, word long")

    for block in test_blocks(items, block_words):
        parts.append(step(spark.sparkContext.broadcast(vars(block))))
    if not parts:
        return spark.createDataFrame([], "item_id string, start long, length long, doc_id long, word long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = found.groupBy("item_id", "start").agg(F.min(F.struct((-F.col("length")).alias("minus"), "doc_id", "word")).alias("b"))
    return best.select("item_id", "start", (-F.col("b.minus")).alias("length"), "b.doc_id", "b.word")
