"""Substring dedup: MinHash bands over paragraphs, exact verification, removals by component; and every long equal run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from filingdelta.llm.common import arrow_map, written
from filingdelta.llm.components import connected_components
from filingdelta.llm.wordscan import Scanner, mix

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
# A paragraph is a line. One of more words than this is cut where a 3-word hash is the least of its neighbours so many words to
# either side, so that copies of a part are cut alike wherever it stands.
LONG_WORDS, RADIUS, GRAM = 400, 100, 3
# Paragraphs of fewer words are turns of phrase: they are not compared, and no shorter stretch is reported.
MIN_WORDS = 15
# Of every ANCHOR-word gram window in PASSAGE words the least one is an anchor: a run of PASSAGE words holds one, in every copy
# the same, and no more than REACH words of the run lie before or behind it that another anchor of the run does not reach.
PASSAGE, ANCHOR = 51, 15
REACH = PASSAGE - ANCHOR
MARKS = 4
BLANK_BYTES = (9, 10, 11, 12, 13, 32)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, least_rows: int = 6, most_rows: int = 8) -> tuple[int, int]:
    """Bands and rows: fewest bands that reach the recall at the similarity with ``least_rows`` or more, then most rows."""
    for bands in range(1, 65):
        fitting = [rows for rows in range(least_rows, most_rows + 1) if 1 - (1 - similarity**rows) ** bands >= recall]
        if fitting:
            return bands, max(fitting)
    raise ValueError("no banding reaches the recall")


def _odd(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1)


def cut(hashes: np.ndarray, firsts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """First words of all paragraphs, given those of all ``lines``; local minima in long lines depend on the words nearby only."""
    n = len(hashes)
    sizes = np.diff(np.append(lines, n))
    long = np.flatnonzero(sizes > LONG_WORDS)
    if not len(long):
        return lines
    begins = np.zeros(n, dtype=bool)
    begins[lines] = True
    for k in long:
        low, high = lines[k], lines[k] + sizes[k]
        gram = np.zeros(high - low, dtype=np.uint64)
        for j in range(GRAM):
            gram[:high - low - j] += hashes[low + j:high] * _odd(j)
        gram = mix(gram)
        least = np.ones(high - low, dtype=bool)
        for j in range(1, RADIUS + 1):
            least[j:] &= gram[j:] < gram[:-j]
            least[:-j] &= gram[:-j] <= gram[j:]
        begins[low:high] |= least
    return np.flatnonzero(begins)


def line_starts(data: np.ndarray, starts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """First words of all lines that have words."""
    breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = breaks[1:] != breaks[:-1]
    new[firsts[:-1][np.diff(firsts) > 0]] = True
    return np.flatnonzero(new)


def anchors(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all anchors, and their hashes; texts of fewer than ``PASSAGE`` words have none."""
    n = len(hashes) - PASSAGE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = np.zeros(len(hashes) - ANCHOR + 1, dtype=np.uint64)
    for j in range(ANCHOR):
        gram += hashes[j:j + len(gram)] * _odd(j + 211)
    gram = mix(gram)
    least, at = gram[:n].copy(), np.arange(n)
    for j in range(1, REACH + 1):
        lower = gram[j:j + n] <= least
        least[lower] = gram[j:j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.unique(at[text[:n] == text[PASSAGE - 1:]])
    return at, gram[at]


def signatures(hashes: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of every paragraph's words in order, its band keys, and the ``MARKS`` * 64 bits that its shingles set."""
    n, sizes = len(hashes), np.diff(np.append(begins, len(hashes)))
    place = np.arange(n) - np.repeat(begins, sizes)
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _odd(91), dtype=np.uint64))
    whole = mix(np.add.reduceat(hashes * powers[place], begins) + sizes.astype(np.uint64))
    left = np.repeat(sizes, sizes) - place
    shingles = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        shingles[:n - j] += np.where(left[:n - j] > j, hashes[j:] * _odd(j + 7), np.uint64(0))
    # Shingles that would pass the paragraph's end count for nothing, unless it is shorter than one.
    real = (left >= SHINGLE) | (place == 0)
    keys = np.zeros((bands, len(begins)), dtype=np.uint64)
    for band in range(bands):
        for row in range(rows):
            turned = np.where(real, mix(shingles ^ _odd(101 + band * rows + row)), np.uint64(2**64 - 1))
            keys[band] = mix(keys[band] + np.minimum.reduceat(turned, begins) + np.uint64(band + 1))
    spread = mix(shingles)
    bits = np.where(real, np.uint64(1) << (spread >> np.uint64(58)), np.uint64(0))
    marks = [np.bitwise_or.reduceat(np.where(spread % np.uint64(MARKS) == k, bits, np.uint64(0)), begins) for k in range(MARKS)]
    return whole, keys, np.stack(marks)


def paragraphs(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(row, doc_id, level, no, start, stop, n_words, h, bands, marks, text)`` of ``docs(doc_id, text)``, places in code points.

    Level 1 has the paragraphs with their texts, those of at least ``MIN_WORDS`` words with band keys; level 2 the anchors, whose
    ``no`` is the number of their first word.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("nth", pa.int32()), ("level", pa.int32()), ("no", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("n_words", pa.int32()),
                        ("h", pa.int64()), ("bands", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        word_bytes = np.ones(256, dtype=bool)
        word_bytes[list(BLANK_BYTES)] = False
        scanner, seen = Scanner(word_bytes), 0
        for batch in batches:
            data, starts, stops, hashes, firsts = scanner.scan(batch.column("text"))
            base, seen = seen, seen + len(firsts) - 1
            if not len(hashes):
                continue
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            lengths = np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)
            offset = points[np.concatenate([[0], np.cumsum(lengths)[:-1]])]
            begins = cut(hashes, firsts, line_starts(data, starts, firsts))
            whole, keys, marks = signatures(hashes, begins, bands, rows)
            ends = np.append(begins[1:], len(hashes)) - 1
            # The last text that starts at a word owns it; empty texts before it own none.
            text = np.searchsorted(firsts, begins, side="right") - 1
            first = np.concatenate([[True], text[1:] != text[:-1]])
            place = np.arange(len(text))
            no = place - np.maximum.accumulate(np.where(first, place, 0))
            raw, own = data.tobytes(), np.flatnonzero(ends - begins + 1 >= MIN_WORDS)
            listed = np.zeros(len(begins) + 1, dtype=np.int32)
            listed[own + 1] = bands
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(text)), "nth": (base + text).astype(np.int32), "level": np.full(len(text), 1, dtype=np.int32), "no": no.astype(np.int32),
                "start": (points[starts[begins]] - offset[text]).astype(np.int32), "stop": (points[stops[ends]] - offset[text]).astype(np.int32),
                "n_words": (ends - begins + 1).astype(np.int32), "h": mix(whole + np.uint64(1)).view(np.int64),
                "bands": pa.ListArray.from_arrays(np.cumsum(listed, dtype=np.int32), np.ascontiguousarray(keys.T[own]).reshape(-1).view(np.int64)),
                "marks": pa.ListArray.from_arrays(np.cumsum(listed // bands * MARKS, dtype=np.int32), np.ascontiguousarray(marks.T[own]).reshape(-1).view(np.int64)),
                "text": [raw[x:y].decode() for x, y in zip(starts[begins].tolist(), stops[ends].tolist())],
            }
            at, h = anchors(hashes, firsts)
            text = np.searchsorted(firsts, at, side="right") - 1
            yield {
                "doc_id": batch.column("doc_id").take(pa.array(text)), "nth": (base + text).astype(np.int32), "level": np.full(len(at), 2, dtype=np.int32), "no": (at - firsts[text]).astype(np.int32),
                "start": (points[starts[at]] - offset[text]).astype(np.int32), "stop": (points[stops[at + ANCHOR - 1]] - offset[text]).astype(np.int32), "n_words": np.full(len(at), ANCHOR, dtype=np.int32),
                "h": mix(h + np.uint64(2)).view(np.int64), "bands": pa.nulls(len(at), pa.list_(pa.int64())), "marks": pa.nulls(len(at), pa.list_(pa.int64())), "text": pa.nulls(len(at), pa.string()),
            }

    sql = "doc_id long, nth int, level int, no int, start int, stop int, n_words int, h long, bands array<long>, marks array<long>, text string"
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = arrow_map(source, run, schema, sql)
    # A row of `docs` is its task and its place in it; both are fixed once the paragraphs are written.
    return found.withColumn("row", F.shiftleft(F.spark_partition_id().cast("long"), 32).bitwiseOR(F.col("nth").cast("long"))).drop("nth")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``alike`` to pairs ``(a, b)`` of paragraph hashes: exact Jaccard similarity of their shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alike", pa.bool_())])

    def shingles(text: str) -> set[tuple[str, ...]]:
        words = text.split(" ")
        return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                one, two = shingles(x), shingles(y)
                common = len(one & two)
                alike.append(common >= SIMILARITY * (len(one) + len(two) - common))
            yield {"a": batch.column("a"), "b": batch.column("b"), "alike": alike}

    joined = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b")
    return arrow_map(joined.select("a", "b", "ta", "tb"), run, schema, "a long, b long, alike boolean")


def may_be_alike(a: str, b: str) -> Column:
    """False only where the marks rule out the similarity.

    A bit that only one side sets stands for a shingle of that side alone: with x such bits of A, the common shingles are at most those of A
    less x, and all shingles are at least those of B and x.
    """
    def fits(one: str, two: str) -> Column:
        alone = reduce(add, [F.bit_count(F.col(f"{one}_marks")[k].bitwiseAND(F.bitwise_not(F.col(f"{two}_marks")[k]))) for k in range(MARKS)])
        least = reduce(add, [F.bit_count(F.col(f"{two}_marks")[k]) for k in range(MARKS)])
        return F.greatest(F.col(f"{one}_words") - SHINGLE + 1, F.lit(1)) - alone >= SIMILARITY * (least + alone)

    return fits(a, b) & fits(b, a)


def similar(units: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between hashes of different paragraphs that join all that collide in a band and are alike.

    A bucket's members are first held against the one that has the most copies, which joins nearly all of a group of near copies at
    one comparison per member. Members that this leaves outside that one's component are then held against all
    members of the bucket in other components that their marks do not rule out. Pairs inside a component need no test, so no
    link that would join two components is lost.
    """
    # Equal paragraphs are one: their bands and marks are the same.
    own = units.where((F.col("level") == 1) & (F.col("n_words") >= MIN_WORDS))
    copies = own.groupBy("h").agg(F.count("*").cast("int").alias("n"), F.first("bands").alias("bands"))
    keyed = copies.select("h", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.max(F.struct("n", "h")).alias("c"), F.count("*").alias("_m")).where("_m > 1").select("key", F.col("c.h").alias("a"))
    members = written(keyed.select("h", "key").join(buckets, "key").where("h <> a"), "members")
    wanted = written(members.select("h").union(members.select("a")).distinct(), "colliding")
    normal = F.array_join(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), " ")
    texts = own.select("h", "text", "marks", "n_words").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    texts = written(texts.select("h", normal.alias("text"), "marks", F.col("n_words").alias("words")), "texts")
    bound = lambda c: texts.select(F.col("h").alias(c), F.col("marks").alias(f"{c}_marks"), F.col("words").alias(f"{c}_words"))
    near = members.select("a", F.col("h").alias("b")).distinct().join(bound("a"), "a").join(bound("b"), "b").where(may_be_alike("a", "b")).select("a", "b")
    first = written(verified(near, texts).where("alike").select("a", "b"), "alike")
    placed = connected_components(first)
    root = lambda c: placed.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    held = members.join(root("h"), "h", "left").join(root("a"), "a", "left").select("key", "h", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("h_root", "h").alias("h_root"))
    held = written(held.join(bound("h"), "h"), "held")
    outside = held.where("h_root <> a_root").select(F.col("key").alias("f_key"), F.col("h").alias("f"), F.col("h_root").alias("f_root"), F.col("h_marks").alias("f_marks"), F.col("h_words").alias("f_words"))
    crossing = (F.col("f_key") == F.col("key")) & (F.col("f_root") != F.col("h_root")) & may_be_alike("f", "h")
    rest = outside.join(held, crossing).select(F.least("f", "h").alias("a"), F.greatest("f", "h").alias("b")).distinct()
    return first.unionByName(verified(rest, texts).where("alike").select("a", "b"))


def surroundings(held: DataFrame, units: DataFrame) -> DataFrame:
    """Adds to repeated anchors the 32-bit hashes of up to ``REACH`` words before (nearest first) and behind, and where these start and stop, from the anchor's place."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("class", pa.int64()), ("removed", pa.int32()), ("place", pa.int32()), ("left", ints), ("right", ints), ("starts", ints), ("stops", ints)])

    def lists(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, step: int, less: np.ndarray | int = 0) -> pa.ListArray:
        """``sizes[k]`` values from ``begins[k]`` on, forwards or backwards, each less ``less[k]``."""
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        chosen = values[np.repeat(begins, sizes) + step * inside] - (np.repeat(less, sizes) if isinstance(less, np.ndarray) else less)
        return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), chosen.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        word_bytes = np.ones(256, dtype=bool)
        word_bytes[list(BLANK_BYTES)] = False
        scanner = Scanner(word_bytes)
        for batch in batches:
            n_found, n_parts = (np.asarray(pc.list_value_length(batch.column(c)), dtype=np.int64) for c in ("found", "parts"))
            (no, classes, removed), (_, begin, text) = (batch.column(c).flatten().flatten() for c in ("found", "parts"))
            data, starts, stops, hashes, firsts = scanner.scan(text)
            hashes = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            # From bytes to code points of the document.
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32))
            lengths = np.asarray(pc.binary_length(text), dtype=np.int64)
            shift = np.repeat(np.asarray(begin, dtype=np.int64) - points[np.cumsum(lengths) - lengths], np.diff(firsts))
            starts, stops = points[starts] + shift, points[stops] + shift
            of_row = firsts[np.append(0, np.cumsum(n_parts))]
            rows, numbers = np.repeat(np.arange(len(n_found)), n_found), np.asarray(no, dtype=np.int64)
            for k in range(0, len(rows), 10_000):
                own = rows[k:k + 10_000]
                at = of_row[own] + numbers[k:k + 10_000]
                end = at + ANCHOR
                before, behind = np.minimum(numbers[k:k + 10_000], REACH), np.minimum(of_row[own + 1] - end, REACH)
                yield {
                    "row": batch.column("row").take(pa.array(own)), "doc_id": batch.column("doc_id").take(pa.array(own)), "no": no[k:k + 10_000], "class": classes[k:k + 10_000], "removed": removed[k:k + 10_000],
                    "place": starts[at].astype(np.int32), "left": lists(hashes, at - 1, before, -1), "right": lists(hashes, end, behind, 1),
                    "starts": lists(starts, at, before + 1, -1, starts[at]), "stops": lists(stops, end - 1, behind + 1, 1, starts[at]),
                }

    found = held.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("no", "class", "removed")).alias("found"))
    parts = units.where("level = 1").join(held.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "start", "text"))).alias("parts"))
    sql = "row long, doc_id long, no int, class long, removed int, place int, left array<int>, right array<int>, starts array<int>, stops array<int>"
    return arrow_map(found.join(parts, "row").select("row", "doc_id", "found", "parts"), run, schema, sql)


def exact_stretches(held: DataFrame, units: DataFrame) -> DataFrame:
    """Repeated anchors ``held`` extended word by word as far as another of their class goes along; the long ones, overlaps as one.

    In the order of the words on one side, the member that goes along furthest stands next to it, so no pairs are formed.
    """
    def shared(words: str, other: Column) -> Column:
        at = F.array_position(F.zip_with(words, other, lambda x, y: x.eqNullSafe(y)), F.lit(False))
        return F.when(other.isNull(), 0).when(at == 0, F.size(words)).otherwise(at - 1).cast("int")

    def furthest(words: str) -> Column:
        order = Window.partitionBy("class").orderBy(words)
        return F.greatest(shared(words, F.lag(words).over(order)), shared(words, F.lead(words).over(order)))

    found = surroundings(held, units).withColumn("to_left", furthest("left")).withColumn("to_right", furthest("right"))
    found = found.select("row", "doc_id", "class", "removed", (F.col("no") - F.col("to_left")).alias("first"), (F.col("no") + ANCHOR + F.col("to_right")).alias("end"),
                         (F.col("place") + F.get("starts", F.col("to_left"))).alias("start"), (F.col("place") + F.get("stops", F.col("to_right"))).alias("stop")).where(F.col("end") - F.col("first") >= PASSAGE)
    by_row = Window.partitionBy("row").orderBy("first", "end")
    reached = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce((F.col("first") > reached).cast("int"), F.lit(1)))
    found = found.withColumn("stretch", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return found.groupBy("row", F.lit(2).alias("level"), "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("first")).cast("long").alias("n_words"),
        F.min("class").alias("class_id"), F.sum("removed").cast("long").alias("removed"), F.count("*").alias("n_paragraphs"))


def firsts_marked(held: DataFrame) -> DataFrame:
    """Members of classes of several with ``removed``: 0 for the first by doc_id, row and number, 1 for the others."""
    known = F.coalesce("doc_id", F.lit(-(1 << 63)))
    many = held.groupBy("class").agg(F.count("*").alias("n"), F.min(known).alias("first_doc")).where("n > 1").drop("n")
    members = written(held.join(many, "class"), "repeats")
    own = members.where(known == F.col("first_doc")).groupBy("class").agg(F.min(F.struct("row", "no")).alias("first"))
    return written(members.join(own, "class").withColumn("removed", (F.struct("row", "no") != F.col("first")).cast("int")).drop("first", "first_doc"), "held-repeats")


def islands(members: DataFrame) -> DataFrame:
    """Members with ``stretch``: the same for paragraphs that follow each other in a row."""
    return members.withColumn("stretch", F.col("no") - F.row_number().over(Window.partitionBy("row").orderBy("no")))


def reported(paragraphs: DataFrame, members: DataFrame) -> DataFrame:
    """``(row, s, e)``: where paragraphs of several follow each other, with up to three short lines (under ``PASSAGE`` words) between them."""
    ours = members.select("row", "no", F.lit(True).alias("ours"))
    rows = paragraphs.join(members.select("row").distinct(), "row", "left_semi").join(ours, ["row", "no"], "left")
    by_row = Window.partitionBy("row").orderBy("no")
    single = F.col("ours").isNull() & (F.col("n_words") >= MIN_WORDS)
    kept = rows.withColumn("part", F.sum(single.cast("int")).over(by_row)).where("ours")
    by_part = Window.partitionBy("row", "part").orderBy("no")
    new = F.coalesce((F.col("no") - F.lag("no").over(by_part) > 4).cast("int"), F.lit(1))
    return kept.withColumn("new", new).withColumn("island", F.sum("new").over(by_part)).groupBy("row", "part", "island").agg(F.min("start").alias("s"), F.max("stop").alias("e"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Stretches of ``docs(doc_id, text)`` that repeat across or inside documents: one row per stretch.

    Columns: row, doc_id, level, start, stop (code points), n_words, class_id (the least class of its paragraphs), removed
    (paragraphs of the stretch that are not the first of their class), n_paragraphs. Paragraphs (level 1) are lines, long ones in parts;
    they are equal, or similar by at least ``SIMILARITY`` on five-word shingles, directly or over others. Level 2 has every run of at
    least ``PASSAGE`` equal words, wherever it stands, to the word; runs that overlap or touch are one stretch. Anchors inside paragraphs
    of level 1, or between two such with a few short lines only, take no part: these are reported as a whole. The first of a class, by doc_id and place, stays. Paragraphs
    of fewer than ``MIN_WORDS`` words count in runs only. Null or empty texts have none; repeated rows repeat each other; a null
    doc_id comes first. Other columns are not read.
    """
    bands, rows = tune_bands()
    units = written(paragraphs(docs, bands, rows), "paragraphs")
    classes = connected_components(similar(units))
    slim = units.select("row", "doc_id", "level", "no", "start", "stop", "n_words", "h")
    lines = slim.where((F.col("level") == 1) & (F.col("n_words") >= MIN_WORDS)).join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("root", "h")).drop("root")
    lines = firsts_marked(lines)
    found = islands(lines).groupBy("row", "level", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n_words").cast("long").alias("n_words"),
        F.min("class").alias("class_id"), F.sum("removed").cast("long").alias("removed"), F.count("*").alias("n_paragraphs"))
    covered = reported(slim.where("level = 1"), lines).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("covered"))
    marks = slim.where("level = 2").withColumn("class", F.col("h"))
    often = marks.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    loose = marks.join(often, "class", "left_semi").join(covered, "row", "left")
    inside = F.exists("covered", lambda c: (c["s"] <= F.col("start")) & (c["e"] >= F.col("stop")))
    # A run goes on in all its copies: an anchor stays where it is loose in one of them.
    loose = written(loose.withColumn("loose", ~F.coalesce(inside, F.lit(False))).drop("covered"), "anchors")
    kept = loose.join(loose.where("loose").select("class").distinct(), "class", "left_semi").drop("loose")
    exact = exact_stretches(firsts_marked(kept), units)
    return found.where(F.col("n_words") >= MIN_WORDS).unionByName(exact).drop("stretch")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, without the paragraphs that repeat an earlier one; the line break behind them goes as well.

    Of a class the first paragraph by doc_id and place stays. Rows of one doc_id are told apart by their texts; equal rows are
    treated alike, so the paragraph stays in each of them where it stays in one. Null texts stay null. Runs that are no paragraphs, and
    parts of long lines, are reported only.
    """
    bands, rows = tune_bands()
    units = written(paragraphs(docs, bands, rows), "paragraphs")
    classes = connected_components(similar(units))
    lines = units.select("row", "doc_id", "level", "no", "n_words", "h", "text").where((F.col("level") == 1) & (F.col("n_words") >= MIN_WORDS))
    lines = firsts_marked(lines.join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("class", F.coalesce("root", "h")).drop("root"))
    stays = lines.where("removed = 0").select("doc_id", "h").distinct().withColumn("_stays", F.lit(True))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))
    gone = lines.select("doc_id", "h", "text").distinct().join(stays.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "_stays"), same, "left").where("_stays IS NULL")
    listed = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("text").alias("_gone"))
    # Paragraphs are told by their words in lower case, as they were compared.
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    own = lambda line: F.translate(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), letters, letters.lower())
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line: ~F.array_contains(F.col("_gone"), own(line))), "\n")
    joined = docs.join(listed, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("text", F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def by_document(passages: DataFrame) -> DataFrame:
    """``(doc_id, n_passages, n_removed, class_id, passages)``: one row per document that has repeated passages.

    ``passages`` lists ``start:stop`` in order, paragraphs and parts of them; ``class_id`` is the least class of its passages, in hexadecimal.
    """
    found = passages.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n_passages"), F.sum("removed").alias("n_removed"), F.min("class_id").alias("class_id"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("all"))
    return found.select("doc_id", "n_passages", "n_removed", F.lower(F.lpad(F.hex("class_id"), 16, "0")).alias("class_id"),
                        F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("passages"))
