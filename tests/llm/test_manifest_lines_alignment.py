"""Merkle manifest, line dedup and tokenizer alignment against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filingdelta.llm import align, linededup, merkle
from filingdelta.llm.common import prepare

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return tuple((x is not None, x) for x in row)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, rank string, digest int"


def manifest_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice(["web", "é", None, ""]), rng.choice(["en", "en", "en", "fr", "de", "", None]), rng.choice([None, 1, 70]), rng.choice([None, "", "a:b", "é🎉" * 9])) for i in range(300)]
    rows += [(7, "web", "en", 1, "same"), (7, "web", "en", 1, "same"), (None, None, "xx", None, None), (None, "a", "fr", 2, "t"), (-3, "a", "zz", 2, "x" * 30_000)]
    rng.shuffle(rows)
    return rows


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    for level in levels[:-1]:
        yield i & 1, level[i ^ 1] if (i ^ 1) < len(level) else None
        i >>= 1


def plain_manifest(rows, tampered):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: ((r[0] is not None, r[0] or 0), plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]])
    top, out = plain_tree([trees[n][-1][0] for n in names]), []
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = [*plain_path(trees[name], i), *plain_path(top, g)]
            changed = tampered(row[0]) and row[3] is not None
            node = plain_leaf((*row[:3], row[3] + 1, row[4])) if changed else plain_leaf(row)
            for right, other in path:
                node = sha(node) if other is None else sha(other + node) if right else sha(node + other)
            root = top[-1][0]
            out.append((row[0], plain_leaf(row), trees[name][-1][0], root, sha("".join(o for _, o in path if o)), node, node == root))
    return out


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_manifest(spark, height):
    prepare(spark)
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS)
    leaves = merkle.document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    got = merkle.verify(merkle.make_manifest(leaves, height), "present").collect()
    expected = plain_manifest(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1])
def test_manifest_of_few_rows(spark, n):
    docs = spark.createDataFrame([(1, None, None, None, None, "", 0)][:n], FIELDS)
    got = merkle.verify(merkle.make_manifest(merkle.document_leaves(docs))).collect()
    leaf = plain_leaf((1, None, None, None, None))
    assert list(map(tuple, got)) == [(1, leaf, leaf, leaf, sha(""), leaf, True)][:n]


@pytest.mark.parametrize("height", range(11))
def test_layout_is_recursive(height):
    """All slots are used once, and every lower subtree of a cut at half height is contiguous."""
    slots = merkle.slots(height)
    assert sorted(np.concatenate(slots)) == list(range((2 << height) - 1))
    upper = (height + 1) // 2
    if upper:
        low = np.concatenate([s[:len(s) >> upper] for s in slots[upper:]])
        assert sorted(low) == list(range((1 << upper) - 1, (1 << upper) - 1 + len(low)))


# Line dedup

LINE_DOCS = "doc_id long, text string, n_lines int, key string, dropped string"
LINE = "This line stands in many documents."


def line_rows():
    rng = random.Random(5)
    words = [f"Wörter number {k} of the list" for k in range(40)]
    rows = [(i, "\n".join(rng.choice([*words[:k % 40 + 1], LINE, "short", "", f"only here {i} {k} and nowhere"]) for k in range(rng.randrange(1, 30)))) for i in range(120)]
    rows += [(i, LINE) for i in range(200, 1400)]
    rows += [(1399, "\t " + LINE.upper() + "\r\n" + LINE), (1398, LINE + "\n\n" + LINE), (None, None), (None, LINE), (1500, ""), (1501, "\n"), (5, "x" * 19 + "\n" + "y" * 20), (6, "Y" * 20), (6, "y" * 20)]
    # Held by three documents, by two, by rows of two ids only, by an id and no id.
    rows += [(1600 + k, "three documents hold this") for k in range(3)] + [(1610 + k, "two documents hold this line") for k in range(2)]
    rows += [(1620 + k % 2, "rows of two ids hold this line") for k in range(6)] + [(None, "and no id is an id as well"), (1630, "and no id is an id as well"), (1631, "and no id is an id as well")]
    return rows + [(7, "\n".join(f"line {k} of a very long document" for k in range(20_000)))]


def plain_lines(rows, min_chars, min_docs):
    stripped = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(stripped(line)) >= min_chars:
                holders[stripped(line)].add(doc_id)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if stripped(x) not in keeper or keeper[stripped(x)] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("min_chars,min_docs", [(20, 3), (1, 2), (20, 5)])
def test_lines(spark, min_chars, min_docs):
    prepare(spark)
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 9, "k", "d") for i, t in rows], LINE_DOCS)
    kept = linededup.drop_repeated_lines(docs, min_chars, min_docs)
    assert set(kept.columns) == {*docs.columns, "n_dropped"} and {(r.key, r.dropped) for r in kept.collect()} == {("k", "d")}
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in kept.collect()]
    assert sorted(got, key=key) == sorted(plain_lines(rows, min_chars, min_docs), key=key)
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_filters_lose_no_repeat():
    """Filled far beyond their size they tell too much, never too little."""
    rng = np.random.default_rng(1)
    for size, unsure in ((100, True), (20_000, False)):
        filters, seen, told = linededup.SeenTwice(size, 3), Counter(), set()
        for _ in range(40):
            keys = np.unique(rng.zipf(1.2, 800).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            told |= set(filters.add(keys, np.ones(len(keys), dtype=np.int64)).tolist())
            seen.update(keys.tolist())
        often = {k for k, n in seen.items() if n >= 3}
        assert often <= told and (unsure or len(told - often) < 0.01 * len(seen))


# Tokenizer alignment

TEXTS = [
    (1, "Hello  world, don't stop"), (2, None), (3, ""), (4, " \n\t "), (5, "a▁b"), (6, "日本語 🎉🎉 é<|endoftext|></s><s>\n\n <0x41>"), (7, "x" * 3000 + " y " * 2000),
    (8, "the the the cat"), (8, "the the the cat"), (None, "no id"), (9, "İ ſ ﷺ \x00\x01 "), (10, "́é 1234567 ++==--"), (11, " " * 999),
]


def plain_alignment(rows):
    first, second = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a_bytes = lambda i: bytes(letters[c] for c in first.id_to_token(i))

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) and second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append((doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(a_bytes(i)) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        shared = sorted(set(ends_a) & set(ends_b))
        links = [(i, j) for i, x in zip(a, ends_a) for j in [dict(zip(ends_b, b)).get(x)] if j is not None] if len(a) < 500 else [(dict(zip(ends_a, a))[x], j) for j, x in zip(b, ends_b) if x in set(shared)]
        groups, before = [], 0
        for end in shared:
            groups.append(",".join(str(i) for i, x in zip(a, ends_a) if before < x <= end) + "|" + ",".join(str(i) for i, x in zip(b, ends_b) if before < x <= end))
            before = end
        counts.update(links)
        docs.append((doc_id, a, b, groups, links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(i, len(a), len(b), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(";".join(g)) if a else "") for i, a, b, g, links in docs]


def test_alignment(spark, monkeypatch):
    prepare(spark)
    short = [(i, t) for i, t in TEXTS if i != 7] + [(7, "x" * 300 + " y " * 100)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in short], "doc_id long, text string, code int, block int")
    found = align.align_tokenizers(spark, docs, BYTE_LEVEL, PIECES)
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got == sorted(plain_alignment(short), key=key)
    assert {r[0] for r in got if r[1] == 0} >= {2, 3, 5}
    assert align.align_tokenizers(spark, docs.limit(0), BYTE_LEVEL, PIECES).count() == 0


def test_alignment_of_given_texts(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").where(F.length("text") < 2000).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = align.align_tokenizers(prepare(spark), docs, BYTE_LEVEL, PIECES)
    assert sorted(map(tuple, found.collect())) == sorted(plain_alignment(rows))


def test_alignment_of_long_texts(spark):
    """Runs without a blank, blanks only and one long document end in time and keep all tokens."""
    rows = [(1, "a" * 300_000), (2, " " * 300_000), (3, " ".join(f"w{k % 991}" for k in range(60_000)))]
    first, second = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = align.align_tokenizers(spark, spark.createDataFrame(rows, "doc_id long, text string"), BYTE_LEVEL, PIECES)
    got = {r.doc_id: (r.n_a, r.n_b) for r in found.collect()}
    assert got == {i: (len(first.encode(" " + t).ids), len(second.encode(t))) for i, t in rows}
