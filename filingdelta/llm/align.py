"""Alignment of two tokenizers over the same texts: shared token ends, linked ids, corpus-wide counts of id pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from filingdelta.llm.bpe import SPLIT, byte_letters, read_vocabulary
from filingdelta.llm.common import arrow_map, written

SPACE_MARK = "▁"
# Bytes of text that a block of documents ends after, and that are encoded at a time.
BLOCK_BYTES, ENCODED_BYTES = 1 << 20, 1 << 18


class ByteLevel:
    """A byte-level vocabulary file; special tokens' strings are plain text."""

    def __init__(self, data: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        model, letters = json.loads(data)["model"], byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.size = max(model["vocab"].values()) + 1
        table = [b""] * self.size
        for token, i in ids.items():
            table[i] = token
        self.table = pa.array(table, type=pa.binary())
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        # Where ids follow the merges' ranks the faster library gives the same ids.
        if merged == sorted(merged) and len(ids) == len(model["vocab"]):
            self.fast, self.library = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={}), None
        else:
            self.library = Tokenizer.from_buffer(data)
            self.library.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + text for text in texts]
        if self.library is None:
            return [self.fast.encode_ordinary(text) for text in spaced]
        return [coded.ids for coded in self.library.encode_batch(spaced, add_special_tokens=False)]


class Pieces:
    """A piece model with byte fallback; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.library.get_piece_size()
        self.table = pa.array([self._bytes(i) for i in range(self.size)], type=pa.binary())

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        if self.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def encoded(tokenizer: ByteLevel | Pieces, texts: list[str]) -> pa.ListArray:
    """The ids of each text; an empty text has none."""
    sizes, parts = [0], []
    held: list[str] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= ENCODED_BYTES or k == len(texts) - 1:
            for text_, ids in zip(held, tokenizer.encode(held)):
                ids = ids if text_ else []
                sizes.append(len(ids))
                parts.append(np.array(ids, dtype=np.int32))
            held, size = [], 0
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), type=pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def without(lists: pa.ListArray, bad: np.ndarray) -> pa.ListArray:
    """The lists, emptied where ``bad``."""
    sizes = np.where(bad, 0, pc.list_value_length(lists).to_numpy())
    stay = np.flatnonzero(~bad[pc.list_parent_indices(lists).to_numpy()])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), type=pa.int32()), pc.list_flatten(lists).take(pa.array(stay)))


def token_bytes(lists: pa.ListArray, table: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The bytes of all tokens of a batch, and where each text's begin and end among them."""
    held = table.take(pc.list_flatten(lists))
    ends = np.append(0, np.cumsum(pc.binary_length(held).to_numpy(zero_copy_only=False), dtype=np.int64))
    return held, ends[lists.offsets.to_numpy()]


def differs(lists: pa.ListArray, table: pa.Array, texts: list[str]) -> np.ndarray:
    """Texts whose tokens do not join to a space and the text."""
    held, at = token_bytes(lists, table)
    # The tokens' bytes lie side by side.
    joined = held.buffers()[2].to_pybytes() if len(held) else b""
    return np.array([joined[a:b] != (b" " + text.encode() if text else b"") for text, a, b in zip(texts, at[:-1], at[1:])], dtype=bool)


def token_table(lists: pa.ListArray, table: pa.Array, name: str) -> pa.Table:
    """One row a token: its text (``doc``), its number in the batch, its id and the byte offset where it ends in its text."""
    ids, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    held, at = token_bytes(lists, table)
    # A sum over the whole batch, less what stands before the token's text.
    ends = pc.subtract(pc.cumulative_sum(pc.binary_length(held).cast(pa.int64())), pa.array(at).take(parents))
    return pa.table({"doc": parents.cast(pa.int64()), "end": ends, f"{name}_at": pa.array(np.arange(len(ids))), name: ids})


def group_strings(lists: pa.ListArray, ends: np.ndarray) -> pa.Array:
    """The ids of every group, comma-joined; ``ends`` numbers, in order, the tokens that end a group."""
    words = pc.cast(pc.list_flatten(lists), pa.string())
    offsets = pa.array(np.append(0, ends + 1), type=pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), ",")


def align_batch(texts: list[str], first: ByteLevel, second: Pieces) -> dict:
    """Tokens, groups and links of a batch of texts as Arrow arrays."""
    a, b = encoded(first, texts), encoded(second, texts)
    bad = differs(a, first.table, texts) | differs(b, second.table, texts)
    if bad.any():
        a, b = without(a, bad), without(b, bad)
    left, right = token_table(a, first.table, "a"), token_table(b, second.table, "b")
    links = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).combine_chunks().sort_by([("a_at", "ascending"), ("b_at", "ascending")])
    docs = links["doc"].to_numpy()
    # Where several tokens end together, of which all but one are without bytes, the last of them ends the group.
    place = np.stack([docs, links["end"].to_numpy()], axis=1) if len(docs) else np.zeros((0, 2), np.int64)
    last = np.ones(len(place), dtype=bool)
    last[:-1] = (place[1:] != place[:-1]).any(axis=1)
    ends_a, ends_b = links["a_at"].to_numpy()[last], links["b_at"].to_numpy()[last]
    n_groups = np.bincount(docs[last], minlength=len(texts))
    joined = pc.binary_join_element_wise(group_strings(a, ends_a), group_strings(b, ends_b), "|")
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_groups)), type=pa.int32()), joined), ";")
    codes = pc.add(pc.multiply(links["a"].cast(pa.int64()), second.size), links["b"].cast(pa.int64()))
    pairs = pa.table({"doc": links["doc"], "code": codes}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "code", "n"])
    counts = pairs.group_by("code", use_threads=False).aggregate([("n", "sum")]).sort_by("code").combine_chunks()
    pairs = pairs.sort_by([("doc", "ascending"), ("code", "ascending")])
    known = counts["code"].to_numpy()
    sizes = np.bincount(pairs["doc"].to_numpy(), minlength=len(texts))
    return {
        "n_a": pc.list_value_length(a).to_numpy(), "n_b": pc.list_value_length(b).to_numpy(), "n_groups": n_groups, "n_links": np.bincount(docs, minlength=len(texts)),
        "groups_sha256": ["" if not n else hashlib.sha256(text.as_buffer()).hexdigest() for n, text in zip(n_groups, shown)],
        "sizes": sizes, "entries": np.searchsorted(known, pairs["code"].to_numpy()).astype(np.int32), "times": pairs["n"].to_numpy().astype(np.int32),
        "codes": known, "counts": counts["n_sum"].to_numpy(),
    }


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, gathered over batches until their texts have ``limit`` bytes."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


LISTS = {"doc_ids": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
         "sizes": pa.int64(), "entries": pa.int32(), "times": pa.int32(), "codes": pa.int64(), "counts": pa.int64()}
SQL_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}


def aligned_blocks(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Blocks of documents: per document its numbers, and which of the block's id pairs (``codes``) it links how often."""
    sent = spark.sparkContext.broadcast((read_vocabulary(byte_level), read_vocabulary(pieces)))
    schema = pa.schema([("block", pa.int64()), *((name, pa.list_(kind)) for name, kind in LISTS.items())])
    sql = "block long, " + ", ".join(f"{name} array<{SQL_NAMES[kind]}>" for name, kind in LISTS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, second = ByteLevel(sent.value[0]), Pieces(sent.value[1])
        number = TaskContext.get().partitionId() << 32
        for ids, texts in blocks(batches):
            found = {"doc_ids": ids, **align_batch(texts, first, second)}
            yield {"block": [number], **{name: pa.ListArray.from_arrays([0, len(found[name])], pa.array(found[name], type=kind)) for name, kind in LISTS.items()}}
            number += 1

    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(texts, run, schema, sql)


def pair_counts(found: DataFrame, second_size: int) -> DataFrame:
    """``(code, n, best)``: the corpus-wide links of each id pair, and whether no pair with the same second id has more."""
    counts = written(found.select(F.explode(F.arrays_zip("codes", "counts")).alias("c")).groupBy(F.col("c.codes").alias("code")).agg(F.sum("c.counts").alias("n")), "pairs")
    second = (F.col("code") % second_size).cast("int").alias("b")
    most = counts.groupBy(second).agg(F.max("n").alias("most"))
    return counts.select("code", "n", second).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs(doc_id, text)``.

    A is the byte-level vocabulary on a space and the text, B the piece model, which adds that space. A text that is null or empty, or
    whose tokens of either side do not join to a space and the text, has zeros and an empty digest. Repeated rows count and repeat;
    no rows give no rows; other columns take no part. A pair's ids meet the corpus-wide counts once a block, not once a document.
    """
    second_size = Pieces(read_vocabulary(pieces)).size
    found = written(aligned_blocks(spark, docs, byte_level, pieces), "aligned")
    asked = found.select("block", F.explode("codes").alias("code")).join(pair_counts(found, second_size), "code")
    # A block's different pairs, in the order of its codes.
    told = asked.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("code", "n", "best"))).alias("told"))
    held = found.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "entries", "times").join(told, "block", "left")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].values for c in batch.schema.names if c not in ("block", "told")}
                sizes, times = row["sizes"].to_numpy(), row["times"].to_numpy().astype(np.int64)
                known = batch.column("told")[k].values
                n = np.zeros(0, np.int64) if known is None else known.field("n").to_numpy()
                best = np.zeros(0, bool) if known is None else known.field("best").to_numpy(zero_copy_only=False)
                doc, entries = np.repeat(np.arange(len(sizes)), sizes), row["entries"].to_numpy()
                n_best, sums = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(n_best, doc, times * best[entries])
                np.add.at(sums, doc, times * n[entries])
                yield {"doc_id": row["doc_ids"], **{c: row[c] for c in names[:4]}, "n_best": n_best, "count_sum": sums, "groups_sha256": row["groups_sha256"]}

    return arrow_map(held, run, schema, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", groups_sha256 string")
