"""Token files: documents' ids in ascending order of doc_id, range-coded in segments of independent blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filingdelta.llm.bpe import CACHED_PIECES, SPLIT, read_vocabulary
from filingdelta.llm.common import arrow_map
from filingdelta.llm.rangecoder import pack, unpack

END_ID = 2
# Ids of a segment: whole documents, coded side by side; a longer document is a segment of its own.
SEGMENT_IDS = 4 << 20
MAX_ID = (1 << 16) - 1


class PieceEncoder:
    """Encodes texts with the tokenizers library, each different piece of the library's own splitting once.

    Pieces are encoded independently of each other by the library, so their ids side by side are the text's. A
    text with a special token goes through the library whole. The table of pieces is bounded.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.pieces = regex.compile(SPLIT), {}

    def _plain(self, text: str) -> bytes:
        ids = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        if len(ids) and ids.max() > MAX_ID:
            raise ValueError("ids above 65535 do not fit the token file")
        return ids.astype("<u2").tobytes()

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), dtype="<u2")
        out, pieces = [], self.pieces
        for piece in self.split.findall(text):
            coded = pieces.get(piece)
            if coded is None:
                if len(pieces) > CACHED_PIECES:
                    pieces.clear()
                coded = self._plain(piece)
                if len(piece) <= 64:
                    pieces[piece] = coded
            out.append(coded)
        return np.frombuffer(b"".join(out), dtype="<u2")


SEGMENT = "part int, segment int, start long, n_ids long, doc_ids array<long>, doc_sizes array<long>, blocks array<binary>, block_sizes array<int>, checksums array<long>"


def write_ids(spark: SparkSession, docs: DataFrame, path: str, vocabulary_path: str, partitions: int | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` and write a token file of segments at ``path``, in ascending order of doc_id.

    Every document ends with ``end_id``; a null text is empty and has that id only. Null doc_ids come first, rows of equal
    doc_id in the order of their texts. Documents are dealt by ranges of doc_id; segments number their ids from the start
    of their range, so writing needs no count of what stands before.
    """
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())),
                        ("blocks", pa.list_(pa.binary())), ("block_sizes", pa.list_(pa.int32())), ("checksums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, part = PieceEncoder(data.value), TaskContext.get().partitionId()
        held: list[tuple[int, np.ndarray]] = []
        size = start = segment = 0

        def flushed() -> dict:
            nonlocal held, size, start, segment
            blocks, block_sizes, sums = pack(np.concatenate([x for _, x in held]))
            row = {"part": [part], "segment": [segment], "start": [start], "n_ids": [size], "doc_ids": [[d for d, _ in held]], "doc_sizes": [[len(x) for _, x in held]],
                   "blocks": [blocks], "block_sizes": [block_sizes], "checksums": [sums]}
            start, segment, held, size = start + size, segment + 1, [], 0
            return row

        end = np.array([end_id], dtype="<u2")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encoder.ids(text), end])
                if held and size + len(ids) > SEGMENT_IDS:
                    yield flushed()
                held.append((doc_id, ids))
                size += len(ids)
        if held:
            yield flushed()

    arrow_map(ordered, run, schema, SEGMENT).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a token file, in no order.

    ``start`` counts the ids of all documents before it; the checksum is the crc32 of its ids as little-endian
    unsigned 32-bit integers. A block that does not have its checksum stops the read. Each segment is decoded by itself;
    what stands before a range of doc_ids comes from one row per range.
    """
    file = spark.read.schema(SEGMENT).parquet(path)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(row["blocks"], row["block_sizes"], row["checksums"]).astype("<u4")
                sizes = row["doc_sizes"]
                begins = np.cumsum([0, *sizes])
                yield {
                    "part": [row["part"]] * len(sizes), "doc_id": row["doc_ids"], "inside": row["start"] + begins[:-1], "n_tokens": sizes,
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins[:-1], begins[1:])],
                }

    docs = arrow_map(file, run, schema, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = file.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range of the file, as many as the writer had tasks.
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
