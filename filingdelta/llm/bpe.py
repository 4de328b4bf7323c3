"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text state machine."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from filingdelta.llm.common import arrow_map

# Fixed values of the vocabulary's word splitter.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_CHARS = 1 << 16
# Pieces, and pairs of tokens, that a task remembers: some 50 MB each.
CACHED_PIECES = 1 << 18
MAX_VOCABULARY_BYTES = 64 << 20
DECODE_IDS = 1 << 15


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file; its size is checked, since it is sent to all tasks."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary above {MAX_VOCABULARY_BYTES} bytes")
    return data


class Tokens:
    """Tokens as bytes and the special tokens of a byte-level vocabulary file: all that decoding needs."""

    def __init__(self, data: bytes):
        spec, letters = json.loads(data), byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self._learn(spec["model"])

    def _learn(self, model: dict) -> None:
        """What else is kept of the file."""


class Vocabulary(Tokens):
    """Also the ids by bytes and the merges by rank, for encoding."""

    def _learn(self, model: dict) -> None:
        ids = model["vocab"]
        self.ids = {self.bytes_of[i]: i for t, i in ids.items() if t not in self.special}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = rank, ids[a + b]
        self.lookahead = sufficient_lookahead(self)


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes behind the end of the input from which every later token boundary must be reached.

    No token made by the merge list is longer than this, so the boundaries of any longer text's encoding
    include one of the last ``lookahead`` positions read so far. What all of these positions agree on can
    no longer change, whatever text follows.
    """
    return max((len(vocabulary.bytes_of[new]) for _, new in vocabulary.merges.values()), default=1)


class Transducer:
    """Encodes a piece byte by byte and emits a token as soon as no later byte can change it.

    For every prefix one token is its encoding's last: the one that the encoding of the prefix before it
    can stand next to. The positions of the last ``lookahead`` bytes are live; the chain of boundaries that
    all live positions share is emitted and forgotten, so memory is the lookahead and the unstable tail.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.beside, self.edges = vocabulary, {}, {}
        self.longest = vocabulary.lookahead
        self.sizes = [len(t) for t in vocabulary.bytes_of]
        # Finds all tokens that end at a byte; bytes stand as the letters of the same number.
        self.ending = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.ending.add_word(token.decode("latin-1"), i)
        self.ending.make_automaton()

    def _edges(self, token: int) -> tuple[list, list] | None:
        """First and last parts of the token's bytes while they are merged, each with the rank that ends it; None if they do not become the token."""
        if token in self.edges:
            return self.edges[token]
        v = self.vocabulary
        ids, first, last = [v.ids[bytes([b])] for b in v.bytes_of[token]], [], []
        while len(ids) > 1:
            rank, at, new = min(((v.merges[p][0], k, v.merges[p][1]) for k, p in enumerate(zip(ids, ids[1:])) if p in v.merges), default=(0, -1, 0))
            if at < 0:
                break
            if at == 0:
                first.append((ids[0], rank))
            if at == len(ids) - 2:
                last.append((ids[-1], rank))
            ids[at:at + 2] = [new]
        end = len(v.merges)
        whole = ids == [token]
        self.edges[token] = ([*first, (token, end)], [*last, (token, end)]) if whole else None
        return self.edges[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary: none joins a last part of the left token and a first part of the right one before either ends."""
        found = self.beside.get((left, right))
        if found is None:
            if len(self.beside) > CACHED_PIECES:
                self.beside.clear()
            merges, found = self.vocabulary.merges, True
            for x, x_end in self._edges(left)[1]:
                for y, y_end in self._edges(right)[0]:
                    met = merges.get((x, y))
                    # Equal ranks are merged from the left.
                    if met is not None and met[0] < x_end and met[0] <= y_end:
                        found = False
            self.beside[left, right] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """All tokens of a piece, as ``stream`` emits them."""
        return [token for part in self.stream(piece) for token in part]

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        fits, edges, sizes, beside = self._fits, self._edges, self.sizes, self.beside
        # Per position from `base` on: the last token of the encoding up to there.
        last, base, check = [-1], 0, 4 * self.longest
        for at, token in self.ending.iter(piece.decode("latin-1")):
            end = at + 1 - base
            start = end - sizes[token]
            if end < len(last) or start < 0:
                continue
            before = last[start]
            near = beside.get((before, token))
            if near is None:
                near = edges(token) is not None and (before < 0 or fits(before, token))
            if not near:
                continue
            last.append(token)
            if end >= check and at + 1 < len(piece):
                stable = self._shared(last)
                check = 4 * self.longest if stable else 2 * check
                yield self._chain(last, stable)
                base += stable
                del last[:stable]
        yield self._chain(last, len(last) - 1)

    def _shared(self, last: list[int]) -> int:
        """The last boundary that the chains of all live positions go through."""
        live = set(range(max(0, len(last) - self.longest), len(last)))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - len(self.vocabulary.bytes_of[last[top]]))
        return live.pop()

    def _chain(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.vocabulary.bytes_of[last[end]])
        return out[::-1]


class Encoder:
    """Encodes texts; a bounded table remembers the pieces met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.transducer, self.pieces = Transducer(vocabulary), {}
        self.split = regex.compile(SPLIT)
        self.special = vocabulary.special
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cut = regex.compile(r"(?<=\S)\s")

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of bounded length, cut where no piece can cross: before white space that follows a letter."""
        at = 0
        while len(text) - at > SLICE_CHARS:
            found = self.cut.search(text, at + SLICE_CHARS)
            if not found:
                break
            yield text[at:found.start()]
            at = found.start()
        yield text[at:]

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, pieces = [], self.pieces
        parts = self.special_at.split(text) if self.special_at and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
                continue
            for piece_text in self._slices(part):
                for piece in self.split.findall(piece_text):
                    coded = pieces.get(piece)
                    if coded is None:
                        if len(pieces) > CACHED_PIECES:
                            pieces.clear()
                        coded = np.array(self.transducer.encode(piece.encode()), dtype="<u4").tobytes()
                        if len(piece) <= 64:
                            pieces[piece] = coded
                    out.append(coded)
        return b"".join(out)


class Decoder:
    """Turns ids into text in parts: bytes of an unfinished character wait for the next part."""

    def __init__(self, vocabulary: Tokens):
        self.bytes_of = vocabulary.bytes_of

    def text(self, ids: np.ndarray) -> Iterator[str]:
        machine, n = codecs.getincrementaldecoder("utf-8")("replace"), len(self.bytes_of)
        for at in range(0, len(ids), DECODE_IDS):
            part = ids[at:at + DECODE_IDS].tolist()
            try:
                data = b"".join(map(self.bytes_of.__getitem__, part))
            except IndexError:  # unknown ids stand for nothing
                data = b"".join(self.bytes_of[i] for i in part if i < n)
            yield machine.decode(data)
        yield machine.decode(b"", True)


_LOADED: dict[tuple[str, int], Tokens] = {}


def loaded(data: bytes, kind: type[Tokens] = Vocabulary) -> Tokens:
    """One parsed vocabulary of a kind per Python worker."""
    key = kind.__name__, hash(data)
    if key not in _LOADED:
        _LOADED[key] = kind(data)
    return _LOADED[key]


def encode(spark: SparkSession, docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``(doc_id, n_tokens long, ids binary)`` per row of ``docs(doc_id, text)``, ids as little-endian unsigned 32-bit.

    A null text is empty; an empty text has no ids and an empty binary. Repeated rows give repeated results,
    null ids of documents stay null, other columns are not read. Texts of any length are encoded in slices.
    """
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = Encoder(loaded(data.value))
        for batch in batches:
            ids = [encoder.ids_bytes(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, run, schema, "doc_id long, n_tokens long, ids binary")


def decode(spark: SparkSession, encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds ``text`` to the rows of ``encode``; null ids give an empty text, unknown ids stand for nothing."""
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        decoder = Decoder(loaded(data.value, Tokens))
        for batch in batches:
            ids = batch.column("ids")
            texts = ["".join(decoder.text(np.frombuffer(x or b"", dtype="<u4"))) for x in ids.to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), "ids": ids, "text": texts}

    return arrow_map(encoded, run, schema, "doc_id long, n_tokens long, ids binary, text string")
