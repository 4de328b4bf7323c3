"""Words of many texts at once: places and 64-bit hashes from Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes hashed at once: a scanner holds 16 bytes for each, and as much again while it works.
SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _inverse(odd: int) -> int:
    """Multiplicative inverse modulo 2**64."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


class Scanner:
    """Finds words, given the bytes that belong to words; A-Z count as a-z."""

    def __init__(self, word_bytes: np.ndarray):
        self.is_word = word_bytes
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        powers = np.full(SLICE_BYTES + 1, BASE, dtype=np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        back = np.full(SLICE_BYTES + 1, _inverse(BASE), dtype=np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def scan(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, word starts and stops in them, word hashes, and the first word of every text (and an end)."""
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = self.lower[data]
        inside = self.is_word[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = inside[edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        ends[edges] = inside[edges]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return data, starts, stops, self._hashes(data, starts, stops), np.searchsorted(starts, offsets)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A word's hash depends on its bytes only; slices end between words, a longer word has slices of its own."""
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(stops, low + SLICE_BYTES, side="right")))
            high = stops[to - 1]
            if high - low > SLICE_BYTES:
                out[at] = self._long(data[low:high])
            else:
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum((data[low:high].astype(np.uint64) + 1) * self.powers[:high - low], out=sums[1:])
                a, b = starts[at:to] - low, stops[at:to] - low
                out[at:to] = (sums[b] - sums[a]) * self.back[a]
            at = to
        return mix(out)

    def _long(self, word: np.ndarray) -> np.uint64:
        total, shift = 0, 1
        for at in range(0, len(word), SLICE_BYTES):
            part = word[at:at + SLICE_BYTES].astype(np.uint64) + 1
            total = (total + int((part * self.powers[:len(part)]).sum(dtype=np.uint64)) * shift) % (1 << 64)
            shift = shift * pow(BASE, SLICE_BYTES, 1 << 64) % (1 << 64)
        return np.uint64(total)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))
