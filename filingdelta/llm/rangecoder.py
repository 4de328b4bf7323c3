"""Adaptive range coding of token ids in independent blocks, many blocks side by side."""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 2048
SLOTS, CONFIDENT = 1024, 3
# Symbols: the order-2, order-1 and order-0 prediction holds, or the bit length (0 to 16) of another id.
HITS, CLASSES = 3, 17
SYMBOLS = HITS + CLASSES
STEP, LIMIT = 24, 4096
LOW_MASK, TOP, BOTTOM = (1 << 48) - 1, 1 << 32, 1 << 28


class Model:
    """Predictions and mixed symbol counts of every block; a new model is the reset state.

    Order-2 and order-1 contexts predict one id each, with a confidence that grows with every hit; order 0 predicts the id
    that led most often. Symbol counts are the sum of those kept for the two confidences and those of the block; both stay
    below 2 * LIMIT, so 16 bits hold them, and sums over symbols add whole rows of blocks.
    """

    def __init__(self, blocks: int):
        self.by_two = np.zeros((blocks, SLOTS), dtype=np.int32)
        self.by_one = np.zeros((blocks, SLOTS), dtype=np.int32)
        self.by_none = np.zeros(blocks, dtype=np.int32)
        self.counts = np.ones((blocks, (CONFIDENT + 1) ** 2, SYMBOLS), dtype=np.int16)
        self.sums = np.full((blocks, (CONFIDENT + 1) ** 2), SYMBOLS, dtype=np.int32)
        self.shared = np.ones((SYMBOLS, blocks), dtype=np.int16)
        self.shared_sums = np.full(blocks, SYMBOLS, dtype=np.int32)
        self.last, self.before = np.zeros(blocks, dtype=np.int32), np.zeros(blocks, dtype=np.int32)

    def predict(self, n: int) -> None:
        """Look up the predictions and cumulative counts of the first ``n`` blocks."""
        self.lane = np.arange(n)
        self.slot_two = ((self.last[:n] * 40503 + self.before[:n] * 30011) >> 5) & (SLOTS - 1)
        self.slot_one = ((self.last[:n] * 40503) >> 5) & (SLOTS - 1)
        self.two, self.one, self.none = self.by_two[self.lane, self.slot_two], self.by_one[self.lane, self.slot_one], self.by_none[:n]
        self.context = (self.two & CONFIDENT) * (CONFIDENT + 1) + (self.one & CONFIDENT)
        self.cumulative = np.zeros((SYMBOLS + 1, n), dtype=np.int16)
        np.add(self.counts[self.lane, self.context].T, self.shared[:, :n], out=self.cumulative[1:])
        for below, above in zip(self.cumulative[1:], self.cumulative[2:]):
            above += below

    def bounds(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the symbols below, and of these with the symbol."""
        return self.cumulative[symbol, self.lane].astype(np.int64), self.cumulative[symbol + 1, self.lane].astype(np.int64)

    def symbols(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, raw bits and how many of them, of the next id of every block."""
        length = BITS[ids]
        symbol = np.where(ids == self.two >> 2, 0, np.where(ids == self.one >> 2, 1, np.where(ids == self.none >> 2, 2, HITS + length)))
        n_raw = np.where(symbol < HITS, 0, np.maximum(length - 1, 0))
        return symbol, np.where(symbol < HITS, 0, ids - np.where(length > 0, 1 << np.maximum(length - 1, 0), 0)), n_raw

    def ids(self, symbol: np.ndarray, raw: np.ndarray) -> np.ndarray:
        length = np.maximum(symbol - HITS, 0)
        plain = np.where(length > 0, (1 << np.maximum(length - 1, 0)) + raw, 0)
        return np.where(symbol == 0, self.two >> 2, np.where(symbol == 1, self.one >> 2, np.where(symbol == 2, self.none >> 2, plain)))

    def learn(self, symbol: np.ndarray, ids: np.ndarray) -> None:
        n, lane = len(ids), self.lane
        self.by_two[lane, self.slot_two] = _moved(self.two, ids)
        self.by_one[lane, self.slot_one] = _moved(self.one, ids)
        self.by_none[:n] = _moved(self.none, ids)
        self.counts[lane, self.context, symbol] += STEP
        self.sums[lane, self.context] += STEP
        full = np.flatnonzero(self.sums[lane, self.context] > LIMIT)
        if len(full):
            at = self.context[full]
            self.counts[full, at] = (self.counts[full, at] + 1) >> 1
            self.sums[full, at] = self.counts[full, at].sum(axis=1)
        self.shared[symbol, lane] += STEP
        self.shared_sums[:n] += STEP
        full = np.flatnonzero(self.shared_sums[:n] > LIMIT)
        if len(full):
            self.shared[:, full] = (self.shared[:, full] + 1) >> 1
            self.shared_sums[full] = self.shared[:, full].sum(axis=0)
        self.before[:n], self.last[:n] = self.last[:n].copy(), ids


BITS = np.array([i.bit_length() for i in range(1 << 16)], dtype=np.int64)


def _moved(held: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A hit raises the confidence, a miss lowers it, a miss without any replaces the prediction."""
    sure = held & CONFIDENT
    hit = held >> 2 == ids
    kept = np.where(hit, held + (sure < CONFIDENT), held - 1)
    return np.where(~hit & (sure == 0), ids << 2, kept).astype(np.int32)


def _open(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks whose leading 16 bits are settled, and those whose range must be cut to settle them."""
    settled = (low ^ (low + span)) < TOP
    return settled, ~settled & (span < BOTTOM)


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Coded bytes of every block; ``lengths`` in descending order, ids of all blocks one after the other."""
    blocks, longest = len(lengths), int(lengths[0])
    begins = np.cumsum(lengths) - lengths
    model, out, filled = Model(blocks), np.zeros((blocks, 2 * longest + 8), dtype="<u2"), np.zeros(blocks, dtype=np.int64)
    low, span = np.zeros(blocks, dtype=np.int64), np.full(blocks, LOW_MASK, dtype=np.int64)
    for t in range(longest):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        model.predict(n)
        now = ids[begins[:n] + t]
        symbol, raw, n_raw = model.symbols(now)
        unit = span[:n] // model.cumulative[-1]
        below, above = model.bounds(symbol)
        fine = (unit * (above - below)) >> n_raw
        low[:n] += unit * below + fine * raw
        span[:n] = fine
        at = np.arange(n)
        while len(at):
            settled, forced = _open(low[at], span[at])
            cut = at[forced]
            span[cut] = -low[cut] & (BOTTOM - 1)
            at = at[settled | forced]
            out[at, filled[at]] = (low[at] >> 32) & 0xFFFF
            filled[at] += 1
            low[at], span[at] = (low[at] << 16) & LOW_MASK, span[at] << 16
        model.learn(symbol, now)
    for shift in (32, 16, 0):
        out[np.arange(blocks), filled] = (low >> shift) & 0xFFFF
        filled += 1
    return [out[k, :filled[k]].tobytes() for k in range(blocks)]


def decode_blocks(coded: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids that ``encode_blocks`` was given."""
    blocks, longest = len(lengths), int(lengths[0])
    begins = np.cumsum(lengths) - lengths
    words = np.zeros((blocks, max(map(len, coded)) // 2 + 4), dtype=np.int64)
    for k, part in enumerate(coded):
        words[k, :len(part) // 2] = np.frombuffer(part, dtype="<u2")
    model, ids = Model(blocks), np.zeros(int(lengths.sum()), dtype=np.int64)
    low, span = np.zeros(blocks, dtype=np.int64), np.full(blocks, LOW_MASK, dtype=np.int64)
    code, taken = (words[:, 0] << 32) | (words[:, 1] << 16) | words[:, 2], np.full(blocks, 3, dtype=np.int64)
    for t in range(longest):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        model.predict(n)
        unit = span[:n] // model.cumulative[-1]
        place = (code[:n] - low[:n]) // unit
        passed = model.cumulative[1:] <= np.clip(place, -1, 2 * LIMIT + 2 * STEP).astype(np.int16)
        symbol = passed.view(np.int8).sum(axis=0, dtype=np.int8).astype(np.int64)
        if symbol.max() >= SYMBOLS:
            raise ValueError("damaged block")
        below, above = model.bounds(symbol)
        n_raw = np.maximum(symbol - HITS - 1, 0)
        fine = (unit * (above - below)) >> n_raw
        low[:n] += unit * below
        raw = (code[:n] - low[:n]) // fine
        low[:n] += fine * raw
        span[:n] = fine
        at = np.arange(n)
        while len(at):
            settled, forced = _open(low[at], span[at])
            cut = at[forced]
            span[cut] = -low[cut] & (BOTTOM - 1)
            at = at[settled | forced]
            code[at] = ((code[at] << 16) & LOW_MASK) | words[at, np.minimum(taken[at], words.shape[1] - 1)]
            taken[at] += 1
            low[at], span[at] = (low[at] << 16) & LOW_MASK, span[at] << 16
        now = model.ids(symbol, raw)
        ids[begins[:n] + t] = now
        model.learn(symbol, now.astype(np.int32))
    return ids


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[list[bytes], list[int], list[int]]:
    """Blocks of at most ``block_ids`` ids: coded bytes, numbers of ids and checksums of the ids."""
    n = len(ids)
    if not n:
        return [], [], []
    lengths = np.full(-(-n // block_ids), block_ids, dtype=np.int64)
    lengths[-1] = n - block_ids * (len(lengths) - 1)
    plain = ids.astype("<u2")
    sums = [zlib.crc32(plain[k:k + block_ids].tobytes()) for k in range(0, n, block_ids)]
    return encode_blocks(ids.astype(np.int64), lengths), lengths.tolist(), sums


def unpack(coded: list[bytes], lengths: list[int], sums: list[int]) -> np.ndarray:
    """The ids of all blocks; raises ValueError if a block does not have its checksum."""
    if not coded:
        return np.zeros(0, dtype=np.int64)
    ids = decode_blocks(coded, np.array(lengths, dtype=np.int64))
    plain, at = ids.astype("<u2"), 0
    for k, (n, checksum) in enumerate(zip(lengths, sums)):
        if zlib.crc32(plain[at:at + n].tobytes()) != checksum:
            raise ValueError(f"checksum of block {k}")
        at += n
    return ids
