"""Vectorised byte, word and hash helpers shared by the Arrow-batched operators.

All functions work on whole texts.  A batch of texts is handled in slices of bounded size,
so memory follows the slice (or the single longest text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U(0x9E3779B97F4A7C15)
_BASE2 = U(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


_BYTE = mix(np.arange(1, 257, dtype=U))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, self.base, U), np.full(n, self.inverse, U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if n > 4 * SLICE_BYTES:  # one huge text: do not keep its tables
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers(_BASE)
_powers2 = _Powers(_BASE2)


class Spans:
    """Hashes of arbitrary spans of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, second: bool = False):
        up, self.down = (_powers2 if second else _powers).get(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts laid end to end.

    start, end: byte positions; first[i]:first[i+1] are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = edge[:-1].copy()
        before[1:] |= ~solid[:-1]
        after = edge[1:].copy()
        after[:-1] |= ~solid[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Spans(_BYTE[self.data]).hash(self.start, self.end)

    def texts(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string column; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts record batches between rows so that each piece has about ``limit`` bytes of text."""
    for batch in batches:
        data, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Counts:
    """Sums of counts by 64-bit key, merged as they come; gives them out when they get many."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > self.most:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            self.parts = [(keys, np.bincount(at, counts, len(keys)).astype(np.int64))]
            self.size = len(keys)

    def full(self) -> bool:
        return self.size > self.most // 2 and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        keys, counts = self.parts[0] if self.parts else (np.zeros(0, U), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return keys, counts


class SortedHashes:
    """Look-up in a sorted array of well-mixed 64-bit hashes, by an index of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, min(24, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        self.shift = U(64 - bits)
        self.start = np.searchsorted(keys >> self.shift, np.arange(2**bits + 1, dtype=U)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The index of each, or -1."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        bucket = wanted >> self.shift
        at, end = self.start[bucket], self.start[bucket + U(1)]
        left = np.flatnonzero(at < end)
        at, end, value = at[left], end[left], wanted[left]
        while len(left):
            key = self.keys[at]
            hit = key == value
            out[left[hit]] = at[hit]
            at = at + 1
            go = (key < value) & (at < end)
            left, at, end, value = left[go], at[go], end[go], value[go]
        return out
