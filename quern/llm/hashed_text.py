"""Hashed text features, and the optimiser of the linear models over them, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import Words, buffers, mix, spans_hash

_RNG = np.random.default_rng(314159)
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
#: Classes of bytes; a word's mask says which it holds.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 8
for _bit, _chars in enumerate((b"!", b"*$%&#", b"|<>", b".,;:?", b"-_'\"()", b"@/\\=+~^[]{}`"), 4):
    _CLASS[np.frombuffer(_chars, np.uint8)] = 1 << _bit


_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
#: Word beginnings of so many bytes are features too, for words that share a stem.
PREFIX_BYTES = (6, 7)
BLOCK = 1 << 19


@dataclass
class Features:
    """Sparse rows: entry k says that row rows[k] has values[k] at buckets[k]."""

    rows: np.ndarray
    buckets: np.ndarray
    values: np.ndarray
    count: int

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries in blocks, so that what is made of them on the way stays small beside them."""
        for i in range(0, len(self.rows), BLOCK):
            yield self.rows[i : i + BLOCK], self.buckets[i : i + BLOCK], self.values[i : i + BLOCK]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.count)
        for rows, buckets, values in self._blocks():
            out += np.bincount(rows, weights[buckets] * values, self.count)
        return out

    def gradient(self, per_row: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for rows, buckets, values in self._blocks():
            out += np.bincount(buckets, per_row[rows] * values, size)
        return out


def _summed(rows: np.ndarray, buckets: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) and how often each occurs."""
    keys, times = np.unique((rows.astype(np.int64) << bits) | buckets, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), times


def char_ngrams(columns: list[pa.Array], low: int, high: int, bits: int) -> Features:
    """Hashed character n-grams of several string columns, each with marked ends; rows have length 1."""
    rows, buckets = [], []
    count = len(columns[0])
    with np.errstate(over="ignore"):
        for field, column in enumerate(columns):
            data, offsets = buffers(column)
            n = len(offsets) - 1
            padded = np.zeros(len(data) + 2 * n, np.uint8)
            begin = offsets[:-1] + 2 * np.arange(n)
            end = offsets[1:] + 2 * np.arange(n) + 1
            padded[begin], padded[end] = 2, 3
            body = np.ones(len(padded), bool)
            body[begin] = body[end] = False
            padded[body] = data
            row = np.repeat(np.arange(n), end - begin + 1)
            for size in range(low, high + 1):
                at = np.arange(max(0, len(padded) - size + 1))
                at = at[at + size <= end[row[at]] + 1]
                hashes = spans_hash(_BYTES[padded], at, at + size) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(field + 1)
                rows.append(row[at])
                buckets.append((mix(hashes) >> np.uint64(64 - bits)).astype(np.int64))
    r, b, times = _summed(np.concatenate(rows), np.concatenate(buckets), bits, count)
    norm = np.sqrt(np.bincount(r, minlength=count))
    return Features(r, b, (1 / norm[r]).astype(np.float32) if len(r) else np.zeros(0, np.float32), count)


def word_features(words: Words, bits: int) -> Features:
    """Words of each text: which occur, what their characters look like, and how they repeat.

    A word's presence counts 1 and a stem's the logarithm of its count, however long the text, so that few telling words
    weigh alike anywhere; character classes and repetition count by their share.
    """
    count = len(words.bounds) - 1
    lengths = np.diff(words.bounds)
    row = np.repeat(np.arange(count), lengths)
    with np.errstate(over="ignore"):
        bucket = (mix(words.hashes ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(64 - bits)).astype(np.int64)
        r, b, times = _summed(row, bucket, bits, count)
        parts = [(r, b, np.ones(len(r), np.float32))]
        if len(row):
            for size in PREFIX_BYTES:
                long = np.flatnonzero(words.ends - words.starts > size)
                stems = spans_hash(_FOLDED[words.data], words.starts[long], words.starts[long] + size)
                stem = (mix(stems + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
                r1, b1, t1 = _summed(row[long], stem, bits, count)
                parts.append((r1, b1, np.log2(1 + t1).astype(np.float32)))
            # reduceat over starts also runs over the spaces up to the next word; they have no class.
            mask = np.bitwise_or.reduceat(_CLASS[words.data], words.starts).astype(np.uint64)
            shape = (mix(mask + np.uint64(0x5BE0CD19137E2179)) >> np.uint64(64 - bits)).astype(np.int64)
            r2, b2, t2 = _summed(row, shape, bits, count)
            parts.append((r2, b2, (4 * t2 / lengths[r2]).astype(np.float32)))
            same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])) + 1
            full = np.flatnonzero(lengths)
            distinct = np.bincount(r, minlength=count)
            named = lambda text: int(mix(np.array([text], np.uint64))[0] >> np.uint64(64 - bits))
            parts.append((full, np.full(len(full), named(101)), (4 * np.bincount(row[same], minlength=count)[full] / lengths[full]).astype(np.float32)))
            parts.append((full, np.full(len(full), named(102)), (4 * (1 - distinct[full] / lengths[full])).astype(np.float32)))
            size = np.log2(1 + lengths[full]).astype(np.int64)
            parts.append((full, np.array([named(200 + int(x)) for x in size], np.int64), np.ones(len(full), np.float32)))
    rows, buckets, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Features(rows, buckets, values, count)


def adam(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam with a step that falls to 0; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        _, g = loss(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
