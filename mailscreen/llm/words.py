"""Words and shingles of whole Arrow columns as NumPy hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Odd multipliers; a prefix sum of byte * BASE^i gives every word's hash by a difference.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x9FB21C651E98DF25], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE^i and BASE^-i (mod 2^64), as far as they have been needed."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, CHUNK)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.size, b, dtype=np.uint64))), dtype=np.uint64) for b in (_BASE, inverse))
        return self.up[:n], self.down


_POWERS = Powers()


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, UTF-8 bytes, offsets of the rows) for slices of about CHUNK bytes; null is empty."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_hash(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of symbols[start:end] for each pair; equal runs of symbols have equal hashes."""
    up, down = _POWERS.upto(len(symbols))
    sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word (A-Z lower-cased, `[^\\x20\\x09-\\x0D]+`), and each row's range of words."""
    inside = ~_SPACE[data]
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1]
    right[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    left[cuts] = inside[cuts]
    right[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return prefix_hash(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles.

    A row with fewer words has one: its whole sequence; a row without words has none.
    """
    for _, rows, data, offsets in text_chunks(column):
        words, ranges = word_hashes(data, offsets)
        spans = max(0, len(words) - width + 1)
        rolled = np.zeros(spans, dtype=np.uint64)
        for k in range(width):
            rolled += mix(words[k : k + spans] + _PLACE[k % 5]) * (_PLACE[(k + 1) % 5] + np.uint64(2 * (k // 5)))
        rolled = mix(rolled)
        for a, b in zip(ranges[:-1], ranges[1:]):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                few = sum((mix(words[a + k : a + k + 1] + _PLACE[k % 5]) * _PLACE[(k + 1) % 5] for k in range(b - a)), np.zeros(1, np.uint64))
                yield mix(few + np.uint64(b - a))
            else:
                yield words[:0]
