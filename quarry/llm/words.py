"""Vectorised text kernels: words, their hashes, windows of words and minimisers over Arrow string batches.

Texts are handled as UTF-8 bytes. A hash of a run of words is a polynomial in 64 bits whose coefficients are the
mixed hashes of the words, so that any run's hash comes from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.random.default_rng(0x5EED).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE_BYTE, _BASE_WORD = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

#: White space of one byte: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What stands between words of lower-case letters, digits and all that isn't ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base**i and base**-i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_BASE_BYTE), _Powers(_BASE_WORD)
#: Powers that are kept from one task to the next.
_KEPT_POWERS = 1 << 21


def forget() -> None:
    """Drop the powers that a very long text needed."""
    for powers in (_BYTES, _WORDS):
        if len(powers.up) > _KEPT_POWERS:
            powers.up, powers.down = powers.up[:1].copy(), powers.down[:1].copy()


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then the same of the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes start[i] to end[i]."""
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


@dataclass
class Grid:
    """Words of several texts: text i has the words first[i] to first[i + 1], word j the bytes start[j] to end[j]."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.start, self.end)


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> Grid:
    """Words of texts that are the bytes bounds[i] to bounds[i + 1] of data."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    step = inside[1:] != inside[:-1]
    # A text's last and the next one's first byte never belong to one word.
    cut = bounds[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    both = cut[inside[cut] & inside[cut + 1]]
    edges = np.flatnonzero(step)
    if len(both):
        edges = np.sort(np.concatenate([edges, both, both]))
    start, end = edges[::2], edges[1::2]
    return Grid(data, np.searchsorted(start, bounds), start, end)


class Rolling:
    """Hashes of any runs of words of a grid."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _WORDS.upto(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)

    def windows(self, k: int) -> np.ndarray:
        """Of every k words in a row, those across two texts included."""
        n = max(0, len(self.total) - k)
        return mix((self.total[k:] - self.total[:n]) * self.down[:n] + np.uint64(k * int(_ODD) & (1 << 64) - 1))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    if len(v) < width:
        return v[:0]
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def within(grid: Grid, k: int) -> np.ndarray:
    """Starts of all runs of k words that lie in one text."""
    n = np.maximum(grid.counts - k + 1, 0)
    return ranges(grid.first[:-1], n)


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of parts of a string array; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(offsets, kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def take_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The bytes of some words, joined by one space each."""
    if not len(start):
        return b""
    length = end - start + 1
    at = ranges(start, length)
    last = np.cumsum(length) - 1
    out = data[np.minimum(at, len(data) - 1)]
    out[last] = 0x20
    return out[:-1].tobytes()
