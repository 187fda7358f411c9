"""Elias-Fano code of a non-decreasing sequence: about 2.5 + log2(u / n) bits a value, with constant-time selection."""

from __future__ import annotations

import struct

import numpy as np

#: Of every so many ones of the upper bits the place of the first is stored.
SAMPLE = 64
_HEAD = struct.Struct("<QQQQ")


class EliasFano:
    """Values v[0] <= v[1] <= ... < 2**64. The low `width` bits of each are packed; the rest are in a bit vector in which value i
    is the one at place (v[i] >> width) + i. samples: the places of values 0, SAMPLE, 2 * SAMPLE, ..."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) and bool((v[1:] < v[:-1]).any()):
            raise ValueError("values must not decrease")
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        upper = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(upper[-1]) + 1 if n else 0, np.uint8)
        bits[upper] = 1
        low = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        kind = "<u4" if len(bits) < 1 << 32 else "<u8"
        return cls(n, width, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), upper[::SAMPLE].astype(kind))

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Values begin to end, from the sampled places around them: no other part of the code is read."""
        end = min(end, self.n)
        if begin >= end:
            return np.zeros(0, np.uint64)
        first, behind = begin // SAMPLE, -(-end // SAMPLE)
        at = int(self.samples[first])
        to = int(self.samples[behind]) if behind < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8 : -(-to // 8)], bitorder="little")[at % 8 :]) + at
        upper = ones[begin - first * SAMPLE :][: end - begin] - np.arange(begin, end)
        at, to = begin * self.width, end * self.width
        bits = np.unpackbits(self.low[at // 8 : -(-to // 8)], bitorder="little")[at % 8 :][: to - at].reshape(end - begin, self.width)
        lower = (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (upper.astype(np.uint64) << np.uint64(self.width)) | lower

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.width, len(self.high), self.samples.itemsize) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        """A view of the bytes; nothing is worked out again."""
        n, width, high, item = _HEAD.unpack_from(data)
        samples = -(-n // SAMPLE)
        at = _HEAD.size + samples * item
        return cls(n, width, np.frombuffer(data, np.uint8, -(-n * width // 8), at + high), np.frombuffer(data, np.uint8, high, at), np.frombuffer(data, f"<u{item}", samples, _HEAD.size))
