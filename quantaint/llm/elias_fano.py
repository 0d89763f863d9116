"""Elias-Fano codes of non-decreasing integers with a select structure.

A value splits into ``low_bits`` low bits, stored side by side, and a high part,
stored in unary: value i sets bit ``high + i``. That takes about 2 + log2(u / n)
bits a value. ``select`` finds the i-th set bit from a sample of every 64th
position (32-bit), so no table of 64-bit offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<QQBIII")
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples):
        self.n, self.low_bits = n, low_bits
        self._low, self._high, self._samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing integers from 0 on."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if n == 0:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, np.uint32))
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must be non-negative and must not decrease")
        low_bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8), bitorder="little")
        places = (values >> low_bits) + np.arange(n)
        if places[-1] >= 1 << 32:
            raise ValueError("too many values for 32-bit samples; use more files")
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low, high, places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value number ``i``: jump to the sample before it, then count set bits by bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self._samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place // 8
        word = int(self._high[byte]) >> (place % 8) << (place % 8)
        while (ones := int(_ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self._high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low_part(i)

    def _low_part(self, i: int) -> int:
        if self.low_bits == 0:
            return 0
        first = i * self.low_bits
        last = first + self.low_bits
        chunk = int.from_bytes(self._low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return chunk >> (first % 8) & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))
        values = (places - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self._low, bitorder="little", count=self.n * self.low_bits)
            weights = 1 << np.arange(self.low_bits, dtype=np.int64)
            values |= bits.reshape(self.n, self.low_bits) @ weights
        return values

    def to_bytes(self) -> bytes:
        parts = (self._low.tobytes(), self._high.tobytes(), self._samples.astype("<u4").tobytes())
        head = _HEAD.pack(self.n, 0, self.low_bits, *map(len, parts))
        return head + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        n, _, low_bits, *sizes = _HEAD.unpack_from(data)
        parts, at = [], _HEAD.size
        for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(data[at : at + size], dtype=kind))
            at += size
        return cls(n, low_bits, *parts)
