"""Monotone sequences of whole numbers in Elias-Fano form, read in place from a buffer.

Of each value the low bits stand packed one after another; the high parts are a row of bits in which value i sets the
bit at its high part + i. A successor search looks at the few values of one high part alone. A directory of the high
parts is made when a sequence is opened; low bits stay packed.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Most low bits: with the 7 of an odd start they are within one unaligned read of 8 bytes.
_MOST_LOW = 56
_BLOCK = 1 << 16


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def encode(values: np.ndarray) -> bytes:
    """The bytes of a non-decreasing sequence of unsigned numbers, a multiple of 8 of them."""
    values = values.astype(U64)
    n = len(values)
    if not n:
        return np.zeros(4, U64).tobytes()
    low = min(_MOST_LOW, max(0, (int(values[-1]) // n).bit_length() - 1))
    shifts = np.arange(low, dtype=U64)
    lows = b"".join(np.packbits(((values[at : at + _BLOCK, None] >> shifts) & U64(1)).astype(np.uint8), bitorder="little").tobytes() for at in range(0, n, _BLOCK)) if low else b""
    ones = (values >> U64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1, np.uint8)
    bits[ones] = 1
    highs = np.packbits(bits, bitorder="little").tobytes()
    low_bytes, high_bytes = _padded(len(lows)) + 8, _padded(len(highs))
    return np.array([n, low, low_bytes, high_bytes], U64).tobytes() + lows.ljust(low_bytes, b"\0") + highs.ljust(high_bytes, b"\0")


class Sequence:
    """A sequence in a buffer from a place on; next is the place after it."""

    def __init__(self, buffer: memoryview, at: int):
        self.n, self.low, low_bytes, high_bytes = (int(v) for v in np.frombuffer(buffer, U64, 4, at))
        at += 32
        self.next = at + low_bytes + high_bytes
        self.mask = U64((1 << self.low) - 1)
        if self.n:
            self.lows = np.ndarray(low_bytes - 7, "<u8", buffer, at, (1,))
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(buffer, np.uint8, high_bytes, at + low_bytes), bitorder="little"))
            self.highs = ones - np.arange(self.n)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return (self.lows[bit >> 3] >> (bit & 7).astype(U64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i."""
        return self.highs[i].astype(U64) << U64(self.low) | self._low(i) if self.low else self.highs[i].astype(U64)

    def find(self, begin: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) that holds x, for each; -1 where none does."""
        if not self.n:
            return np.full(len(x), -1)
        high = (x >> U64(self.low)).astype(np.int64)
        lo = np.maximum(begin, np.searchsorted(self.highs, high, "left"))
        hi = top = np.minimum(end, np.searchsorted(self.highs, high, "right"))
        want = x & self.mask
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < want[open_]
            lo[open_[less]] = middle[less] + 1
            hi = hi.copy() if hi is top else hi
            hi[open_[~less]] = middle[~less]
        found = np.full(len(x), -1)
        some = np.flatnonzero(lo < top)
        some = some[self._low(lo[some]) == want[some]]
        found[some] = lo[some]
        return found
