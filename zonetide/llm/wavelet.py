"""A wavelet matrix: a sequence of small codes, kept as bit levels that answer rank queries."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        words = np.zeros(len(flags) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words.astype("<u8", copy=False)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones among the first ``at`` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Codes below ``2 ** bits``. Each level stores one bit of every code, the highest first; between levels the
    codes are sorted stably by that bit, zeros before ones. A level takes a quarter of a byte a code."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.size, self.levels, self.zeros = len(codes), [], []
        for bit in reversed(range(bits)):
            flags = (codes >> bit & 1).astype(bool)
            self.levels.append(_Bits(flags))
            self.zeros.append(int(len(codes) - flags.sum()))
            codes = np.concatenate((codes[~flags], codes[flags]))

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` codes equal ``code``, for each of the places ``at``."""
        start, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            if code >> (len(self.levels) - 1 - depth) & 1:
                start, end = zeros + level.ones(start), zeros + level.ones(end)
            else:
                start, end = start - level.ones(start), end - level.ones(end)
        return end - start

    def rank_of(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` codes are one of ``codes``."""
        return sum(self.rank(code, at) for code in codes)

    def select_of(self, codes: tuple[int, ...], number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place from ``low`` on with ``number`` of ``codes`` before it, by bisection on ranks.
        Up to ``high`` there must be as many."""
        low, high = np.asarray(low, np.int64).copy(), np.asarray(high, np.int64).copy()
        while (low < high).any():
            middle = (low + high) >> 1
            enough = self.rank_of(codes, middle) >= number
            high = np.where(enough, middle, high)
            low = np.where(enough, low, np.minimum(middle + 1, high))
        return low
