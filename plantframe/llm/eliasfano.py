"""Elias-Fano sequences: non-decreasing whole numbers in about two bits and the logarithm of the mean gap each.

The low bits of a number stand in a packed array; the high ones are counted in unary in a bit vector, for which the
ones before each 64-bit word are kept. Both are read in place, from memory or from a mapped file.
"""

from __future__ import annotations

import numpy as np

_COUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _select_table() -> np.ndarray:
    """Place of the r-th one of each byte."""
    table = np.zeros((256, 8), np.uint8)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(places)] = places
    return table


_PLACE = _select_table()


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one of each rank (from 0) in each word."""
    parts = words.astype("<u8").view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_COUNT[parts], axis=1, dtype=np.int64)
    byte = (upto <= rank[:, None]).sum(axis=1)
    row = np.arange(len(words))
    before = np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
    return byte * 8 + _PLACE[parts[row, byte], rank - before]


class EliasFano:
    """``arrays`` are what a file holds: [number of values, low bits], low words, high words, ones before each word."""

    def __init__(self, arrays: list[np.ndarray]):
        self.head, self.low, self.high, self.before = arrays
        self.n, self.width = int(self.head[0]), int(self.head[1])

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) // 64 + 1 if n else 0) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64)).astype(np.uint64)
        return EliasFano([np.array([n, width], np.uint64), low, high, before])

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.before]

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        low = self.low[word] >> shift
        over = shift + np.uint64(self.width) > 64
        low[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return low & np.uint64((1 << self.width) - 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at some places."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.uint64)
        word = np.searchsorted(self.before, index.astype(np.uint64), "right") - 1
        ones = word * 64 + _in_word(self.high[word], index - self.before[word].astype(np.int64))
        return (ones - index).astype(np.uint64) << np.uint64(self.width) | self._lows(index)

    def _zeros(self, rank: np.ndarray) -> np.ndarray:
        """Places in the high bits of the zeros of some ranks (from 0); behind all bits if there is none."""
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before.astype(np.int64) if not hasattr(self, "zeros") else self.zeros
        self.zeros = zeros
        word = np.searchsorted(zeros, rank, "right") - 1
        out = np.full(len(rank), len(self.high) * 64, np.int64)
        real = word < len(self.high)
        out[real] = word[real] * 64 + _in_word(~self.high[word[real]], rank[real] - zeros[word[real]])
        return out

    def find(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, within ``[low, high)`` if given, or -1: the successor search of the sequence."""
        values = np.asarray(values, np.uint64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        bucket = (values >> np.uint64(self.width)).astype(np.int64)
        begin = np.where(bucket > 0, self._zeros(np.maximum(bucket - 1, 0)) - np.maximum(bucket - 1, 0), 0)
        end = self._zeros(bucket) - bucket
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        if low is not None:
            begin, end = np.maximum(begin, low), np.minimum(end, high)
        want = values & np.uint64((1 << self.width) - 1)
        # halve the ranges until the first place that is not below the value
        stop = end.copy()
        on = np.flatnonzero(begin < end)
        while len(on):
            middle = (begin[on] + end[on]) >> 1
            less = self._lows(middle) < want[on]
            begin[on] = np.where(less, middle + 1, begin[on])
            end[on] = np.where(less, end[on], middle)
            on = on[begin[on] < end[on]]
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(begin < stop)
        hit = inside[self._lows(begin[inside]) == want[inside]]
        out[hit] = begin[hit]
        return out
