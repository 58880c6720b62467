"""Elias-Fano sequences over numpy arrays: a sorted list of n numbers below u in about ``2 + log2(u / n)`` bits each, with vectorised access and search.

Each number's low bits are packed; its high part is a unary bit vector with a count of ones for every word of 64 bits. The arrays can be memory maps.
"""

from __future__ import annotations

import numpy as np

_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of each set bit in each byte, by rank; 8 beyond the last.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64).ravel()


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after another, in words of 64 bits (and one spare)."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    if not width or not n:
        return out
    at = np.arange(n, dtype=np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    np.bitwise_or.at(out, word, values << bit)
    over = np.flatnonzero(bit.astype(np.int64) + width > 64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out


def _unpack(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = packed[word] >> bit
    high = np.where(bit > 0, packed[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
    return (low | high) & (_ALL >> np.uint64(64 - width))


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with the given rank within each word: the running counts of its bytes, side by side in one word, tell the byte, a table the bit."""
    x = words - ((words >> _ONE) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    rank = rank.astype(np.uint64)
    shift = np.bitwise_count(((rank * _BYTES) | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)
    left = rank - ((upto << np.uint64(8)) >> shift & np.uint64(0xFF))
    return shift.astype(np.int64) + _IN_BYTE[((words >> shift & np.uint64(0xFF)) << np.uint64(3) | left).astype(np.int64)]


class EliasFano:
    """``n`` sorted numbers. ``parts`` are the arrays to store: low, high, ones."""

    def __init__(self, n: int, width: int, top: int, parts: dict[str, np.ndarray]):
        self.n, self.width, self.top = n, width, top
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self._zeros: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict[str, int], dict[str, np.ndarray]]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return {"n": 0, "width": 0, "top": 0}, {"low": np.zeros(1, np.uint64), "high": np.zeros(1, np.uint64), "ones": np.zeros(2, np.uint32)}
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = values & np.uint64((1 << width) - 1)
        upper = (values >> np.uint64(width)).astype(np.int64)
        top = int(upper[-1])
        at = upper + np.arange(n)
        words = np.zeros(-(-(n + top + 1) // 64), np.uint64)
        w = at >> 6
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        words[w[first]] = np.bitwise_or.reduceat(_ONE << (at & 63).astype(np.uint64), first)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.uint32 if 64 * len(words) < 1 << 32 else np.uint64)
        return {"n": n, "width": width, "top": top}, {"low": _pack(low, width), "high": words, "ones": ones}

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        meta, parts = cls.encode(values)
        return cls(meta["n"], meta["width"], meta["top"], parts)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        if ones:
            counts = self.ones
        else:
            if self._zeros is None:
                self._zeros = (np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones).astype(self.ones.dtype)
            counts = self._zeros
        rank = rank.astype(counts.dtype)
        word = np.searchsorted(counts, rank, side="right") - 1
        bits = self.high[word]
        return word * 64 + _in_word(bits if ones else ~bits, rank - counts[word])

    def _next(self, at: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the next set (or clear) bit after each place; there is one."""
        word, out = (at + 1) >> 6, np.empty(len(at), np.int64)
        mask = _ALL << ((at + 1) & 63).astype(np.uint64)
        todo = np.arange(len(at))
        while len(todo):
            w = self.high[word]
            w = (w if ones else ~w) & mask
            hit = w != 0
            lowest = w[hit]
            out[todo[hit]] = word[hit] * 64 + np.bitwise_count((lowest & (~lowest + _ONE)) - _ONE)
            todo, word = todo[~hit], word[~hit] + 1
            mask = _ALL
        return out

    def access_pairs(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at each index and at the one after it."""
        at = self._select(index, True)
        both = []
        for i, place in ((index, at), (index + 1, self._next(at, True) if len(at) else at)):
            both.append(((place - i).astype(np.uint64) << np.uint64(self.width) | _unpack(self.low, i, self.width)).astype(np.int64))
        return both[0], both[1]

    def access(self, index: np.ndarray) -> np.ndarray:
        index = np.asarray(index, np.int64)
        upper = (self._select(index, True) - index).astype(np.uint64)
        return upper << np.uint64(self.width) | _unpack(self.low, index, self.width)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value by successor search, within [begin, end) where given; -1 where it is absent."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        upper = (values >> np.uint64(self.width)).astype(np.int64)
        todo = np.flatnonzero(upper <= self.top) if self.n else np.zeros(0, np.int64)
        if not len(todo):
            return out
        h, low = upper[todo], values[todo] & np.uint64((1 << self.width) - 1)
        before = np.where(h > 0, self._select(np.maximum(h - 1, 0), False), -1)
        start = before - (h - 1)  # numbers whose high part is below h
        stop = self._next(before, False) - h
        if begin is not None:
            start, stop = np.maximum(start, begin[todo]), np.minimum(stop, end[todo])
        last = stop.copy()
        while True:  # the first place in [start, stop) whose low bits are not below
            open_ = np.flatnonzero(start < stop)
            if not len(open_):
                break
            middle = (start[open_] + stop[open_]) >> 1
            below = _unpack(self.low, middle, self.width) < low[open_]
            start[open_] = np.where(below, middle + 1, start[open_])
            stop[open_] = np.where(below, stop[open_], middle)
        hit = np.flatnonzero(start < last)
        hit = hit[_unpack(self.low, start[hit], self.width) == low[hit]]
        out[todo[hit]] = start[hit]
        return out
