"""64-bit names of the words of many texts at once, from their bytes, without a Python object for a word.

A word's name is the sum of its letters' values times powers of an odd base, taken as a difference of one running sum over the batch; the power of the word's place divides out, so that a word has the
same name wherever it stands. Words end at U+0020 and U+0009 to U+000D. Time is linear in the bytes and working memory is bounded by ``CHUNK_BYTES`` or one word, whichever is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed together.
CHUNK_BYTES = 1 << 20

_MIX, _LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def powers_of(base: int, n: int) -> np.ndarray:
    t = np.full(n, np.uint64(base & ((1 << 64) - 1)))
    t[:1] = 1
    return np.cumprod(t, dtype=np.uint64)


class Words:
    """``fold``: A-Z count as a-z."""

    def __init__(self, fold: bool):
        pick = np.random.default_rng(20)
        self.letter = pick.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.letter[65:91] = self.letter[97:123]
        self.word = np.ones(256, bool)
        self.word[[9, 10, 11, 12, 13, 32]] = False
        self.base = int(pick.integers(0, 2**60)) * 8 + 5
        self.power, self.inverse = np.ones(0, np.uint64), np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, CHUNK_BYTES + 1)
            self.power, self.inverse = powers_of(self.base, n), powers_of(pow(self.base, -1, 1 << 64), n)

    def _cuts(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Chunks that end with a text, or within a long one before a blank."""
        at, last = int(ends[0]), int(ends[-1])
        while at < last:
            cut = int(ends[np.searchsorted(ends, at + CHUNK_BYTES, side="right") - 1])
            if cut <= at:
                whole = cut = int(ends[np.searchsorted(ends, at, side="right")])
                for begin in range(at + CHUNK_BYTES, whole, CHUNK_BYTES):
                    blank = np.flatnonzero(~self.word[data[begin : min(begin + CHUNK_BYTES, whole)]])
                    if len(blank):
                        cut = begin + int(blank[0])
                        break
            yield at, cut
            at = cut

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The names of the words of all texts in a row (a null text has none), and the bounds of each text among them."""
        texts = pc.fill_null(column, "").cast(pa.large_binary())
        if not len(texts):
            return np.zeros(0, np.uint64), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in self._cuts(data, offsets):
            d = data[a:b]
            self._grow(len(d) + 1)
            inside = self.word[d]
            edge = offsets[(offsets > a) & (offsets < b)] - a
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
            s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            upto = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(self.letter[d] * self.power[: len(d)], out=upto[1:])
            found.append(mixed((upto[e] - upto[s]) * self.inverse[s] + (e - s).astype(np.uint64) * _LENGTH))
            places.append(s + a)
        return np.concatenate(found), np.searchsorted(np.concatenate(places), offsets)


def rolled(v: np.ndarray, n: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """Name of the ``n`` words from each position on that has them."""
    out = np.zeros(max(len(v) - n + 1, 0), np.uint64)
    for j in range(n):
        out *= np.uint64(base)
        out += v[j : len(v) - n + 1 + j]
    return mixed(out)
