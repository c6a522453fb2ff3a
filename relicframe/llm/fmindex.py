"""An FM-index over word sequences: count and locate phrases by backward search.

The index holds many sequences, each ended by a mark of its own, as one Burrows-Wheeler
transform in a wavelet matrix over packed bits. A phrase is searched from its last
word to its first, each step narrowing a range of suffixes by two ranks; places come from
every SAMPLE-th suffix position, other suffixes walk back to one. All steps
take arrays of phrases or suffixes at once.
"""

from __future__ import annotations

import numpy as np

#: Of the positions of a sequence, each SAMPLE-th and the first keep their suffix position.
SAMPLE = 8


class Bits:
    """Packed bits with ranks."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Symbols by bit planes, highest first, each plane stably parted by the plane above."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.planes: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bits = (symbols >> shift & 1).astype(bool)
            plane = Bits(bits)
            self.planes.append((shift, plane, len(symbols) - plane.ones))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        everything = np.arange(alphabet)
        self.first = self._down(everything, np.zeros(alphabet, np.int64))

    def _down(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, plane, zeros in self.planes:
            ones = plane.rank(i)
            i = np.where(symbols >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Places before i that hold the symbol."""
        return self._down(symbols, i) - self.first[symbols]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, places before i that hold it)."""
        symbols = np.zeros(len(i), np.int64)
        for shift, plane, zeros in self.planes:
            ones, bit = plane.rank(i), plane.get(i)
            symbols |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + ones, i - ones)
        return symbols, i - self.first[symbols]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; 0 ends a sequence, and equal endings go by position.

    Prefix doubling: what is told apart stays in its place, and only groups of equal
    prefixes are sorted again.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words before the mark
    bits = max(1, int(symbols.max()).bit_length())
    width = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([symbols, np.zeros(width, np.int64)])
    for i in range(width):
        key = key << bits | np.where(left > i, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    known = width
    while True:
        # groups of two or more whose members go on beyond what is known
        edges = np.flatnonzero(np.concatenate([fresh, [True]]))
        sizes = np.diff(edges)
        at = np.flatnonzero((np.repeat(sizes, sizes) > 1) & (left[order] >= known))
        if not at.size:
            return order
        where = order[at]
        # a group's members all go on, or have all ended: equal prefixes hold equal marks
        sub = np.lexsort((where, ranks[np.minimum(where + known, n - 1)], ranks[where]))
        where = where[sub]
        order[at] = where
        own, following = ranks[where], ranks[np.minimum(where + known, n - 1)]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (following[1:] != following[:-1])])
        fresh[at] = new
        ranks[where] = np.maximum.accumulate(np.where(new, at, 0))
        known *= 2


class FmIndex:
    """Index of word sequences: symbols 1 .. alphabet - 1, each sequence ended by 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        symbols = symbols.astype(np.int64)
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the first position follows the last mark
        self.size, self.alphabet = len(symbols), alphabet
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.bwt = WaveletMatrix(before, alphabet)
        kept = (before == 0) | (order % SAMPLE == 0)
        self.sampled, self.samples = Bits(kept), order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the suffixes that begin with each phrase, a row of symbols at the left; symbol 0 is in no sequence."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not live.size:
                break
            symbols = phrases[live, lengths[live] - back]
            ranks = self.bwt.rank(np.concatenate([symbols, symbols]), np.concatenate([low[live], high[live]]))
            found = symbols > 0
            low[live] = np.where(found, self.starts[symbols] + ranks[: len(live)], 0)
            high[live] = np.where(found, self.starts[symbols] + ranks[len(live) :], 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, given by their rows."""
        out, steps, at, todo = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while todo.size:
            known = self.sampled.get(at)
            out[todo[known]] = self.samples[self.sampled.rank(at[known])] + steps
            at, todo = at[~known], todo[~known]
            if todo.size:
                symbols, ranks = self.bwt.access(at)
                at = self.starts[symbols] + ranks
            steps += 1
        return out

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of all places of all phrases."""
        low, high = self.ranges(phrases, lengths)
        counts = high - low
        which = np.repeat(np.arange(len(phrases)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, self.locate(low[which] + inside)
