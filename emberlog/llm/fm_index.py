"""An FM-index over integer symbols: wavelet-tree ranks and sampled suffix positions.

All operations take arrays, so that many patterns or rows advance together.
"""

from __future__ import annotations

import numpy as np

ONE, MASK = np.uint64(1), np.uint64(63)


class BitRanks:
    """A bit vector that counts the ones before any position."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        words = np.zeros((self.size >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (ONE << (i.astype(np.uint64) & MASK)) - ONE
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i.astype(np.uint64) & MASK)) & ONE == ONE


class WaveletTree:
    """Ranks and access over a sequence of symbols, as one bit vector per binary digit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[BitRanks, int]] = []
        self.shifts = list(range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1))
        rest = symbols
        for shift in self.shifts:
            bits = (rest >> shift) & 1 == 1
            self.levels.append((BitRanks(bits), int(len(bits) - bits.sum())))
            rest = np.concatenate([rest[~bits], rest[bits]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, (bits, zeros) in zip(self.shifts, self.levels):
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before position i."""
        return self._down(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c = (c << 1) | one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Only suffixes that still tie are sorted again;
    every symbol that ends a segment must be unique, so that ties end."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    ordered = ranks[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = ~(new & np.concatenate([new[1:], [True]]))
    slots, step = np.flatnonzero(tied), 1
    while len(slots):
        own = order[slots]
        key = rank[own] * np.int64(n + 1) + rank[own + step]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[own] = slots[head]
        slots = slots[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return order


class FMIndex:
    """Index of segments of symbols 1..sigma-1. ``text`` holds the segments, each ended by a 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        self.size = n = len(text)
        ends = text == 0
        ranks = text.astype(np.int64) + int(ends.sum()) - 1
        ranks[ends] = np.arange(int(ends.sum()))
        order = suffix_array(ranks)
        last = text[order - 1]
        self.tree = WaveletTree(last, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.less = np.cumsum(counts) - counts
        # a walk to the left never has to pass the start of a segment
        kept = (order % sample == 0) | (last == 0)
        self.sampled, self.positions = BitRanks(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the suffixes that begin with each pattern; patterns are right-aligned rows."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for back in range(1, width + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])] if back > 1 else live[lengths[live] >= back]
            if not len(live):
                break
            c = patterns[live, width - back]
            low[live] = self.less[c] + self.tree.rank(c, low[live])
            high[live] = self.less[c] + self.tree.rank(c, high[live])
        high = np.where(lengths > 0, np.maximum(low, high), low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking left to a sampled row."""
        found, rows, at = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        walked = 0
        while len(at):
            done = self.sampled.get(rows)
            found[at[done]] = self.positions[self.sampled.rank(rows[done])] + walked
            at, rows = at[~done], rows[~done]
            c, before = self.tree.access(rows)
            rows = self.less[c] + before
            walked += 1
        return found
