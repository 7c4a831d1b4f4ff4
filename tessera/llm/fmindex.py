"""FM-index over integer sequences: sorted suffixes, wavelet-matrix ranks, backward search, sampled positions. All by arrays."""

from __future__ import annotations

import numpy as np

SAMPLED = 8  # every eighth position of the sequence is kept; others are reached by walking back


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s in order, by doubling the compared length."""
    n = len(s)
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step) - 1
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Bits:
    """A row of bits, 64 to a word, that tells how many ones lie before a place: a count a word and one popcount."""

    def __init__(self, ones: np.ndarray) -> None:
        raw = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(raw)] = raw
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Of a sequence of small non-negative integers; within, all are one larger, and a 0 of its own ends the sequence.

    Held: the wavelet matrix of the last column (a bit row a level), the first column's counts, and the position of
    every SAMPLED-th suffix with a bit row that tells which rows have one.
    """

    def __init__(self, s: np.ndarray) -> None:
        s = np.append(s + 1, 0)
        order = suffix_order(s)
        self.n, row = len(s), s[order - 1].astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])
        sampled = order % SAMPLED == 0
        self.sampled, self.position = Bits(sampled), order[sampled].astype(np.int32)
        self.levels = []
        for bit in reversed(range(max(1, int(s.max()).bit_length()))):
            ones = ((row >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(row) - ones.sum())))
            row = np.concatenate([row[~ones], row[ones]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before row i of the last column."""
        lo, hi = np.zeros_like(i), i
        for bit, ones, zeros in self.levels:
            up = (symbol >> bit) & 1 == 1
            a, b = ones.rank(lo), ones.rank(hi)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        """The symbols of rows i of the last column, read off the levels."""
        out = np.zeros_like(i)
        for bit, ones, zeros in self.levels:
            up, a = ones[i], ones.rank(i)
            out |= up.astype(np.int64) << bit
            i = np.where(up, zeros + a, i - a)
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For patterns of one length (a row each): which pattern, and where in the sequence, for every occurrence."""
        patterns = patterns.astype(np.int64) + 1
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        live = np.flatnonzero(patterns.max(1) < len(self.first) - 1)
        for column in reversed(range(patterns.shape[1])):
            c = patterns[live, column]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        counts = (hi - lo)[live]
        which = np.repeat(live, counts)
        rows = np.repeat(lo[live] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return which, self._positions(rows)

    def _positions(self, rows: np.ndarray) -> np.ndarray:
        found, walk, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(walk):
            here = self.sampled[rows]
            found[walk[here]] = (self.position[self.sampled.rank(rows[here])] + steps) % self.n
            walk, rows = walk[~here], rows[~here]
            c = self.symbol(rows)
            rows, steps = self.first[c] + self.rank(c, rows), steps + 1
        return found
