"""FM-index of a bounded shard of word numbers: suffix order, wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of all suffixes in order. The last symbol must be 0 and occur nowhere else; others need ``bits`` bits."""
    n, packed = len(symbols), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        if j < n:
            key[: n - j] |= symbols[j:]
    order = np.argsort(key, kind="stable")
    head = np.empty(n, bool)
    head[:1], head[1:] = True, key[order][1:] != key[order][:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = packed
    while True:
        tail = np.append(head[1:], True)
        open_ = np.flatnonzero(~(head & tail))  # places in groups of several suffixes
        if not len(open_):
            return order
        these = order[open_]
        group, after = rank[these], rank[np.minimum(these + step, n)]
        by = np.lexsort((after, group))
        these, group, after = these[by], group[by], after[by]
        order[open_] = these
        new = np.empty(len(these), bool)
        new[:1], new[1:] = True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[open_] = new
        rank[these] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class WaveletMatrix:
    """Rank and access on a sequence of small numbers, one bit plane after the other."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.planes = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
            self.planes.append((level, ones, len(sequence) - int(ones[-1])))
            sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.planes:
            up = ((symbol >> level) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start, end = np.where(up, zeros + s, start - s), np.where(up, zeros + e, end - e)
        return end - start

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol, start, end = np.zeros_like(place), np.zeros_like(place), place
        for level, ones, zeros in self.planes:
            up = ones[end + 1] - ones[end] == 1
            symbol = symbol | np.where(up, 1 << level, 0)
            s, e = ones[start], ones[end]
            start, end = np.where(up, zeros + s, start - s), np.where(up, zeros + e, end - e)
        return symbol, end - start


class FMIndex:
    """Index of a sequence of numbers >= 1; every ``sampled``-th position is kept for locating."""

    def __init__(self, sequence: np.ndarray, sampled: int = 16):
        symbols = np.append(sequence.astype(np.int64), 0)
        bits = max(1, int(symbols.max()).bit_length())
        order = suffix_order(symbols, bits)
        self.size, self.largest = len(symbols), int(symbols.max())
        self.tree = WaveletMatrix(symbols[order - 1], bits)  # the last column; position 0 is preceded by the end sign
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=(1 << bits) + 1))))
        kept = order % sampled == 0
        self.kept_before = np.concatenate(([0], np.cumsum(kept)))
        self.kept_at = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; phrases stand right-aligned in a matrix and are read from their last word to their first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.where(phrases.max(axis=1, initial=0) > self.largest, 0, self.size)  # a word that the shard lacks
        width = phrases.shape[1]
        for k in range(int(lengths.max(initial=0))):
            at = np.flatnonzero((lengths > k) & (low < high))
            if not len(at):
                break
            symbol = phrases[at, width - 1 - k].astype(np.int64)
            low[at] = self.before[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.tree.rank(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back until a sampled row."""
        found, steps = np.empty(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            kept = self.kept_before[rows + 1] - self.kept_before[rows] == 1
            found[todo[kept]] = self.kept_at[self.kept_before[rows[kept]]] + steps
            todo, rows = todo[~kept], rows[~kept]
            symbol, rank = self.tree.access(rows)
            rows, steps = self.before[symbol] + rank, steps + 1
        return found
