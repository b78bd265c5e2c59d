"""An FM-index over runs of word numbers: suffix order, wavelet tree, backward search, location.

All steps work on whole arrays: every phrase of one length is searched at once, and every
occurrence is located at once.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """A level-wise wavelet tree (zeros before ones at each level, from the highest bit)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.depth, self.levels, self.zeros = max(1, int(largest).bit_length()), [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(BitRank(bits))
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at`` symbols, for arrays of both."""
        start = np.zeros_like(at)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            low, high = bits.ones(start), bits.ones(at)
            start, at = np.where(one, zeros + low, start - low), np.where(one, zeros + high, at - high)
        return at - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it comes before."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, low, high = bits.get(at), bits.ones(start), bits.ones(at)
            start, at = np.where(one, zeros + low, start - low), np.where(one, zeros + high, at - high)
            symbol = symbol * 2 + one
        return symbol, at - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling. Each 0 ends a run and differs from all other 0s."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        sorted_ranks = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.concatenate(([0], np.cumsum(sorted_ranks[1:] != sorted_ranks[:-1])))
        if n == 0 or dense[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = dense[step:] + 1
        rank, step = dense * (n + 1) + ahead, step * 2
        order = np.argsort(rank, kind="stable")


class FMIndex:
    """Over ``symbols``: runs of numbers from 1 up, each run followed by a 0."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        symbols = symbols.astype(np.int64)
        order, largest = suffix_order(symbols), int(symbols.max(initial=0))
        before = symbols[order - 1]
        self.tree = WaveletTree(before, largest)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1))))
        starts = np.concatenate(([True], symbols[:-1] == 0)) if len(symbols) else np.zeros(0, bool)
        sampled = (np.arange(len(symbols)) % sample == 0) | starts  # run starts too, so no walk leaves its run
        kept = sampled[order]
        self.marked, self.places, self.largest = BitRank(kept), order[kept], largest

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases of one length (one in each row), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = np.minimum(phrases[:, k], self.largest)
            absent = phrases[:, k] > self.largest
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = np.where(absent, low, self.first[symbol] + self.tree.rank(symbol, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step backwards until a sampled row is met."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            found = self.marked.get(at)
            out[left[found]] = self.places[self.marked.ones(at[found])] + steps[left[found]]
            left, at = left[~found], at[~found]
            if len(left):
                symbol, rank = self.tree.access(at)
                at = self.first[symbol] + rank
                steps[left] += 1
        return out
