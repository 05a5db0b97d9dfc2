"""A compressed FM-index over sequences of words: the Burrows-Wheeler transform in a wavelet matrix with popcount ranks.

Suffixes are sorted by their first `depth` symbols at least, which is enough for patterns of that length; sorting takes log2(depth) doublings.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a count before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[BitVector] = []
        self.height = max(1, int(sigma - 1).bit_length())
        for level in reversed(range(self.height)):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(sigma)
        self.starts = self._down(np.zeros(sigma, dtype=np.int64), every)

    def _down(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        for bits, level in zip(self.levels, reversed(range(self.height)), strict=True):
            ones = bits.rank1(i)
            i = np.where(c >> level & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i symbols."""
        return self._down(i, c) - self.starts[c]


class FMIndex:
    """symbols: sequences of 1..sigma-1, each ended by 0."""

    def __init__(self, symbols: np.ndarray, sigma: int, depth: int = 16):
        n = len(symbols)
        rank, length = symbols.astype(np.int64), 1
        while length < depth:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - length)] = rank[length:] + 1
            _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
            length *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(symbols[self.suffixes - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that start with each row of patterns; empty if none does."""
        m = len(patterns)
        last = patterns[:, -1]
        both = np.concatenate([self.smaller[last], self.smaller[last + 1]])
        for k in range(patterns.shape[1] - 2, -1, -1):
            c = patterns[:, k]
            twice = np.concatenate([c, c])
            both = self.smaller[twice] + self.bwt.rank(twice, both)
        return both[:m], both[m:]


def matching_first(sequences: list[list], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each sequence, the least owner of a sequence that holds it: owners[k] is the owner of sequences[k].

    Each sequence is streamed against the index of all: backward search from each window's last word gives its matching
    statistic up to `window`; where that is reached, the interval of the match names all places of the same words.
    """
    names: dict = {}
    flat = np.fromiter((names.setdefault(x, len(names) + 1) for s in sequences for x in (*s, None)), dtype=np.int64)
    end = names[None]  # the end mark becomes symbol 0
    flat = np.where(flat == end, 0, np.where(flat > end, flat - 1, flat))
    lengths = np.fromiter((len(s) + 1 for s in sequences), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    index = FMIndex(flat, len(names), window)
    of = np.repeat(np.arange(len(sequences)), lengths)[index.suffixes]
    counts = np.maximum(lengths - window, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    if not len(at):
        return [np.empty(0, owners.dtype) for _ in sequences]
    low, high = index.search(flat[at[:, None] + np.arange(window)])
    # Windows of equal words have one interval, and different intervals don't overlap: one pass over the suffixes.
    unique, back = np.unique(low, return_inverse=True)
    stop = np.zeros(len(unique), dtype=np.int64)
    stop[back] = high
    by_suffix = np.append(owners[of], owners[:1])
    edges = np.stack([unique, stop], axis=1).ravel()
    least = np.minimum.reduceat(by_suffix, edges)[::2]
    return np.split(least[back], np.cumsum(counts)[:-1])
