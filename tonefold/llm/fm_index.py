"""A compressed full-text index over numbers: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Suffixes are sorted by their first DEPTH symbols, enough for patterns of up to DEPTH. All operations work on arrays
of many patterns at once.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


def _ranked(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs."""
    return np.unique(first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64), return_inverse=True)[1]


class BitRank:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, BitRank]] = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, BitRank(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i comes to lie for the symbol at the lowest level; differences there are counts."""
        for shift, bits in self.levels:
            ones = bits.ones(i)
            i = np.where(symbol >> shift & 1, bits.zeros + ones, i - ones)
        return i


class Classes:
    """Runs of the suffix order whose suffixes share their first symbols: a bit where a run begins, with ranks, and the bounds of the runs."""

    def __init__(self, new: np.ndarray):
        self.begins = BitRank(new)
        self.bounds = np.append(np.flatnonzero(new), len(new)).astype(np.int32)

    def of(self, row: np.ndarray) -> np.ndarray:
        return self.begins.ones(row + 1) - 1


class FMIndex:
    """Kept: the transform in a wavelet matrix, two bit vectors with ranks, and one place for each run of suffixes that share `length` symbols."""

    def __init__(self, symbols: np.ndarray, size: int, length: int):
        """Symbols below size, 0 between the texts; for patterns of `length` symbols, more than 1 and at most DEPTH."""
        n = len(symbols)
        ranks, step = {1: symbols.astype(np.int64)}, 1
        while step < DEPTH:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = ranks[step][step:] + 1
            ranks[2 * step] = _ranked(ranks[step], ahead)
            step *= 2
        places = np.argsort(ranks[step], kind="stable")
        self.tree = WaveletMatrix(symbols[places - 1], size)
        every = np.arange(size)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])[:-1]
        self.base = smaller - self.tree.descend(every, np.zeros(size, np.int64))
        self.short = self._classes(ranks, places, length - 1)
        self.full = self._classes(ranks, places, length)
        self.earliest = np.minimum.reduceat(places, self.full.bounds[:-1]).astype(np.int32)

    @staticmethod
    def _classes(ranks: dict[int, np.ndarray], places: np.ndarray, depth: int) -> Classes:
        power = 1 << (depth.bit_length() - 1)
        n, head = len(places), ranks[power]
        tail = np.full(n, -1, np.int64)
        tail[: n - (depth - power)] = head[depth - power :]
        head, tail = head[places], tail[places]
        new = np.ones(n, bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        return Classes(new)

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with the symbol put in front."""
        at = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.base[symbol], 2)
        return at[: len(symbol)], at[len(symbol) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns less their last symbol, for patterns of full length."""
        c = self.short.of(low)
        return self.short.bounds[c].astype(np.int64), self.short.bounds[c + 1].astype(np.int64)

    def first_place(self, low: np.ndarray) -> np.ndarray:
        """Smallest place at which a full-length pattern with the interval from low begins."""
        return self.earliest[self.full.of(low)]


def repeats(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each text a flag for each window of `length` symbols: does it also begin at an earlier place (an earlier text, or earlier in this one)?

    The texts are streamed through the index of all of them from their ends, all in step; the matching statistic
    is held at `length`, so each step is one backward extension after dropping the last symbol.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    known, ids = np.unique(np.concatenate(texts), return_inverse=True)
    symbols = np.zeros(int(sizes.sum() + len(texts)), np.int64)
    symbols[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(texts)), sizes)] = ids + 1
    index = FMIndex(symbols, len(known) + 1, length)
    order = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(texts), np.int64), np.full(len(texts), len(symbols), np.int64)
    flags = np.zeros(len(symbols), bool)
    longest = sizes[order]
    for step in range(int(sizes.max())):
        active = order[: np.searchsorted(-longest, -step, "left")]
        at = starts[active] + sizes[active] - 1 - step
        lo, hi = low[active], high[active]
        if step >= length:
            lo, hi = index.shorten(lo)
        low[active], high[active] = lo, hi = index.backward(symbols[at], lo, hi)
        if step >= length - 1:
            flags[at] = index.first_place(lo) < at
    return [flags[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), sizes.tolist())]
