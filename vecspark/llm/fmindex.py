"""An FM-index over short word sequences, for patterns of a fixed length.

The sequences lie end to end, each with a terminator. Suffixes are sorted by prefix doubling to the depth of
the patterns, whatever it is; the last step overlaps. The Burrows-Wheeler transform is kept in
a wavelet matrix (one bit vector a level of the alphabet, with a count every 64 bits); backward search
advances many patterns at once.
"""

from __future__ import annotations

import numpy as np

class WaveletMatrix:
    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.n, self.levels = len(seq), max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (seq >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bits) - bits.sum()))
            seq = np.concatenate([seq[~bits], seq[bits]])
        self.base = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            word, off = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << off) - np.uint64(1)
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & mask)
            at = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, at) - self.base[symbol]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    new = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    rank = np.empty(len(keys), np.int64)
    rank[order] = new
    return rank, order


class FMIndex:
    """Over sequences of symbols (1..n) with a value each; patterns have `length` symbols."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, values: np.ndarray, length: int):
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = flat
        self.length, n = length, len(text)
        self.n_symbols = int(text.max()) + 1
        # Ranks by the first 1, 2, 4, ... and at last `length` symbols.
        rank, order = _ranked(text)
        depth, ranks = 1, [(1, rank)]
        while depth < length:
            step = min(depth, length - depth)
            after = np.full(n, -1, np.int64)
            after[:-step] = rank[step:]
            rank, order = _ranked(rank * (n + 1) + after + 1)
            depth += step
            ranks.append((depth, rank))
        self.bwt = WaveletMatrix(text[order - 1], self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        # Groups of suffixes that agree on their first `length` (and length - 1) symbols.
        full, short = (self._group(ranks, order, d) for d in (length, length - 1))
        self.group = np.cumsum(full) - 1
        owner = np.repeat(values, sizes + 1)[order]
        self.least = np.minimum.reduceat(owner, np.flatnonzero(full))
        at = np.flatnonzero(short)
        which = np.cumsum(short) - 1
        self.low, self.high = at[which], np.append(at[1:], n)[which]

    @staticmethod
    def _group(ranks: list[tuple[int, np.ndarray]], order: np.ndarray, depth: int) -> np.ndarray:
        """True where a suffix, in order, differs from the one before within `depth` symbols."""
        n = len(order)
        new = np.zeros(n, bool)
        new[0] = True
        if depth:
            h, rank = next((h, r) for h, r in reversed(ranks) if h <= depth)
            for at in {0, depth - h}:
                key = np.append(rank, np.full(at, -1))[order + at]
                new[1:] |= key[1:] != key[:-1]
        return new

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: from the interval of P to that of symbol P, which occurs (so a single place stays single)."""
        wide = np.flatnonzero(high > low + 1)
        both = self.bwt.rank(np.concatenate([symbol, symbol[wide]]), np.concatenate([low, high[wide]]))
        start = self.first[symbol]
        low = start + both[: len(low)]
        high = low + 1
        high[wide] = start[wide] + both[len(low) :]
        return low, high

    def least_values(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each window of the pattern length in each (indexed) sequence, in order, the least value that holds it.

        Matching statistics from right to left: once a window of full length matches, it gives up its last
        symbol (the interval of its group one shorter) and takes the symbol before it.
        """
        n, k = len(sizes), self.length
        low, high = np.zeros(n, np.int64), np.full(n, self.bwt.n, np.int64)
        counts = sizes - k + 1
        place = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(place[-1]), np.int64)
        order = np.argsort(-sizes, kind="stable")
        for t in range(int(sizes.max())):
            live = order[: int(np.searchsorted(-sizes[order], -t))]
            lo, hi = low[live], high[live]
            if t >= k:
                lo, hi = self.low[lo], self.high[lo]
            lo, hi = self.step(flat[starts[live] + sizes[live] - 1 - t], lo, hi)
            low[live], high[live] = lo, hi
            if t >= k - 1:
                out[place[live] + sizes[live] - 1 - t] = self.least[self.group[lo]]
        return out
