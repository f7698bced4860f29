"""An FM-index over passages of word ids, in numpy.

The text is a row of passages, each closed by a 0 that sorts before all words; of equal suffixes the earlier one
comes first, so stepping back from a suffix to the one before it is exact within a passage.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of a passage one suffix position is kept.
SAMPLE = 16


class RankBits:
    """How many ones a bit vector has before a position."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros(-(-self.n // 64) * 64 + 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)[:-1]]).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletTree:
    """Bits of the symbols from the highest down; at each level zeros go to the left half and ones to the right."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[RankBits] = []
        self.zeros: list[int] = []
        here = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (here >> level & 1).astype(bool)
            self.rows.append(RankBits(bits))
            self.zeros.append(len(here) - int(bits.sum()))
            here = np.concatenate([here[~bits], here[bits]])
        every = np.arange(sigma, dtype=np.int64)
        self.starts = self._down(every, np.zeros(sigma, dtype=np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            ones = row.rank(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._down(symbol, at) - self.starts[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            bit, ones = row.get(at), row.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.starts[symbol]


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions in the order of their suffixes, each suffix read up to the 0 that closes its passage."""
    n = len(text)
    width = max(1, int(sigma - 1).bit_length())
    packed = max(1, 62 // width)
    key, alive = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(packed):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: max(0, n - k)] = text[k:]
        symbol[~alive] = 0
        alive &= symbol != 0
        key = key << width | symbol
    order = np.argsort(key, kind="stable")
    have = packed
    while True:
        ordered = key[order]
        fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh) + 1
        if not alive.any() or int(rank.max()) == n:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: n - have] = rank[have:]
        after[~alive] = 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        further = np.zeros(n, dtype=bool)
        further[: n - have] = alive[have:]
        alive &= further
        have *= 2


class FMIndex:
    """text: int64 ids, every passage closed by 0; sigma: one more than the largest id."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        order = suffix_order(text, sigma)
        before = text[order - 1]
        before[order == 0] = 0
        self.n = n
        self.tree = WaveletTree(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma].astype(np.int64)
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept = RankBits(kept)
        self.samples = order[kept]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of the suffixes that start with each phrase; phrases are padded on the left."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.nonzero(lengths > 0)[0]
        high[lengths <= 0] = 0
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of rows: step back to a kept suffix and add the steps."""
        at, steps, found = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            hit = self.kept.get(here)
            done = open_[hit]
            found[done] = self.samples[self.kept.rank(at[done])] + steps[done]
            open_ = open_[~hit]
            if len(open_):
                symbol, before = self.tree.access_rank(at[open_])
                at[open_] = self.first[symbol] + before
                steps[open_] += 1
        return found
