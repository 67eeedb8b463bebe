"""A full-text index over integer symbols: suffix array, BWT in a wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends sorts before its extensions."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    k = 1
    while n > 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:]
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]])
        rank = new
        if rank.max() == n or k >= n:
            break
        k *= 2
    return order


class WaveletMatrix:
    """Rank and access over integers below 2**levels: a bit vector with prefix counts for each level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.n, self.levels = len(values), levels
        self.ones, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level & 1).astype(np.int64)
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        left, right = np.zeros(len(symbols), np.int64), upto.astype(np.int64)
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            bit = symbols >> level & 1 == 1
            left = np.where(bit, zeros + ones[left], left - ones[left])
            right = np.where(bit, zeros + ones[right], right - ones[right])
        return right - left

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and how often each occurs before its position."""
        out, right, left = np.zeros(len(at), np.int64), at.astype(np.int64), np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[right + 1] - ones[right] == 1
            left = np.where(bit, zeros + ones[left], left - ones[left])
            right = np.where(bit, zeros + ones[right], right - ones[right])
            out = out << 1 | bit
        return out, right - left


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 8):
        """text: non-negative integers; patterns must not hold the value 0, which marks ends of runs."""
        # One more 0 at the end, so that every suffix has a symbol before it in the cyclic order.
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_array(text)
        self.top = int(text.max())
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=self.top + 1))]
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, self.top.bit_length()))
        # Starts of runs are sampled too, so that no step back crosses a 0.
        kept = (order % sample == 0) | (bwt == 0)
        self.marked = np.r_[0, np.cumsum(kept)]
        self.samples = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of right-aligned patterns, one in each row, by backward search."""
        n, width = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.wavelet.n, np.int64)
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            c = patterns[live, width - 1 - step].astype(np.int64)
            fits = (c > 0) & (c <= self.top)
            hi[live[~fits]] = lo[live[~fits]]
            live, c = live[fits], c[fits]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back through the BWT to the next sampled position."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[rows[todo] + 1] > self.marked[rows[todo]]
            done = todo[hit]
            out[done] = self.samples[self.marked[rows[done]]] + steps
            todo = todo[~hit]
            c, before = self.wavelet.access(rows[todo])
            rows[todo] = self.before[c] + before
            steps += 1
        return out
