"""An FM-index over integer symbols in arrays: suffix array, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of symbols below `sigma` whose last is a unique, least 0; by prefix doubling of unsettled groups."""
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.zeros(n + width, np.int64)
    padded[:n] = text
    for k in range(width):
        key = (key << bits) | padded[k : n + k]
    sa = np.argsort(key)
    key = key[sa]
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    group = np.maximum.accumulate(np.where(new, at, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = group
    alone = new & np.append(new[1:], True)
    open_ = np.flatnonzero(~alone)
    h = width
    while len(open_):
        s = sa[open_]
        pair = group[open_] * n + rank[np.minimum(s + h, n - 1)]
        order = np.argsort(pair)
        s, pair = s[order], pair[order]
        sa[open_] = s
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        group[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[s] = group[open_]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each word."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.words = np.zeros(len(flags) // 64 + 2, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FmIndex:
    """Counts and places of patterns in a text of symbols from 1 to sigma - 1."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text, sigma)
        self.n, self.bwt = len(text), text[sa - 1].astype(np.int32)
        counts = np.bincount(text, minlength=sigma)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sampled = sa % every == 0
        self.marks, self.places = Bits(sampled), sa[sampled]
        self.levels: list[tuple[int, Bits, int]] = []
        row = self.bwt
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(row) - np.count_nonzero(ones))))
            row = np.concatenate([row[~ones], row[ones]])
        self.base = np.zeros(sigma, np.int64)
        self.base = first - self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            r = ones.rank(i)
            i = np.where(c >> bit & 1, zeros + r, i - r)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows that begin with c among the rows before i, put behind all rows that begin with less."""
        return self.base[c] + self._down(c, i)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each pattern (a row of symbols), from the last symbol backwards."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            ends = self.step(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = ends[: len(c)], ends[len(c) :]
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            here = rows[left]
            found = self.marks.get(here)
            out[left[found]] = self.places[self.marks.rank(here[found])] + steps
            left = left[~found]
            here = here[~found]
            rows[left] = self.step(self.bwt[here].astype(np.int64), here)
            steps += 1
        return out
