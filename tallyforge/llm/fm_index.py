"""FM-index over an integer text: suffix order by prefix doubling, ranks by a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in sorted order. A zero ends a run and counts as a letter of its own, the earlier the smaller."""
    n = len(text)
    key = text.astype(np.int64)
    ends = np.flatnonzero(text == 0)
    key += len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key, kind="stable")
    rank, span = np.zeros(n, np.int64), 1
    while True:
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new) - 1
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] + 1
        key = rank * (n + 1) + after
        # only suffixes whose rank isn't theirs alone move, and only among themselves
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        part = order[open_]
        order[open_] = part[np.argsort(key[part], kind="stable")]
        span *= 2


class Wavelet:
    """Wavelet matrix: how often a letter stands before a place, and which letter stands there."""

    def __init__(self, text: np.ndarray, letters: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        self.bits = max(1, int(letters - 1).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            one = (text >> bit) & 1
            zeros = np.zeros(len(text) + 1, np.int32)
            np.cumsum(1 - one, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            text = np.concatenate((text[one == 0], text[one == 1]))

    def rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        at, begin = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level, (zeros, n) in enumerate(self.levels):
            one = ((letter >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = zeros[at], zeros[begin]
            at, begin = np.where(one, n + at - a, a), np.where(one, n + begin - b, b)
        return at - begin

    def letter(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for zeros, n in self.levels:
            a = zeros[at]
            one = zeros[at + 1] == a
            out = out * 2 + one
            at = np.where(one, n + at - a, a)
        return out


class FMIndex:
    """text: letters from 1 to letters - 1; a zero ends each run. Nothing matches across a zero."""

    STEP = 8

    def __init__(self, text: np.ndarray, letters: int):
        self.n = len(text)
        order = suffix_order(text)
        last = text[order - 1] if self.n else text
        self.wavelet = Wavelet(last, letters)
        self.before = np.zeros(letters + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=letters), out=self.before[1:])
        sampled = (order % self.STEP == 0) | (last == 0)
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one row each, all of one length. The rows [lo, hi) of the suffixes that begin with each."""
        m = len(phrases)
        lo, hi, live = np.zeros(m, np.int64), np.full(m, self.n, np.int64), np.arange(m)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            a = self.before[c] + self.wavelet.rank(c, lo[live])
            b = self.before[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back letter by letter until a row whose position is kept."""
        rows, out, steps, live = rows.astype(np.int64), np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            here = rows[live]
            done = self.sampled[here]
            out[live[done]] = self.samples[self.sample_at[here[done]]] + steps
            live, here = live[~done], here[~done]
            c = self.wavelet.letter(here)
            rows[live] = self.before[c] + self.wavelet.rank(c, here)
            steps += 1
        return out
