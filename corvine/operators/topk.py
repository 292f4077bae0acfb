"""The best k of each query over rows that stream past, in memory bounded by queries times k."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Entries, one for each query and rank, that one task holds at most; more queries take more passes.
HELD = 4_000_000
#: Candidates that wait before they are merged, at least.
WAITING = 500_000
#: Digits by which scores are compared.
DIGITS = 9


def rounded(x: np.ndarray) -> np.ndarray:
    """``x`` in units of the last of DIGITS, halves away from zero by the shortest decimal that names the number, as Spark's round does."""
    t = x * 10.0**DIGITS
    out = np.floor(t + 0.5)
    for i in np.flatnonzero(np.abs(t - np.floor(t) - 0.5) < 1e-4 + np.abs(t) * 4e-16):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Best:
    """For each of ``n`` queries the k rows of highest rounded score, ties by lower id. NaN is above all numbers, -inf stands for null."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        #: The key a row must reach to be of use to a query.
        self.least = np.full(n, -np.inf)
        self.query, self.key = np.zeros(0, np.int64), np.zeros(0)
        self.id, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def floor(self) -> np.ndarray:
        """A score under which no row is of use, for each query; a unit is left for rounding."""
        return (self.least - 1) / 10.0**DIGITS

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        key = np.where(np.isnan(score), np.inf, score)
        finite = np.isfinite(key)
        key[finite] = rounded(key[finite])
        some = key >= self.least[query]
        self.waiting.append((query[some], key[some], id_[some], score[some]))
        self.size += int(some.sum())
        if self.size >= max(WAITING, self.n * self.k):
            self.merge()

    def merge(self) -> None:
        every = [np.concatenate(c) for c in zip((self.query, self.key, self.id, self.score), *self.waiting, strict=True)]
        order = np.lexsort((every[2], -every[1], every[0]))
        starts = np.searchsorted(every[0][order], np.arange(self.n + 1))
        rank = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
        order = order[rank < self.k]
        self.query, self.key, self.id, self.score = (c[order] for c in every)
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.least[full] = self.key[np.searchsorted(self.query, full) + self.k - 1]
        self.waiting, self.size = [], 0
