"""Ranks of rows in one order, as a bit matrix: counts below a bound and order statistics of ranges.

Each level (one a bit) is one vector operation over all questions, so they cost their number times the
logarithm of the ranks, however long the ranges are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Ranks:
    """Ranks in one order of the rows, for counts below a bound."""

    def __init__(self, ranks: np.ndarray, bits: int | None = None):
        self.size = len(ranks)
        self.bits = bits or max(int(ranks.max(initial=0)).bit_length(), 1)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        # Places fit into 32 bits: a long group has a matrix of some megabytes a million rows and level.
        small = np.int32 if self.size < 1 << 31 and self.bits < 32 else np.int64
        values = ranks.astype(small)
        for bit in range(self.bits - 1, -1, -1):
            set_ = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(set_)]).astype(small))
            self.zeros.append(int(len(values) - set_.sum()))
            values = np.concatenate([values[set_ == 0], values[set_ == 1]])

    def below(self, first: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many places of each range hold a rank below its bound."""
        first, end = first.copy(), np.maximum(end, first)
        found, size = np.zeros(len(first), np.int64), end - first
        whole = bound >> self.bits > 0  # every rank is below
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level]
            a, b = ones[first], ones[end]
            high = (bound >> bit) & 1 == 1
            found += np.where(high, (end - b) - (first - a), 0)
            first = np.where(high, self.zeros[level] + a, first - a)
            end = np.where(high, self.zeros[level] + b, end - b)
        return np.where(whole, size, found)


class Difference:
    """The ranks of rows that came and have not gone, as of moments: ``came`` and ``gone`` hold the
    ranks in the order of coming and of going, and at a moment the first ``n_came`` of the ones had
    come and the first ``n_gone`` of the others, all of them among these, had gone."""

    def __init__(self, came: np.ndarray, gone: np.ndarray, n_came: np.ndarray, n_gone: np.ndarray):
        bits = max(int(came.max(initial=0)).bit_length(), 1)
        self.came, self.gone, self.bits = Ranks(came, bits), Ranks(gone, bits), bits
        self.n_came, self.n_gone, self.n = n_came, n_gone, n_came - n_gone

    def below(self, bound: np.ndarray) -> np.ndarray:
        none = np.zeros(len(bound), np.int64)
        return self.came.below(none, self.n_came, bound) - self.gone.below(none, self.n_gone, bound)

    def nth(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank at each place (from 0) of the moments ``at``."""
        a, b = np.zeros(len(at), np.int64), self.n_came[at]
        c, d = np.zeros(len(at), np.int64), self.n_gone[at]
        found = np.zeros(len(at), np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            came, gone = self.came.ones[level], self.gone.ones[level]
            i, j, k, m = came[a], came[b], gone[c], gone[d]
            zeros = (b - j) - (a - i) - (d - m) + (c - k)
            high = place >= zeros
            place = place - np.where(high, zeros, 0)
            found += high.astype(np.int64) << bit
            more, less = self.came.zeros[level], self.gone.zeros[level]
            a, b = np.where(high, more + i, a - i), np.where(high, more + j, b - j)
            c, d = np.where(high, less + k, c - k), np.where(high, less + m, d - m)
        return found


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different values, nulls included, and which rows are null."""
    known = column.combine_chunks().dictionary_encode(null_encoding="encode")
    known = known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known
    return known.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy()
