"""Quantiles of sliding windows over an array, at a cost per window that grows with the logarithm of the array."""

from __future__ import annotations

import numpy as np


class SortedRuns:
    """Answers "the k-th smallest of values[i:j]" for many (i, j, k) at once.

    The values' ranks are split bit by bit, highest first; each level keeps, for every place, how many zeros come
    before it, and puts zeros before ones without changing their order otherwise. So each level holds runs that are sorted
    by the bits so far, and a window is a stretch of one run: the number of zeros in it tells where the k-th value goes on.
    """

    def __init__(self, values: np.ndarray):
        self.distinct, ranks = np.unique(values, return_inverse=True)
        self.levels = []
        for bit in reversed(range(max(len(self.distinct) - 1, 1).bit_length())):
            ones = (ranks >> bit) & 1
            zeros_before = np.concatenate(([0], np.cumsum(1 - ones)))
            self.levels.append((bit, zeros_before))
            ranks = np.concatenate((ranks[ones == 0], ranks[ones == 1]))

    def smallest(self, first: np.ndarray, last: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th (from 0) smallest value of each window ``first`` to before ``last``; ``0 <= k < last - first``."""
        first, last, k = first.copy(), last.copy(), k.copy()
        rank = np.zeros(len(k), np.int64)
        for bit, before in self.levels:
            low, high, zeros = before[first], before[last], before[-1]
            right = k >= high - low
            rank |= right.astype(np.int64) << bit
            k -= np.where(right, high - low, 0)
            first = np.where(right, zeros + first - low, low)
            last = np.where(right, zeros + last - high, high)
        return self.distinct[rank]


def window_quantiles(
    values: np.ndarray, size: int, ahead: int, wanted: list[tuple[float, int]], start: np.ndarray | int = 0, stop: np.ndarray | int | None = None
) -> list[np.ndarray]:
    """For each (q, least) the linearly interpolated quantile of the ``size`` values that end ``ahead`` places after each place.

    NaN counts as missing. Windows are cut at the ends of the array, or of each place's stretch from ``start`` to before ``stop``;
    a window with fewer than ``least`` values, or none, gives NaN.
    """
    stop = len(values) if stop is None else stop
    present = ~np.isnan(values)
    before = np.concatenate(([0], np.cumsum(present)))
    places = np.arange(len(values))
    first = before[np.clip(places + ahead - size + 1, start, stop)]
    last = before[np.clip(places + ahead + 1, start, stop)]
    count = last - first
    runs = SortedRuns(values[present]) if present.any() else None
    found = []
    for q, least in wanted:
        result = np.full(len(values), np.nan)
        ok = count >= max(least, 1)
        if runs is not None and ok.any():
            rank = q * (count[ok] - 1)
            floor = np.floor(rank).astype(np.int64)
            low = runs.smallest(first[ok], last[ok], floor)
            high = runs.smallest(first[ok], last[ok], np.minimum(floor + 1, count[ok] - 1))
            share = rank - floor
            result[ok] = np.where(share == 0, low, low + (high - low) * share)
        found.append(result)
    return found
