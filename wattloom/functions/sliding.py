"""Medians of sliding windows in NumPy and sorted lists: what enters and what leaves is found by bisection.

A step costs the logarithm of the window (and moving a few bytes in a sorted list), so a wide
window takes hardly longer than a narrow one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np

#: Rows of all series whose windows are held at once.
BLOCK = 8192
#: Rows of a block whose moments its windows share.
SHARED = 16


def _middle(window: list[float]) -> float:
    n = len(window)
    return window[n >> 1] if n & 1 else 0.5 * (window[(n >> 1) - 1] + window[n >> 1])


def _deviation(window: list[float], centre: float) -> float:
    """Median distance of a sorted window from `centre`.

    The k + 1 values nearest to the centre are neighbours in the window; where they begin is
    found by bisection, and the farther end is the k-th distance.
    """
    n = len(window)
    k = (n - 1) >> 1
    a, b = 0, n - 1 - k
    while a < b:
        m = (a + b) >> 1
        if centre - window[m] > window[m + k + 1] - centre:
            a = m + 1
        else:
            b = m
    own = max(centre - window[a], window[a + k] - centre)
    if n & 1:
        return own
    after = min(centre - window[a - 1] if a else np.inf, window[a + k + 1] - centre if a + k + 1 < n else np.inf)
    return 0.5 * (own + after)


def sliding_median(values: np.ndarray, before: int, after: int, least: int = 1, deviation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Median, and with `deviation` the median distance from it, of the rows i - before .. i + after.

    NaN is missing. Where fewer than `least` values are in reach, or none, the result is NaN.
    """
    x = np.asarray(values, float).tolist()
    n = len(x)
    middle, spread = np.full(n, np.nan), np.full(n, np.nan)
    window: list[float] = []
    for v in x[:after]:
        if v == v:
            insort(window, v)
    need = max(1, least)
    for i in range(n):
        if i + after < n and (v := x[i + after]) == v:
            insort(window, v)
        if i > before and (v := x[i - before - 1]) == v:
            del window[bisect_left(window, v)]
        if len(window) >= need:
            middle[i] = m = _middle(window)
            if deviation:
                spread[i] = _deviation(window, m)
    return middle, spread


def hampel_distance(values: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling median, each row's distance from its own, and the rolling median of those distances."""
    centre, _ = sliding_median(values, before, after)
    away = np.abs(np.asarray(values, float) - centre)
    return centre, away, sliding_median(away, before, after)[0]


def _windows(x: np.ndarray, before: int, after: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Windows of the rows of each series in `x` (series, rows), a block of rows at a time; NaN beyond the ends."""
    held = np.pad(x, ((0, 0), (before, after)), constant_values=np.nan)
    windows, step = np.lib.stride_tricks.sliding_window_view(held, before + 1 + after, axis=1), max(1, BLOCK // len(x))
    for k in range(0, x.shape[1], step):
        yield slice(k, k + step), windows[:, k : k + step]


def short_medians(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """sliding_median of several series (series, rows) at once, by sorting each window: for windows of some dozens of rows."""
    out = np.empty(x.shape)
    for at, window in _windows(x, before, after):
        s = np.sort(window, axis=2)  # NaN comes last
        n = np.count_nonzero(s == s, axis=2)[..., None]
        low, high = (np.take_along_axis(s, np.maximum(k, 0), 2)[..., 0] for k in ((n - 1) >> 1, n >> 1))
        out[:, at] = np.where(n[..., 0] > 0, 0.5 * (low + high), np.nan)
    return out


def _take_in(moments: list[np.ndarray], x: np.ndarray, on: np.ndarray | bool = True) -> None:
    """Welford's update of (n, sum, mean, sum of squared deviations) by one more value each, where `on`."""
    n, total, mean, square = moments
    n += on
    x = np.where(on, x, mean)
    away = x - mean
    total += np.where(on, x, 0.0)
    mean += away / np.maximum(n, 1.0)
    square += (x - mean) * away


def _moments(x: np.ndarray, before: int, after: int, first: int) -> list[np.ndarray]:
    """(n, sum, mean, sum of squared deviations) of the window around each row of several series (series, rows); row 0 is the series' row `first`.

    Blocks of SHARED rows are summed up once and merged by Chan's formula into all windows that hold
    them whole; the rows before and after these follow one by one.
    """
    rows, shift = x.shape[1], first % SHARED
    at = np.arange(rows)
    begin, end = np.maximum(at - before, 0), np.minimum(at + after + 1, rows)
    left, right = -(-(begin + shift) // SHARED), (end + shift) // SHARED
    near = np.minimum(left * SHARED - shift, end)
    far = np.maximum(right * SHARED - shift, near)
    empty = lambda k: [np.zeros(k), *np.zeros((3, len(x), k))]
    blocks, own = empty((rows + shift) // SHARED), empty(rows)
    held = np.pad(x, ((0, 0), (shift, 0)))[:, : len(blocks[0]) * SHARED].reshape(len(x), -1, SHARED)
    for k in range(SHARED):
        _take_in(blocks, held[:, :, k])

    def by_row(start: np.ndarray, stop: np.ndarray) -> None:
        for k in range((stop - start).max(initial=0)):
            _take_in(own, x.take(np.minimum(start + k, rows - 1), axis=1), start + k < stop)

    by_row(begin, near)
    n, total, mean, square = own
    for k in range((right - left).max(initial=0)):
        on, block = left + k < right, np.minimum(left + k, len(blocks[0]) - 1)
        total_, mean_, square_ = (np.where(on, b.take(block, axis=1), 0.0) for b in blocks[1:])
        gap, both = np.where(on, mean_ - mean, 0.0), np.maximum(n + SHARED * on, 1.0)
        total += total_
        square += square_
        square += gap * gap * SHARED * n / both
        mean += gap * SHARED / both
        n += SHARED * on
    by_row(far, end)
    return own


def short_zscores(x: np.ndarray, before: int, after: int, least: int, first: int = 0) -> np.ndarray:
    """Each row's distance from its window's mean in sample standard deviations, for several series (series, rows) without missing values.

    NaN with fewer than `least` rows in reach, or without any deviation. Where all that is in reach differs by
    rounding only, the result is what the order of the sums makes of it: here that of DuckDB's avg and stddev_samp
    over windows below 256 rows, if row 0 is the series' row `first`.
    """
    n, total, _, square = _moments(x, before, after, first)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.sqrt(square / (n - 1))
        return np.where((n >= least) & (spread > 0), np.abs(x - total / n) / spread, np.nan)
