"""Cubic penalised B-splines: design, fit and prediction band. NumPy only.

A row touches four neighbouring coefficients, so all matrices are banded: they are kept as
four diagonals, factored once, and the band of a prediction needs 4 x 4 values a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed value: the most coefficients of one fit.
MAX_BASIS = 2200


def choose_n_basis(n: int, cap: int = MAX_BASIS) -> int:
    return max(5, min(n - 3, cap))


_BAND = 4


def basis_rows(x: np.ndarray, n_basis: int) -> tuple[np.ndarray, np.ndarray]:
    """For each x the first of its four coefficients, and the four basis values, on clamped, equally spaced knots."""
    x = np.asarray(x, float)
    lo, hi = float(x.min()), float(x.max())
    hi = hi if hi > lo else lo + 1
    knots = np.concatenate([[lo] * 4, np.linspace(lo, hi, n_basis - 2)[1:-1], [hi] * 4])
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, 3, n_basis - 1)
    near = np.ones((len(x), 1))
    for degree in range(1, 4):
        wider = np.zeros((len(x), degree + 1))
        for r in range(degree):
            left, right = knots[span - degree + r + 1], knots[span + r + 1]
            width = right - left
            share = np.divide(near[:, r], width, out=np.zeros(len(x)), where=width > 0)
            wider[:, r] += share * (right - x)
            wider[:, r + 1] += share * (x - left)
        near = wider
    return span - 3, near


def design(x: np.ndarray, n_basis: int) -> np.ndarray:
    """The same as a dense matrix, one row for each x."""
    first, near = basis_rows(x, n_basis)
    out = np.zeros((len(near), n_basis))
    np.put_along_axis(out, first[:, None] + np.arange(_BAND), near, axis=1)
    return out


def _gram_band(first: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Diagonals of the basis' products: band[d, i] is the entry at (i + d, i)."""
    band = np.zeros((_BAND, k))
    for p in range(_BAND):
        for q in range(p, _BAND):
            np.add.at(band[q - p], first + p, near[:, p] * near[:, q])
    return band


def _penalty_band(k: int) -> np.ndarray:
    """Diagonals of the squared second differences of k coefficients."""
    band, rows, d = np.zeros((_BAND, k)), np.arange(k - 2), (1.0, -2.0, 1.0)
    for p in range(3):
        for q in range(p, 3):
            np.add.at(band[q - p], rows + p, d[p] * d[q])
    return band


def penalty(n_basis: int) -> np.ndarray:
    """The same as a dense matrix."""
    return _dense(_penalty_band(n_basis))


def _dense(band: np.ndarray) -> np.ndarray:
    k = band.shape[1]
    out = np.zeros((k, k))
    for d in range(min(_BAND, k)):
        i = np.arange(k - d)
        out[i + d, i] = out[i, i + d] = band[d, : k - d]
    return out


def _factor(band: np.ndarray) -> np.ndarray:
    """Row j: the lower Cholesky factor's entries at columns j - 3 .. j."""
    k = band.shape[1]
    out = np.zeros((k, _BAND))
    for j in range(k):
        for c in range(max(0, j - 3), j + 1):
            value = band[j - c, c]
            for t in range(max(0, j - 3), c):
                value -= out[j, t - j + 3] * out[c, t - c + 3]
            if c < j:
                out[j, c - j + 3] = value / out[c, 3]
            elif value > 0:
                out[j, 3] = value**0.5
            else:
                raise ValueError("the smoothing is too small for these coefficients")
    return out


def _solve(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the factored matrix takes to the columns of `right`: down and up the band once each."""
    x, k = np.array(right, float), len(factor)
    for j in range(k):
        a = max(0, j - 3)
        x[j] = (x[j] - factor[j, a - j + 3 : 3] @ x[a:j]) / factor[j, 3]
    for j in range(k - 1, -1, -1):
        b = min(k, j + 4)
        below = np.arange(j + 1, b)
        x[j] = (x[j] - factor[below, j - below + 3] @ x[j + 1 : b]) / factor[j, 3]
    return x


#: So small a step that its square vanishes beside any number.
_STEP = 1e-150


def _inverse_band(band: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The diagonals of A^-1, and those of A^-1 G A^-1, for banded A and G, in time that grows with k alone.

    The first are found from the factors L D L^T, from the last column to the first, as each needs
    only entries inside the band. The second are the change of the first, with the sign turned,
    when A grows along G; one run with a step along the imaginary axis gives both, without
    any difference of near numbers.
    """
    k = band.shape[1]
    columns = (band + 1j * _STEP * gram).T.tolist()  # columns[c][d]: the entry at (c + d, c)
    pivot: list[complex] = []
    low: list[list[complex]] = []  # low[c][d]: L at (c + d, c)
    for c in range(k):
        own = list(columns[c])
        for back in range(1, min(3, c) + 1):
            left, scale = low[c - back], pivot[c - back]
            weight = left[back] * scale
            for d in range(_BAND - back):
                own[d] -= left[back + d] * weight
        pivot.append(own[0])
        low.append([1.0, *(x / own[0] for x in own[1:])])
    out: list[list[complex]] = [[0j] * _BAND for _ in range(k + _BAND)]  # out[c][d]: the inverse at (c + d, c)
    for c in range(k - 1, -1, -1):
        own = low[c]
        for d in range(min(3, k - 1 - c), -1, -1):
            total = 1 / pivot[c] if d == 0 else 0j
            for t in range(1, min(3, k - 1 - c) + 1):
                if own[t]:
                    i, j = (d, t) if d >= t else (t, d)
                    total -= own[t] * (out[c + j][i - j] if d else out[c][t])
            out[c][d] = total
    found = np.array(out[:k]).T
    return found.real, -found.imag / _STEP


@dataclass
class Fit:
    """A fitted curve at all rows, with what its band needs."""

    curve: np.ndarray
    n_fitted: int
    n_basis: int
    df: float
    mse: float
    leverage: np.ndarray
    basis_capped: bool

    def df_per_day(self, days: float) -> float:
        return self.df / days if days > 0 else float("nan")


def fit_curve(x: np.ndarray, y: np.ndarray, smoothing: float = 1e4, n_basis: int | None = None, max_basis: int = MAX_BASIS) -> Fit:
    """Least squares on rows with a value, plus `smoothing` times the penalty; evaluated at all rows."""
    if smoothing <= 0:
        raise ValueError("the smoothing must be positive")
    x, y = np.asarray(x, float), np.asarray(y, float)
    good = np.isfinite(y)
    n = int(good.sum())
    k = choose_n_basis(n, max_basis) if n_basis is None else n_basis
    if n <= k or n < 7:
        raise ValueError(f"{n} values are too few for {k} coefficients")
    first, near = basis_rows(x, k)
    own, values = first[good], near[good]
    gram = _gram_band(own, values, k)
    factor = _factor(gram + smoothing * _penalty_band(k))
    right = np.zeros(k)
    np.add.at(right, own[:, None] + np.arange(_BAND), values * y[good][:, None])
    place = first[:, None] + np.arange(_BAND)
    curve = (near * _solve(factor, right)[place]).sum(axis=1)
    inverse, spread = _inverse_band(gram + smoothing * _penalty_band(k), gram)
    # The trace of the hat matrix: both factors are banded where it counts, and symmetric.
    df = float((inverse[0] * gram[0]).sum() + 2 * (inverse[1:] * gram[1:]).sum())
    mse = float(((y[good] - curve[good]) ** 2).sum() / max(n - df, 1))
    # The covariance of the coefficients in units of the residual variance; a row needs 4 x 4 of it.
    leverage = sum((1 if p == q else 2) * near[:, p] * near[:, q] * spread[q - p, first + p] for p in range(_BAND) for q in range(p, _BAND))
    return Fit(curve, n, k, df, mse, leverage, n_basis is None and n - 3 > max_basis)


def band_flags(x: np.ndarray, y: np.ndarray, smoothing: float = 1e4, z: float = 1.96, log_scale: bool = False, n_basis: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Fit]:
    """flags, curve, lower and upper bound, and the fit: a row is flagged outside curve ± z standard errors of prediction."""
    y = np.asarray(y, float)
    if log_scale and (y[np.isfinite(y)] <= 0).any():
        raise ValueError("a log scale needs positive values")
    fit = fit_curve(x, np.log(y) if log_scale else y, smoothing, n_basis)
    half = z * np.sqrt(fit.mse * (1 + fit.leverage))
    low, high, curve = fit.curve - half, fit.curve + half, fit.curve
    if log_scale:
        low, high, curve = np.exp(low), np.exp(high), np.exp(curve)
    with np.errstate(invalid="ignore"):
        flags = np.isfinite(y) & ((y < low) | (y > high))
    return flags, curve, low, high, fit


def _stack_coefficients(first: np.ndarray, near: np.ndarray, y: np.ndarray, k: int, smoothing: float) -> np.ndarray:
    """Coefficients (fits x k) of as many fits of equal shape: `first` (fits x rows), `near` (fits x rows x 4), `y` with NaN for rows that are left out.

    One banded factorisation for all: each step of it is an operation over the fits. NaN where the matrix is not positive.
    """
    fits = len(y)
    good = np.isfinite(y)
    at = (np.arange(fits)[:, None] * k + first)[good]
    w, v = near[good], y[good]
    place = lambda p: at + p
    band = np.zeros((_BAND, fits, k))
    for p in range(_BAND):
        for q in range(p, _BAND):
            band[q - p] += np.bincount(place(p), w[:, p] * w[:, q], fits * k).reshape(fits, k)
    band += smoothing * _penalty_band(k)[:, None, :]
    x = sum(np.bincount(place(p), w[:, p] * v, fits * k) for p in range(_BAND)).reshape(fits, k).T.copy()
    low = np.zeros((k, _BAND, fits))
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(k):
            for c in range(max(0, j - 3), j + 1):
                value = band[j - c, :, c].copy()
                for t in range(max(0, j - 3), c):
                    value -= low[j, t - j + 3] * low[c, t - c + 3]
                low[j, c - j + 3] = value / low[c, 3] if c < j else np.sqrt(value)
            for c in range(max(0, j - 3), j):
                x[j] -= low[j, c - j + 3] * x[c]
            x[j] /= low[j, 3]
        for j in range(k - 1, -1, -1):
            for c in range(j + 1, min(k, j + 4)):
                x[j] -= low[c, j - c + 3] * x[c]
            x[j] /= low[j, 3]
    return x.T


#: Rows of all fits in one stack.
STACK_ROWS = 500_000


def impute_regions(x: np.ndarray, y: np.ndarray, pos: np.ndarray, starts: np.ndarray, ends: np.ndarray, context: int, smoothing: float) -> list[np.ndarray | None]:
    """What `impute_region` gives for each of many regions, those of one shape fitted together.

    Regions are given by positions; rows are in the order of `pos`, and in y all rows that no fit
    may see are NaN. A region's own rows are hidden from its fit.
    """
    a, b = np.searchsorted(pos, starts), np.searchsorted(pos, ends)
    width = np.maximum(context, 4 * (ends - starts + 1))
    lo, hi = np.searchsorted(pos, starts - width), np.searchsorted(pos, ends + width, side="right")
    seen = np.concatenate([[0], np.cumsum(np.isfinite(y))])
    n = seen[hi] - seen[lo] - (seen[b + 1] - seen[a])
    k = np.maximum(5, np.minimum(n - 4, np.rint(0.5 * (hi - lo)).astype(np.int64)))
    shape = np.stack([hi - lo, a - lo, b - a + 1, k], axis=1)
    out: list[np.ndarray | None] = [None] * len(starts)
    fit = np.flatnonzero((n >= k + 2) & (n >= 12))
    shapes, which = np.unique(shape[fit], axis=0, return_inverse=True)
    for s, (m, before, gap, basis) in enumerate(shapes.tolist()):
        own = fit[which.ravel() == s]
        for part in np.array_split(own, max(1, -(-len(own) * m // STACK_ROWS))):
            rows = lo[part][:, None] + np.arange(m)
            t = x[rows] - x[lo[part]][:, None]
            t = t / np.maximum(t.max(axis=1, keepdims=True), 1e-300) * (basis - 3)
            # All fits share the knots 0 .. basis - 3; the two ends make sure that they span the range.
            first, near = basis_rows(np.concatenate([t.ravel(), [0.0, basis - 3.0]]), basis)
            first, near = first[:-2].reshape(t.shape), near[:-2].reshape(*t.shape, _BAND)
            values = y[rows]
            values[:, before : before + gap] = np.nan
            found = _stack_coefficients(first, near, values, basis, smoothing * gap)
            inside = slice(before, before + gap)
            at = first[:, inside, None] + np.arange(_BAND)
            curve = (near[:, inside] * found[np.arange(len(part))[:, None, None], at]).sum(axis=2)
            for i, own_curve in zip(part.tolist(), curve, strict=True):
                out[i] = own_curve if np.isfinite(own_curve).all() else None
    return out


def impute_region(x: np.ndarray, y: np.ndarray, blocked: np.ndarray, start: int, end: int, context: int, smoothing: float) -> np.ndarray | None:
    """Values for rows start..end from a local fit; None with too little around them.

    The fit sees max(context, 4 gaps) rows on either side, without any blocked row, and is
    smoothed in proportion to the gap.
    """
    gap = end - start + 1
    width = max(context, 4 * gap)
    lo, hi = max(0, start - width), min(len(y), end + width + 1)
    own = np.where(blocked[lo:hi], np.nan, y[lo:hi])
    n = int(np.isfinite(own).sum())
    k = max(5, min(n - 4, round(0.5 * (hi - lo))))
    if n < k + 2 or n < 12:
        return None
    return fit_curve(x[lo:hi], own, smoothing * max(1, gap), k).curve[start - lo : end - lo + 1]
