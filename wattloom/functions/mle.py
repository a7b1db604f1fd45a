"""Maximum-likelihood fits of six families, with AIC and Kolmogorov-Smirnov distance. NumPy only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

FAMILIES = ("norm", "lognorm", "gamma", "weibull_min", "expon", "uniform")
POSITIVE = frozenset(("lognorm", "gamma", "weibull_min", "expon"))
MIN_VALUES = 30
POOR_KS, SAME_AIC = 0.10, 2.0

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = math.lgamma


@dataclass
class FamilyFit:
    family: str
    params: tuple[float, ...]
    aic: float
    ks: float


def _gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: a series for small x, a continued fraction beyond."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    small = (x > 0) & (x < a + 1)
    if small.any():
        v = x[small]
        term = total = np.full_like(v, 1 / a)
        for k in range(1, 600):
            term = term * v / (a + k)
            total = total + term
            if (term < 1e-14 * total).all():
                break
        out[small] = total * np.exp(-v + a * np.log(v) - _lgamma(a))
    large = x >= a + 1
    if large.any():
        v, tiny = x[large], 1e-300
        b = v + 1 - a
        c, d = np.full_like(v, 1 / tiny), 1 / b
        h = d
        for k in range(1, 600):
            an, b = -k * (k - a), b + 2
            d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
            c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-13).all():
                break
        out[large] = 1 - h * np.exp(-v + a * np.log(v) - _lgamma(a))
    return np.clip(out, 0, 1)


def log_pdf(family: str, p: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    """Log density; -inf outside the support."""
    with np.errstate(all="ignore"):
        if family == "norm":
            z = (x - p[0]) / p[1]
            return -0.5 * z * z - math.log(p[1]) - 0.5 * math.log(2 * math.pi)
        if family == "expon":
            return np.where(x >= p[0], -(x - p[0]) / p[1] - math.log(p[1]), -np.inf)
        if family == "uniform":
            return np.where((x >= p[0]) & (x <= p[0] + p[1]), -math.log(p[1]), -np.inf)
        s, loc, scale = p
        z = (x - loc) / scale
        if family == "lognorm":
            out = -np.log(s * (x - loc) * math.sqrt(2 * math.pi)) - 0.5 * (np.log(z) / s) ** 2
        elif family == "gamma":
            out = (s - 1) * np.log(z) - z - _lgamma(s) - math.log(scale)
        else:
            out = math.log(s / scale) + (s - 1) * np.log(z) - z**s
        return np.where(z > 0, out, -np.inf)


def cdf(family: str, p: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        if family == "norm":
            return 0.5 * (1 + _erf((x - p[0]) / (p[1] * math.sqrt(2))))
        if family == "expon":
            return np.where(x > p[0], 1 - np.exp(-(x - p[0]) / p[1]), 0.0)
        if family == "uniform":
            return np.clip((x - p[0]) / p[1], 0, 1)
        s, loc, scale = p
        z = np.maximum((x - loc) / scale, 0)
        if family == "lognorm":
            return np.where(z > 0, 0.5 * (1 + _erf(np.log(np.where(z > 0, z, 1)) / (s * math.sqrt(2)))), 0.0)
        return _gamma_cdf(s, z) if family == "gamma" else 1 - np.exp(-(z**s))


def _simplex(f, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead minimum of f."""
    points = [start] + [start + d for d in np.eye(len(start)) * 0.25]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-9 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = {t: centre + t * (points[-1] - centre) for t in (-1.0,)}
        value = f(tried[-1.0])
        if value < values[0]:
            far = centre - 2 * (points[-1] - centre)
            better = f(far)
            points[-1], values[-1] = (far, better) if better < value else (tried[-1.0], value)
        elif value < values[-2]:
            points[-1], values[-1] = tried[-1.0], value
        else:
            near = centre + (0.5 if value >= values[-1] else -0.5) * (points[-1] - centre)
            closer = f(near)
            if closer < min(value, values[-1]):
                points[-1], values[-1] = near, closer
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _fit_three(family: str, x: np.ndarray) -> tuple[float, ...]:
    """Shape, location and scale; the location stays below the least value."""
    lo, spread = float(x.min()), float(x.std()) or 1.0

    def params(t: np.ndarray) -> tuple[float, ...]:
        return float(np.exp(np.clip(t[0], -6, 6))), lo - spread * float(np.exp(np.clip(t[1], -25, 5))), float(np.exp(np.clip(t[2], -40, 40)))

    def loss(t: np.ndarray) -> float:
        value = -float(log_pdf(family, params(t), x).sum())
        return value if math.isfinite(value) else 1e300

    mean = float(x.mean()) - lo + 0.1 * spread
    shape = {"lognorm": 0.6, "gamma": max((mean / spread) ** 2, 0.1), "weibull_min": max(mean / spread, 0.3)}[family]
    scale = {"lognorm": mean, "gamma": mean / shape, "weibull_min": mean}[family]
    starts = [np.array([math.log(shape), g, math.log(scale)]) for g in (-2.3, 0.0)]
    return params(min((_simplex(loss, s) for s in starts), key=loss))


def fit_family(family: str, x: np.ndarray) -> FamilyFit | None:
    if family == "norm":
        p: tuple[float, ...] = (float(x.mean()), float(x.std()))
    elif family == "expon":
        p = (float(x.min()), float(x.mean() - x.min()))
    elif family == "uniform":
        p = (float(x.min()), float(x.max() - x.min()))
    else:
        p = _fit_three(family, x)
    if p[-1] <= 0:
        return None
    total = float(log_pdf(family, p, x).sum())
    if not math.isfinite(total):
        return None
    s, n = np.sort(x), len(x)
    f = cdf(family, p, s)
    ks = float(max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()))
    return FamilyFit(family, p, 2 * len(p) - 2 * total, ks)


def fit_distributions(values: np.ndarray) -> list[FamilyFit]:
    """Fits by ascending AIC; families on positive values only where all are; nothing under 30 values."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if len(x) < MIN_VALUES:
        return []
    fits = (fit_family(f, x) for f in FAMILIES if f not in POSITIVE or x.min() > 0)
    return sorted((f for f in fits if f), key=lambda f: f.aic)


def describe(fits: list[FamilyFit], inflated: bool = False, share: float = 0.0, at_zero: bool = True, level: float = 0.0) -> str:
    """One line on which family fits."""
    if inflated:
        lead = f"{share:.1%} of the readings lie " + ("near zero" if at_zero else f"near the lower bound {level:.3g}")
        return f"{lead}; the rest is closest to {fits[0].family}" if fits else lead
    if not fits:
        return "too few readings to fit"
    best, *others = fits
    if best.ks > POOR_KS:
        return f"no standard family fits (closest {best.family}, KS {best.ks:.2f})"
    if others and others[0].aic - best.aic < SAME_AIC:
        return f"{best.family} and {others[0].family} cannot be told apart"
    return f"{best.family} (KS {best.ks:.3f})"
