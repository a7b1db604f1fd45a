import time

import numpy as np
import pytest

from wattloom.functions import bspline, butter, mle


def test_design_rows_sum_to_one():
    b = bspline.design(np.linspace(0, 3, 50), 12)
    np.testing.assert_allclose(b.sum(axis=1), 1, atol=1e-12)
    assert (np.count_nonzero(b, axis=1) <= 4).all()
    assert np.isfinite(bspline.design(np.zeros(5), 6)).all()


def test_band_matches_the_dense_hat_matrix():
    rng = np.random.default_rng(0)
    x, lam, k = np.sort(rng.random(60)), 0.5, 30
    y = np.sin(6 * x) + rng.normal(0, 0.1, 60)
    fit = bspline.fit_curve(x, y, lam, k)
    b = bspline.design(x, k)
    hat = b @ np.linalg.solve(b.T @ b + lam * bspline.penalty(k), b.T)
    np.testing.assert_allclose(fit.curve, hat @ y, atol=1e-8)
    assert fit.df == pytest.approx(np.trace(hat))
    np.testing.assert_allclose(fit.leverage, np.diag(hat @ hat.T), atol=1e-8)


def test_fit_refuses_and_constant_is_kept():
    with pytest.raises(ValueError):
        bspline.fit_curve(np.arange(9.0), np.ones(9), 0)
    with pytest.raises(ValueError):
        bspline.fit_curve(np.arange(4.0), np.ones(4))
    np.testing.assert_allclose(bspline.fit_curve(np.arange(50.0), np.full(50, 3.0)).curve, 3, atol=1e-8)
    with pytest.raises(ValueError):
        bspline.band_flags(np.arange(50.0), np.zeros(50), log_scale=True)
    assert bspline.impute_region(np.arange(9.0), np.ones(9), np.zeros(9, bool), 4, 4, 3, 1.0) is None


def test_butterworth_known_values():
    b, a = butter.butterworth(2, 0.5)
    np.testing.assert_allclose(b, [0.2929, 0.5858, 0.2929], atol=1e-4)
    np.testing.assert_allclose(a, [1, 0, 0.1716], atol=1e-4)
    for order, wn in ((3, 1 / 15), (3, 0.4), (5, 0.1)):
        b, a = butter.butterworth(order, wn)
        z = np.exp(1j * np.pi * wn)
        assert b.sum() / a.sum() == pytest.approx(1)
        assert abs(np.polyval(b, z) / np.polyval(a, z)) ** 2 == pytest.approx(0.5)


def test_zero_phase():
    np.testing.assert_allclose(butter.smooth(np.full(200, 5.0), 1, 30), 5, atol=1e-9)
    pulse = np.zeros(401)
    pulse[200] = 1
    out = butter.smooth(pulse, 1, 30)
    np.testing.assert_allclose(out, out[::-1], atol=1e-9)
    with pytest.raises(ValueError):
        butter.smooth(np.zeros(10), 1, 30)


@pytest.mark.parametrize("family", mle.FAMILIES)
def test_no_neighbour_is_likelier(family):
    rng = np.random.default_rng(3)
    x = {"norm": rng.normal(5, 2, 2000), "lognorm": rng.lognormal(1, 0.5, 2000), "gamma": rng.gamma(3, 2, 2000), "weibull_min": 4 * rng.weibull(1.8, 2000), "expon": 1 + rng.exponential(3, 2000), "uniform": rng.uniform(2, 9, 2000)}[family]
    fit = mle.fit_family(family, x)
    own = mle.log_pdf(family, fit.params, x).sum()
    for k in range(len(fit.params)):
        for f in (0.97, 1.03):
            p = list(fit.params)
            p[k] *= f
            assert mle.log_pdf(family, tuple(p), x).sum() <= own + 0.5
    assert fit.ks < 0.05


def test_ranking_and_words():
    x = np.random.default_rng(4).normal(100, 5, 3000)
    fits = mle.fit_distributions(x)
    assert fits[0].ks < 0.05 and len(fits) == 6 and fits == sorted(fits, key=lambda f: f.aic)
    assert {f.family for f in mle.fit_distributions(x - 100)} == {"norm", "uniform"}
    assert mle.fit_distributions(x[:10]) == [] and "too few" in mle.describe([])
    assert "cannot be told apart" in mle.describe([mle.FamilyFit("norm", (), 10, 0.01), mle.FamilyFit("gamma", (), 11, 0.01)])


def test_the_longest_fit_is_quick():
    rng = np.random.default_rng(3)
    x = np.arange(8064) / 288
    y = 100 + 30 * np.sin(2 * np.pi * x) + rng.normal(0, 2, len(x))
    y[4000] += 60
    began = time.perf_counter()
    flags, *_, fit = bspline.band_flags(x, y, smoothing=10.0)
    assert flags[4000] and fit.n_basis == bspline.MAX_BASIS and fit.basis_capped
    assert time.perf_counter() - began < 10


def _row_by_row(b, a, x, z):
    """The transposed direct form, a row at a time."""
    z, out = [*z, 0.0], []
    for v in x:
        y = b[0] * v + z[0]
        for k in range(len(a) - 1):
            z[k] = b[k + 1] * v + z[k + 1] - a[k + 1] * y
        out.append(y)
    return np.array(out), np.array(z[:-1])


@pytest.mark.parametrize("order, cutoff", [(1, 0.3), (3, 0.05), (3, 0.9), (5, 0.2)])
def test_recurrence_equals_row_by_row(order, cutoff):
    b, a = butter.butterworth(order, cutoff)
    rng = np.random.default_rng(order)
    for n in (0, 1, 127, 128, 129, 5000):
        x, z = 100 * rng.normal(size=n), rng.normal(size=order)
        for block in (1, 16, 128):
            y, end = butter.Recurrence(b, a, block).run(x, z)
            want, last = _row_by_row(b, a, x, z)
            scale = max(1.0, np.abs(want).max(initial=0))
            # Small blocks take more squarings of the step, each with its rounding.
            near = 1e-12 if block == butter.BLOCK else 1e-11
            assert np.abs(y - want).max(initial=0) < near * scale and np.abs(end - last).max() < near * scale


def test_parts_join_by_their_states():
    b, a = butter.butterworth(3, 0.2)
    x = np.random.default_rng(9).normal(size=3000).cumsum()
    own, (first, second) = butter.Recurrence(b, a), (x[:1100], x[1100:])
    zero = np.zeros(3)
    whole, end = own.run(x, zero)
    _, s1 = own.run(first, zero)
    y2, _ = own.run(second, s1)
    assert np.abs(y2 - whole[1100:]).max() < 1e-9
    # From a zero state, the carried state is added afterwards.
    _, s2 = own.run(second, zero)
    assert np.abs(own.power(len(second)) @ s1 + s2 - end).max() < 1e-9


def test_a_million_rows_are_filtered_at_once():
    x = np.random.default_rng(10).normal(size=1_000_000)
    began = time.process_time()
    butter.smooth(x, 1.0, 30.0)
    assert time.process_time() - began < 5


def test_regions_in_a_stack_equal_single_fits():
    rng = np.random.default_rng(12)
    n, context = 600, 12
    x = np.sort(rng.random(n)) + np.arange(n) / 20
    y = np.sin(x) + rng.normal(0, 0.1, n)
    starts, ends = np.array([0, 30, 60, 90, 140, 200, 300, 420, 500, 596]), np.array([2, 30, 63, 92, 149, 200, 323, 421, 500, 599])
    blocked = np.zeros(n, bool)
    for a, b in zip(starts, ends, strict=True):
        blocked[a : b + 1] = True
    blocked[205:330] = blocked[470:560] = True  # too thin around 500
    y[rng.random(n) < 0.1] = np.nan
    got = bspline.impute_regions(x, np.where(blocked, np.nan, y), np.arange(n), starts, ends, context, 0.3)
    for a, b, own in zip(starts, ends, got, strict=True):
        want = bspline.impute_region(x, y, blocked, a, b, context, 0.3)
        assert (want is None) == (own is None)
        if want is not None:
            np.testing.assert_allclose(own, want, atol=1e-9)
    assert any(g is None for g in got) and any(g is not None for g in got)


def test_ten_thousand_regions_in_one_stack():
    n = 300_000
    x, y = np.arange(n) / 288, np.sin(np.arange(n) / 40)
    starts = np.arange(100, n - 100, 29)
    began = time.process_time()
    got = bspline.impute_regions(x, y, np.arange(n), starts, starts + 2, 12, 0.1)
    assert time.process_time() - began < 20 and len(got) == len(starts)
    assert max(np.abs(g - y[a : a + 3]).max() for g, a in zip(got, starts, strict=True)) < 0.05


@pytest.mark.parametrize("k", [4, 5, 30, 200])
def test_inverse_inside_the_band(k):
    rng = np.random.default_rng(k)
    x = np.sort(rng.random(4 * k))
    gram = bspline._gram_band(*bspline.basis_rows(x, k), k)
    band = gram + 0.3 * bspline._penalty_band(k)
    whole = np.linalg.inv(bspline._dense(band))
    spread = whole @ bspline._dense(gram) @ whole
    for got, want in zip(bspline._inverse_band(band, gram), (whole, spread), strict=True):
        for d in range(min(4, k)):
            np.testing.assert_allclose(got[d, : k - d], np.diagonal(want, -d), rtol=1e-7, atol=1e-10 * np.abs(want).max())


def test_a_month_is_fitted_in_a_second():
    x = np.arange(8064) / 288
    y = np.sin(x) + np.random.default_rng(1).normal(0, 0.1, 8064)
    began = time.process_time()
    fit = bspline.fit_curve(x, y, 1e4)
    assert time.process_time() - began < 2 and 3 < fit.df < 2200
