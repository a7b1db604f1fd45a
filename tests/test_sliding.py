"""Sliding medians against NumPy on each window, and the operators that stand on them over chunk borders."""

import time

import numpy as np
import pytest

from wattloom.functions.sliding import hampel_distance, sliding_median
from wattloom.operators.rolling import MAD_TO_SIGMA, by_chunk, hampel, hampel_excess, reach, rolling_mad, rolling_median


def plain(x, before, after, least=1):
    middle, spread = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for i in range(len(x)):
        own = x[max(0, i - before) : i + after + 1]
        own = own[~np.isnan(own)]
        if len(own) >= max(1, least):
            middle[i] = np.median(own)
            spread[i] = np.median(np.abs(own - middle[i]))
    return middle, spread


def series(n, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, n).astype(float) if ties else rng.normal(size=n)
    x[rng.random(n) < 0.15] = np.nan
    x[n // 2 : n // 2 + 30] = np.nan
    return x


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("window", [1, 2, 3, 12, 25, 400])
def test_median_and_deviation(window, ties):
    x = series(300, window, ties)
    before, after = reach(window)
    for least in (1, 5):
        for got, want in zip(sliding_median(x, before, after, least, deviation=True), plain(x, before, after, least), strict=True):
            assert np.allclose(got, want, rtol=0, atol=1e-12, equal_nan=True)


def test_a_wide_window_takes_hardly_longer():
    x = np.random.default_rng(3).normal(size=200_000)
    took = []
    for window in (12, 288):
        began = time.process_time()
        sliding_median(x, *reach(window), deviation=True)
        took.append(time.process_time() - began)
    assert took[1] < 2.5 * took[0]


@pytest.mark.parametrize("window", [5, 12])
def test_over_chunk_borders(spark, window):
    x = series(240, 7)
    before, after = reach(window)
    rows = [("a", k, None if np.isnan(v) else float(v), "kept") for k, v in enumerate(x)] + [("b", k, None, "none") for k in range(40)]
    df = spark.createDataFrame(rows, "channel string, pos long, value double, note string").repartition(5)
    centre, away, spread = hampel_distance(x, before, after)
    kernel = lambda v: dict(zip(("c", "d", "s"), hampel_distance(v, before, after), strict=True))
    got = by_chunk(df, 2 * before, 2 * after, kernel, {"c": "double", "d": "double", "s": "double"}, size=32)
    assert got.columns == ["channel", "pos", "value", "note", "c", "d", "s"] and got.count() == 280
    own = sorted((r for r in got.collect() if r.channel == "a"), key=lambda r: r.pos)
    for name, want in (("c", centre), ("d", away), ("s", spread)):
        assert np.allclose([np.nan if r[name] is None else r[name] for r in own], want, rtol=0, atol=1e-12, equal_nan=True)
    assert all(r.c is None and r.note == "none" for r in got.collect() if r.channel == "b")
    flags = {(r.channel, r.pos): r.flagged for r in hampel(df, window, 2.0).collect()}
    with np.errstate(invalid="ignore"):
        assert [flags["a", k] for k in range(240)] == (away > 2.0 * MAD_TO_SIGMA * spread).tolist()
    assert not any(f for (c, _), f in flags.items() if c == "b")
    excess = {(r.pos, r.window): r.excess for r in hampel_excess(df.where("channel = 'a'"), [3, window]).collect()}
    assert len(excess) == 480
    for k in range(240):
        want = away[k] / (MAD_TO_SIGMA * spread[k]) if spread[k] > 0 and away[k] == away[k] else None
        assert (excess[k, window] is None) == (want is None) and (want is None or abs(excess[k, window] - want) < 1e-9)
    mads = {r.pos: (r.centre, r.scale) for r in rolling_mad(df.where("channel = 'a'"), window, 3).collect()}
    middle, wide = plain(x, before, after, 3)
    for k in range(240):
        assert (mads[k][0] is None) == np.isnan(middle[k]) and (mads[k][0] is None or abs(mads[k][1] - MAD_TO_SIGMA * wide[k]) < 1e-9)
    assert rolling_median(df, window, 3).where("centre is not null and channel = 'a'").count() == int((~np.isnan(middle)).sum())
