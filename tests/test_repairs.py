"""Repairs over stretches: gaps against single fits, and bands without seams."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattloom.functions.bspline import fit_curve, impute_region
from wattloom.operators import repair
from wattloom.operators.repair import TOO_LONG, TOO_THIN, impute_missing, spline_flags


def frame(spark, y):
    ts = pd.date_range("2024-01-01", periods=len(y), freq="5min")
    rows = [("a", k, t.to_pydatetime(), None if np.isnan(v) else float(v)) for k, (t, v) in enumerate(zip(ts, y, strict=True))]
    return spark.createDataFrame(rows, "channel string, pos long, ts timestamp_ntz, value double").repartition(5)


def test_gaps_of_all_stretches_equal_single_fits(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", 128)
    rng = np.random.default_rng(3)
    n, context, max_gap = 900, 20, 6
    y = 50 + 10 * np.sin(np.arange(n) / 30) + rng.normal(0, 1, n)
    for at in rng.choice(n, 60, replace=False):
        y[at : at + rng.integers(1, 9)] = np.nan
    y[124:131] = np.nan  # longer than allowed, over a border
    y[254:258] = np.nan
    y[500:640:2] = np.nan  # every other row, and little else
    y[501:640:4] = np.nan
    got = {r.pos: r for r in impute_missing(frame(spark, y), 0.1, context, max_gap).collect()}
    assert len(got) == n
    missing = np.isnan(y)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], missing.astype(int), [0]])))
    x = np.arange(n) * 300 / 86_400
    kinds = set()
    for a, b in zip(edge[::2], edge[1::2] - 1, strict=True):
        want = impute_region(x, y, missing, a, b, context, 0.1) if b - a < max_gap else None
        for k in range(a, b + 1):
            if want is None:
                assert got[k].value is None and got[k].reason == (TOO_LONG.format(max_gap) if b - a >= max_gap else TOO_THIN)
            else:
                assert abs(got[k].value - want[k - a]) < 1e-8 and got[k].imputed and got[k].reason == ""
        kinds.add(b - a >= max_gap if want is None else "fit")
    assert {True, "fit"} <= kinds
    assert all(got[k].value == y[k] and not got[k].imputed for k in np.flatnonzero(~missing))


def test_many_gaps_in_one_job(spark):
    n = 40_000
    y = np.sin(np.arange(n) / 25)
    y[50:-50:10] = np.nan
    out = impute_missing(frame(spark, y).select("channel", "pos", "ts", "value"), 0.01, 12)
    filled = out.where("imputed").agg(F.count("*").alias("n"), F.max(F.abs(F.col("value") - F.sin(F.col("pos") / 25))).alias("worst")).first()
    assert filled.n == int(np.isnan(y).sum()) and filled.worst < 0.01


def test_bands_meet_at_the_ends_of_stretches(spark):
    rng = np.random.default_rng(5)
    n, rows = 900, 300
    y = 10 * np.sin(np.arange(n) / 40) + rng.normal(0, 0.5, n)
    got = sorted(spline_flags(frame(spark, y), 100.0, rows_per_fit=rows, overlap=100).collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(n))
    curve = np.array([r.curve for r in got])
    steps = np.abs(np.diff(curve, 2))
    seams = [k for border in (rows, 2 * rows) for k in (border - 2, border - 1)]
    loose = sorted(spline_flags(frame(spark, y), 100.0, rows_per_fit=rows, overlap=0).collect(), key=lambda r: r.pos)
    apart = np.abs(np.diff(np.array([r.curve for r in loose]), 2))
    assert steps[seams].max() < 0.2 * apart[seams].max() and steps[seams].max() < 3 * np.delete(steps, seams).max()
    # A series of one stretch is one fit.
    one = sorted(spline_flags(frame(spark, y[:200]), 100.0).collect(), key=lambda r: r.pos)
    assert np.allclose([r.curve for r in one], fit_curve(np.arange(200) * 300 / 86_400, y[:200], 100.0).curve, atol=1e-9)
