"""Exact quantiles by narrowing counts, against NumPy."""

import numpy as np
import pytest

from wattloom.operators import order, stats
from wattloom.operators.order import exact_quantiles

POINTS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def channels():
    rng = np.random.default_rng(1)
    return {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 3, 2000).astype(float),
        "scales": np.sign(rng.normal(size=1500)) * 10.0 ** rng.integers(-3, 300, 1500),
        "widest": np.concatenate([rng.normal(size=500), [-1.7e308, 1.7e308]]),
        "constant": np.full(900, 7.5),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        "hot": np.concatenate([np.zeros(5000), rng.normal(size=50)]),
    }


def frame(spark):
    rows = [(c, float(v)) for c, x in channels().items() for v in x] + [("none", None), ("normal", None), ("one", float("nan"))]
    return spark.createDataFrame(rows, "channel string, value double").repartition(6)


@pytest.mark.parametrize("few, bins, small", [(20_000, 1024, 0), (40, 64, 0), (40, 64, 1200)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, bins, small):
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "BINS", bins)
    got = {r.channel: r.q for r in exact_quantiles(frame(spark), POINTS, small).collect()}
    assert got.pop("none") is None
    for c, x in channels().items():
        x = np.sort(x)
        for p, q in zip(POINTS, got[c], strict=True):
            at = p * (len(x) - 1)
            a, b, w = x[int(at)], x[min(int(at) + 1, len(x) - 1)], at - int(at)
            assert q == pytest.approx((1 - w) * a + w * b, rel=1e-9, abs=1e-12)


def test_only_few_values_are_ranked(spark, monkeypatch):
    """What a task may hold is bounded: the last step sees FEW values of an interval at most."""
    monkeypatch.setattr(order, "FEW", 40)
    seen = []
    whole = order.F.row_number
    monkeypatch.setattr(order.F, "row_number", lambda: seen.append(1) or whole())
    held = frame(spark).where("channel = 'hot'")
    assert exact_quantiles(held, [0.5], small=0).first().q == [0.0] and not seen  # ties close the interval without ranking


def test_both_ways_agree(spark):
    df = frame(spark).where("channel <> 'widest' and not isnan(value)")
    for a, b in ((stats.percentiles(df, small=0), stats.percentiles(df)), (stats.mad(df, small=0), stats.mad(df))):
        one, other = ({r.channel: tuple(r)[1:] for r in x.collect()} for x in (a, b))
        assert one.keys() == other.keys()
        for c in one:
            assert other[c] == one[c] if None in one[c] else one[c] == pytest.approx(other[c], rel=1e-9, abs=1e-300)
