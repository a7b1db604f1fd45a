"""Windows whose values differ by rounding only: means and deviations there are what the order of their sums makes of them. Ties of rounding."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from wattloom.functions.sliding import short_zscores
from wattloom.operators.gaps import interpolate
from wattloom.queries import rounded


def nearly_level(rng, channels, rows):
    """Levels, and runs of neighbouring floats around them."""
    level = np.round(rng.exponential(50, (channels, 1)) + 1, 2)
    steps = np.cumsum(rng.random((channels, rows)) < 0.07, axis=1) * 7 % 3 - 1
    return level + steps * np.spacing(level)


@pytest.mark.parametrize("window", [6, 12, 16, 48, 72])
def test_zscores_equal_sql_to_the_bit(window):
    x = nearly_level(np.random.default_rng(4), 12, 720)
    before, after, least = window // 2, window - 1 - window // 2, max(3, window // 2)
    t = pd.DataFrame({"channel": np.repeat(np.arange(12), 720), "pos": np.tile(np.arange(720), 12), "value": x.ravel()})  # noqa: F841
    rows = duckdb.sql(f"""SELECT CASE WHEN count(value) OVER q >= {least} THEN abs(value - avg(value) OVER q) / nullif(stddev_samp(value) OVER q, 0) END FROM t
        WINDOW q AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) ORDER BY channel, pos""").fetchall()
    sql = np.array([np.nan if z is None else z for (z,) in rows]).reshape(x.shape)
    got = short_zscores(x, before, after, least)
    assert (sql > 2).any() and np.array_equal(got, sql, equal_nan=True)
    for first in (320, 333):
        own = short_zscores(x[:, first:], before, after, least, first)[:, before:]
        assert np.array_equal(own, got[:, first + before :], equal_nan=True)


def test_lines_equal_sql_to_the_bit(spark):
    """As (b - a) * k / n, not as (b - a) * (k / n)."""
    ends = [(0.1, 0.7), (51.51, 3.02), (20.3, 20.300000000000004), (7.7, 120.01)]
    rows = [(f"{k}_{n}", p, a if p == 0 else b if p == n else None) for k, (a, b) in enumerate(ends) for n in (3, 7, 49) for p in range(n + 1)]
    got = {(r.channel, r.pos): r.value for r in interpolate(spark.createDataFrame(rows, "channel string, pos long, value double"), None).collect()}
    for k, (a, b) in enumerate(ends):
        for n in (3, 7, 49):
            assert all(got[f"{k}_{n}", p] == a + (b - a) * p / n for p in range(1, n))


def test_calibration_of_nearly_level_households(spark, tmp_path):
    """Means of two readings in tenths miss a third's by a bit; both calibrations then equal their SQL."""
    rng = np.random.default_rng(5)
    start, n = datetime.datetime(2024, 1, 1), 2600
    ts = sorted(start + datetime.timedelta(seconds=int(s)) for s in rng.integers(0, 720 * 3600, n))
    frame = pd.DataFrame({"event_id": range(n), "ts": pd.Series(ts).astype("datetime64[us]"), "user_id": rng.integers(0, 40, n), "event_type": "view", "value": rng.choice([0.2, 0.3, 0.3, 0.3, 0.4], n)})
    frame.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("household_calibration", "household_hampel_calibration"):
        got, want = entry.queries()[name](spark, str(tmp_path)), con.sql(entry.oracle_sql()[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("digits", [6, 9])
def test_ties_are_rounded_as_in_sql(spark, digits):
    """0.2570725 is 0.257072 in SQL, as its product with 1e6 is below a half."""
    rng = np.random.default_rng(6)
    values = [(10 * k + 5) / 10.0 ** (digits + 1) for k in rng.integers(0, 10**digits, 500).tolist()]
    values += [-v for v in values] + [0.2570725, 0.0, 12.0, 1e300, float("inf"), None]
    rows = pd.DataFrame({"i": range(len(values)), "x": pd.Series(values, dtype=object)})  # noqa: F841
    sql = duckdb.sql(f"SELECT round(CAST(x AS DOUBLE), {digits}) FROM rows ORDER BY i").fetchall()
    got = rounded(spark.createDataFrame(list(enumerate(values)), "i long, x double"), digits).orderBy("i")
    assert [r.x for r in got.collect()] == [v for (v,) in sql]
