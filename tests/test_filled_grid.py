"""Grids and their filling from measured rows alone, against NumPy and against filling the cells."""

import datetime as dt

import numpy as np
import pytest

from wattloom.operators import panel
from wattloom.operators.gaps import filled_grid, interpolate
from wattloom.operators.order import exact_quantiles
from wattloom.operators.panel import grid

HOURS = 60
START = dt.datetime(2024, 1, 1, 5)


def measured():
    rng = np.random.default_rng(5)
    rows = [("a", h, float(rng.normal())) for h in sorted(rng.choice(HOURS, 12, replace=False))]
    rows += [("a", rows[0][1], 4.0), ("a", 30, float("nan")), ("b", 0, 1.0), ("b", HOURS - 1, 5.0), ("one", 25, 2.0), ("none", 7, None), (None, 9, 3.0)]
    return rows


@pytest.fixture(params=[7, 4096])
def events(spark, request, monkeypatch):
    monkeypatch.setattr(panel, "CELLS", request.param)
    rows = [(c, START + dt.timedelta(hours=int(h), minutes=11), v) for c, h, v in measured()]
    return spark.createDataFrame(rows, "channel string, ts timestamp_ntz, value double")


def test_grid_has_every_cell(events):
    got = {(r.channel, r.pos): (r.ts, r.value) for r in grid(events, "ts", "channel", "value", 3600).collect()}
    assert sorted(got, key=str) == sorted(((c, p) for c in ("a", "b", "one", "none", None) for p in range(HOURS)), key=str)
    for (c, p), (ts, value) in got.items():
        own = [v for name, h, v in measured() if name == c is not None and h == p and v is not None and v == v]
        assert ts == START + dt.timedelta(hours=p)
        assert value == (pytest.approx(np.mean(own)) if own else None)


@pytest.mark.parametrize("limit", [1, 4, None])
def test_filled_from_measured_rows_as_from_cells(events, limit):
    key = lambda r: (str(r.channel), r.pos)
    got = sorted(filled_grid(events, "ts", "channel", "value", 3600, limit).collect(), key=key)
    cells = grid(events, "ts", "channel", "value", 3600)
    want = sorted(interpolate(cells, limit).collect(), key=key)
    assert got == want
    for c in ("a", "b", "one"):
        known = {r.pos: r.value for r in cells.where(f"channel = '{c}' and value is not null").collect()}
        at = np.array(sorted(known))
        for r in (r for r in got if r.channel == c):
            near = limit is None or (np.abs(at - r.pos) <= limit).any()
            line = np.interp(r.pos, at, [known[k] for k in at])
            assert r.filled == (near and r.pos not in known)
            assert r.value == (pytest.approx(line) if near else None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_neither_joined_nor_dealt_out(events):
    """A cell costs one row: it is made after all shuffles, and no frame is read anew for every row."""
    for df in (grid(events, "ts", "channel", "value", 3600), filled_grid(events, "ts", "channel", "value", 3600, 4)):
        made = plan(df).split("sequence(slot")[0]
        assert "Exchange" not in made and "Join" not in made and "Sort" not in made
    assert "unboundedfollowing" not in plan(interpolate(grid(events, "ts", "channel", "value", 3600), 4)).lower()


def test_household_totals_from_measured_rows(spark, sf):
    """Household cells are made for the sums alone: they meet no join and no frame to the end."""
    from wattloom.queries import QUERIES

    made = plan(QUERIES["household_totals"](spark, sf)).lower()
    assert "unboundedfollowing" not in made and "join" not in made.split("sequence(slot")[0]


def test_short_channels_are_ranked_without_a_join(events):
    """A join with the grid's cells was planned as their broadcast through the driver."""
    found = exact_quantiles(grid(events, "ts", "channel", "value", 3600), [0.5])
    assert "Join" not in plan(found)
    assert {r.channel: r.q for r in found.collect()}["b"] == [3.0]


def test_percentiles_of_households_make_no_empty_cells(spark, sf, tmp_path):
    from wattloom.queries import QUERIES

    rows = [(START + dt.timedelta(hours=h), u, v) for u, h, v in ((1, 0, 1.0), (1, 5000, 4.0), (2, 9000, None), (3, 9000, 7.0))]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["household_percentiles"](spark, str(tmp_path))
    assert {r.channel: r.p25 for r in found.collect()} == {f"Household_{k:05d}": v for k, v in ((1, 1.75), (2, None), (3, 7.0))}
    assert "sequence(slot" not in plan(QUERIES["household_percentiles"](spark, sf))
