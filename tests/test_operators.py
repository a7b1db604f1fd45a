"""Operators against pandas on gappy series, across chunk borders and at edges."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import chunks, faults, gaps, repair, rolling, scaling, stats
from wattloom.model import Channel
from wattloom.operators.classify import channel_roles, classify, infer_kind, name_role
from wattloom.operators.faults import calibrate
from wattloom.operators.lowpass import lowpass
from wattloom.operators.panel import grid, uniform_grid
from wattloom.operators.screen import clip, replace_sentinels
from wattloom.queries import QUERIES, load_series, load_total


def frame(spark, values, channel="a"):
    ts = pd.date_range("2024-01-01", periods=len(values), freq="5min")
    rows = [(channel, i, t.to_pydatetime(), None if v is None or v != v else float(v)) for i, (t, v) in enumerate(zip(ts, values, strict=True))]
    return spark.createDataFrame(rows, "channel string, pos long, ts timestamp_ntz, value double")


@pytest.fixture
def gappy():
    rng = np.random.default_rng(5)
    v = rng.normal(50, 10, 400)
    v[rng.random(400) < 0.3] = np.nan
    v[:7] = np.nan
    v[-5:] = np.nan
    v[100:130] = np.nan
    return v


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    for module in (chunks, gaps):
        monkeypatch.setattr(module, "CHUNK", 37, raising=False)
    for f in (chunks.with_halo, chunks.own_rows, chunks.with_chunk):
        monkeypatch.setattr(f, "__defaults__", (37,))


@pytest.mark.parametrize("limit", [1, 3, 24, None])
def test_interpolation_is_pandas(spark, gappy, limit):
    got = gaps.interpolate(frame(spark, gappy), limit).orderBy("pos").toPandas()["value"].to_numpy(float)
    want = pd.Series(gappy).interpolate(limit=limit, limit_direction="both").to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_interpolation_without_values_or_rows(spark):
    assert gaps.interpolate(frame(spark, [None, None, None])).where("value is not null").count() == 0
    assert gaps.interpolate(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        gaps.interpolate(frame(spark, [1.0]), 0)


@pytest.mark.parametrize("window", [5, 12, 48])
def test_zscore_is_pandas(spark, gappy, window):
    got = rolling.rolling_zscore(frame(spark, gappy), window, 1.5).orderBy("pos").toPandas()
    r = pd.Series(gappy).rolling(window, center=True, min_periods=max(3, window // 2))
    np.testing.assert_allclose(got["centre"].to_numpy(float), r.mean(), atol=1e-9)
    np.testing.assert_allclose(got["threshold"].to_numpy(float), 1.5 * r.std(), atol=1e-9)
    want = (pd.Series(gappy) - r.mean()).abs() > 1.5 * r.std()
    assert (got["flagged"].to_numpy(bool) == want.to_numpy()).all()


@pytest.mark.parametrize("window", [5, 12])
def test_medians_are_pandas(spark, gappy, window):
    s = pd.Series(gappy)
    centre = s.rolling(window, center=True, min_periods=1).median()
    got = rolling.hampel(frame(spark, gappy), window, 3).orderBy("pos").toPandas()
    np.testing.assert_allclose(got["centre"].to_numpy(float), centre, atol=1e-9)
    np.testing.assert_allclose(got["spread"].to_numpy(float), (s - centre).abs().rolling(window, center=True, min_periods=1).median(), atol=1e-9)
    mad = rolling.rolling_mad(frame(spark, gappy), window).orderBy("pos").toPandas()["scale"].to_numpy(float)
    own = s.rolling(window, center=True, min_periods=1).apply(lambda x: np.nanmedian(np.abs(x - np.nanmedian(x))) if np.isfinite(x).any() else np.nan, raw=True)
    np.testing.assert_allclose(mad, 1.4826 * own, atol=1e-9)


def test_zscore_ceiling(spark):
    assert rolling.min_window_for_zscore(3) == 11
    with pytest.raises(ValueError):
        rolling.check_detector(10, 3.0)
    flat = rolling.rolling_zscore(frame(spark, [5.0] * 100), 12, 3)
    assert flat.where("flagged").count() == 0


def test_runs_cross_chunks(spark, gappy):
    got = {(r.start, r.end) for r in gaps.regions(frame(spark, gappy), F.col("value").isNull()).collect()}
    m = np.isnan(gappy).astype(int)
    e = np.diff(np.r_[0, m, 0])
    assert got == set(zip(np.flatnonzero(e == 1).tolist(), (np.flatnonzero(e == -1) - 1).tolist(), strict=True))


def test_moments_of_constants_and_few(spark):
    r = stats.moments(frame(spark, [4.0] * 10)).first()
    assert (r.std, r.skew, r.kurtosis) == (0.0, 0.0, 0.0)
    r = stats.moments(frame(spark, [4.0])).first()
    assert r.std == 0.0 and r.skew is None


def test_shape_is_pandas(spark):
    v = np.random.default_rng(1).gamma(2, 3, 300)
    r = stats.moments(frame(spark, v)).first()
    s = pd.Series(v)
    assert r.skew == pytest.approx(s.skew()) and r.kurtosis == pytest.approx(s.kurt())


def test_scaler_round_trip_and_file(spark, tmp_path, gappy):
    rows = frame(spark, gappy).unionByName(frame(spark, [3.0] * 400, "flat")).unionByName(frame(spark, [None] * 400, "none"))
    scaler = scaling.fit(rows, 0.7)
    scaled = scaling.transform(rows, scaler)
    assert scaled.where("channel = 'flat' and value <> 0").count() == 0
    whole = scaling.round_trip_error(rows, scaler).first()
    assert whole.max_error < 1e-12 and whole.n_close == whole.n > 0
    assert scaling.round_trip_error(rows, scaler, digits=2).first().max_error > 1e-6
    path = str(tmp_path / "scaler.json")
    scaling.ScalerFile.of(scaler).save(path)
    again = scaling.ScalerFile.load(path).frame(spark)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scaler.select(again.columns).collect()))
    (tmp_path / "bad.json").write_text('{"schema_version": 2, "channels": {}}')
    with pytest.raises(ValueError):
        scaling.ScalerFile.load(str(tmp_path / "bad.json"))


def test_missing_stays_missing(spark):
    rows = frame(spark, [None, 5.0, -999.0])
    assert rows.select(clip(F.col("value"), 0, 1).alias("v")).collect()[0].v is None
    assert [r.value for r in replace_sentinels(rows).orderBy("pos").collect()] == [None, 5.0, None]


def test_duplicates_are_refused_on_a_grid(spark):
    rows = frame(spark, [1.0, 2.0])
    with pytest.raises(Exception, match="duplicate"):
        uniform_grid(rows.unionByName(rows), 300).collect()


def test_clean_repairs_spikes(spark):
    series = load_series(spark, 600).withColumn("value", F.when(F.col("pos").isin(100, 300, 301), F.col("value") + 200).otherwise(F.col("value")))
    out = repair.clean_series(series, window=24, sigma=3.0)
    done = {r.pos: r for r in out.where("flagged").collect()}
    assert {100, 300, 301} <= set(done) and all(done[p].imputed for p in (100, 300, 301))
    truth = {r.pos: r.value for r in load_series(spark, 600).collect()}
    assert all(abs(done[p].value - truth[p]) < 15 for p in (100, 300, 301))
    assert repair.region_table(out, "flagged").count() >= 2
    assert repair.corrections(out, 1).first().change < -150


def test_gaps_fill_and_night_is_zero(spark):
    v = [0.0] * 60 + [100 + 50 * np.sin(i / 9) for i in range(120)]
    v[20] = v[21] = v[120] = None
    v[150:180] = [None] * 30
    out = {r.pos: r for r in repair.impute_missing(frame(spark, v), context=20, max_gap=5, dark_threshold=5.0, valid_range=(0, 500)).collect()}
    assert out[20].value == 0 and out[20].reason == repair.NIGHT
    assert abs(out[120].value - (100 + 50 * np.sin(60 / 9))) < 5
    assert out[160].value is None and "longer than max gap (5)" in out[160].reason


def test_holdout_beats_noise(spark):
    got = repair.holdout_validation(load_series(spark, 800), "load", n=40)
    assert got["n"] == 40 and got["mae"] < got["std"]


def test_lowpass_keeps_constants_and_gaps(spark):
    v = [7.0] * 300
    v[50] = None
    out = {r.pos: r.value for r in lowpass(frame(spark, v), 300, 30).collect()}
    assert out[50] is None and all(abs(x - 7) < 1e-9 for p, x in out.items() if p != 50)
    with pytest.raises(ValueError):
        lowpass(frame(spark, v), 300, 10)


def test_calibration_prefers_something_reachable(spark):
    grid = calibrate(load_series(spark), windows=(12, 24), sigmas=(2.5, 5.0), repeats=2, n_faults=30).toPandas().set_index(["window", "sigma"])
    assert not grid.loc[(12, 5.0)].reachable and grid.loc[(24, 2.5)].recall > 0.1
    with pytest.raises(ValueError):
        calibrate(load_series(spark, 100))


def test_roles(spark):
    names = {"GHI": "irradiance", "t_amb": "temperature", "Household_01": "power", "solar_power_kw": "power", "total_w_m2": "irradiance", "insolation load": "power", "xyz": None, "irradiance kw": "irradiance"}
    rows = spark.createDataFrame([(n,) for n in names], "channel string")
    assert {r.channel: r.role for r in rows.select("channel", name_role(F.col("channel")).alias("role")).collect()} == names
    fields = "channel string, n long, lo double, hi double, has_negative boolean, dark_hours long, lit_hours long"
    prints = spark.createDataFrame([("load", 1000, -10.0, 30.0, True, 0, 0), ("x", 1000, 0.0, 900.0, False, 8, 8), ("y", 100, 0.0, 900.0, False, 8, 8), ("z", None, None, None, None, None, None)], fields)
    got = {r.channel: (r.role, r.confidence, bool(r.note)) for r in channel_roles(prints, "power").collect()}
    assert got == {"load": ("temperature", 0.8, True), "x": ("irradiance", 0.8, False), "y": ("power", 0.6, False), "z": ("power", 0.6, False)}
    assert infer_kind((Channel.of("a", "temperature", 0.8),)) == "environmental"
    one = classify(frame(spark, [1.0, 2.0], "q"), headerless=False)
    assert [(c.name, c.role) for c in one] == [("q", "power")]


def test_bimodal():
    one, two = [0] * 15 + [50] * 10 + [0] * 15, [0] * 5 + [60] * 5 + [0] * 20 + [60] * 5 + [0] * 5
    assert stats.bimodal(two) and not stats.bimodal([1] * 40) and isinstance(stats.bimodal(one), bool)


def test_windows_do_not_run_in_one_task(spark):
    plan = rolling.rolling_zscore(load_series(spark), 12, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_faults_keep_their_distance(spark):
    for n, wanted in ((10**12, 50), (2016, 120), (720, 120)):
        rows = faults.draw_faults(spark, n, 1, repeats=2, n_faults=wanted).orderBy("rep", "position").collect()
        for rep in (0, 1):
            places = [r.position for r in rows if r.rep == rep]
            assert min(b - a for a, b in zip(places, places[1:])) >= 20 and places[0] >= 100 and places[-1] < n - 103
        assert len(rows) == 2 * min(wanted, (n - 203) // max(20, (n - 203) // wanted)) and {r.kind for r in rows} == set(faults.KINDS)
    runs = faults.draw_runs(spark, 20_000, 3, repeats=1).orderBy("position").collect()
    assert len(runs) == 40 and all(b.position - a.position - a.length >= 60 for a, b in zip(runs, runs[1:])) and {r.kind for r in runs} == set(faults.TUNER_KINDS)
    assert all(3 <= r.length <= 9 or r.kind == "spike" and r.length == 1 for r in runs)


def test_precision_is_missing_when_nothing_is_flagged(spark):
    flags = frame(spark, [1.0, 2.0]).withColumn("flagged", F.lit(False)).withColumn("fault", F.lit(1))
    r = faults.event_scores(flags, ["channel"]).first()
    assert r.precision is None and r.f1 == 0 and r.f_half == 0


def test_recall_at_the_best_cell(spark):
    series = load_series(spark)
    got = faults.recall_at(series, 24, 3.0, repeats=2, n_faults=40).collect()
    assert {r.magnitude for r in got if r.kind == "size"} == set(faults.MAGNITUDES) and {r.length for r in got if r.kind == "dropout"} <= {1, 2, 3}
    by = {r.magnitude: r.recall for r in got if r.kind == "size"}
    assert by[12.0] >= by[3.0]


def test_grids_come_from_many_tasks(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("b", "2025-01-01 00:00:00", 2.0)], "c string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = grid(events, "t", "c", "v", 300)
    assert out.count() == 2 * (366 * 288 + 1) and out.where("value is not null").count() == 2
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert grid(events.where("false"), "t", "c", "v", 300).count() == 0


def test_calibration_queries_judge_the_tables(spark, sf):
    rows = QUERIES["fault_injection"](spark, sf).collect()
    truth = {r.pos: r.ts for r in load_total(spark, sf).collect()}
    assert len(truth) >= 500 and sorted(truth) == list(range(len(truth))) and {r.pos: r.ts for r in rows} == truth
    assert {(r.window, r.sigma) for r in QUERIES["detector_stability"](spark, sf).collect()} == {(w, s) for w in faults.TUNER_WINDOWS for s in faults.TUNER_SIGMAS}
