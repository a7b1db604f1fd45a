from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from wattloom.__main__ import main
from wattloom.model import Channel, Dataset
from wattloom.operators.distributions import channel_statistics, skew_range
from wattloom.operators.faults import calibrate_channels, run_note, tunable
from wattloom.operators.repair import clean_series, impute_missing
from wattloom.plans.gates import State, advance, check_parameters, date_window, legal_actions, revert, shift_window
from wattloom.plans.layers import LayerStack, StatsCache
from wattloom.plans.steps import AggregateStep, CleanStep, FillStep, FilterStep, InterpolateStep, NormaliseStep, SentinelStep, run_chain
from wattloom.queries import load_series as load_formula
from wattloom.sources.files import derived_name, load_dataset, load_readings, load_series, wide, write_table
from wattloom.streaming.maps import prepare, write_stream

PANEL = "2002-02-01 00:00:30,1.5,-999\n2002-02-01 00:10:00,3.5,4\n2002-02-01 00:05:00,x,2\n2002-02-01 00:15:00,-999,5\n"


@pytest.fixture
def panel(tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text(PANEL)
    return str(path)


def test_loading(spark, panel, tmp_path):
    rows, headerless = load_readings(spark, panel)
    assert headerless and {r.channel for r in rows.collect()} == {"Household_01", "Household_02"}
    first = rows.where("channel = 'Household_01'").orderBy("pos").collect()
    assert [r.value for r in first] == [1.5, None, 3.5, -999.0] and first[0].ts.second == 0
    named = tmp_path / "series.csv"
    named.write_text("timestamp,note,total_active_power_kw\n2024-01-01 00:00,a,1\n2024-01-01 01:00,b,2\n")
    assert [r.value for r in load_series(spark, str(named)).orderBy("pos").collect()] == [1.0, 2.0]
    ds = load_dataset(spark, panel)
    assert ds.kind == "household_panel" and ds.interval_s == 300 and ds.interval_label() == "5 min"
    for bad in ("x.docx", "y"):
        with pytest.raises(ValueError):
            load_readings(spark, bad)
    with pytest.raises(KeyError):
        ds.series("nothing")
    with pytest.raises(ValueError):
        write_table(ds.readings, panel, panel)
    assert derived_name("/a/b.csv", "cleaned") == "/a/b_cleaned.csv"


def test_duplicate_times(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("2024-01-01 00:00,1\n2024-01-01 00:00,2\n2024-01-01 00:05,3\n")
    assert load_readings(spark, str(path))[0].count() == 3
    kept = load_readings(spark, str(path), "first")[0].orderBy("pos").collect()
    assert [(r.pos, r.value) for r in kept] == [(0, 1.0), (1, 3.0)]


def test_chain_layers_and_export(spark, panel):
    ds = load_dataset(spark, panel)
    result = run_chain(ds, [SentinelStep(), InterpolateStep(2), AggregateStep(), NormaliseStep(1.0)])
    values = [r.value for r in result.dataset.readings.orderBy("pos").collect()]
    assert len(values) == 4 and min(values) == 0 and max(values) == 1
    changed = result.ledger.collect()
    assert sum(r.reason.startswith("sentinel") for r in changed) == 2 and all(r.before == -999 for r in changed if r.reason.startswith("sentinel"))
    assert "Sentinel replacement" in result.report and "Aggregation" in result.report
    assert ds.readings.where("value = -999").count() == 2  # the input stays
    stack = LayerStack(ds)
    stack.stage(SentinelStep().run(ds))
    stack.discard()
    layer = stack.stage(SentinelStep().run(ds))
    assert layer.id == 2 and stack.commit().n_changed() == 2 and stack.breadcrumb() == "Raw › Sentinels"
    assert stack.full_ledger().count() == 2 and stack.can_revert() and stack.revert().id == 0
    stack.stage(InterpolateStep().run(ds))
    stack.commit()
    assert len(stack.history()) == 2 and stack.revert_to_root().name == "Raw"
    assert wide(ds.readings, ds.names()).columns == ["ts", "Household_01", "Household_02"]


def test_cache_keeps_the_last():
    cache, made = StatsCache(2), []
    for k in (1, 2, 1, 3, 2):
        cache.get((k,), lambda k=k: made.append(k))
    assert made == [1, 2, 3, 2]


def test_gates():
    s = State("loaded", "household_panel", "power")
    assert {"sentinels", "detect"} <= legal_actions(s) and "aggregate" not in legal_actions(s)
    s = advance(s, "sentinels")
    assert "aggregate" in legal_actions(s) and "sentinels" not in legal_actions(s)
    assert advance(s, "aggregate").stage == "aggregated"
    assert legal_actions(State()) == {"import"} and not legal_actions(State(busy=True))
    assert "filter" in legal_actions(State("loaded", "environmental"))
    with pytest.raises(ValueError):
        advance(State(), "clean")


def test_going_back():
    s = State("aggregated", "household_panel", "power", can_revert=True)
    assert [revert(s, x).stage for x in ("Raw", "Sentinels", "Interpolated", "Aggregated", "Cleaned")] == ["loaded", "loaded", "sentinels_handled", "aggregated", "aggregated"]
    assert revert(State("aggregated", "aggregate_series", can_revert=True), "Aggregated", first=True) == State("loaded", "aggregate_series")
    with pytest.raises(ValueError):
        revert(State("loaded"), "Raw")


def test_clean_fill_and_filter_steps(spark):
    series = load_formula(spark, 1200).withColumn("value", F.when(F.col("pos").isin(300, 700), F.col("value") + 300).when(F.col("pos").between(500, 503), None).otherwise(F.col("value")))
    ds = Dataset(series, (Channel.of("load", "power", 0.9),), "aggregate_series", "x", "Raw", 300)
    reasons, reports = [], []
    for step in (CleanStep(sigma=4.0), FillStep(), FilterStep()):
        result = step.run(ds)
        reasons += [r.reason for r in result.ledger.collect()]
        reports.append(result.report)
        rows = result.dataset.readings.select(*series.columns).collect()
        ds = replace(result.dataset, readings=spark.createDataFrame(rows, series.schema))  # what follows starts from here
    assert sum(r.startswith("zscore") for r in reasons) >= 2 and sum(r.startswith("local fit") for r in reasons) == 4 and sum(r.startswith("low-pass") for r in reasons) > 1000
    assert max(r.value for r in rows) < 200
    for title in ("Cleaning", "Gap filling", "Low-pass filter", "Largest corrections", "What was taken away"):
        assert title in "".join(reports)


def _load_file(spark, tmp_path, n, gaps):
    rows = load_formula(spark, n).orderBy("pos").toPandas()
    rows.loc[rows["pos"].isin(gaps), "value"] = None
    path = str(tmp_path / "load.csv")
    rows.assign(ts=rows["ts"].dt.strftime("%Y-%m-%d %H:%M:%S"))[["ts", "value"]].to_csv(path, index=False)
    return path


def test_tune_writes_grid_and_report(spark, tmp_path):
    """On the longest run without a gap: what lies beyond a gap is no neighbour."""
    path = _load_file(spark, tmp_path, 2700, [300, 301, 2500])
    main(["tune", path])
    out = sorted(x.name for x in tmp_path.iterdir())
    assert {"load_tuning_report.txt"} <= set(out) and any("stability" in x for x in out)
    assert "As good as the best" in (tmp_path / "load_tuning_report.txt").read_text()
    run = tunable(load_series(spark, path))
    assert (run.count(), run.agg(F.min("pos")).first()[0], run.agg(F.max("pos")).first()[0]) == (2198, 0, 2197)


def test_calibrate_writes_grid_and_report(spark, tmp_path):
    main(["calibrate", _load_file(spark, tmp_path, 900, [40])])
    text = (tmp_path / "load_calibration_report.txt").read_text()
    assert all(x in text for x in ("Best cell", "As good as the best", "Recall at the best cell", "kind: dropout", "cells lie beyond"))
    assert spark.read.csv(str(tmp_path / "load_calibration.csv"), header=True).count() == 42


def test_run_note(spark):
    rows = lambda *x: spark.createDataFrame([("dropout", None, k + 1, v, 9) for k, v in enumerate(x)] + [("size", 3.0, None, 0.1, 9)], "kind string, magnitude double, length long, recall double, n long")
    assert "90% at 1 row, 40% at 2 rows" in run_note(rows(0.9, 0.4)) and run_note(rows(0.9, 0.88)) == run_note(rows(0.9)) == ""
    with pytest.raises(ValueError, match="zscore or hampel"):
        calibrate_channels(rows(0.1), "other")


def test_tune_refuses_short_runs(spark, tmp_path):
    with pytest.raises(ValueError, match="1300 rows; tuning needs 2000"):
        main(["tune", _load_file(spark, tmp_path, 2600, [1300])])


def test_repairs_refuse_few_values(spark):
    rows = load_formula(spark, 49)
    with pytest.raises(ValueError, match="fewer than 50 values"):
        clean_series(rows)
    with pytest.raises(ValueError, match="fewer than 50 values"):
        impute_missing(rows)


def test_a_bad_time_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("time,a\n2024-01-01 00:00,1\nnot a time,2\n,\n")
    with pytest.raises(Exception, match="does not parse: not a time"):
        load_readings(spark, str(path))[0].collect()


def test_statistics_in_words(spark):
    rows = load_formula(spark, 800).withColumn("channel", F.lit("load"))
    r = channel_statistics(rows, 300).first()
    assert isinstance(r.two_peaks, bool) and r["shape"] and r["family"] and r.n == 800
    got = skew_range(rows, rows.select("pos", "ts", F.col("value").alias("total"))).first()
    assert got.least == got.most == pytest.approx(got.of_total)


def test_parameters():
    for bad in (dict(window=12, sigma=4.0), dict(cutoff_min=10, step_min=5), dict(max_gap=0), dict(share_pct=0), dict(low=1, high=1)):
        with pytest.raises(ValueError):
            check_parameters(**bad)
    assert len(check_parameters(max_gap=50, rows=100, layer="Raw")) == 2


def test_dates():
    first, last = date(2024, 1, 1), date(2024, 12, 31)
    assert date_window("Month", date(2024, 1, 31), first, last) == (date(2024, 1, 31), date(2024, 2, 28))
    assert date_window("Week", date(2024, 12, 30), first, last)[1] == last
    assert shift_window("Month", date(2024, 3, 31), -1, first, last) == date(2024, 2, 29)
    assert shift_window("Day", first, -1, first, last) == first
    assert shift_window("Free", date(2024, 3, 1), 1, first, last, date(2024, 3, 10)) == date(2024, 3, 11)
    assert shift_window("Free", date(2024, 12, 20), 1, first, last, date(2024, 12, 29)) == date(2024, 12, 22)


def test_stream_equals_batch(spark, panel, tmp_path):
    rows, _ = load_readings(spark, panel)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    write_stream(prepare(stream, valid_range=(0, 4.5)), out, str(tmp_path / "check")).awaitTermination()
    want = prepare(rows, valid_range=(0, 4.5))
    key = lambda df: sorted((r.channel, r.pos, r.value is None, r.value or 0) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(want)
    assert want.where(F.col("value") == 5).count() == 0
