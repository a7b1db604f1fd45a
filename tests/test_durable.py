"""Durable layers: written once, read from their own files, branches and both sessions."""

import pytest
from pyspark.sql import functions as F

from wattloom.model import Channel, Dataset
from wattloom.plans.durable import DurableStack
from wattloom.plans.steps import AggregateStep, InterpolateStep, NormaliseStep, SentinelStep

CHANNELS = (Channel.of("a", "power", 0.9, "by name"), Channel.of("b", "irradiance", 0.5))


def dataset(spark):
    rows = [(c, k, f"2024-01-01 00:{5 * k:02d}:00", -999.0 if (c, k) in {("a", 3), ("b", 4)} else float(k + 1)) for c in "ab" for k in range(10)]
    readings = spark.createDataFrame(rows, "channel string, pos long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return Dataset(readings, CHANNELS, "household_panel", "panel.csv", "Raw", 300, ("a note",))


def test_layers_are_written_once_and_read_alone(spark, tmp_path, capsys):
    stack = DurableStack.create(str(tmp_path / "x"), dataset(spark))
    for step in (SentinelStep(), InterpolateStep(2), AggregateStep(), NormaliseStep(1.0)):
        stack.apply(step)
    assert [r.id for r in stack.layers()] == [0, 1, 2, 3, 4] and stack.active.parent == 3
    last = stack.dataset()
    last.readings.explain("formatted")
    plan = capsys.readouterr().out
    assert "Scan parquet" in plan and not any(x in plan for x in ("Exchange", "Window", "Join", "Aggregate"))
    files = {f for f in last.readings.inputFiles()}
    assert files and all("/layers/0004-" in f for f in files)
    assert last.readings.count() == 10 and last.readings.agg(F.max("value")).first()[0] == 1.0
    assert stack.active.n_rows == 10 and stack.layers()[1].n_changed == 2


def test_a_new_session_finds_layers_ledger_and_what_is_known(spark, tmp_path):
    folder = str(tmp_path / "y")
    stack = DurableStack.create(folder, dataset(spark))
    stack.apply(SentinelStep())
    stack.apply(InterpolateStep(2))
    again = DurableStack(spark, folder)
    assert again.layers() == stack.layers() and again.breadcrumb() == stack.breadcrumb() and again.active == stack.active
    ds = again.dataset()
    assert ds.channels == CHANNELS and (ds.kind, ds.source, ds.interval_s, ds.notes) == ("household_panel", "panel.csv", 300, ("a note",))
    ledger = again.full_ledger().groupBy("layer").count().orderBy("layer").collect()
    assert [(r.layer, r["count"]) for r in ledger] == [(1, 2), (2, 2)]
    assert again.dataset(0).readings.where("value = -999").count() == 2  # the root stays


def test_going_back_makes_branches(spark, tmp_path):
    folder = str(tmp_path / "z")
    stack = DurableStack.create(folder, dataset(spark))
    stack.apply(SentinelStep())
    stack.apply(InterpolateStep(2))
    assert stack.revert().id == 1 and stack.apply(InterpolateStep(1)).parent == 1
    assert [r.id for r in stack.lineage()] == [0, 1, 3] and [r.id for r in stack.lineage(2)] == [0, 1, 2]
    assert DurableStack(spark, folder).active.id == 3
    assert stack.revert(2).id == 2 and DurableStack(spark, folder).active.id == 2
    with pytest.raises(KeyError):
        stack.revert(9)
    stack.revert(0)
    with pytest.raises(RuntimeError):
        stack.revert()
    with pytest.raises(ValueError):
        DurableStack.create(folder, dataset(spark))


def test_a_broken_commit_leaves_no_layer(spark, tmp_path):
    folder = str(tmp_path / "w")
    stack = DurableStack.create(folder, dataset(spark))

    class Broken:
        key, name = "broken", "Broken"

        def run(self, ds):
            result = SentinelStep().run(ds)
            bad = result.dataset.readings.withColumn("value", F.raise_error(F.lit("halfway")).cast("double"))
            return type(result)(ds.with_readings(bad, "Broken"), result.ledger)

    with pytest.raises(Exception, match="halfway"):
        stack.apply(Broken())
    assert [r.id for r in DurableStack(spark, folder).layers()] == [0] and stack.apply(SentinelStep()).id == 1
    # Another writer has gone on from the same place.
    late = DurableStack(spark, folder)
    stack.apply(InterpolateStep(2))
    with pytest.raises(Exception, match="(?i)exist"):
        late.apply(InterpolateStep(2))
