"""Calibration of all channels: its kernels against plain ones, and its chunks against whole channels."""

from functools import partial

import numpy as np
import pytest

from wattloom.functions import sliding
from wattloom.functions.sliding import short_medians, short_zscores, sliding_median
from wattloom.operators import faults
from wattloom.operators.chunks import with_halo

CELLS = {"windows": (12, 48), "sigmas": (2.0, 3.0), "repeats": 2, "n_faults": 12}


@pytest.mark.parametrize("before, after", [(6, 5), (24, 23), (1, 1), (3, 0)])
def test_kernels_equal_plain_ones(monkeypatch, before, after):
    monkeypatch.setattr(sliding, "BLOCK", 64)
    x = np.round(np.random.default_rng(3).normal(size=(3, 100)), 1)
    x[1, 20:75] = 0.1
    assert (short_medians(x, before, after) == np.stack([sliding_median(v, before, after)[0] for v in x])).all()
    got, least = short_zscores(x, before, after, 3), 3
    for (k, i), z in np.ndenumerate(got):
        w = x[k, max(0, i - before) : i + after + 1]
        judged = len(w) >= least and (w != w[0]).any()
        assert z == pytest.approx(abs(x[k, i] - w.mean()) / w.std(ddof=1)) if judged else np.isnan(z)


def readings(spark):
    rng = np.random.default_rng(8)
    rows = [(c, p, float(v) if rng.random() > 0.05 else None) for c, n in (("a", 700), ("b", 1100), ("short", 400)) for p, v in enumerate(rng.normal(20, 3, n))]
    rows += [("flat", p, 7.0) for p in range(600)] + [("steps", p, float(p // 150)) for p in range(900)]
    return spark.createDataFrame(rows, "channel string, pos long, value double")


@pytest.mark.parametrize("detector", ["zscore", "hampel"])
def test_chunks_change_nothing(spark, monkeypatch, detector):
    df = readings(spark)
    whole = sorted(faults.calibrate_channels(df, detector, **CELLS).collect())
    assert {r.channel for r in whole} == {"a", "b", "flat", "steps"} and any(r.f1 > 0.3 for r in whole)
    monkeypatch.setattr(faults, "CHUNK", 250)
    monkeypatch.setattr(faults, "with_halo", partial(with_halo, size=250))
    assert sorted(faults.calibrate_channels(df, detector, **CELLS).collect()) == whole


def test_readings_are_made_once(spark):
    """Counts, draws and detectors each ran all that is upstream again."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = readings(spark)
    n = df.count()
    faults.calibrate_channels(df.mapInArrow(passed, df.schema), **CELLS).collect()
    assert seen.value == n
