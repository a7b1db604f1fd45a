"""Zero-phase low-pass of channels on a uniform grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.butter import butterworth, smooth
from wattloom.operators.panel import uniform_grid
from wattloom.operators.repair import lowpass_input
from wattloom.operators.screen import clip

#: Rows filtered at once, and rows before and after that settle the filter. A Butterworth's
#: memory fades geometrically; SETTLE cutoffs leave less of it than rounding does.
STRETCH, SETTLE = 200_000, 40


def lowpass(readings: DataFrame, step_s: int, cutoff_min: float = 30.0, order: int = 3, valid_range: tuple[float, float] | None = None, clamp: bool = True) -> DataFrame:
    """Readings on a grid of `step_s`, screened, filled, filtered and clamped; missing stays missing.

    A channel shorter than a stretch is filtered whole; a longer one in stretches that overlap
    by what the filter needs to settle, so that none is limited to one task.
    """
    if cutoff_min <= 2 * step_s / 60:
        raise ValueError(f"a cutoff of {cutoff_min:g} min is at or above the Nyquist limit of {2 * step_s / 60:g} min")
    butterworth(order, 2 * step_s / 60 / cutoff_min)
    edge = int(np.ceil(SETTLE * cutoff_min * 60 / step_s)) + 3 * (order + 1)
    rows = lowpass_input(uniform_grid(readings, step_s), valid_range)
    first, last = F.floor((F.col("pos") - edge) / STRETCH), F.floor((F.col("pos") + edge) / STRETCH)
    rows = rows.withColumn("stretch", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        own = (part["pos"] // STRETCH == part["stretch"]).to_numpy()
        values = part["value"].to_numpy(float)
        if not own.any():
            out = values
        elif np.isfinite(values).all():
            out = smooth(values, step_s / 60, cutoff_min, order)
        else:  # a channel without any value
            out = values
        return pd.DataFrame({"channel": part["channel"], "pos": part["pos"], "ts": part["ts"], "value": out, "missing": part["missing"]})[own]

    out = rows.groupBy("channel", "stretch").applyInPandas(lambda part: run(part), "channel string, pos long, ts timestamp_ntz, value double, missing boolean")
    value = F.when(~F.col("missing"), F.nanvl("value", F.lit(None)))
    if clamp and valid_range:
        value = clip(value, *valid_range)
    return out.withColumn("value", value).drop("missing")
