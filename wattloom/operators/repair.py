"""Repair of series with local splines: outliers that were flagged, and holes that were there."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.bspline import band_flags, impute_regions
from wattloom.operators.chunks import with_halo
from wattloom.operators.gaps import interpolate, regions
from wattloom.operators.rolling import DETECTORS, check_detector
from wattloom.operators.screen import clip

#: Fixed value: a channel needs so many rows with a value to be repaired.
MIN_ROWS = 50
#: Rows of a channel whose gaps are fitted together.
STRETCH = 8192
TOO_LONG, TOO_THIN, NIGHT = "run longer than max gap ({})", "not enough clean context for a local fit", "night — set to zero"


def _check_rows(readings: DataFrame) -> None:
    """Refuse channels with too few values for a repair to mean anything."""
    few = readings.groupBy("channel").agg(F.count("value").alias("n")).where(F.col("n") < MIN_ROWS).orderBy("channel").limit(5).collect()
    if few:
        raise ValueError(f"fewer than {MIN_ROWS} values in " + ", ".join(f"{r.channel} ({r.n})" for r in few))


def _context(rows: DataFrame, gaps: DataFrame, context: int) -> DataFrame:
    """Rows around each gap: (channel, gap, start, end, pos, ts, value, blocked), by an equi-join on pos.

    A gap of n rows asks for max(context, 4n) rows on either side, so the work grows with the gaps.
    """
    reach = F.greatest(F.lit(context), 4 * F.col("length"))
    wanted = gaps.select("channel", "start", "end", F.explode(F.sequence(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach)).alias("pos"))
    return wanted.join(rows.select("channel", "pos", "ts", "value", "blocked"), ["channel", "pos"])


def _fills(rows: DataFrame, gaps: DataFrame, context: int, smoothing: float, longest: int, dark: float | None = None) -> DataFrame:
    """(channel, start, pos, fill, reason) for the rows of each of the `gaps`, none longer than `longest`; a null fill where no local fit is possible.

    Rows are dealt into stretches with as much on either side as the longest gap's fit sees; all
    gaps that start in a stretch are fitted there in stacks.
    """
    side = max(context, 4 * longest) + longest
    near = with_halo(rows.select("channel", "pos", "ts", "value", "blocked"), side, side, STRETCH)
    own = gaps.select(F.col("channel").alias("owner"), F.col("start"), F.col("end"), F.floor(F.col("start") / STRETCH).alias("part"))

    def fill(rows: pd.DataFrame, gaps: pd.DataFrame) -> pd.DataFrame:
        rows, gaps = rows.sort_values("pos"), gaps.sort_values("start")
        pos, values = rows["pos"].to_numpy(), rows["value"].to_numpy(float)
        x = rows["ts"].to_numpy("datetime64[s]").astype(np.int64) / 86_400.0
        starts, ends = gaps["start"].to_numpy(), gaps["end"].to_numpy()
        found = impute_regions(x, np.where(rows["blocked"].to_numpy(bool), np.nan, values), pos, starts, ends, context, smoothing) if len(gaps) else []
        reasons = [TOO_THIN if f is None else "" for f in found]
        if dark is not None:
            for k, (a, b) in enumerate(zip(np.searchsorted(pos, starts), np.searchsorted(pos, ends), strict=True)):
                around = np.concatenate([values[max(0, a - context) : a], values[b + 1 : b + 1 + context]])
                around = around[np.isfinite(around)]
                if len(around) >= 4 and around.max() <= dark:
                    found[k], reasons[k] = np.zeros(b - a + 1), NIGHT
        sizes = ends - starts + 1
        fills = [np.full(n, np.nan) if f is None else f for f, n in zip(found, sizes, strict=True)]
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        names = gaps["owner"].to_numpy()
        return pd.DataFrame({"channel": np.repeat(names, sizes), "start": np.repeat(starts, sizes), "pos": flat([np.arange(a, b + 1) for a, b in zip(starts, ends, strict=True)], np.int64), "fill": flat(fills, float), "reason": np.repeat(np.array(reasons, object), sizes)})

    both = near.groupBy("channel", "chunk").cogroup(own.groupBy("owner", "part"))
    return both.applyInPandas(fill, "channel string, start long, pos long, fill double, reason string").withColumn("fill", F.nanvl("fill", F.lit(None)))


def _repair(rows: DataFrame, gaps: DataFrame, max_gap: int, context: int, smoothing: float, dark: float | None, bounds: tuple[float, float] | None) -> DataFrame:
    short = gaps.where(f"length <= {max_gap}")
    fills = _fills(rows, short, context, smoothing, max_gap, dark)
    if bounds:
        fills = fills.withColumn("clamped", F.col("fill") != clip(F.col("fill"), *bounds)).withColumn("fill", clip(F.col("fill"), *bounds))
    long = gaps.where(f"length > {max_gap}").select("channel", "start", F.explode(F.sequence("start", "end")).alias("pos"), F.lit(None).cast("double").alias("fill"), F.lit(TOO_LONG.format(max_gap)).alias("reason"))
    return rows.join(fills.unionByName(long, allowMissingColumns=True), ["channel", "pos"], "left")


def clean_series(readings: DataFrame, method: str = "zscore", window: int = 48, sigma: float = 3.0, smoothing: float = 1.0, context: int = 12, max_gap: int = 24) -> DataFrame:
    """Readings with outliers replaced by a local fit; adds before, flagged, imputed, reason.

    Flagged runs longer than `max_gap`, and such without clean rows enough around them, stay
    missing, with the reason. A channel with fewer than MIN_ROWS values is an error. Holes that were there before are never flagged, so never filled.
    """
    check_detector(window, sigma)
    _check_rows(readings)
    flags = DETECTORS[method](readings, window, sigma).select(*readings.columns, "flagged")
    rows = flags.withColumn("before", F.col("value")).withColumn("value", F.when(~F.col("flagged"), F.col("value"))).withColumn("blocked", F.col("flagged"))
    out = _repair(rows, regions(flags, F.col("flagged")), max_gap, context, smoothing, None, None)
    return out.withColumn("imputed", F.col("fill").isNotNull()).withColumn("value", F.coalesce("fill", "value")).select(*readings.columns, "before", "flagged", "imputed", F.coalesce("reason", F.lit("")).alias("reason"))


def impute_missing(readings: DataFrame, smoothing: float = 0.1, context: int = 60, max_gap: int = 24, valid_range: tuple[float, float] | None = None, dark_threshold: float | None = None) -> DataFrame:
    """Readings with holes filled by a local fit; adds imputed, clamped, reason.

    In this order: too long a hole stays; between dark neighbours it becomes zero; else the
    spline, clamped to the valid range. A channel with fewer than MIN_ROWS values is an error.
    """
    _check_rows(readings)
    rows = readings.withColumn("blocked", F.col("value").isNull())
    out = _repair(rows, regions(readings, F.col("value").isNull()), max_gap, context, smoothing, dark_threshold, valid_range)
    clamped = F.coalesce(F.col("clamped"), F.lit(False)) if valid_range else F.lit(False)
    return out.withColumn("imputed", F.col("fill").isNotNull()).withColumn("value", F.coalesce("value", "fill")).select(*readings.columns, "imputed", clamped.alias("clamped"), F.coalesce("reason", F.lit("")).alias("reason"))


def region_table(repaired: DataFrame, mask: str) -> DataFrame:
    """(channel, start, end, length, imputed, reason) of a repair's regions; `mask` names what made them."""
    runs = regions(repaired, F.expr(mask))
    first = repaired.select("channel", F.col("pos").alias("start"), "imputed", "reason")
    return runs.join(first, ["channel", "start"]).select("channel", "start", "end", "length", "imputed", "reason")


def corrections(repaired: DataFrame, top: int | None = None) -> DataFrame:
    """(timestamp, channel, original, imputed, change), the largest changes first (15 in the report)."""
    out = repaired.where("imputed").select(F.col("ts").alias("timestamp"), "channel", F.col("before").alias("original"), F.col("value").alias("imputed"), (F.col("value") - F.col("before")).alias("change"))
    out = out.orderBy(F.desc(F.abs("change")), "timestamp", "channel")
    return out.limit(top) if top else out


def holdout_validation(readings: DataFrame, channel: str, n: int = 200, smoothing: float = 1.0, context: int = 12, seed: int = 42) -> dict[str, float]:
    """Errors of the local fit, and of linear interpolation, on hidden clean readings of one channel.

    A sample of `n` readings is drawn by a seeded hash; each is hidden by itself.
    """
    rows = readings.where(F.col("channel") == channel).withColumn("blocked", F.col("value").isNull())
    edges = rows.agg(F.min("pos").alias("a"), F.max("pos").alias("b")).first()
    inner = rows.where(F.col("value").isNotNull() & F.col("pos").between(edges.a + context, edges.b - context))
    picks = inner.orderBy(F.xxhash64("pos", F.lit(seed)), "pos").limit(n).select("channel", F.col("pos").alias("start"), F.col("pos").alias("end"), F.lit(1).cast("long").alias("length"), F.col("value").alias("true"))
    if picks.count() < 20:
        raise ValueError("too few clean readings to validate on")
    around = _context(rows, picks, context)
    around = around.withColumn("value", F.when(F.col("pos") != F.col("start"), F.col("value")))
    fits = _fills(rows, picks, context, smoothing, 1).select("channel", "pos", "fill")
    linear = _neighbour_line(around)
    both = picks.withColumnRenamed("start", "pos").join(fits, ["channel", "pos"]).join(linear, ["channel", "pos"]).where("fill is not null and line is not null")
    e, l = F.col("fill") - F.col("true"), F.col("line") - F.col("true")
    r = both.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(l)).alias("linear_mae"), F.sqrt(F.avg(l * l)).alias("linear_rmse"), F.stddev_pop("true").alias("std")).first()
    return r.asDict()


def _neighbour_line(around: DataFrame) -> DataFrame:
    """(channel, pos, line): straight line between the nearest present rows of each hidden one."""
    point = F.struct("pos", "value")
    before = F.max(F.when((F.col("pos") < F.col("start")) & F.col("value").isNotNull(), point)).alias("p")
    after = F.min(F.when((F.col("pos") > F.col("start")) & F.col("value").isNotNull(), point)).alias("n")
    by = around.groupBy("channel", "start").agg(before, after)
    line = F.col("p.value") + (F.col("n.value") - F.col("p.value")) * F.try_divide(F.col("start") - F.col("p.pos"), F.col("n.pos") - F.col("p.pos"))
    return by.select("channel", F.col("start").alias("pos"), line.alias("line"))


def spline_flags(readings: DataFrame, smoothing: float = 1e4, z: float = 1.96, log_scale: bool = False, rows_per_fit: int = 8064, overlap: int = 576) -> DataFrame:
    """Adds curve, low, high, flagged: outside the prediction band of a spline through each stretch of `rows_per_fit` rows.

    A fit also sees `overlap` rows on either side of its stretch, so that the curve has no loose
    ends where stretches meet. Also of the stretch's fit: n_fitted, df, df_per_day and
    basis_capped. A stretch with too few values for a fit is left unflagged, with nulls there.
    """

    def flag(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        own = (rows["pos"] // rows_per_fit == rows["chunk"]).to_numpy()
        x = rows["ts"].to_numpy("datetime64[s]").astype(np.int64) / 86_400.0
        curve = low = high = np.full(len(rows), np.nan)
        flags, told = np.zeros(len(rows), bool), {"n_fitted": None, "df": np.nan, "df_per_day": np.nan, "basis_capped": None}
        if own.any():
            with contextlib.suppress(ValueError):
                flags, curve, low, high, fit = band_flags(x - x[0], rows["value"].to_numpy(float), smoothing, z, log_scale)
                told = {"n_fitted": fit.n_fitted, "df": fit.df, "df_per_day": fit.df_per_day(float(x[-1] - x[0])), "basis_capped": fit.basis_capped}
        return pd.DataFrame({"channel": rows["channel"], "pos": rows["pos"], "ts": rows["ts"], "value": rows["value"], "curve": curve, "low": low, "high": high, "flagged": flags, **told})[own]

    stretch = with_halo(readings.select("channel", "pos", "ts", "value"), overlap, overlap, rows_per_fit)
    out = stretch.groupBy("channel", "chunk").applyInPandas(lambda rows: flag(rows), "channel string, pos long, ts timestamp_ntz, value double, curve double, low double, high double, flagged boolean, n_fitted long, df double, df_per_day double, basis_capped boolean")
    return out.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("value", "curve", "low", "high", "df", "df_per_day")})


def lowpass_input(readings: DataFrame, valid_range: tuple[float, float] | None) -> DataFrame:
    """Screened and filled readings, with `missing` where nothing valid was."""
    v = F.col("value")
    good = F.when(v.between(*valid_range), v) if valid_range else v
    screened = readings.withColumn("value", good).withColumn("missing", F.col("value").isNull())
    return interpolate(screened, None)
