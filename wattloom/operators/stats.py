"""Totals and statistics. All sums are partial before they are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.operators.chunks import renumbered
from wattloom.operators.gaps import longest_gap
from wattloom.operators.order import SMALL, exact_median, exact_quantiles, points_of

PERCENTILES = (1, 5, 25, 75, 95, 99)
#: Share of a channel's range that counts as its floor, and from which share of readings it is inflated.
FLOOR_BAND, INFLATED_AT = 0.005, 0.20


def strict_total(readings: DataFrame) -> DataFrame:
    """(pos, ts, total): sum over channels; missing where any channel is. Every cell must have a row."""
    return readings.groupBy("pos", "ts").agg(F.when(F.count("value") == F.count("*"), F.sum("value")).alias("total"))


def naive_total(readings: DataFrame) -> DataFrame:
    """(pos, ts, total): sum of what is there; 0 where nothing is."""
    return readings.groupBy("pos", "ts").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def totals(readings: DataFrame) -> DataFrame:
    """(pos, ts, present, naive, total): values there, their sum, and the sum where all are there, in one aggregate."""
    both = F.sum("value")
    return readings.groupBy("pos", "ts").agg(F.count("value").alias("present"), F.coalesce(both, F.lit(0.0)).alias("naive"), F.when(F.count("value") == F.count("*"), both).alias("total"))


def worst_timestamps(readings: DataFrame, filled: DataFrame, top: int = 5) -> DataFrame:
    """(ts, missing, naive, total): the `top` times at which most channels are missing; `total` is that of the `filled` readings."""
    by = readings.groupBy("pos", "ts").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("naive"))
    worst = by.where("missing > 0").orderBy(F.desc("missing"), "pos").limit(top)
    return strict_total(filled.join(F.broadcast(worst.select("pos")), "pos", "left_semi")).join(worst, ["pos", "ts"]).select("ts", "missing", "naive", "total")


def missing_by_channel(readings: DataFrame) -> DataFrame:
    return readings.groupBy("channel").agg(F.count_if(F.col("value").isNull()).alias("missing"))


def _standard(g: Column, n: Column, sd: Column, least: int, full: Column) -> Column:
    """Bias-corrected shape; 0 for a constant series, missing with too few rows."""
    return F.when(n < least, None).when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(full)


def shape(value: Column) -> tuple[Column, Column]:
    """Sample skewness and sample excess kurtosis as aggregates."""
    n = F.count(value).cast("double")
    sd = F.stddev_pop(value)
    skew = F.try_divide(F.skewness(value) * F.sqrt(n * (n - 1)), n - 2)
    kurt = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return _standard(skew, n, sd, 3, skew), _standard(kurt, n, sd, 4, kurt)


def moments(readings: DataFrame, by: str = "channel") -> DataFrame:
    """n, mean, median, std, min, max, skew, kurtosis by channel. The std of one value is 0."""
    v = F.col("value")
    skew, kurt = shape(v)
    return readings.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), skew.alias("skew"), kurt.alias("kurtosis"))


def percentiles(readings: DataFrame, points: tuple[int, ...] = PERCENTILES, small: int = SMALL) -> DataFrame:
    """(channel, p1, p5, ..., iqr), linear between order statistics; channels beyond `small` values are narrowed down by counts."""
    found = exact_quantiles(readings, [p / 100 for p in points], small)
    return found.select("channel", *points_of(F.col("q"), [f"p{q}" for q in points])).withColumn("iqr", F.col("p75") - F.col("p25"))


def mad(readings: DataFrame, small: int = SMALL) -> DataFrame:
    """(channel, mad): median distance from the median. Medians are one row a channel."""
    away = readings.join(exact_median(readings, "centre", small), "channel").select("channel", F.abs(F.col("value") - F.col("centre")).alias("value"))
    return exact_median(away, "mad", small)


def coverage(readings: DataFrame) -> DataFrame:
    """(channel, n, n_missing, pct_missing, longest_gap)."""
    v = F.col("value")
    counts = readings.groupBy("channel").agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"), (100 * F.try_divide(F.count_if(v.isNull()), F.count("*"))).alias("pct_missing"))
    return counts.join(longest_gap(readings), "channel")


def energy_kwh(readings: DataFrame, interval_s: float) -> DataFrame:
    """(channel, energy_kwh): kilowatts summed over time."""
    return readings.groupBy("channel").agg((F.sum("value") * interval_s / 3600).alias("energy_kwh"))


def _with_range(readings: DataFrame) -> DataFrame:
    span = readings.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return readings.join(span, "channel")


def floor_mass(readings: DataFrame) -> DataFrame:
    """(channel, floor_mass, inflated, floor_is_zero): share of readings at the bottom of the range."""
    band = F.col("lo") + F.greatest(F.lit(1e-9), FLOOR_BAND * (F.col("hi") - F.col("lo")))
    by = _with_range(readings).where("value is not null").groupBy("channel").agg(F.avg((F.col("value") <= band).cast("double")).alias("floor_mass"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return by.select("channel", "floor_mass", (F.col("floor_mass") >= INFLATED_AT).alias("inflated"), (F.abs("lo") < F.greatest(F.lit(1.0), 0.01 * F.abs("hi"))).alias("floor_is_zero"))


def histogram(readings: DataFrame, bins: int = 40) -> DataFrame:
    """(channel, bin, count): equal widths from least to largest, the last bin closed; empty bins are left out."""
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(bins - 1)))
    return _with_range(readings).where("value is not null").groupBy("channel", place.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def increments(readings: DataFrame) -> DataFrame:
    """Adds `step`: the difference to the row before where both are present. Row pairs meet by a join on pos, in any number of tasks."""
    before = readings.select("channel", (F.col("pos") + 1).alias("pos"), F.col("value").alias("_before"))
    return readings.join(before, ["channel", "pos"], "left").withColumn("step", F.col("value") - F.col("_before")).drop("_before")


def increment_moments(readings: DataFrame) -> DataFrame:
    """Moments of the differences between neighbouring rows."""
    return moments(increments(readings).select("channel", F.col("step").alias("value")).where("value is not null"))


def stride_sample(readings: DataFrame, limit: int = 20_000) -> DataFrame:
    """Every k-th present value of a channel, k the least stride that leaves `limit` at most (a fixed feature of the distribution fits)."""
    from_chunk = readings.where("value is not null").withColumn("chunk", F.floor(F.col("pos") / 65_536))
    counts = from_chunk.groupBy("channel", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("channel")
    base = counts.select("channel", "chunk", F.coalesce(F.sum("n").over(w.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.ceil(F.sum("n").over(w) / limit).alias("stride"))
    place = F.row_number().over(Window.partitionBy("channel", "chunk").orderBy("pos")) - 1
    ranked = from_chunk.withColumn("_k", place).join(base, ["channel", "chunk"])
    return ranked.where((F.col("base") + F.col("_k")) % F.col("stride") == 0).drop("chunk", "_k", "base", "stride")


def bimodal(counts: list[int]) -> bool:
    """Two peaks above 0.15 of the highest, with a trough under 0.6 of the lower one between the two highest.

    `counts` are 40 bins, smoothed over three; needs 200 readings.
    """
    if sum(counts) < 200:
        return False
    padded = [0, *counts, 0]
    level = [sum(padded[i : i + 3]) / 3 for i in range(len(counts))]
    peaks = [i for i in range(1, len(level) - 1) if level[i - 1] < level[i] >= level[i + 1] and level[i] > 0.15 * max(level)]
    highest = sorted(sorted(peaks, key=lambda i: -level[i])[:2])
    if len(highest) < 2:
        return False
    return min(level[highest[0] : highest[1] + 1]) < 0.6 * min(level[i] for i in highest)


def verdict(skew: float | None, kurtosis: float | None, two_peaks: bool) -> str:
    """What the moments say about the shape."""
    if skew is None or kurtosis is None:
        return "too few readings"
    found = []
    if abs(skew) < 0.5 and abs(kurtosis) < 1:
        found.append("approximately normal")
    if abs(skew) > 1:
        found.append("right-skewed" if skew > 0 else "left-skewed")
    if kurtosis > 3:
        found.append("heavy-tailed")
    if two_peaks:
        found.append("bimodal")
    return ", ".join(found) or "moderately skewed"


def profile(readings: DataFrame, interval_s: float) -> DataFrame:
    """One row a channel with all of its statistics: coverage, moments, spread, percentiles, floor, energy."""
    out = coverage(readings)
    for part in (moments(readings).drop("n"), mad(readings), percentiles(readings), floor_mass(readings), energy_kwh(readings, interval_s)):
        out = out.join(part, "channel", "left")
    return out.withColumn("cv", F.try_divide(F.col("std"), F.nullif("mean", F.lit(0.0))))


def effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """(channel, stage, n, mean, ...): moments before and after, one above the other."""
    return moments(before).withColumn("stage", F.lit("before")).unionByName(moments(after).withColumn("stage", F.lit("after")))


def residual_moments(original: DataFrame, filtered: DataFrame) -> DataFrame:
    """Moments of what a filter took away, where both are present."""
    both = original.select("channel", "pos", F.col("value").alias("o")).join(filtered.select("channel", "pos", F.col("value").alias("f")), ["channel", "pos"])
    return moments(both.select("channel", (F.col("o") - F.col("f")).alias("value")).where("value is not null"))


def peak_trough_effect(original: DataFrame, filtered: DataFrame, window: int = 61, min_periods: int = 20) -> DataFrame:
    """(channel, peak, trough): mean residual where the original lies above or below its rolling median.

    Missing rows are left out first and the rest renumbered. Needs over 1000 residuals, and 50 on either side.
    """
    both = original.select("channel", "pos", F.col("value").alias("o")).join(filtered.select("channel", "pos", F.col("value").alias("f")), ["channel", "pos"]).where("o is not null and f is not null")
    from wattloom.operators.rolling import rolling_median

    rows = rolling_median(renumbered(both.withColumn("value", F.col("o"))), window, min_periods)
    r, high, low = F.col("o") - F.col("f"), F.col("o") > F.col("centre"), F.col("o") < F.col("centre")
    enough = (F.count("*") > 1000) & (F.count_if(high) > 50) & (F.count_if(low) > 50)
    return rows.groupBy("channel").agg(F.when(enough, F.avg(F.when(high, r))).alias("peak"), F.when(enough, F.avg(F.when(low, r))).alias("trough"))
