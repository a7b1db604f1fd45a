"""Sentinel codes and physically impossible readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = (-999.0,)
TOLERANCE = 1e-6
LEDGER_LIMIT = 200_000


def is_sentinel(value: Column, codes: Sequence[float] = SENTINELS, tolerance: float = TOLERANCE) -> Column:
    """Within `tolerance` (strictly) of a code; false for missing values."""
    out = F.lit(False)
    for code in codes:
        out = out | (F.abs(value - F.lit(float(code))) < tolerance)
    return F.coalesce(out, F.lit(False))


def replace_sentinels(readings: DataFrame, codes: Sequence[float] = SENTINELS, tolerance: float = TOLERANCE) -> DataFrame:
    """Codes become NULL; adds `before` and `hit`."""
    hit = is_sentinel(F.col("value"), codes, tolerance)
    return readings.withColumn("before", F.col("value")).withColumn("hit", hit).withColumn("value", F.when(~F.col("hit"), F.col("before")))


def screen_range(readings: DataFrame, low: float, high: float) -> DataFrame:
    """Values outside [low, high] become NULL; adds `before` and `hit`."""
    if not high > low:
        raise ValueError("the upper bound must exceed the lower")
    hit = F.coalesce((F.col("value") < low) | (F.col("value") > high), F.lit(False))
    return readings.withColumn("before", F.col("value")).withColumn("hit", hit).withColumn("value", F.when(~F.col("hit"), F.col("before")))


def clip(value: Column, low: float, high: float) -> Column:
    """Into [low, high]; a missing value stays missing (greatest and least would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low))))


def numeric(text: Column) -> Column:
    """Text to DOUBLE; what is no number, and NaN, becomes NULL."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def ledger(changed: DataFrame, mask: Column, reason: str, limit: int | None = LEDGER_LIMIT) -> DataFrame:
    """(ts, channel, before, after, reason) of the rows where `mask` holds, by time and channel.

    The default keeps the first 200 000 rows of the report; None keeps all.
    """
    out = changed.where(mask).select("pos", "ts", "channel", "before", F.col("value").alias("after"), F.lit(reason).alias("reason")).orderBy("pos", "channel")
    return (out.limit(limit) if limit is not None else out).drop("pos")


def scan(readings: DataFrame, codes: Sequence[float] = SENTINELS) -> DataFrame:
    """One row: hits, channels with hits, cells, share and missing values."""
    by = readings.groupBy("channel").agg(F.count_if(is_sentinel(F.col("value"), codes)).alias("hits"), F.count("*").alias("cells"), F.count_if(F.col("value").isNull()).alias("missing"))
    return by.agg(F.sum("hits").alias("n_hits"), F.count_if(F.col("hits") > 0).alias("n_channels"), F.sum("cells").alias("total_cells"), F.coalesce(F.try_divide(F.sum("hits"), F.sum("cells")), F.lit(0.0)).alias("fraction"), F.sum("missing").alias("n_missing"))


def hits_by(readings: DataFrame, key: str, codes: Sequence[float] = SENTINELS, top: int | None = None) -> DataFrame:
    """(key, hits) where there are any, most first; `top` of them, if given (10 in the report)."""
    out = readings.where(is_sentinel(F.col("value"), codes)).groupBy(key).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), key)
    return out.limit(top) if top else out


def candidates(readings: DataFrame, min_count: int = 20, top: int = 5) -> DataFrame:
    """(value, count): values that repeat and lie outside the 0.1 % and 99.9 % quantiles, zero left out; the `top` most frequent."""
    edges = readings.agg(F.percentile("value", F.lit(0.001)).alias("lo"), F.percentile("value", F.lit(0.999)).alias("hi"))
    counts = readings.where("value is not null and value <> 0").groupBy("value").agg(F.count("*").alias("count")).where(F.col("count") >= min_count)
    # One row of bounds joins by a constant key.
    out = counts.withColumn("k", F.lit(1)).join(F.broadcast(edges.withColumn("k", F.lit(1))), "k").where("value < lo or value > hi")
    return out.select("value", "count").orderBy(F.desc("count"), "value").limit(top)
