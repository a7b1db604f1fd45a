"""Distribution fits by channel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.functions.mle import MIN_VALUES, FamilyFit, describe, fit_distributions
from wattloom.operators.stats import FLOOR_BAND, bimodal, floor_mass, histogram, moments, profile, stride_sample, verdict

#: Values of one channel that a fit sees, by a fixed stride.
FIT_SAMPLE = 20_000


def distribution_fits(readings: DataFrame, sample: int = FIT_SAMPLE) -> DataFrame:
    """(channel, rank, family, aic, ks, params): families by ascending AIC.

    Where a channel is inflated at its floor, only values above it are fitted, if they are
    enough. A group holds `sample` values at most.
    """
    rows = readings.where("value is not null")
    span = rows.groupBy("channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    marked = rows.join(span, "channel").join(floor_mass(readings).select("channel", "inflated"), "channel")
    above = F.col("value") > F.col("lo") + F.greatest(F.lit(1e-9), FLOOR_BAND * (F.col("hi") - F.col("lo")))
    marked = marked.withColumn("above", above)
    left = marked.groupBy("channel").agg(F.count_if("above").alias("n_above"))
    used = marked.join(left, "channel").where(f"not inflated or above or n_above < {MIN_VALUES}").select("channel", "pos", "ts", "value")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        fits = fit_distributions(rows["value"].to_numpy())
        out = [(rows["channel"].iloc[0], k, f.family, f.aic, f.ks, list(f.params)) for k, f in enumerate(fits, 1)]
        return pd.DataFrame(out, columns=["channel", "rank", "family", "aic", "ks", "params"])

    return stride_sample(used, sample).groupBy("channel").applyInPandas(lambda rows: fit(rows), "channel string, rank int, family string, aic double, ks double, params array<double>")


def channel_statistics(readings: DataFrame, interval_s: float, with_fit: bool = True) -> DataFrame:
    """The profile of each channel with what it says in words: two_peaks, shape and, `with_fit`, family.

    The 40 bins and the fits of a channel are a handful of numbers; the sentences are made from them in tasks.
    """
    bins = histogram(readings).groupBy("channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("bins"))
    fits = distribution_fits(readings) if with_fit else readings.sparkSession.createDataFrame([], "channel string, rank int, family string, aic double, ks double, params array<double>")
    fits = fits.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("rank", "family", "aic", "ks"))).alias("fits"))
    full = profile(readings, interval_s).join(bins, "channel", "left").join(fits, "channel", "left")

    def say(batches):
        for rows in batches:
            two, shape, family = [], [], []
            for r in rows.itertuples(index=False):
                found = dict(r.bins) if r.bins is not None else {}
                two.append(bimodal([int(found.get(k, 0)) for k in range(40)]))
                known = lambda x: None if x is None or x != x else float(x)
                shape.append(verdict(known(r.skew), known(r.kurtosis), two[-1]))
                own = [FamilyFit(f["family"], (), f["aic"], f["ks"]) for f in (r.fits if r.fits is not None else [])]
                family.append(describe(own, bool(r.inflated), float(r.floor_mass or 0), bool(r.floor_is_zero), float(r.lo or 0)))
            yield pd.DataFrame({"channel": rows["channel"], "two_peaks": two, "shape": shape, "family": family})

    told = full.select("channel", "skew", "kurtosis", "bins", "fits", "inflated", "floor_mass", "floor_is_zero", F.col("min").alias("lo")).mapInPandas(say, "channel string, two_peaks boolean, shape string, family string")
    return full.drop("bins", "fits").join(told, "channel").drop(*([] if with_fit else ["family"]))


def skew_range(readings: DataFrame, total: DataFrame) -> DataFrame:
    """(least, most, of_total): how skewed single channels are, next to their total (pos, ts, total)."""
    own = moments(readings).agg(F.min("skew").alias("least"), F.max("skew").alias("most"))
    whole = moments(total.select(F.lit("total").alias("channel"), F.col("total").alias("value"))).select(F.col("skew").alias("of_total"))
    return own.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k").drop("k")
