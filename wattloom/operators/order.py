"""Exact order statistics of channels of any length, by passes of counts that narrow an interval.

A pass cuts the interval that holds a wanted value into BINS equal parts and counts the values
in each, partial counts first. The part that holds the wanted rank, from the least to the
greatest value in it, is the next interval. Once all intervals hold few values, these are
ranked. Nothing holds a channel's values, and ties need no memory at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Channels of at most so many values are ranked by the built-in aggregate, which holds a channel's distinct values.
SMALL = 1_000_000
BINS = 1024
#: Values in an interval that are ranked at last.
FEW = 20_000
#: So many (channel, rank) rows of 60 bytes are broadcast.
SMALL_TARGETS = 100_000


def _wanted(counts: DataFrame, points: list[float]) -> DataFrame:
    """(channel, point, share, rank, lo, hi, n): the two values that a point lies between, for channels of n values from lo to hi."""
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    cells = F.array(*[F.struct(F.lit(k).alias("point"), (at(p) - F.floor(at(p))).alias("share"), F.floor(at(p)).alias("below")) for k, p in enumerate(points)])
    both = counts.withColumn("c", F.explode(cells)).withColumn("rank", F.explode(F.array_distinct(F.array("c.below", F.least(F.col("c.below") + 1, F.col("n") - 1)))))
    return both.select("channel", "c.point", "c.share", (F.col("rank") == F.col("c.below")).alias("lower"), "rank", "lo", "hi", "n")


def _at_ranks(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """(channel, rank, value) for `ranks` (channel, rank, lo, hi, n); the value of a rank lies from lo to hi, and n values do."""
    spark = values.sparkSession
    open_, done = ranks.withColumn("skipped", F.lit(0).cast("long")), []
    while True:
        # Two rows a point for each long channel; as a list they cut the plan, which would grow with each pass.
        held = open_.collect()
        schema = open_.schema
        closed = [r for r in held if r.lo == r.hi]
        wide = [r for r in held if r.lo != r.hi]
        done += [(r.channel, r.rank, r.lo) for r in closed]
        if not wide:
            break
        targets = spark.createDataFrame(wide, schema)
        targets = F.broadcast(targets) if len(wide) <= SMALL_TARGETS else targets
        inside = values.join(targets, "channel").where(F.col("value").between(F.col("lo"), F.col("hi")))
        if max(r.n for r in wide) <= FEW:
            w = Window.partitionBy("channel", "rank").orderBy("value")
            placed = inside.withColumn("_k", F.row_number().over(w) - 1 + F.col("skipped")).where("_k = rank")
            done += [(r.channel, r.rank, r.value) for r in placed.select("channel", "rank", "value").collect()]
            break
        # Halves first, so that the width of an interval does not overflow. Over many scales, equal parts of the logarithm.
        linear = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        log = lambda c: F.signum(c) * F.log1p(F.abs(F.col(c)))
        share = F.when(F.col("hi") / 2 - F.col("lo") / 2 > 500, (log("value") - log("lo")) / (log("hi") - log("lo"))).otherwise(linear)
        bins = inside.withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1))).groupBy("channel", "rank", "skipped", "bin").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        w = Window.partitionBy("channel", "rank").orderBy("bin")
        bins = bins.withColumn("_upto", F.sum("n").over(w)).withColumn("_before", F.col("_upto") - F.col("n"))
        hit = (F.col("rank") >= F.col("skipped") + F.col("_before")) & (F.col("rank") < F.col("skipped") + F.col("_upto"))
        open_ = bins.where(hit).select("channel", "rank", "lo", "hi", "n", (F.col("skipped") + F.col("_before")).alias("skipped"))
    return spark.createDataFrame(done, ranks.select("channel", "rank", F.col("lo").alias("value")).schema)


def exact_quantiles(values: DataFrame, points: list[float], small: int = SMALL) -> DataFrame:
    """(channel, q): the quantiles of (channel, value) at `points`, linear between neighbouring values; missing values are left out.

    A channel without values has null. NaN counts as missing here.
    """
    known = values.select("channel", F.col("value").cast("double").alias("value")).where("value is not null and not isnan(value)")
    counts = known.groupBy("channel").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    few = lambda rows: rows.groupBy("channel").agg(F.percentile("value", F.array(*map(F.lit, points))).alias("q"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= small:
        return few(values.select("channel", F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value")))
    names = values.groupBy("channel").agg(F.count("*").alias("_n")).select("channel")
    # Of the channels longer than `small` there are at most the share of all values that this number says.
    long = counts.where(F.col("n") > small)
    wanted = _wanted(long, points)
    at = _at_ranks(known, wanted.select("channel", "rank", "lo", "hi", "n").distinct())
    side = lambda lower: F.max(F.when(F.col("lower") == lower, F.col("value")))
    two = wanted.join(at, ["channel", "rank"]).groupBy("channel", "point").agg(F.max("share").alias("share"), side(True).alias("a"), side(False).alias("b"))
    value = F.when(F.col("b").isNull() | (F.col("share") == 0), F.col("a")).otherwise((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    found = two.groupBy("channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("point", value.alias("v")))), lambda x: x["v"]).alias("q"))
    short = few(known.join(counts.where(F.col("n") <= small).select("channel"), "channel", "left_semi"))
    return names.join(found.unionByName(short), "channel", "left")


def exact_median(values: DataFrame, name: str, small: int = SMALL) -> DataFrame:
    """(channel, <name>)."""
    return exact_quantiles(values, [0.5], small).select("channel", F.get("q", F.lit(0)).alias(name))


def points_of(q: Column, names: list[str]) -> list[Column]:
    return [F.get(q, F.lit(k)).alias(name) for k, name in enumerate(names)]
