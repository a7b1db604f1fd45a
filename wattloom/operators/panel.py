"""Panels: long readings on a complete grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def minute_floor(ts: Column) -> Column:
    """Floor to the minute; date_trunc gives a zoned timestamp, so it is cast back."""
    return F.date_trunc("minute", ts).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


#: Cells of a grid that one row of bounds turns into.
CELLS = 4096


def _cells(spans: DataFrame) -> DataFrame:
    """Rows (.., slot) for the slots a .. b of each row of `spans` (.., a, b).

    Stretches of CELLS slots are dealt out before they become rows, so a grid is made by many tasks.
    """
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, last = F.floor(F.col("a") / CELLS), F.floor(F.col("b") / CELLS)
    parts = spans.where("a <= b").withColumn("_part", F.explode(F.sequence(first, last)))
    keys = [c for c in spans.columns if c not in ("a", "b")]
    parts = parts.repartition(n, *keys, "_part")
    slot = F.explode(F.sequence(F.greatest(F.col("a"), F.col("_part") * CELLS), F.least(F.col("b"), F.col("_part") * CELLS + CELLS - 1)))
    return parts.withColumn("slot", slot).drop("_part")


def knots(events: DataFrame, ts: str, channel: str, value: str, step_s: int) -> DataFrame:
    """(channel, part, slot, value, first, end): the means by channel and step, dealt out by stretches (`part`) of CELLS slots.

    Each channel also has a row for the first slot of every stretch, with NULL if nothing was
    measured there. Cells lie from a row's slot to the one before the next row's of its stretch,
    or before `end`; `first` is the grid's first slot. So empty cells need no row before they are made.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.floor(seconds(F.col(ts)) / step_s).cast("long")
    # As an equi-join has it, a channel without a name meets no value.
    value_ = F.when(F.col(channel).isNotNull(), F.nanvl(F.col(value).cast("double"), F.lit(None)))
    rows = events.select(F.col(channel).alias("channel"), slot.alias("slot"), value_.alias("v"))
    bounds = events.agg(F.struct(F.min(slot).alias("a"), F.max(slot).alias("b"))).scalar()
    names = rows.groupBy("channel").agg(F.count("*").alias("_n")).select("channel", bounds["a"].alias("a"), bounds["b"].alias("b"))
    starts = names.where("a <= b").withColumn("_part", F.explode(F.sequence(F.floor(F.col("a") / CELLS), F.floor(F.col("b") / CELLS))))
    starts = starts.select("channel", F.greatest(F.col("a"), F.col("_part") * CELLS).alias("slot"), F.lit(None).cast("double").alias("v"))
    means = rows.where("slot is not null").unionByName(starts).groupBy("channel", "slot").agg(F.avg("v").alias("value"))
    # A fixed number of partitions, as cells are many more than these rows.
    out = means.withColumn("part", F.floor(F.col("slot") / CELLS)).repartition(n, "channel", "part")
    return out.select("channel", "part", "slot", "value", bounds["a"].alias("first"), F.least(bounds["b"] + 1, (F.col("part") + 1) * CELLS).alias("end"))


def cells_of(rows: DataFrame, step_s: int) -> DataFrame:
    """`rows` of knots() with a row for each cell, and its slot (`cell`), `pos` and `ts`."""
    after = F.coalesce(F.lead("slot").over(Window.partitionBy("channel", "part").orderBy("slot")), F.col("end"))
    cells = rows.withColumn("_after", after).withColumn("cell", F.explode(F.sequence("slot", F.col("_after") - 1)))
    ts_ = F.timestamp_add("SECOND", F.col("cell") * step_s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return cells.withColumn("pos", F.col("cell") - F.col("first")).withColumn("ts", ts_)


def grid(events: DataFrame, ts: str, channel: str, value: str, step_s: int) -> DataFrame:
    """Mean of `value` by channel and step, on the complete grid of all steps and channels; empty cells are NULL."""
    cells = cells_of(knots(events, ts, channel, value, step_s), step_s)
    return cells.select("channel", "pos", "ts", F.when(F.col("cell") == F.col("slot"), F.col("value")).alias("value"))


def uniform_grid(readings: DataFrame, step_s: int) -> DataFrame:
    """Left join of each channel's grid of `step_s` with its readings.

    Readings off the grid are dropped. A channel with two readings at one time is an error,
    as it leaves open which one holds.
    """
    span = readings.groupBy("channel").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    n = F.floor(F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / step_s)
    cells = _cells(span.select("channel", "start", F.lit(0).cast("long").alias("a"), n.alias("b")))
    cells = cells.select("channel", F.col("slot").alias("pos"), F.timestamp_add("SECOND", F.col("slot") * step_s, F.col("start")).alias("ts"))
    once = readings.groupBy("channel", "ts").agg(F.max("value").alias("value"), F.count("*").alias("n"))
    once = once.select("channel", "ts", F.when(F.col("n") > 1, F.raise_error(F.lit("duplicate timestamps: remove them before gridding")).cast("double")).otherwise(F.col("value")).alias("value"))
    return cells.join(once, ["channel", "ts"], "left").select("channel", "pos", "ts", "value")


def median_interval(readings: DataFrame, default_s: int = 300) -> DataFrame:
    """One row: the median step of the shared timeline in seconds; `default_s` if there are fewer than two rows or it is not positive."""
    line = readings.select("pos", "ts").distinct().withColumn("chunk", F.floor(F.col("pos") / 65536))
    ends = line.groupBy("chunk").agg(F.max_by("ts", "pos").alias("last"))
    ends = ends.select((F.col("chunk") + 1).alias("chunk"), "last")
    inside = F.lag("ts").over(Window.partitionBy("chunk").orderBy("pos"))
    steps = line.withColumn("before", inside).join(ends, "chunk", "left").select(F.timestamp_diff("SECOND", F.coalesce("before", "last"), F.col("ts")).alias("step"))
    median = F.percentile("step", F.lit(0.5))
    return steps.agg(F.when(median > 0, median).otherwise(float(default_s)).alias("interval_s"), F.coalesce(F.min("step") == F.max("step"), F.lit(True)).alias("regular"))
