"""Runs of rows, and filling of gaps by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.operators.chunks import chunk_window, with_chunk
from wattloom.operators.panel import cells_of, knots


def regions(readings: DataFrame, mask: Column) -> DataFrame:
    """(channel, start, end, length): maximal runs of rows where `mask` holds, ends included.

    Runs are found within chunks; only those that touch a chunk's border are then joined across chunks.
    """
    rows = with_chunk(readings.where(mask).select("channel", "pos"))
    island = F.col("pos") - F.row_number().over(chunk_window())
    runs = rows.withColumn("island", island).groupBy("channel", "chunk", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    # The chunks of the rows just before and after a run tell whether it touches a border.
    ends = with_chunk(runs.withColumnRenamed("chunk", "own").withColumn("pos", F.col("start") - 1)).withColumnRenamed("chunk", "before")
    ends = with_chunk(ends.withColumn("pos", F.col("end") + 1)).withColumnRenamed("chunk", "after")
    touches = (F.col("before") != F.col("own")) | (F.col("after") != F.col("own"))
    inner = ends.where(~touches).select("channel", "start", "end")
    w = Window.partitionBy("channel").orderBy("start")
    fresh = F.coalesce(F.col("start") != F.lag("end").over(w) + 1, F.lit(True)).cast("long")
    across = ends.where(touches).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    across = across.groupBy("channel", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
    out = inner.unionByName(across)
    return out.select("channel", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"))


def longest_gap(readings: DataFrame) -> DataFrame:
    """(channel, longest_gap) for every channel; 0 without missing values."""
    found = regions(readings, F.col("value").isNull()).groupBy("channel").agg(F.max("length").alias("longest"))
    names = readings.groupBy("channel").agg(F.count("*").alias("n"))
    return names.join(found, "channel", "left").select("channel", F.coalesce("longest", F.lit(0)).cast("long").alias("longest_gap"))


def longest_complete_run(readings: DataFrame) -> DataFrame:
    """(channel, start, end, length): the first of each channel's longest runs without a gap."""
    runs = regions(readings, F.col("value").isNotNull())
    best = F.max_by(F.struct("start", "end", "length"), F.struct("length", -F.col("start"))).alias("r")
    return runs.groupBy("channel").agg(best).select("channel", "r.start", "r.end", "r.length")


def _neighbours(rows: DataFrame, part: str, at: str) -> DataFrame:
    """Adds _pp, _pv, _np, _nv: place and value of the last known value up to a row, and of the first one after it.

    They are found within (channel, `part`); what lies beyond comes from one summary row for each part.
    """
    # lag and lead pass over a partition once; a frame to its end would be read anew for every row.
    over = f"OVER (PARTITION BY channel, {part} ORDER BY {at})"
    known = f"CASE WHEN value IS NOT NULL THEN named_struct('pos', {at}, 'value', value) END"
    near = rows.withColumn("_p", F.expr(f"last({known}) IGNORE NULLS {over[:-1]} ROWS UNBOUNDED PRECEDING)")).withColumn("_n", F.expr(f"lead({known}) IGNORE NULLS {over}"))
    # Numbers, unlike structs, are summed up without sorting the rows.
    there = rows.where("value is not null").groupBy("channel", part)
    ends = there.agg(F.min(at).alias("_a"), F.min_by("value", at).alias("_av"), F.max(at).alias("_b"), F.max_by("value", at).alias("_bv"))
    parts = rows.groupBy("channel", part).agg(F.count("*").alias("_rows")).drop("_rows").join(ends.hint("merge"), ["channel", part], "left")
    beyond = f"OVER (PARTITION BY channel ORDER BY {part})"
    side = lambda f, a: F.expr(f"{f}(CASE WHEN {a} IS NOT NULL THEN named_struct('pos', {a}, 'value', {a}v) END) IGNORE NULLS {beyond}")
    parts = parts.select("channel", part, side("lag", "_b").alias("_before"), side("lead", "_a").alias("_behind"))
    out = near.join(parts.hint("merge"), ["channel", part])
    out = out.withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_behind"))
    return out.withColumns({"_pp": F.col("_p.pos"), "_pv": F.col("_p.value"), "_np": F.col("_n.pos"), "_nv": F.col("_n.value")}).drop("_p", "_n", "_before", "_behind")


def _line(at: str, limit: int | None) -> Column:
    """The value of a missing row at `at` by its neighbours, missing where none is near enough."""
    if limit is not None and limit <= 0:
        raise ValueError("the limit must be positive")
    since, until = F.col(at) - F.col("_pp"), F.col("_np") - F.col(at)
    line = F.col("_pv") + F.try_divide((F.col("_nv") - F.col("_pv")) * since, since + until)
    near = F.lit(True) if limit is None else F.coalesce(since <= limit, F.lit(False)) | F.coalesce(until <= limit, F.lit(False))
    return F.when(near, F.coalesce(line, "_pv", "_nv"))


def interpolate(readings: DataFrame, limit: int | None = 24) -> DataFrame:
    """Fill missing values on a straight line between neighbours by row position; adds `filled`.

    `limit` rows are filled from each side, so a gap of up to twice as many closes and a longer
    one keeps its middle. Before the first and after the last value the nearest one is used, as
    far as `limit` reaches. Without a limit all is filled but a channel without values.
    """
    line = _line("pos", limit)
    rows = _neighbours(with_chunk(readings), "chunk", "pos")
    out = rows.withColumn("_v", F.coalesce("value", line)).withColumn("filled", F.col("value").isNull() & F.col("_v").isNotNull())
    return out.select(*[F.col("_v").alias(c) if c == "value" else F.col(c) for c in readings.columns], "filled")


def filled_grid(events: DataFrame, ts: str, channel: str, value: str, step_s: int, limit: int | None = 24) -> DataFrame:
    """(channel, pos, ts, value, filled): the same as `interpolate` of the `grid` of `events`.

    Only what was measured is dealt out and sorted; each row then makes the empty cells up to the next.
    """
    line = _line("cell", limit)
    cells = cells_of(_neighbours(knots(events, ts, channel, value, step_s), "part", "slot"), step_s)
    own = F.when(F.col("cell") == F.col("slot"), F.col("value"))
    out = cells.withColumn("_own", own).withColumn("_v", F.coalesce("_own", line))
    return out.select("channel", "pos", "ts", F.col("_v").alias("value"), (F.col("_own").isNull() & F.col("_v").isNotNull()).alias("filled"))
