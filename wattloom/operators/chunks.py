"""Long series in chunks, so that one channel with most of the rows is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a channel in one chunk.
CHUNK = 65_536


def with_halo(readings: DataFrame, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """Rows with the chunk that needs them: its own, and others for whose frames they are the edge.

    A frame of `before` rows back and `after` ahead then lies within one (channel, chunk).
    """
    first, last = F.floor((F.col("pos") - after) / size), F.floor((F.col("pos") + before) / size)
    return readings.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def own_rows(haloed: DataFrame, size: int = CHUNK) -> DataFrame:
    return haloed.where(F.floor(F.col("pos") / size) == F.col("chunk")).drop("chunk")


def chunk_window() -> WindowSpec:
    return Window.partitionBy("channel", "chunk").orderBy("pos")


def with_chunk(readings: DataFrame, size: int = CHUNK) -> DataFrame:
    return readings.withColumn("chunk", F.floor(F.col("pos") / size))


def renumbered(series: DataFrame) -> DataFrame:
    """The rows with a value, `pos` counted anew: a rank within chunks plus one sum over chunks."""
    rows = with_chunk(series.where("value is not null"))
    before = F.sum("n").over(Window.partitionBy("channel").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("channel", "chunk").agg(F.count("*").alias("n")).select("channel", "chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(sizes.hint("merge"), ["channel", "chunk"]).withColumn("pos", F.col("_before") + F.row_number().over(chunk_window()) - 1).drop("chunk", "_before")
