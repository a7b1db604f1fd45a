"""Stateless steps on streams of readings. Windows and interpolation need the future, so they are batch only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wattloom.operators.scaling import transform
from wattloom.operators.screen import SENTINELS, replace_sentinels, screen_range


def prepare(stream: DataFrame, codes: Sequence[float] = SENTINELS, valid_range: tuple[float, float] | None = None, scaler: DataFrame | None = None) -> DataFrame:
    """Sentinels and impossible readings become NULL; a saved scaler is applied."""
    out = replace_sentinels(stream, codes).drop("before", "hit")
    if valid_range:
        out = screen_range(out, *valid_range).drop("before", "hit")
    return transform(out, scaler) if scaler is not None else out


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until what is there is done."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
