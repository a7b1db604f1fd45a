"""Min-max scaling learnt on a leading share of the rows, and its inverse."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.operators.screen import clip

SCHEMA_VERSION = 1
CONSTANT_BELOW = 1e-12


def n_fit_rows(n: int, share: float) -> int:
    """Leading rows to learn from: the share, rounded half to even, at least one."""
    if not 0 < share <= 1:
        raise ValueError("the share must lie in (0, 1]")
    return max(1, round(n * share))


def fit(readings: DataFrame, share: float = 0.7) -> DataFrame:
    """(channel, data_min, data_max, n_fit, constant) over the leading rows of the shared timeline. One row a channel.

    A channel without values there counts as constant between 0 and 1.
    """
    n = readings.agg(F.coalesce(F.max("pos"), F.lit(-1)) + 1).first()[0]
    rows = n_fit_rows(n, share)
    by = readings.groupBy("channel").agg(F.min(F.when(F.col("pos") < rows, F.col("value"))).alias("lo"), F.max(F.when(F.col("pos") < rows, F.col("value"))).alias("hi"))
    return by.select("channel", F.coalesce("lo", F.lit(0.0)).alias("data_min"), F.coalesce("hi", F.lit(1.0)).alias("data_max"), F.lit(rows).cast("long").alias("n_fit"), (F.col("lo").isNull() | (F.col("hi") - F.col("lo") < CONSTANT_BELOW)).alias("constant"))


def _with(readings: DataFrame, scaler: DataFrame) -> DataFrame:
    return readings.join(scaler.select("channel", "data_min", "data_max", "constant"), "channel", "left")


def transform(readings: DataFrame, scaler: DataFrame, low: float = 0.0, high: float = 1.0, clipped: bool = False) -> DataFrame:
    """Scale into [low, high]. Constant channels become `low`; channels that the scaler lacks pass through."""
    if not high > low:
        raise ValueError("the upper bound must exceed the lower")
    v = F.col("value")
    scaled = low + (v - F.col("data_min")) * (high - low) / F.nullif(F.col("data_max") - F.col("data_min"), F.lit(0.0))
    value = F.when(F.col("constant").isNull(), v).when(F.col("constant"), F.when(v.isNotNull(), low)).otherwise(clip(scaled, low, high) if clipped else scaled)
    return _with(readings, scaler).withColumn("value", value).select(*readings.columns)


def inverse(readings: DataFrame, scaler: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Undo `transform`; constant channels become their minimum."""
    v = F.col("value")
    raw = F.col("data_min") + (v - low) / (high - low) * (F.col("data_max") - F.col("data_min"))
    value = F.when(F.col("constant").isNull(), v).when(F.col("constant"), F.when(v.isNotNull(), F.col("data_min"))).otherwise(raw)
    return _with(readings, scaler).withColumn("value", value).select(*readings.columns)


def excursions(scaled: DataFrame, scaler: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(channel, n_outside, pct_outside, min_scaled, max_scaled, worst_excursion) of held-out rows, for channels that leave the range."""
    v = F.col("value")
    held = scaled.join(scaler.select("channel", "n_fit"), "channel").where("pos >= n_fit and value is not null")
    outside = F.count_if((v < low) | (v > high))
    by = held.groupBy("channel").agg(outside.alias("n_outside"), (100 * outside / F.count("*")).alias("pct_outside"), F.min(v).alias("min_scaled"), F.max(v).alias("max_scaled"), F.max(F.greatest(v - high, low - v)).alias("worst_excursion"))
    return by.where("n_outside > 0")


#: Relative error up to which a value counts as recovered.
CLOSE = 1e-12


def round_trip_error(readings: DataFrame, scaler: DataFrame, low: float = 0.0, high: float = 1.0, digits: int | None = None) -> DataFrame:
    """One row, (n, n_close, max_error): values compared, those recovered, and the largest relative error of scaling and back; zeros are left out.

    With `digits` the scaled values are rounded in between, as in a file that keeps so many.
    """
    scaled = transform(readings, scaler, low, high)
    if digits is not None:
        scaled = scaled.withColumn("value", F.round("value", digits))
    back = inverse(scaled, scaler, low, high).select("channel", "pos", F.col("value").alias("back"))
    error = F.try_divide(F.abs(F.col("value") - F.col("back")), F.abs(F.nullif("value", F.lit(0.0))))
    both = readings.join(back, ["channel", "pos"]).select(error.alias("e"))
    return both.agg(F.count("e").alias("n"), F.count_if(F.col("e") < CLOSE).alias("n_close"), F.max("e").alias("max_error"))


@dataclass
class ScalerFile:
    """A scaler with where it came from, as JSON of schema version 1."""

    channels: dict[str, dict]
    feature_range: tuple[float, float] = (0.0, 1.0)
    fit_source: str = ""
    fit_rows: int = 0
    fit_share: float = 1.0
    schema_version: int = SCHEMA_VERSION

    @classmethod
    def of(cls, scaler: DataFrame, source: str = "", share: float = 0.7, low: float = 0.0, high: float = 1.0) -> ScalerFile:
        rows = {r.channel: {"data_min": r.data_min, "data_max": r.data_max, "n_fit": r.n_fit, "constant": r.constant} for r in scaler.orderBy("channel").collect()}
        return cls(rows, (low, high), source, next((r["n_fit"] for r in rows.values()), 0), share)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> ScalerFile:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"scaler schema {data.get('schema_version')!r} is not {SCHEMA_VERSION}")
        return cls(**data | {"feature_range": tuple(data["feature_range"])})

    def frame(self, spark) -> DataFrame:
        rows = [(k, float(v["data_min"]), float(v["data_max"]), int(v["n_fit"]), bool(v["constant"])) for k, v in self.channels.items()]
        return spark.createDataFrame(rows, "channel string, data_min double, data_max double, n_fit long, constant boolean")
