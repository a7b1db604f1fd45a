"""Roles of channels, from their names, their shape and their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.model import AGGREGATE_SERIES, ENVIRONMENTAL, HOUSEHOLD_PANEL, IRRADIANCE, POWER, TEMPERATURE, UNKNOWN, Channel

#: Names that tell a role, without regard to case.
IRRADIANCE_NAMES = r"(?i)(ghi|dni|dhi|irradian|insolat|solar[_ ]?rad|w[_ ]?m2|w/m)"
TEMPERATURE_NAMES = r"(?i)(temp|t_?amb|ambient|deg[_ ]?c|°c)"
POWER_NAMES = r"(?i)(kwh?|k_?w|power|load|demand|active|total|household)"
#: Names that stay irradiance although a word for power is in them.
STRICT_IRRADIANCE = r"(?i)(ghi|dni|dhi|irradian|w[_ ]?m2|w/m)"
BY_NAME, BY_PHYSICS, BY_STRUCTURE = 0.9, 0.8, 0.6
#: Fixed values of the fingerprint.
DARK_FLOOR, DARK_SHARE, NEGATIVE_BELOW, MIN_READINGS = 5.0, 0.02, -5.0, 288
DARK_HOUR_AT, LIT_HOUR_AT, HOURS_NEEDED = 0.9, 0.1, 6
PEAK_RANGE, TEMPERATURE_RANGE = (100.0, 1600.0), (-20.0, 60.0)


def fingerprint(readings: DataFrame) -> DataFrame:
    """(channel, n, lo, hi, dark_fraction, has_negative, dark_hours, lit_hours).

    Dark: at most 5 or 2 % of the largest value. Hours of the day are dark if 90 % of their
    readings are, lit if 10 % at most; they count from 288 readings on.
    """
    rows = readings.where("value is not null")
    span = rows.groupBy("channel").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    dark = (F.col("value") <= F.greatest(F.lit(DARK_FLOOR), DARK_SHARE * F.col("hi"))).cast("long")
    by_hour = rows.join(span.select("channel", "hi"), "channel").groupBy("channel", F.hour("ts").alias("hour")).agg(F.sum(dark).alias("dark"), F.count("*").alias("rows"))
    share = F.col("dark") / F.col("rows")
    hours = by_hour.groupBy("channel").agg(F.sum("dark").alias("dark"), F.count_if(share >= DARK_HOUR_AT).alias("dark_hours"), F.count_if(share <= LIT_HOUR_AT).alias("lit_hours"))
    enough = F.col("n") >= MIN_READINGS
    return span.join(hours, "channel").select("channel", "n", "lo", "hi", (F.col("dark") / F.col("n")).alias("dark_fraction"), (F.col("lo") < NEGATIVE_BELOW).alias("has_negative"), F.when(enough, F.col("dark_hours")).otherwise(0).alias("dark_hours"), F.when(enough, F.col("lit_hours")).otherwise(0).alias("lit_hours"))


def name_role(name: Column) -> Column:
    """What a name says: irradiance, unless only its words for power are clear; then temperature; then power."""
    solar, power = name.rlike(IRRADIANCE_NAMES), name.rlike(POWER_NAMES)
    return F.when(solar & (~power | name.rlike(STRICT_IRRADIANCE)), IRRADIANCE).when(~solar & name.rlike(TEMPERATURE_NAMES), TEMPERATURE).when(power, POWER)


def value_role() -> Column:
    """What a fingerprint says: light has dark and lit hours and a plausible peak, air temperature goes below zero in a narrow range."""
    light = (F.least("dark_hours", "lit_hours") >= HOURS_NEEDED) & ~F.col("has_negative") & F.col("hi").between(*PEAK_RANGE)
    air = F.col("has_negative") & (F.col("lo") >= TEMPERATURE_RANGE[0]) & (F.col("hi") <= TEMPERATURE_RANGE[1])
    return F.when(F.col("n") >= MIN_READINGS, F.when(light, IRRADIANCE).when(air, TEMPERATURE))


def channel_roles(prints: DataFrame, structural: str | None = None) -> DataFrame:
    """(channel, role, confidence, note) from fingerprints: one CASE over what values, names and structure say.

    Values that contradict the name overrule it, with a note.
    """
    told = prints.withColumn("_name", name_role(F.col("channel"))).withColumn("_value", value_role()).withColumn("_structure", F.lit(structural).cast("string"))
    clash = F.coalesce(F.col("_name") != F.col("_value"), F.lit(False))
    role = F.when(clash, F.col("_value")).otherwise(F.coalesce("_name", "_value", "_structure", F.lit(UNKNOWN)))
    trust = F.when(clash, BY_PHYSICS).when(F.col("_name").isNotNull(), BY_NAME).when(F.col("_value").isNotNull(), BY_PHYSICS).when(F.col("_structure").isNotNull(), BY_STRUCTURE).otherwise(0.0)
    note = F.when(clash, F.concat(F.lit("the name suggests "), "_name", F.lit(", the values look like "), "_value")).otherwise("")
    return told.select("channel", role.alias("role"), trust.alias("confidence"), note.alias("note"))


def classify(readings: DataFrame, headerless: bool) -> tuple[Channel, ...]:
    """Every channel's role, one small row a channel; channels without any value have no fingerprint."""
    names = readings.groupBy("channel").agg(F.count("value").alias("_present"))
    n = names.count()
    structural = POWER if (n >= 2 if headerless else n == 1) else None
    prints = names.select("channel").join(fingerprint(readings), "channel", "left")
    return tuple(Channel.of(r.channel, r.role, r.confidence, r.note) for r in channel_roles(prints, structural).orderBy("channel").collect())


def infer_kind(channels: tuple[Channel, ...]) -> str:
    if any(c.role in (IRRADIANCE, TEMPERATURE) for c in channels):
        return ENVIRONMENTAL
    power = sum(c.role == POWER for c in channels)
    return HOUSEHOLD_PANEL if (power or len(channels)) > 1 else AGGREGATE_SERIES
