"""The data model: readings, channels, datasets.

Readings are long: (channel STRING, pos BIGINT, ts TIMESTAMP_NTZ, value DOUBLE). `pos` is the
0-based row number over the shared timeline; windows, gaps and splits count rows by it. A
missing value is NULL, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POWER, IRRADIANCE, TEMPERATURE, UNKNOWN = "power", "irradiance", "temperature", "unknown"
HOUSEHOLD_PANEL, AGGREGATE_SERIES, ENVIRONMENTAL = "household_panel", "aggregate_series", "environmental"

#: Fixed values by role: unit, valid range, low-pass cutoff in minutes.
ROLE_DEFAULTS = {
    POWER: ("kW", None, None),
    IRRADIANCE: ("W/m²", (0.0, 1400.0), 30.0),
    TEMPERATURE: ("°C", (-20.0, 60.0), 15.0),
    UNKNOWN: ("", None, None),
}
DEFAULT_INTERVAL_S = 300


@dataclass(frozen=True)
class Channel:
    name: str
    role: str = UNKNOWN
    unit: str = ""
    valid_range: tuple[float, float] | None = None
    cutoff_min: float | None = None
    confidence: float = 0.0
    note: str = ""

    @classmethod
    def of(cls, name: str, role: str, confidence: float, note: str = "") -> Channel:
        unit, valid, cutoff = ROLE_DEFAULTS[role]
        return cls(name, role, unit, valid, cutoff, confidence, note)

    @property
    def label(self) -> str:
        return f"{self.name} ({self.unit})" if self.unit else self.name


@dataclass(frozen=True)
class Dataset:
    """Readings with what is known about their channels. Never changed, only replaced."""

    readings: DataFrame
    channels: tuple[Channel, ...]
    kind: str
    source: str = ""
    layer: str = "Raw"
    interval_s: int = DEFAULT_INTERVAL_S
    notes: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        return [c.name for c in self.channels]

    def channel(self, name: str) -> Channel:
        for c in self.channels:
            if c.name == name:
                return c
        raise KeyError(f"no channel {name!r}; there are {', '.join(self.names())}")

    def series(self, name: str, start=None, end=None) -> DataFrame:
        """One channel, optionally from `start` to `end`, both included."""
        self.channel(name)
        out = self.readings.where(F.col("channel") == name)
        if start is not None:
            out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            out = out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        return out

    def with_readings(self, readings: DataFrame, layer: str, names: list[str] | None = None) -> Dataset:
        """The same dataset over other readings; channels that are gone are dropped, the interval stays."""
        kept = tuple(c for c in self.channels if names is None or c.name in names)
        return replace(self, readings=readings, channels=kept, layer=layer)

    def interval_label(self) -> str:
        s = self.interval_s
        return f"{s // 3600} h" if s % 3600 == 0 else f"{s // 60} min" if s % 60 == 0 else f"{s} s"

    def samples_to_duration(self, samples: int) -> str:
        minutes = samples * self.interval_s / 60
        return f"{minutes:g} min" if minutes < 120 else f"{minutes / 60:g} h" if minutes < 2880 else f"{minutes / 1440:g} d"

    def kind_label(self) -> str:
        return {HOUSEHOLD_PANEL: "Household panel", AGGREGATE_SERIES: "Aggregate series", ENVIRONMENTAL: "Environmental data"}[self.kind]

    def summary(self) -> str:
        return f"{self.kind_label()}: {len(self.channels)} channel(s) every {self.interval_label()}, layer {self.layer}"
