"""Steps from dataset to dataset, and chains of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.model import AGGREGATE_SERIES, POWER, Channel, Dataset
from wattloom.operators.gaps import interpolate
from wattloom.operators.lowpass import lowpass
from wattloom.operators.repair import clean_series, corrections, impute_missing, region_table
from wattloom.operators.scaling import fit, transform
from wattloom.operators.screen import SENTINELS, candidates, hits_by, ledger, replace_sentinels
from wattloom.operators.stats import effect, energy_kwh, increment_moments, missing_by_channel, moments, naive_total, peak_trough_effect, residual_moments, strict_total, worst_timestamps
from wattloom.plans.reports import lines_of, report

EMPTY_LEDGER = "ts timestamp_ntz, channel string, before double, after double, reason string"


@dataclass(frozen=True)
class StepResult:
    """What a step gives: the new dataset, what changed, and the report's text, made when asked for."""

    dataset: Dataset
    ledger: DataFrame
    stats: dict = field(default_factory=dict)
    render: Callable[[], str] = lambda: ""

    @property
    def report(self) -> str:
        return self.render()


class Step(Protocol):
    key: str
    name: str

    def run(self, ds: Dataset) -> StepResult: ...


def no_ledger(ds: Dataset) -> DataFrame:
    return ds.readings.sparkSession.createDataFrame([], EMPTY_LEDGER)


@dataclass(frozen=True)
class SentinelStep:
    """Sentinel codes become missing; nothing is filled."""

    codes: Sequence[float] = SENTINELS
    key: str = "sentinels"
    name: str = "Sentinels"

    def run(self, ds: Dataset) -> StepResult:
        changed = replace_sentinels(ds.readings, self.codes)
        shown = ", ".join(f"{c:g}" for c in self.codes)

        def render() -> str:
            n = changed.agg(F.count("*").alias("n"), F.count_if("hit").alias("h")).first()
            parts = [("Per channel", lines_of(hits_by(ds.readings, "channel", self.codes))), ("Times with most hits", lines_of(hits_by(ds.readings, "ts", self.codes, 10))), ("Other values that look like codes", lines_of(candidates(ds.readings)))]
            return report("Sentinel replacement", ds, [f"codes searched: {shown}", f"readings: {n.n:,}", f"replaced: {n.h:,}"], parts)

        return StepResult(ds.with_readings(changed.drop("before", "hit"), self.name), ledger(changed, F.col("hit"), f"sentinel code {shown}"), {}, render)


@dataclass(frozen=True)
class InterpolateStep:
    """Gaps are filled by position, `limit` rows from each side."""

    limit: int = 24
    key: str = "interpolate"
    name: str = "Interpolated"

    def run(self, ds: Dataset) -> StepResult:
        filled = interpolate(ds.readings, self.limit)
        changed = filled.withColumn("before", F.lit(None).cast("double"))

        def render() -> str:
            left = missing_by_channel(filled).where("missing > 0").orderBy(F.desc("missing"), "channel")
            return report("Interpolation", ds, [f"limit: {self.limit} rows from each side ({ds.samples_to_duration(self.limit)})"], [("Still missing", lines_of(left))])

        return StepResult(ds.with_readings(filled.drop("filled"), self.name), ledger(changed, F.col("filled"), f"interpolated (limit {self.limit})"), {}, render)


@dataclass(frozen=True)
class AggregateStep:
    """All channels become one total; a time with a missing channel has none."""

    total: str = "total_active_power_kw"
    key: str = "aggregate"
    name: str = "Aggregated"

    def run(self, ds: Dataset) -> StepResult:
        summed = strict_total(ds.readings).select(F.lit(self.total).alias("channel"), "pos", "ts", F.col("total").alias("value"))
        channel = Channel(self.total, POWER, "kW", confidence=1.0)
        out = replace(ds, readings=summed, channels=(channel,), kind=AGGREGATE_SERIES, layer=self.name)

        def render() -> str:
            parts = [("Statistics", lines_of(moments(summed))), ("Energy", lines_of(energy_kwh(summed, ds.interval_s))), ("Sum of what is there, for comparison", lines_of(moments(naive_total(ds.readings).select(F.lit("naive").alias("channel"), F.col("total").alias("value"))))), ("Times with most channels missing", lines_of(worst_timestamps(ds.readings, interpolate(ds.readings))))]
            return report("Aggregation", ds, [f"channels: {len(ds.channels)}"], parts)

        return StepResult(out, no_ledger(ds), {}, render)


@dataclass(frozen=True)
class NormaliseStep:
    """Min-max scaling learnt on the leading share of the rows."""

    share: float = 0.7
    low: float = 0.0
    high: float = 1.0
    key: str = "normalise"
    name: str = "Normalised"

    def run(self, ds: Dataset) -> StepResult:
        scaler = fit(ds.readings, self.share)
        out = ds.with_readings(transform(ds.readings, scaler, self.low, self.high), self.name)
        channels = tuple(replace(c, unit="normalised", valid_range=None) for c in out.channels)
        return StepResult(replace(out, channels=channels), no_ledger(ds), {"scaler": scaler}, lambda: report("Normalisation", ds, [f"range: {self.low:g} to {self.high:g}", f"learnt on {self.share:.0%} of the rows"], [("Scaler", lines_of(scaler))]))


@dataclass(frozen=True)
class CleanStep:
    """Flagged readings are replaced by local fits. The ledger has every flagged reading, replaced or missing now."""

    method: str = "zscore"
    window: int = 48
    sigma: float = 3.0
    max_gap: int = 24
    key: str = "clean"
    name: str = "Cleaned"

    def run(self, ds: Dataset) -> StepResult:
        out = clean_series(ds.readings, self.method, self.window, self.sigma, max_gap=self.max_gap)

        def render() -> str:
            n = out.agg(F.count_if("flagged").alias("f"), F.count_if("imputed").alias("i")).first()
            facts = [f"method: {self.method}, window {self.window}, sigma {self.sigma:g}", f"flagged: {n.f:,}", f"replaced: {n.i:,}"]
            left = region_table(out, "flagged").where("not imputed").orderBy("channel", "start")
            return report("Cleaning", ds, facts, [("Largest corrections", lines_of(corrections(out, 15))), ("Left missing", lines_of(left)), ("Before and after", lines_of(effect(ds.readings, out).orderBy("channel", F.desc("stage"))))])

        return StepResult(ds.with_readings(out.select(*ds.readings.columns), self.name), ledger(out, F.col("flagged"), f"{self.method} (window {self.window}, sigma {self.sigma:g})"), {}, render)


@dataclass(frozen=True)
class FillStep:
    """Holes are filled by local fits, or by zero at night. The ledger has the filled readings."""

    max_gap: int = 24
    context: int = 60
    dark_threshold: float | None = None
    key: str = "fill"
    name: str = "Filled"

    def run(self, ds: Dataset) -> StepResult:
        limits = {c.valid_range for c in ds.channels}
        bounds = limits.pop() if len(limits) == 1 else None
        out = impute_missing(ds.readings, context=self.context, max_gap=self.max_gap, valid_range=bounds, dark_threshold=self.dark_threshold)
        changed = out.withColumn("before", F.lit(None).cast("double"))

        def render() -> str:
            n = out.agg(F.count_if("imputed").alias("i"), F.count_if("clamped").alias("c"), F.count_if(F.col("value").isNull()).alias("m")).first()
            left = region_table(out, "value is null").orderBy("channel", "start")
            return report("Gap filling", ds, [f"longest gap filled: {self.max_gap} rows", f"filled: {n.i:,}", f"clamped: {n.c:,}", f"still missing: {n.m:,}"], [("Left missing", lines_of(left))])

        return StepResult(ds.with_readings(out.select(*ds.readings.columns), self.name), ledger(changed, F.col("imputed"), f"local fit (gaps up to {self.max_gap})"), {}, render)


@dataclass(frozen=True)
class FilterStep:
    """Zero-phase low-pass on the channel's own grid. The ledger has readings that changed by more than rounding."""

    cutoff_min: float = 30.0
    order: int = 3
    key: str = "filter"
    name: str = "Filtered"

    def run(self, ds: Dataset) -> StepResult:
        out = lowpass(ds.readings, ds.interval_s, self.cutoff_min, self.order)
        old = ds.readings.select("channel", "ts", F.col("value").alias("before"))
        changed = out.join(old, ["channel", "ts"], "left")
        moved = F.coalesce(F.abs(F.col("value") - F.col("before")) > 1e-8 + 1e-9 * F.abs("before"), F.col("value").isNull() != F.col("before").isNull())

        def render() -> str:
            parts = [("What was taken away", lines_of(residual_moments(ds.readings, out))), ("Steps before", lines_of(increment_moments(ds.readings))), ("Steps after", lines_of(increment_moments(out))), ("At peaks and troughs", lines_of(peak_trough_effect(ds.readings, out)))]
            return report("Low-pass filter", ds, [f"cutoff: {self.cutoff_min:g} min, order {self.order}"], parts)

        return StepResult(ds.with_readings(out, self.name), ledger(changed, moved, f"low-pass ({self.cutoff_min:g} min)"), {}, render)


def run_chain(ds: Dataset, steps: Sequence[Step]) -> StepResult:
    """Run steps one after the other; ledgers are joined, stats keyed by step."""
    ledgers, stats, renders = no_ledger(ds), {}, []
    for step in steps:
        result = step.run(ds)
        ds, ledgers = result.dataset, ledgers.unionByName(result.ledger)
        stats[step.key] = result.stats
        renders.append(result.render)
    return StepResult(ds, ledgers, stats, lambda: "\n\n".join(r() for r in renders))
