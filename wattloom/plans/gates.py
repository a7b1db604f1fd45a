"""Which actions a state allows, checks of parameters, and windows of dates."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from wattloom.model import AGGREGATE_SERIES, ENVIRONMENTAL, HOUSEHOLD_PANEL, POWER
from wattloom.operators.rolling import check_detector

EMPTY, LOADED, SENTINELS_HANDLED, AGGREGATED = "empty", "loaded", "sentinels_handled", "aggregated"
#: The stage that a layer's name stands for when one goes back to it.
STAGE_OF_LAYER = {"Raw": LOADED, "Sentinels": LOADED, "Interpolated": SENTINELS_HANDLED, "Aggregated": AGGREGATED}


@dataclass(frozen=True)
class State:
    stage: str = EMPTY
    kind: str = ""
    role: str = ""
    has_holes: bool = False
    can_revert: bool = False
    busy: bool = False


def legal_actions(s: State) -> frozenset[str]:
    """A pure function of the state."""
    if s.busy:
        return frozenset()
    out = {"import"}
    if s.stage != EMPTY:
        out |= {"plot", "properties", "history", "normalise"}
        if s.kind != ENVIRONMENTAL and s.stage == LOADED:
            out.add("sentinels")
        if s.kind == HOUSEHOLD_PANEL and s.stage == SENTINELS_HANDLED:
            out.add("aggregate")
        if s.role == POWER:
            out |= {"detect", "calibrate", "clean"}
        if s.has_holes:
            out.add("fill_gaps")
        if s.kind == ENVIRONMENTAL:
            out.add("filter")
        if s.can_revert:
            out.add("revert")
    return frozenset(out)


def advance(s: State, action: str) -> State:
    """The state after a committed action."""
    if action not in legal_actions(s):
        raise ValueError(f"{action} is not possible now")
    if action == "sentinels":
        return State(SENTINELS_HANDLED, s.kind, s.role, s.has_holes, True)
    if action == "aggregate":
        return State(AGGREGATED, AGGREGATE_SERIES, POWER, s.has_holes, True)
    return State(LOADED if action == "import" else s.stage, s.kind, s.role, s.has_holes, s.can_revert or action in ("clean", "fill_gaps", "filter", "normalise"))


def revert(s: State, layer: str, first: bool = False) -> State:
    """The state after going back to `layer`; `first`: it is the bottom one. Other layers keep the stage."""
    if s.busy or not s.can_revert:
        raise ValueError("there is nothing to go back to")
    stage = LOADED if first and s.kind == AGGREGATE_SERIES else STAGE_OF_LAYER.get(layer, s.stage)
    return State(stage, s.kind, s.role, s.has_holes, not first)


def check_parameters(*, window: int | None = None, sigma: float | None = None, cutoff_min: float | None = None, step_min: float | None = None, max_gap: int | None = None, rows: int | None = None, share_pct: float | None = None, low: float | None = None, high: float | None = None, layer: str = "") -> list[str]:
    """Raise on what cannot work; return warnings on what is unusual."""
    warnings = []
    if window is not None and sigma is not None:
        check_detector(window, sigma)
    if cutoff_min is not None and step_min is not None and cutoff_min <= 2 * step_min:
        raise ValueError("the cutoff lies at or above the Nyquist limit")
    if max_gap is not None:
        if max_gap <= 0:
            raise ValueError("the gap limit must be positive")
        if rows and max_gap > 0.1 * rows:
            warnings.append("the gap limit exceeds a tenth of the rows")
    if share_pct is not None and not 0 < share_pct <= 100:
        raise ValueError("the training share lies above 0 and up to 100 %")
    if low is not None and high is not None and not high > low:
        raise ValueError("the upper bound must exceed the lower")
    if layer == "Raw":
        warnings.append("the raw layer is about to be normalised: a spike would set the range")
    return warnings


def _add_months(d: date, n: int) -> date:
    k = d.year * 12 + d.month - 1 + n
    year, month = divmod(k, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def date_window(mode: str, start: date, first: date, last: date) -> tuple[date, date]:
    """First and last day of a Full, Month, Week or Day window that begins at `start`, inside the data."""
    if mode == "Full":
        return first, last
    end = {"Month": _add_months(start, 1) - timedelta(days=1), "Week": start + timedelta(days=6), "Day": start}[mode]
    return max(start, first), min(end, last)


def shift_window(mode: str, start: date, direction: int, first: date, last: date, end: date | None = None) -> date:
    """Start of the next (1) or previous (-1) window, inside the data. A free span, start to `end`, moves by its own length."""
    if mode == "Full":
        return first
    if end is not None:
        span = end - start + timedelta(days=1)
        return max(min(start + direction * span, last - span + timedelta(days=1)), first)
    moved = _add_months(start, direction) if mode == "Month" else start + direction * timedelta(days={"Week": 7, "Day": 1}[mode])
    return min(max(moved, first), last)
