"""Plain-text reports over small results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from wattloom.model import Dataset

#: Rows of a table that a report shows.
ROWS_SHOWN = 40


def _cell(value) -> str:
    return "—" if value is None else f"{value:,.4g}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def lines_of(df: DataFrame, rows: int = ROWS_SHOWN) -> list[str]:
    """The first rows of a small result, one line each."""
    return ["  ".join(f"{k}: {_cell(v)}" for k, v in r.asDict().items()) for r in df.limit(rows).collect()]


def report(title: str, ds: Dataset, facts: Sequence[str], parts: Sequence[tuple[str, Sequence[str]]]) -> str:
    out = [title, "-" * len(title), f"source: {ds.source or 'in memory'}", ds.summary(), *facts]
    for name, lines in parts:
        if lines:
            out += ["", name, *(f"  {x}" for x in lines)]
    return "\n".join(out)
