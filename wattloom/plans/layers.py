"""Layers of a dataset: staged, committed, reverted."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from wattloom.model import Dataset
from wattloom.plans.steps import StepResult


@dataclass(frozen=True)
class Layer:
    id: int
    name: str
    dataset: Dataset
    ledger: DataFrame | None = None

    def n_changed(self) -> int:
        """Rows of the ledger, which its limit also limits."""
        return 0 if self.ledger is None else self.ledger.count()


class LayerStack:
    """Layers on top of a root, a pointer to the active one, and one staged layer at most.

    Ids are given when a layer is staged, so those of discarded ones are not used again.
    Committing drops the layers above the active one.
    """

    def __init__(self, root: Dataset):
        self._layers = [Layer(0, root.layer, root)]
        self._active, self._next, self._staged = 0, 1, None

    @property
    def active(self) -> Layer:
        return self._layers[self._active]

    @property
    def staged(self) -> Layer | None:
        return self._staged

    def stage(self, result: StepResult) -> Layer:
        if self._staged is not None:
            raise RuntimeError("commit or discard the staged layer first")
        self._staged = Layer(self._next, result.dataset.layer, result.dataset, result.ledger)
        self._next += 1
        return self._staged

    def commit(self) -> Layer:
        if self._staged is None:
            raise RuntimeError("nothing is staged")
        self._layers = [*self._layers[: self._active + 1], self._staged]
        self._active, self._staged = len(self._layers) - 1, None
        return self.active

    def discard(self) -> None:
        self._staged = None

    def can_revert(self) -> bool:
        return self._active > 0

    def revert(self) -> Layer:
        if not self.can_revert():
            raise RuntimeError("the root layer is active")
        self._active -= 1
        return self.active

    def revert_to_root(self) -> Layer:
        self._active = 0
        return self.active

    def history(self) -> list[str]:
        return [f"{'→' if k == self._active else ' '} {x.id}: {x.name}" for k, x in enumerate(self._layers)]

    def breadcrumb(self) -> str:
        return " › ".join(x.name for x in self._layers[: self._active + 1])

    def full_ledger(self) -> DataFrame | None:
        """The ledgers of the active layer and those below it, one after the other."""
        out = None
        for x in self._layers[: self._active + 1]:
            if x.ledger is not None:
                out = x.ledger if out is None else out.unionByName(x.ledger)
        return out

    def memory_mb(self) -> float:
        """Size of all layers as 8-byte values, if they were held in memory; they are plans until written."""
        return sum(x.dataset.readings.count() for x in self._layers) * 8 / 1e6


class StatsCache:
    """The last 64 computed statistics, by layer and span."""

    def __init__(self, size: int = 64):
        self._size, self._rows = size, OrderedDict()

    def get(self, key: tuple, make):
        if key in self._rows:
            self._rows.move_to_end(key)
        else:
            self._rows[key] = make()
            if len(self._rows) > self._size:
                self._rows.popitem(last=False)
        return self._rows[key]
