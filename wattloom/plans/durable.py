"""Layers of a dataset that outlive the session: each is written once, and a log says how they hang together.

A folder holds the readings and the ledger of every layer as Parquet, and a log of one small
record for each event: a layer was made from a parent by a step, or a layer became the active
one. A layer counts from the moment its record is there, so a job that dies halfway leaves
nothing behind that is read. Reading a layer scans its own files only, whatever made it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.model import Channel, Dataset
from wattloom.plans.steps import EMPTY_LEDGER, Step

READINGS = "channel string, pos long, ts timestamp_ntz, value double"


@dataclass(frozen=True)
class Record:
    """A layer's entry in the log."""

    id: int
    parent: int | None
    name: str
    step: str
    params: str
    path: str
    about: str
    n_rows: int
    n_changed: int


class DurableStack:
    """Layers in `folder`, which every task can reach; the first is the dataset as loaded.

    Committing after a revert makes a branch: the layers left behind keep their ids and can be
    gone back to. Two writers that commit at once get an error, not a mixture.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._layers: dict[int, Record] = {}
        self._active, self._seq = -1, 0
        self._read_log()

    @classmethod
    def create(cls, folder: str, ds: Dataset) -> DurableStack:
        stack = cls(ds.readings.sparkSession, folder)
        if stack._layers:
            raise ValueError(f"{folder} holds layers already; open it instead")
        empty = ds.readings.sparkSession.createDataFrame([], EMPTY_LEDGER)
        stack._write(ds, empty, None, "load", {"source": ds.source})
        return stack

    def _log(self) -> str:
        return f"{self._folder}/log"

    def _read_log(self) -> None:
        here = self._spark._jvm.org.apache.hadoop.fs.Path(self._log())
        if not here.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(here):
            return
        # A record of a few hundred bytes for each commit and each step back.
        for row in sorted(self._spark.read.text(f"{self._log()}/*").collect(), key=lambda r: json.loads(r.value)["seq"]):
            event = json.loads(row.value)
            self._seq = event["seq"] + 1
            if "layer" in event:
                self._layers[event["layer"]["id"]] = Record(**event["layer"])
            self._active = event["active"]

    def _append(self, event: dict) -> None:
        line = json.dumps(event | {"seq": self._seq}, ensure_ascii=False)
        self._spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self._log()}/{self._seq:08d}")
        self._seq += 1

    def _write(self, ds: Dataset, ledger: DataFrame, parent: int | None, step: str, params: dict) -> Record:
        own = max(self._layers, default=-1) + 1
        path = f"{self._folder}/layers/{own:04d}-{uuid.uuid4().hex[:8]}"
        ds.readings.select("channel", "pos", "ts", "value").write.parquet(f"{path}/readings")
        ledger.select("ts", "channel", "before", "after", "reason").write.parquet(f"{path}/ledger")
        about = {"channels": [asdict(c) for c in ds.channels], "kind": ds.kind, "source": ds.source, "layer": ds.layer, "interval_s": ds.interval_s, "notes": list(ds.notes)}
        n_rows, n_changed = self._spark.read.parquet(f"{path}/readings").count(), self._ledger(path).count()
        record = Record(own, parent, ds.layer, step, json.dumps(params, default=str), path, json.dumps(about), n_rows, n_changed)
        self._append({"layer": asdict(record), "active": own})
        self._layers[own], self._active = record, own
        return record

    def _ledger(self, path: str) -> DataFrame:
        return self._spark.read.schema(EMPTY_LEDGER).parquet(f"{path}/ledger")

    @property
    def active(self) -> Record:
        return self._layers[self._active]

    def dataset(self, layer: int | None = None) -> Dataset:
        """A layer (the active one by default) from its own files."""
        record = self._layers[self._active if layer is None else layer]
        about = json.loads(record.about)
        channels = tuple(Channel(**{**c, "valid_range": tuple(c["valid_range"]) if c["valid_range"] else None}) for c in about.pop("channels"))
        readings = self._spark.read.schema(READINGS).parquet(f"{record.path}/readings")
        return Dataset(readings, channels, notes=tuple(about.pop("notes")), **about)

    def apply(self, step: Step) -> Record:
        """Run a step on the active layer and commit what it gives on top of it."""
        result = step.run(self.dataset())
        params = asdict(step) if is_dataclass(step) else {}
        return self._write(result.dataset, result.ledger, self._active, step.key, params)

    def revert(self, layer: int | None = None) -> Record:
        """Make a layer the active one; by default the parent of the one that is."""
        target = self.active.parent if layer is None else layer
        if target is None:
            raise RuntimeError("the root layer is active")
        if target not in self._layers:
            raise KeyError(f"no layer {target}")
        self._append({"active": target})
        self._active = target
        return self.active

    def lineage(self, layer: int | None = None) -> list[Record]:
        """From the root to a layer."""
        out, at = [], self._active if layer is None else layer
        while at is not None:
            out.append(self._layers[at])
            at = out[-1].parent
        return out[::-1]

    def breadcrumb(self) -> str:
        return " › ".join(r.name for r in self.lineage())

    def layers(self) -> list[Record]:
        return [self._layers[k] for k in sorted(self._layers)]

    def full_ledger(self, layer: int | None = None) -> DataFrame:
        """(layer, ts, channel, before, after, reason) of all changes from the root to a layer, read from what was written then."""
        out = None
        for record in self.lineage(layer):
            own = self._ledger(record.path).select(F.lit(record.id).alias("layer"), "*")
            out = own if out is None else out.unionByName(own)
        return out
