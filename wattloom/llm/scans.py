"""Running sums over a sorted table in many tasks, and nearest smaller values by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import materialize

#: Values of a block.
BLOCK = 65_536


def running(rows: DataFrame, order: list[Column | str], sums: list[str], within: str | None = None) -> DataFrame:
    """`rows` with the running sum `<name>_run` (its own row included) of each column of `sums`.

    Rows are in the order of `order`, and the sums begin anew with each value of the long column
    `within`. The summed columns are longs that are not negative, without nulls. The rows are
    dealt into ranges, equal ones and those of one `within` too; each task sums its own range,
    and one row a range then carries the sums over.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.columns
    keyed = rows.withColumn("_key", F.col(within) if within else F.lit(0).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    by = ["_key", *order, "_tie"]
    ranged = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    names = [f"{c}_run" for c in sums]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, total = TaskContext.get().partitionId(), None, np.zeros(len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(batch.schema.get_field_index("_key")).to_numpy()
            added = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in sums], axis=1).cumsum(axis=0)
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            base = np.concatenate([np.zeros((1, len(sums)), np.int64), added])[starts]
            if key[0] == last:
                base[0] -= total
            out = added - np.repeat(base, np.diff(np.append(starts, n)), axis=0)
            last, total = key[-1], out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, k]) for k in range(len(sums))), pa.array(np.full(n, part, np.int32))], [*batch.schema.names, *names, "_part"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    local = materialize(ranged.mapInArrow(scan, f"{types}, {', '.join(f'`{c}` long' for c in names)}, _part int"), "scan")
    # Running sums never fall, so the greatest row of a range is its last.
    ends = local.groupBy("_part").agg(F.min("_key").alias("first"), F.max(F.struct("_key", *names)).alias("last"))
    carried, key, total = [], None, np.zeros(len(sums), np.int64)
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        own = np.array(r["last"][1:], np.int64)
        if r["first"] == key:
            carried.append((r["_part"], key, *total.tolist()))
        total = own + total if r["first"] == key == r["last"][0] else own
        key = r["last"][0]
    schema = f"_part int, _key long, {', '.join(f'_{k} long' for k in range(len(sums)))}"
    out = local.join(F.broadcast(spark.createDataFrame(carried, schema)), ["_part", "_key"], "left")
    return out.select(*kept, *((F.col(c) + F.coalesce(F.col(f"_{k}"), F.lit(0))).alias(c) for k, c in enumerate(names)))


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the index of the nearest smaller one before it (else -1) and after it (else their number)."""
    n = len(values)
    before, after, stack = np.full(n, -1), np.full(n, n), []
    for k, v in enumerate(values.tolist()):
        while stack and stack[-1][1] > v:
            after[stack.pop()[0]] = k
        low = stack[-1] if stack else None
        before[k] = -1 if low is None else low[0] if low[1] < v else before[low[0]]
        stack.append((k, v))
    return before, after


def _strict_minima(values: np.ndarray) -> np.ndarray:
    """Where a value is below all before it, or below all after it."""
    top = np.iinfo(np.int64).max
    ahead = np.concatenate([[top], np.minimum.accumulate(values)[:-1]])
    behind = np.concatenate([np.minimum.accumulate(values[::-1])[::-1][1:], [top]])
    return (values < ahead) | (values < behind)


def nearest_smaller(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """(value, left, right), distinct: for the values of (pos, value), the positions of the nearest smaller ones.

    Positions are dense from 0, and the value there is the least of all and the only one of its
    size. Without a smaller value after it, `right` is the number of values. Equal values with no
    smaller one between them give the same row.

    Blocks are settled on their own. Of those that need another block only the minima of a block
    from either end go on: they are the nearest smaller values that other blocks can find there.
    """
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = values.count()
    level = values.select(F.col("pos").alias("rank"), "pos", F.col("value").cast("long").alias("value"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))
    size, found = n, []
    while True:
        last = size <= block

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def judge() -> pa.RecordBatch:
                rows = pa.Table.from_batches(held).sort_by("pos")
                pos, value = rows["pos"].to_numpy(), rows["value"].to_numpy()
                before, after = smaller_neighbours(value)
                left, right = (pc.fill_null(rows[c], -1).to_numpy() for c in ("left", "right"))
                left = np.where((left < 0) & (before >= 0), pos[before], left)
                right = np.where((right < 0) & (after < len(pos)), pos[np.minimum(after, len(pos) - 1)], right)
                if last:
                    right = np.where(right < 0, n, right)
                done = (left >= 0) & (right >= 0)
                stay = done | _strict_minima(value)
                return pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (pos, value, left, right, done)], ["pos", "value", "left", "right", "done"])

            own = None
            for batch in batches:
                blocks = batch.column(0).to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if held and blocks[a] != own:
                        yield judge()
                        held = []
                    own = blocks[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield judge()

        dealt = level.withColumn("block", F.floor(F.col("rank") / block)).select("block", "pos", "value", "left", "right").repartition(parts, "block").sortWithinPartitions("block")
        settled = materialize(dealt.mapInArrow(settle, "pos long, value long, left long, right long, done boolean"), "level")
        found.append(settled.where("done").select("value", "left", "right"))
        if last:
            break
        open_ = settled.where("not done").select("pos", "value", F.when(F.col("left") >= 0, F.col("left")).alias("left"), F.when(F.col("right") >= 0, F.col("right")).alias("right"), F.lit(1).cast("long").alias("one"))
        level = materialize(running(open_, ["pos"], ["one"]).select((F.col("one_run") - 1).alias("rank"), "pos", "value", "left", "right"), "open")
        before, size = size, level.count()
        block *= 1 + (2 * size > before)  # a long run of rising values has many minima
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()
