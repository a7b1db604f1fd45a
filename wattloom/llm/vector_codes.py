"""Compression of vectors to codes: a codebook for each of several parts, fitted by rounds of nearest entries.

The nearest entry is found through a ball tree over the entries of a part's codebook. A
ball has an integer centre and a radius rounded up; a point's distance to the centre is
rounded down, so the difference of the two never exceeds the distance to any entry of the
ball. Balls are visited from the nearer to the farther while that bound, squared, is at most
the best distance so far: not only below it, as an equal distance may belong to a lower
index. Distances that decide are integers. Points go down the tree in batches.

Codebooks are small (entries times width) and go to every task; what comes back from a round
is one sum for each component of each entry, added up in each task and then in a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import join_hot, materialize, slices

#: Entries that are compared one by one at the end of a branch.
LEAF = 12
#: Points that go down the tree together.
BATCH = 4096


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all entries, exact as long as they fit 64 bits."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2**52:  # doubles hold these integers
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[:, k]) ** 2
    return out


def _root_up(n: int) -> int:
    return math.isqrt(n - 1) + 1 if n else 0


def _root_down(n: np.ndarray) -> np.ndarray:
    root = np.sqrt(n.astype(np.float64)).astype(np.int64)
    return root - (root * root > n)


@dataclass
class _Ball:
    centre: np.ndarray
    radius: int
    members: np.ndarray  # indexes of entries, ascending
    near: tuple[_Ball, _Ball] | None = None


class BallTree:
    """Exact nearest entries of integer points; of equally near ones the least index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._ball(np.arange(len(entries)))
        #: Distances to entries that were worked out, of those that comparing all would take.
        self.compared = self.possible = 0

    def _ball(self, members: np.ndarray) -> _Ball:
        own = self.entries[members]
        centre = np.rint(own.mean(axis=0)).astype(np.int64)
        away = _squares(own, centre[None])[:, 0]
        ball = _Ball(centre, _root_up(int(away.max(initial=0))), members)
        if len(members) > self.leaf and away.any():
            # The two ends are far apart; each member goes to the nearer one.
            a = own[int(away.argmax())]
            from_a = _squares(own, a[None])[:, 0]
            b = own[int(from_a.argmax())]
            left = from_a <= _squares(own, b[None])[:, 0]
            ball.near = (self._ball(members[left]), self._ball(members[~left]))
        return ball

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of x."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries))
        self.possible += len(x) * len(self.entries)
        self._visit(self.root, x, np.arange(len(x)), best, index)
        return index, best

    def _visit(self, ball: _Ball, x: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if ball.near is None:
            self.compared += len(rows) * len(ball.members)
            away = _squares(x[rows], self.entries[ball.members])
            at = away.argmin(axis=1)
            found, least = ball.members[at], away[np.arange(len(rows)), at]
            better = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = least[better], found[better]
            return
        away = _root_down(_squares(x[rows], np.stack([b.centre for b in ball.near])))
        bound = np.maximum(0, away - np.array([b.radius for b in ball.near]))
        left_first = away[:, 0] <= away[:, 1]
        for own, order in ((left_first, (0, 1)), (~left_first, (1, 0))):
            for k in order:
                self._visit(ball.near[k], x, rows[own & (bound[:, k] ** 2 <= best[rows])], best, index)


def _batches(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches, BATCH):
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy().reshape(batch.num_rows, width)


def _parts_of(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(part, entry) -> count and componentwise sum of the parts nearest to the entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        totals = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, x in _batches(batches, 0, width):
            for tree, part, total, count in zip(trees, _parts_of(x, len(books)), totals, counts, strict=True):
                index, _ = tree.nearest(part)
                np.add.at(total, index, part)
                count += np.bincount(index, minlength=len(count))
        for k, (total, count) in enumerate(zip(totals, counts, strict=True)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k)), pa.array(used), pa.array(count[used]), pa.array([t.tolist() for t in total[used]], pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    found = rows.select("v").mapInArrow(add, "part long, entry long, n long, total array<long>")
    counts = found.groupBy("part", "entry").agg(F.sum("n").alias("n"))
    totals = found.select("part", "entry", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
    # One row for each component of each entry at most, whatever the number of vectors.
    out = {(r.part, r.entry): (r.n, np.zeros(width // len(books), np.int64)) for r in counts.collect()}
    for r in totals.collect():
        out[r.part, r.entry][1][r["at"]] = r.x
    return out


def integer_vectors(vectors: DataFrame, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, as a table, and the length of v, a multiple of `parts`."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(scale * x)).alias("v"))
    rows = materialize(rows, "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).head()
    length = first.n if first else 0
    rows = rows.where(F.size("v") == length)
    top = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0
    if 4 * length * top * top >= 2**63:
        raise ValueError(f"squared distances between vectors of {length} components up to {top} do not fit a long")
    width = -(-length // parts) * parts
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), width - length))), width


def fit_codebooks(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook (entries x components) for each part."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = [np.ascontiguousarray(b) for b in _parts_of(np.array([r.v for r in start], np.int64).reshape(len(start), width), parts)]
    for _ in range(rounds if start else 0):
        fresh = [b.copy() for b in books]
        for (part, entry), (n, total) in _sums(rows, books, width).items():
            fresh[part][entry] = total // n
        books = fresh
    return books


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """`rows` with `codes` (an index for each part) and `error` instead of v."""
    names = [c for c in rows.columns if c != "v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in books]
        for batch, x in _batches(batches, len(names), width):
            found = [tree.nearest(part) for tree, part in zip(trees, _parts_of(x, len(books)), strict=True)]
            codes = np.stack([f[0] for f in found], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(sum(f[1] for f in found))], [*names, "codes", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    return rows.select(*names, "v").mapInArrow(assign, f"{schema}, codes array<int>, error long")


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components as decimals, by part, entry and place."""
    return sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row of `vectors` (vec_id, embedding, label) that takes part.

    Components become floor(scale * x). The first `entries` vectors by vec_id start the codebooks
    (rows that repeat a vec_id in the order of their vectors, rows without one last); in each round
    every entry becomes the mean, rounded down, of the parts nearest to it, and unused entries
    stay. `error` is the squared distance to what the code stands for, label_error its sum over
    the rows of equal label, nulls together; without a column `label` all are null.

    Vectors that are null, or hold null, NaN or infinite components, take no part, nor do those
    whose length is not that of the first; lengths that `parts` does not divide are filled up with
    zeros. Vectors whose distances do not fit a long are an error. Repeated rows count each and
    all return. Empty in, empty out. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    rows, width = integer_vectors(vectors, parts, scale)
    books = fit_codebooks(rows, width, parts, entries, rounds)
    coded = materialize(encode(rows, books, width) if len(books[0]) else rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), "codes")
    # A label may stand on a third of all rows.
    keyed = coded.withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("_none", F.col("label").isNull())
    totals = keyed.groupBy("_label", "_none").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_hot(keyed, materialize(totals, "label-errors"), ["_label", "_none"], "n", coded.count())
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
