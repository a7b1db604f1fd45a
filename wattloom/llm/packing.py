"""Hierarchical packing of tokenised documents into windows of several context sizes.

A document's full windows of the largest size stand alone. Its remainder is routed to
the smallest tier that holds it. From the longest tier down, a window opens with its
longest piece; the gap goes to the largest pieces of the same or shorter tiers that
fit, and the last gap to the head of one piece that is cut there. Windows are thus
exactly full. What is left at the end of a partition is split at the powers of two.

A partition packs its own documents in pools of bounded size: no row is shuffled and
no task holds more than a pool.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import slices, text_or_empty
from wattloom.llm.tokens import GENERATION, encoder

TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens of one step group, of any tier.
STEP_TOKENS = 16 * 4096
#: A partition packs as soon as it holds so many tokens, or so many pieces.
POOL_TOKENS = 2_000_000
POOL_PIECES = 20_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step", pa.int64()), ("ids", pa.binary())])


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "total", "start", "ids")

    def __init__(self, doc, total: int, start: int, ids: np.ndarray):
        self.doc, self.total, self.start, self.ids = doc, total, start, ids

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.total, self.start, self.ids[:n]), Piece(self.doc, self.total, self.start + n, self.ids[n:])


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    return next(t for t in tiers if length <= t)


def pack_pool(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces that fill none."""
    order = count()  # a tie-breaker, so that pieces are never compared
    pool: list[tuple[int, int, Piece]] = sorted((len(p), next(order), p) for p in pieces)
    windows = []
    while pool:
        length, _, first = pool.pop()
        size, window = tier_of(length, tiers), [first]
        gap = size - length
        while gap and pool:
            at = bisect_right(pool, gap, key=lambda x: x[0])
            if at:
                length, _, piece = pool.pop(at - 1)
            else:  # every piece is longer than the gap: the shortest gives its head
                _, _, piece = pool.pop(0)
                piece, rest = piece.cut(gap)
                insort(pool, (len(rest), next(order), rest))
                length = gap
            window.append(piece)
            gap -= length
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def split_by_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are the powers of two that make up the sum."""
    total, out, queue = sum(map(len, pieces)), [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        need, window = total & (1 << bit), []
        while need:
            piece = queue.pop(0)
            if len(piece) > need:
                piece, rest = piece.cut(need)
                queue.insert(0, rest)
            window.append(piece)
            need -= len(piece)
        if window:
            out.append(window)
    return out


def step_groups(lengths: list[int], step_tokens: int) -> list[int]:
    """A step number for each window: windows of one length, in groups whose sizes differ by one at most."""
    groups, first = [0] * len(lengths), 0
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by_length.setdefault(n, []).append(i)
    for n in sorted(by_length, reverse=True):
        own = by_length[n]
        steps = -(-len(own) * n // step_tokens)
        for k, i in enumerate(own):
            groups[i] = first + k * steps // len(own)
        first += steps
    return groups


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = True, cached: int = GENERATION) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step, ids.

    `tier` is the length of the sequence, `ids` holds the piece as little-endian uint32.
    `tiers` are ascending powers of two. A null text counts as empty and is one end id; an
    empty table gives no rows. Rows that repeat a doc_id are packed one by one. Other columns
    are ignored. `sequence_id` and `step` have the partition in their upper bits, so they
    need no count of what other tasks made. Without `with_ids` the column `ids` never leaves
    the worker; `cached` bounds the encoder's cache. Neither changes any other column.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be ascending powers of two")
    largest, schema = tiers[-1], _SCHEMA if with_ids else _SCHEMA.remove(_SCHEMA.get_field_index("ids"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer, cached), TaskContext.get().partitionId() << 33
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = step = 0
        full: list[list[Piece]] = []
        pool: list[Piece] = []
        held = 0

        def emit(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence, step
            lengths = [sum(map(len, w)) for w in windows]
            steps, rows = step_groups(lengths, step_tokens), []
            for window, n, group in zip(windows, lengths, steps, strict=True):
                offset = 0
                for p in window:
                    raw = p.ids.tobytes()
                    rows.append((p.doc, p.start, len(p), zlib.crc32(raw), p.total, base | sequence, offset, n, base | (step + group), *[raw] * with_ids))
                    offset += len(p)
                sequence += 1
            step += max(steps, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode.ids(text) + end, dtype="<u4")
                whole = len(ids) // largest * largest
                full += [[Piece(doc, len(ids), k, ids[k : k + largest])] for k in range(0, whole, largest)]
                if whole < len(ids):
                    pool.append(Piece(doc, len(ids), whole, ids[whole:]))
                held += len(ids)
                if held >= POOL_TOKENS or len(pool) >= POOL_PIECES:
                    windows, pool = pack_pool(pool, tiers)
                    if full or windows:
                        yield emit(full + windows)
                    full, held = [], sum(map(len, pool))
        windows, rest = pack_pool(pool, tiers)
        if windows := full + windows + split_by_powers(rest):
            yield emit(windows)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step long" + ", ids binary" * with_ids)
