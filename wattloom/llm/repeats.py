"""Removal of byte strings that occur more than once in a collection.

Every 200-byte window has an anchor: the 32 bytes in it with the least hash. Equal windows
have equal anchors at equal places, so windows need to be compared only with those around
an equal anchor. The windows of one anchor in a text form a span of 200 to 368 bytes.

1. Spans are counted by anchor and a 128-bit digest of their bytes. Where a whole span occurs
   again, all its windows do. Inside a long repeated passage that settles all spans but those at its ends.
2. The open spans around one anchor, with one copy of each span that meets them, are short
   documents of a collection. They are sorted column-wise: one symbol of every document is
   inserted each round, from the right end to the left, and each round updates the order
   of the suffixes (the column of the Burrows-Wheeler transform) and the lengths of common
   prefixes from the arrays of the round before. A window is repeated where the suffix
   that starts it has a common prefix of 200 bytes with a neighbour.

Groups of open spans beyond a batch are not sorted in one task: the 200-byte windows in them
are counted by a 128-bit hash, with partial sums before the shuffle.

The collection lies in Spark's sorted shuffle files and is read through once, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import HOT_SHARE, join_hot, materialize, release, shuffles_end_with_their_job, slices, text_or_empty

LENGTH, GRAM = 200, 32
#: Bytes of a shared window that lie on one side of its anchor at least.
SIDE = (LENGTH - GRAM) // 2
_REACH = LENGTH - GRAM  # anchors start so many bytes after the window at most
_COLUMNS = _REACH + LENGTH
#: Runs or spans of texts that may be sent to every task (24 bytes each).
SMALL_ENTRIES = 20_000
#: Strings sorted at once, twice so many at most; the windows of a larger group are counted instead.
BATCH = 20_000

#: Enough for any place in a string that a table can hold.
_POSITION_BITS = 31
_RNG = np.random.default_rng(71)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x5851F42D4C957F2D
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def spans_of(data: bytes) -> tuple[np.ndarray, ...]:
    """first and last window start, anchor position, anchor hash: one entry for each anchor of `data`.

    The hash is a polynomial, of which unlike texts may have the same: it only says which spans may meet.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    ahead, back = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * ahead[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    # The least gram of each window, leftmost among equals: minima of blocks from both sides.
    keys = (grams >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    width = _REACH + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(left[:windows], right[width - 1 : width - 1 + windows]) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [windows - 1]])
    at = anchor[first]
    return first, last, at, grams[at].astype(np.int64)


def span_digests(data: bytes, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A digest of each span's bytes and of its anchor's place in it."""
    return [blake2b(data[f : t + LENGTH], digest_size=16, salt=b"%d" % (a - f)).digest() for f, t, a in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)]


def _min_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(values[a+1 .. b]) for each pair a < b."""
    length = b - a
    level = np.frexp(length.astype(np.float64))[1] - 1
    out, table = np.empty(len(a), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:]) if len(table) > half else table
        own = level == k
        out[own] = np.minimum(table[a[own] + 1], table[b[own] - (1 << k) + 1])
    return out


def repeated_starts(group: np.ndarray, strings: list[bytes], offset: np.ndarray) -> list[np.ndarray]:
    """For each string, whether the 200-byte window at each of its starts occurs at the same place in another string of its group.

    `offset` is the anchor's place in the string. Strings of a group are adjacent.
    """
    n = len(strings)
    start = _REACH - offset
    end = start + np.array([len(s) for s in strings])
    table = np.zeros((_COLUMNS, n), np.uint8)
    for k, s in enumerate(strings):
        table[start[k] : end[k], k] = np.frombuffer(s, np.uint8)
    group = np.unique(group, return_inverse=True)[1].astype(np.int64) * 257
    order, common = np.arange(n), np.zeros(n, np.int16)  # common[i]: prefix shared by order[i-1] and order[i]
    found = [np.zeros(max(0, len(s) - LENGTH + 1), bool) for s in strings]
    hit = np.zeros((_REACH + 1, n), bool)
    for column in range(_COLUMNS - 1, -1, -1):
        there = (start <= column) & (column < end)
        symbol = np.where(there, table[column].astype(np.int64) + 1, 0)
        key = (group + symbol)[order]
        moved = np.argsort(key, kind="stable")
        longer = np.zeros(n, np.int16)
        same = np.flatnonzero((key[moved[1:]] == key[moved[:-1]]) & (symbol[order[moved[1:]]] > 0))
        if len(same):
            longer[same + 1] = 1 + _min_between(common, moved[same], moved[same + 1])
        order, common = order[moved], longer
        if column <= _REACH:
            long = common >= LENGTH
            hit[column, order] = long | np.append(long[1:], False)
    for k in range(n):
        found[k] = hit[start[k] : start[k] + len(found[k]), k]
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _spans(rows: DataFrame) -> DataFrame:
    """One row for each anchor of each text. `place` packs first window, anchor and last window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.encode() for x in batch.column(2).to_pylist()]
            parts = [spans_of(x) for x in texts]
            span = [d for x, p in zip(texts, parts, strict=True) for d in span_digests(x, *p[:3])]
            owner = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
            first, last, at, anchor = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
            place = first | (at - first) << _POSITION_BITS | (last - first) << (_POSITION_BITS + 8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place), pa.array(anchor), pa.array(span, pa.binary())], ["key", "mark", "place", "anchor", "span"])

    return rows.select("key", "mark", "text").mapInArrow(find, "key long, mark long, place long, anchor long, span binary")


def _unpack(place: int) -> tuple[int, int, int]:
    """First window, anchor, last window."""
    first = place & ((1 << _POSITION_BITS) - 1)
    return first, first + (place >> _POSITION_BITS & 255), first + (place >> (_POSITION_BITS + 8))


def _merged(pieces: list[tuple[int, int]]) -> list[dict]:
    """Maximal runs that the (start, end) pieces cover."""
    out: list[dict] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def _frequent_anchors(spans: DataFrame) -> DataFrame:
    """(anchor): all anchors with more than one in HOT_SHARE rows, 2 * HOT_SHARE of them at most.

    A task names those that are half as frequent in its own rows; what it leaves out adds up to less than half of the share.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [batch.column(0).to_numpy() for batch in batches]
        anchor, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
        often = n * 2 * HOT_SHARE >= n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(anchor[often]), pa.array(n[often])], ["anchor", "n"])

    counts = spans.select("anchor").mapInArrow(frequent, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") * 2 * HOT_SHARE > spans.count()).select("anchor")


def _place_hash() -> Column:
    return F.xxhash64("key", "mark", "place")


def _judged(spans: DataFrame) -> DataFrame:
    """(key, mark, place, whole, anchor, wide): places of spans that occur again, and one place of each kind of span around an anchor with open ones.

    All spans of an anchor meet in one task. `anchor` is null where the place stands for no kind;
    `wide` says that the anchor has more strings than a batch.
    """
    kind, around = Window.partitionBy("anchor", "span"), Window.partitionBy("anchor")
    # One shuffle and one sort serve all frames; an anchor that occurs once meets nothing.
    near = spans.repartition("anchor").sortWithinPartitions("anchor", "span").withColumn("_rows", F.count("*").over(around)).where("_rows > 1")
    near = near.withColumn("n", F.count("*").over(kind)).withColumn("_sent", F.min(_place_hash()).over(kind) == _place_hash())
    near = near.withColumn("_open", F.count_if(F.col("n") == 1).over(around) > 0).withColumn("_strings", F.count_if("_sent").over(around))
    sent = F.col("_sent") & F.col("_open")
    found = near.withColumn("whole", F.col("n") > 1).withColumn("wide", sent & (F.col("_strings") > BATCH)).where(F.col("whole") | sent)
    return found.select("key", "mark", "place", "whole", F.when(sent, F.col("anchor")).alias("anchor"), "wide")


def _judged_frequent(spans: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """As _judged, where an anchor or a kind may have more rows than a task should: counts and joins. The tables that it reads come along."""
    # One anchor may hold a third of all places: rows of such are joined where they are.
    near = materialize(spans, "near-spans")
    kinds = materialize(near.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(_place_hash()).alias("stand_in")), "kinds")
    # A kind sends one string, so it is kinds and not places that make a group large.
    anchors = kinds.groupBy("anchor").agg(F.count_if(F.col("n") == 1).alias("single"), F.count("*").alias("kinds"), (F.count("*") > BATCH).alias("wide"))
    anchors = materialize(anchors.withColumn("_w", F.col("kinds")), "anchor-kinds")
    # Of each kind of span one place stands for it where open ones need partners.
    known = join_hot(kinds, anchors, ["anchor"], "_w", kinds.count()).select("anchor", "span", "n", (F.col("n") > 1).alias("whole"), F.when((F.col("kinds") > 1) & (F.col("single") > 0), F.col("stand_in")).alias("stand_in"), "wide")
    known = materialize(known.where("whole or stand_in is not null"), "known")
    sent = F.coalesce(F.col("stand_in") == _place_hash(), F.lit(False))
    found = join_hot(near, known, ["anchor", "span"], "n", near.count()).where(F.col("whole") | sent)
    return found.select("key", "mark", "place", "whole", F.when(sent, F.col("anchor")).alias("anchor"), (sent & F.col("wide")).alias("wide")), [near, kinds, anchors, known]


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SENT = pa.list_(pa.struct([("place", pa.int64()), ("whole", pa.bool_()), ("anchor", pa.int64()), ("wide", pa.bool_())]))


def _by_text(entries: DataFrame) -> DataFrame:
    """(key, mark, gone, sent): a text's runs of whole repeated spans, and its spans that others are compared with."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, sent = [], []
            for own in batch.column(2).to_pylist():
                places = [(_unpack(s["place"]), s) for s in own]
                gone.append(_merged([(f, last + LENGTH) for (f, _, last), s in places if s["whole"]]))
                sent.append([{k: s[k] for k in ("place", "whole", "anchor", "wide")} for _, s in places if s["anchor"] is not None])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, _RUNS), pa.array(sent, _SENT)], ["key", "mark", "gone", "sent"])

    lists = entries.groupBy("key", "mark").agg(F.collect_set(F.struct("place", "whole", "anchor", "wide")).alias("spans"))
    return lists.mapInArrow(merge, "key long, mark long, gone array<struct<start:int,end:int>>, sent array<struct<place:long,whole:boolean,anchor:long,wide:boolean>>")


def _small(df: DataFrame, size) -> DataFrame:
    """Marked for broadcast, if its lists hold few entries in all; else joined by a shuffle."""
    n = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    return F.broadcast(df) if n[0] + n[1] <= SMALL_ENTRIES else df


def _open_windows(strings: DataFrame) -> DataFrame:
    """(key, mark, runs): repeated runs of the open strings (side, single, key, mark, first, offset, data), sorted by side and place."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judge(rows: list[tuple]) -> pa.RecordBatch:
            ids = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
            hits = repeated_starts(np.array([ids[r[0]] for r in rows]), [r[6] for r in rows], np.array([r[5] for r in rows]))
            out: tuple[list, list, list] = ([], [], [])
            for (_, single, key, mark, first, *_), hit in zip(rows, hits, strict=True):
                if single and hit.any():
                    runs = [{"start": int(first + x), "end": int(first + y + LENGTH)} for x, y in zip(*_runs(hit), strict=True)]
                    for column, value in zip(out, (key, mark, runs), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _RUNS)], ["key", "mark", "runs"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                # Equal rows of the table send one string; it is a whole span, so no window of it is asked for.
                if held and (row[0], *row[2:5]) == (held[-1][0], *held[-1][2:5]):
                    continue
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield judge(held)
                    held = []
                held.append(row)
        if held:
            yield judge(held)

    return strings.mapInArrow(sort, "key long, mark long, runs array<struct<start:int,end:int>>")


_OPENED = {"key": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "offset": pa.int32(), "anchor": pa.int64(), "single": pa.bool_(), "wide": pa.bool_(), "data": pa.binary()}


def _packed(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], list(types))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with its bytes for each span that (key, mark, text, sent) names; `offset` is the anchor's place in it."""
    held: list[tuple] = []
    for batch in slices(batches):
        for key, mark, text, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            data = text.encode()
            for s in own:
                first, at, last = _unpack(s["place"])
                held.append((key, mark, first, at - first, s["anchor"], not s["whole"], s["wide"], data[first : last + LENGTH]))
                if len(held) >= 4096:
                    yield _packed(held, _OPENED)
                    held = []
    if held:
        yield _packed(held, _OPENED)


def _open_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(side, single, key, mark, first, offset, data, side's letter) of open spans, a list for each slice of them."""
    for batch in slices(batches):
        out = []
        for key, mark, first, offset, anchor, single, _, data in zip(*(batch.column(k).to_pylist() for k in range(len(_OPENED))), strict=True):
            # Equal windows agree in so many bytes before the anchor or after it.
            for side, near in (("l", data[max(0, offset - SIDE) : offset]), ("r", data[offset + GRAM : offset + GRAM + SIDE])):
                if len(near) == SIDE:
                    group = sha256(side.encode() + anchor.to_bytes(8, "little", signed=True) + near).digest()[:16]
                    out.append((group, single, key, mark, first, offset, data, side))
        yield out


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for own in _open_strings(batches):
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in own], pa.binary())], ["side"])


def _cut(large: frozenset[bytes]):
    """The open strings of groups that are not in `large`."""
    types = {"side": pa.binary(), "single": pa.bool_(), "key": pa.int64(), "mark": pa.int64(), "first": pa.int32(), "offset": pa.int32(), "data": pa.binary()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _open_strings(batches):
            yield _packed([s for s in own if s[0] not in large], types)

    return cut


def _counted_windows(opened: DataFrame, large: frozenset[bytes]) -> tuple[DataFrame, DataFrame]:
    """(key, mark, runs): repeated windows of the groups in `large`, by counts of equal windows. The table that it reads comes along."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _open_strings(batches):
            for _, single, key, mark, first, offset, data, side in (s for s in own if s[0] in large):
                # Left of the anchor a window has SIDE bytes or more, or else more to its right: one side counts it.
                last = len(data) - LENGTH
                starts = range(0, min(last, offset - SIDE) + 1) if side == "l" else range(max(0, offset - SIDE + 1), last + 1)
                n = len(starts)
                found = [blake2b(data[x : x + LENGTH], digest_size=16).digest() for x in starts]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([single] * n, pa.bool_()), pa.array([key] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array([first + x for x in starts], pa.int32())], ["window", "single", "key", "mark", "start"])

    found = opened.mapInArrow(windows, "window binary, single boolean, key long, mark long, start int")
    counts = found.groupBy("window").agg(F.count("*").alias("n"), F.max("single").alias("asked"))
    repeated = materialize(counts.where("n > 1 and asked").select("window"), "repeated-windows")
    hits = found.where("single").join(_small(repeated, F.lit(0)), "window")
    return hits.select("key", "mark", F.array(F.struct("start", (F.col("start") + LENGTH).cast("int").alias("end"))).alias("runs")), repeated


def _repeated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (key, mark, gone) and (key, mark, runs): what goes of the texts in `rows` (key, mark, text), by whole spans and by windows of open ones."""
    spans = materialize(_spans(rows), "spans")
    often = materialize(_frequent_anchors(spans), "frequent-anchors")
    entries, used = _judged(spans.join(F.broadcast(often), "anchor", "left_anti")), [spans, often]
    if not often.isEmpty():
        found, tables = _judged_frequent(spans.join(F.broadcast(often), "anchor"))
        entries, used = entries.unionByName(found), used + tables
    lists = materialize(_by_text(entries), "lists")
    release(*used)
    asked = _small(lists.where("size(sent) > 0").select("key", "mark", "sent"), F.size("sent"))

    # Texts are dealt out for their open spans once; all that follows reads the spans.
    texts = rows.join(asked, ["key", "mark"]).select("key", "mark", "text", "sent")
    opened = materialize(texts.mapInArrow(_opened, "key long, mark long, first int, offset int, anchor long, single boolean, wide boolean, data binary"), "open-spans")
    # Only around an anchor with places enough can a group be too large.
    wide, large, used = opened.where("wide"), frozenset(), [opened]
    if not wide.isEmpty():
        sides = wide.mapInArrow(_sides, "side binary").groupBy("side").agg(F.count("*").alias("n")).where(F.col("n") > BATCH)
        large = frozenset(bytes(r.side) for r in sides.select("side").collect())
    strings = opened.mapInArrow(_cut(large), "side binary, single boolean, key long, mark long, first int, offset int, data binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _open_windows(strings.repartition(parts, "side").sortWithinPartitions("side", "key", "mark", "first"))
    if large:
        counted, windows = _counted_windows(wide, large)
        runs, used = runs.unionByName(counted), [*used, windows]
    runs = materialize(runs.groupBy("key", "mark").agg(F.flatten(F.collect_list("runs")).alias("runs")), "open-runs")
    release(*used)
    return lists.where("size(gone) > 0").select("key", "mark", "gone"), runs


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) for every row of `docs` (doc_id, text).

    A byte goes if a 200-byte string that covers it starts anywhere else in the collection, the
    same text included; copies of a text thus all lose it. `removed` lists the (start, end) bytes.
    A null text counts as empty. Rows that repeat a doc_id are documents of their own, also if
    their texts are the same. Texts may be as long as a column holds. Other columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"))
    # `mark` tells texts with one doc_id apart; a null doc_id joins under a number of its own.
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("mark", F.xxhash64("text"))
    with shuffles_end_with_their_job(docs.sparkSession):
        gone, runs = _repeated(rows)
        gone, runs = _small(gone, F.size("gone")), _small(runs, F.size("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, *found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = text.encode()
                gone = _merged([(r["start"], r["end"]) for runs_ in found for r in runs_ or ()])
                kept, at = sha256(), 0
                for r in gone:
                    kept.update(data[at : r["start"]])
                    at = r["end"]
                kept.update(data[at:])
                for column, value in zip(out, (len(data), sum(r["end"] - r["start"] for r in gone), len(gone), kept.hexdigest(), gone), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), _RUNS), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    whole = rows.join(gone, ["key", "mark"], "left").join(runs, ["key", "mark"], "left")
    return whole.select("doc_id", "text", "gone", "runs").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>")
