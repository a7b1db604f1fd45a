"""Removal of word sequences that an earlier document holds: matching statistics on suffix automata.

Every window of 13 words has an anchor: the 5 words in it with the least hash. Equal windows
have equal anchors at equal places, so a document needs to be streamed only past reference
text around an anchor that it shares. The windows of one anchor in a text form a span of 13
to 21 words.

1. Spans whose anchor occurs in no other document are dropped: nothing of them is repeated.
2. Spans that are equal (by a 128-bit digest of their words) are one kind; the document with
   the least doc_id holds the reference, and all later ones lose the span.
3. What is left is the reference text of anchors that have several kinds, such as the ends of
   shared passages. It is dealt by anchor into shards of bounded size. A shard's suffix automaton
   is grown in the order of doc_id: each string is first streamed through the automaton of all
   smaller doc_ids, and where its matching statistic reaches 13 words, the window goes.

An anchor with more kinds than a shard holds gets no automaton: its windows go through a
shuffle with the least doc_id of each, partial minima first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import join_hot, materialize, release, slices, text_or_empty

LENGTH, GRAM = 13, 5
_GRAMS = LENGTH - GRAM + 1  # in a window
#: Strings of a shard; with the last anchor's strings, twice so many at most.
SHARD = 4096
#: Words hashed together, and words of a very long text in one piece.
GROUP, PIECE = 200_000, 500_000
#: Rows of one document around one anchor that wait for a second document.
PENDING = 1_000_000

_PLACE_BITS, _OFFSET_BITS = 40, 8
_ORDER_BITS = np.uint64(21)  # of a place within a group
_WEIGHTS = np.random.default_rng(29).integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split knows ASCII white space only


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def spans_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts of `sizes` words, whose hashes follow each other: text, first and last window, anchor's place, anchor's hash.

    Places count from the start of the text.
    """
    n = len(hashes) - GRAM + 1
    if n < _GRAMS:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = hashes[:n] * _WEIGHTS[0]
    for k in range(1, GRAM):
        grams += hashes[k : k + n] * _WEIGHTS[k]
    grams = _mix(grams)
    # The least gram of each window, leftmost among equals: minima of blocks from both sides.
    keys = (grams >> _ORDER_BITS << _ORDER_BITS) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // _GRAMS) * _GRAMS, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, _GRAMS)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(hashes) - LENGTH + 1
    anchor = (np.minimum(left[:windows], right[_GRAMS - 1 : _GRAMS - 1 + windows]) & np.uint64((1 << int(_ORDER_BITS)) - 1)).astype(np.int64)
    # Windows that would cross into the next text are none.
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    real = np.flatnonzero(np.arange(windows) + LENGTH <= ends[text])
    if not len(real):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    own = anchor[real]
    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    stops = np.append(starts[1:], len(real)) - 1
    first, last, at = real[starts], real[stops], own[starts]
    base = (ends - sizes)[text[first]]
    return text[first], first - base, last - base, at - base, grams[at].astype(np.int64)


def pack(first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    return first | (at - first) << _PLACE_BITS | (last - first) << (_PLACE_BITS + _OFFSET_BITS)


def unpack(place: int) -> tuple[int, int, int]:
    """First window, last window, anchor."""
    first = place & ((1 << _PLACE_BITS) - 1)
    return first, first + (place >> (_PLACE_BITS + _OFFSET_BITS)), first + (place >> _PLACE_BITS & ((1 << _OFFSET_BITS) - 1))


def _hashed(texts: list[str]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Groups of (text's index, place of its first word) with the pieces' sizes and all words' hashes."""
    index, start, hashes, held = [], [], [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        for at in range(0, max(1, len(words) - LENGTH + 1), PIECE):
            piece = words[at : at + PIECE + LENGTH - 1]
            if len(piece) >= LENGTH:
                index.append(k)
                start.append(at)
                hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, piece), np.uint64, len(piece)))
                held += len(piece)
            if held >= GROUP:
                yield index, start, hashes
                index, start, hashes, held = [], [], [], 0
    if index:
        yield index, start, hashes


def _spans(rows: DataFrame) -> DataFrame:
    """One row for each span of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for index, start, hashes in _hashed(batch.column(2).to_pylist()):
                text, first, last, at, anchor = spans_of(np.concatenate(hashes), np.array([len(h) for h in hashes]))
                base = np.array(start)[text]
                owner = pa.array(np.array(index)[text])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(pack(first + base, last + base, at + base)), pa.array(anchor)], ["key", "mark", "place", "anchor"])

    return rows.select("key", "mark", "text").mapInArrow(find, "key long, mark long, place long, anchor long")


def _of_two_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor and key, those of anchors with two keys; `edge` marks an anchor that may have a second key in another partition."""
    names = ["key", "mark", "place", "anchor"]
    held = [np.zeros(0, np.int64)] * 4  # the rows of the anchor read last, as long as they are of one key
    opening, known = None, None  # the partition's first anchor; the last anchor, if two of its keys were seen

    def packed(columns: list[np.ndarray], edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(edge)], [*names, "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        key, anchor = rows[0], rows[3]
        opening = anchor[0] if opening is None else opening
        starts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        stops = np.append(starts[1:], len(anchor))
        shared = (key[starts] != key[stops - 1]) | (anchor[starts] == known if known is not None else False)
        edge = ~shared & (anchor[starts] == opening)
        waits = not shared[-1] and stops[-1] - starts[-1] < PENDING
        if not shared[-1] and not waits:
            edge[-1] = True
        known = anchor[-1] if shared[-1] else None
        out = shared | edge
        if waits:
            out[-1] = False
        take = np.repeat(out, stops - starts)
        held = [r[starts[-1] :] if waits else r[:0] for r in rows]
        yield packed([r[take] for r in rows], np.repeat(edge, stops - starts)[take])
    yield packed(held, np.ones(len(held[0]), bool))


def _near(spans: DataFrame) -> DataFrame:
    """The spans whose anchor occurs in texts of two keys or more.

    Ranges of (anchor, key) split an anchor that many texts hold; what lies at the ends of a
    partition is put together afterwards, two anchors for each partition.
    """
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spans.repartitionByRange(parts, "anchor", "key", "place").sortWithinPartitions("anchor", "key")
    found = materialize(ranged.mapInArrow(_of_two_texts, "key long, mark long, place long, anchor long, edge boolean"), "near")
    edges = found.where("edge").select("anchor").distinct()
    shared = materialize(found.join(F.broadcast(edges), "anchor").groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("anchor"), "edges")
    return found.where("not edge").unionByName(found.where("edge").join(F.broadcast(shared), "anchor", "left_semi")).drop("edge")


def _coded(texts: DataFrame) -> DataFrame:
    """(key, mark, place, anchor, digest) of the spans that (key, mark, text, spans) names."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owner, places, anchors, digests = [], [], [], []
            for k, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = words_of(text)
                for s in own:
                    first, last, at = unpack(s["place"])
                    owner.append(k)
                    places.append(s["place"])
                    anchors.append(s["anchor"])
                    digests.append(blake2b(b"%d " % (at - first) + b" ".join(words[first : last + LENGTH]), digest_size=16).digest())
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(places, pa.int64()), pa.array(anchors, pa.int64()), pa.array(digests, pa.binary())], ["key", "mark", "place", "anchor", "digest"])

    return texts.select("key", "mark", "text", "spans").mapInArrow(digest, "key long, mark long, place long, anchor long, digest binary")


class SuffixAutomaton:
    """Of several sequences: every path from the start spells a part of one of them, and every part has its path."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, ahead: dict) -> int:
        self.next.append(ahead)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _fitting(self, p: int, symbol: object) -> int:
        """Where `symbol` leads from p, split off if longer strings lead there too."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            if symbol in self.next[last]:
                last = self._fitting(last, symbol)
                continue
            fresh = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = fresh
                p = self.link[p]
            if p >= 0:
                self.link[fresh] = self._fitting(p, symbol)
            last = fresh

    def matching(self, sequence) -> list[int]:
        """For each place, the length of the longest part ending there that some added sequence holds."""
        ahead, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in ahead[state]:
                state = link[state]
                size = length[state]
            if symbol in ahead[state]:
                state = ahead[state][symbol]
                size += 1
            out.append(size)
        return out


def _runs(hits: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of words that windows ending at `hits` (ascending) cover."""
    out: list[list[int]] = []
    for e in hits:
        if out and e + 1 - LENGTH <= out[-1][1]:
            out[-1][1] = e + 1
        else:
            out.append([e + 1 - LENGTH, e + 1])
    return [(a, b) for a, b in out]


def held_earlier(strings: list[tuple[int, list[bytes]]]) -> list[list[tuple[int, int]]]:
    """For each (key, words), the runs covered by windows that a string of a smaller key holds. Keys ascend."""
    automaton, out, waiting = SuffixAutomaton(), [], []
    for k, (key, words) in enumerate(strings):
        if waiting and waiting[-1][0] != key:
            for _, earlier in waiting:
                automaton.add(earlier)
            waiting = []
        waiting.append(strings[k])
        out.append(_runs([e for e, size in enumerate(automaton.matching(words)) if size >= LENGTH]))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS_SQL = "array<struct<start:long,end:long>>"


def _merged(pieces: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(pieces):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def _whole(entries: DataFrame) -> DataFrame:
    """(key, mark, gone): the runs of a text's spans that an earlier text holds whole."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            gone = [_merged([(first, last + LENGTH) for first, last, _ in map(unpack, own)]) for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, _RUNS)], ["key", "mark", "gone"])

    lists = entries.where("whole").groupBy("key", "mark").agg(F.collect_set("place").alias("places"))
    return lists.mapInArrow(merge, f"key long, mark long, gone {_RUNS_SQL}")


def _strings(texts: DataFrame) -> DataFrame:
    """(anchor, wide, key, mark, first, data): the open spans that (key, mark, text, spans) names, as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, (text, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = words_of(text)
                for s in own:
                    first, last, _ = unpack(s["place"])
                    for column, value in zip(out, (k, s["anchor"], s["wide"], first, b" ".join(words[first : last + LENGTH])), strict=True):
                        column.append(value)
            owner = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["anchor", "wide", "key", "mark", "first", "data"])

    return texts.select("key", "mark", "text", "spans").mapInArrow(cut, "anchor long, wide boolean, key long, mark long, first long, data binary")


def _through_automata(strings: DataFrame) -> DataFrame:
    """(key, mark, run): runs of the strings (sorted by anchor) that smaller keys hold, a shard of anchors at a time."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def judge() -> pa.RecordBatch:
            held.sort(key=lambda r: r[1])
            out: tuple[list, list, list, list] = ([], [], [], [])
            for (_, key, mark, first, _), runs in zip(held, held_earlier([(r[1], r[4].split(b" ")) for r in held]), strict=True):
                for a, b in runs:
                    for column, value in zip(out, (key, mark, first + a, first + b), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "mark", "start", "end"])

        for batch in slices(batches, 4096):
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if len(held) >= SHARD and row[0] != held[-1][0]:
                    yield judge()
                    held.clear()
                held.append(row)
        yield judge()

    return strings.select("anchor", "key", "mark", "first", "data").mapInArrow(stream, "key long, mark long, start long, end long")


def _through_a_shuffle(strings: DataFrame) -> DataFrame:
    """(key, mark, start, end): windows of the strings that a smaller key holds, by the least key of each window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            owner, starts, digests = [], [], []
            for k, (first, data) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = data.split(b" ")
                for x in range(len(words) - LENGTH + 1):
                    owner.append(k)
                    starts.append(first + x)
                    digests.append(blake2b(b" ".join(words[x : x + LENGTH]), digest_size=16).digest())
            owner = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(starts, pa.int64())], ["window", "key", "mark", "start"])

    found = materialize(strings.select("key", "mark", "first", "data").mapInArrow(windows, "window binary, key long, mark long, start long"), "windows")
    least = materialize(found.groupBy("window").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"), "least")
    hits = join_hot(found, least, ["window"], "n", found.count()).where("key > low")
    return hits.select("key", "mark", "start", (F.col("start") + LENGTH).alias("end"))


def remove_held_earlier(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) for every row of `docs` (doc_id, text).

    Words are runs without ASCII white space. A word goes if it lies in 13 words in a row that
    also start in a document with a smaller doc_id; what is left are the earliest copies. `removed`
    lists the (start, end) words, kept_sha256 is of the kept words with one space between them.
    A null text has no words. Rows without a doc_id lose nothing and take nothing; rows that
    repeat a doc_id are judged each by the smaller doc_ids only, and the same rows get the same
    result. Texts and words may be as long as a column holds. Other columns are ignored. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # `mark` tells texts with one doc_id apart.
    rows = rows.withColumn("key", F.col("doc_id")).withColumn("mark", F.xxhash64("text"))
    with_id = rows.where("key is not null")
    spans = materialize(_spans(with_id), "spans")
    near = _near(spans)
    lists = materialize(near.groupBy("key", "mark").agg(F.collect_set(F.struct("place", "anchor")).alias("spans")), "near-lists")
    release(spans)
    coded = materialize(_coded(with_id.join(lists, ["key", "mark"])), "coded")
    kinds = materialize(coded.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "kinds")
    anchors = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("_w", F.col("kinds")), "anchors")
    open_ = join_hot(kinds, anchors, ["anchor"], "_w", kinds.count()).select("anchor", "digest", "n", "low", (F.col("kinds") > SHARD).alias("wide"))
    repeated = kinds.where("low < high").join(anchors.select("anchor"), "anchor", "left_anti").select("anchor", "digest", "n", "low", F.lit(None).cast("boolean").alias("wide"))
    known = materialize(open_.unionByName(repeated), "known")
    entries = join_hot(coded, known, ["anchor", "digest"], "n", coded.count()).withColumn("whole", F.col("key") > F.col("low")).where("whole or wide is not null")
    entries = materialize(entries.select("key", "mark", "place", "anchor", "whole", "wide"), "entries")
    gone = _whole(entries)
    release(coded, kinds, anchors, known, lists)

    asked = entries.where("not whole").groupBy("key", "mark").agg(F.collect_set(F.struct("place", "anchor", "wide")).alias("spans"))
    strings = materialize(_strings(with_id.join(asked, ["key", "mark"])), "strings")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = _through_automata(strings.where("not wide").repartition(parts, "anchor").sortWithinPartitions("anchor"))
    wide = strings.where("wide")
    if not wide.isEmpty():
        runs = runs.unionByName(_through_a_shuffle(wide))
    runs = materialize(runs.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "end")).alias("runs")), "runs")
    release(strings)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [])
            for text, *found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words, kept, at = words_of(text), [], 0
                removed = _merged([(r["start"], r["end"]) for pieces in found for r in pieces or ()])
                for r in removed:
                    kept += words[at : r["start"]]
                    at = r["end"]
                kept += words[at:]
                for column, value in zip(out, (len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest(), removed), strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), _RUNS), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    removals = materialize(gone.join(runs, ["key", "mark"], "full"), "removals")
    whole = rows.join(removals, ["key", "mark"], "left").select("doc_id", "text", "gone", "runs")
    return whole.mapInArrow(finish, f"doc_id long, n_words long, n_removed long, kept_sha256 string, removed {_RUNS_SQL}")
