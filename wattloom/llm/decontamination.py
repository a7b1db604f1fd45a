"""Benchmark passages in documents, also with other numbers, names or units.

Both sides become templates: numbers, names and units turn into typed placeholders, all
other tokens into bare lower-case words. Windows of templates are joined by hash. For
each document, item and alignment, the slots' values must map one to one; then the share
of the item's windows that were met decides. Windows with few words say little once their
slots are open, so they are joined as they stand only: all windows of lower-case tokens are
joined as well, in the same pass, and decide in the same way unless slots clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import give_back, hold, materialize, slices, text_or_empty

WINDOW = 8
#: An item counts as met if so much of its windows is, or so many in one alignment.
MIN_SHARE, MIN_RUN = 0.5, 6
#: Window hashes of the benchmark that may be sent to every task (8 bytes each), and windows with their slots.
SMALL_BENCHMARK, SMALL_WINDOWS = 2_000_000, 50_000

UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi mile miles meter meters metre metres inch inches ft feet foot yard yards l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent degree degrees mph kmh hz khz mhz ghz kb mb gb tb watt watts kw kwh volt volts".split())
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"\d").search

WORD, NUMBER, NAME, UNIT, EMPTY = range(5)


class _Vocabulary(dict):
    """token -> place in arrays of hashes, kinds and marks; emptied between texts when large."""

    def __init__(self):
        super().__init__()
        self._size(1 << 16)

    def _size(self, n: int) -> None:
        old = len(getattr(self, "value", ()))
        for name, kind in (("value", np.uint64), ("kind", np.uint8), ("title", bool), ("ends", bool)):
            array = np.zeros(n, kind)
            array[:old] = getattr(self, name, array[:0])
            setattr(self, name, array)

    def __missing__(self, chunk: str) -> int:
        core = _EDGES.sub("", chunk)
        low = core.lower()
        kind = EMPTY if not core else NUMBER if _NUMBER(core) else UNIT if low in UNITS else WORD
        self[chunk] = k = len(self)
        if k >= len(self.value):
            self._size(2 * k)
        self.value[k] = int.from_bytes(blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self.kind[k], self.ends[k] = kind, chunk[-1:] in ".!?:;"
        self.title[k] = kind == WORD and core[0].isupper() and (core[1:].islower() or len(core) == 1)
        return k

    def tokens(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """All tokens; of those with letters or digits: places, hashes and kinds. A capitalised word inside a sentence is a name."""
        if len(self) > 300_000:
            self.clear()
        chunks = text.split()
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        kind = self.kind[at]
        kind[1:][self.title[at[1:]] & ~self.ends[at[:-1]]] = NAME
        real = np.flatnonzero(kind != EMPTY)
        return chunks, real, self.value[at[real]], kind[real]


_SLOT = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def windows(base: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Hashes of the windows of each size: one round a token, shared by all sizes."""
    out, found = np.full(len(base), WINDOW, np.uint64), {}
    for k in range(max(sizes, default=0)):
        n = len(base) - k
        if n <= 0:
            break
        out = _mix(out[:n] * np.uint64(0x9E3779B97F4A7C15) + base[k:])
        if k + 1 in sizes:
            found[k + 1] = out
    return found


def _slots(tokens: list[str], places: np.ndarray, kinds: np.ndarray, at: int, size: int) -> list[str]:
    return [f"{kinds[k]}:{_EDGES.sub('', tokens[places[k]]).lower()}" for k in range(at, at + size) if kinds[k] != WORD]


_FOUND = "key long, size int, plain boolean, {id} long, {pos} int, {slots} array<string>"


def _template_windows(rows: DataFrame, sizes: list[int], shared: Broadcast | None, names: tuple[str, str, str], whole_short: bool) -> DataFrame:
    """Windows of `rows` (id, text); of documents, only those whose hash is among the `shared` sorted ones, if given."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontamination", None)
        wanted = shared.value if shared else None
        filter_bits = None
        if wanted is not None:
            filter_bits = np.zeros(1 << 22, bool)
            filter_bits[(wanted & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        vocabulary = _Vocabulary()
        for batch in slices(batches, 256):
            out: list[list] = [[], [], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts = [vocabulary.tokens(text)[1:] for text in texts]
            ends = np.cumsum([len(p[0]) for p in parts])
            starts = ends - [len(p[0]) for p in parts]
            values, kinds = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            words = np.concatenate([[0], np.cumsum(kinds == WORD)])
            own = np.minimum(ends - starts, WINDOW)
            asked = sorted(set(own[own > 0].tolist())) if whole_short else sizes
            split: dict[int, list[str]] = {}
            for plain, base in ((False, np.where(kinds == WORD, values, _SLOT[kinds])), (True, values)):
                for size, keys in windows(base, asked).items():
                    good = np.ones(len(keys), bool) if plain else words[size:] - words[:-size] >= (size + 1) // 2  # half of a window must be words
                    if filter_bits is not None:
                        good &= filter_bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)]
                    hits = np.flatnonzero(good)
                    if filter_bits is not None:
                        hits = hits[wanted[np.searchsorted(wanted, keys[hits]).clip(max=len(wanted) - 1)] == keys[hits]]
                    texts_of = np.searchsorted(ends, hits, "right")
                    inside = hits + size <= ends[texts_of]
                    if whole_short:
                        inside &= own[texts_of] == size
                    for at, k in zip(hits[inside].tolist(), texts_of[inside].tolist(), strict=True):
                        slots = []
                        if not plain:
                            if k not in split:
                                split[k] = texts[k].split()
                            slots = _slots(split[k], parts[k][0], parts[k][2], at - int(starts[k]), size)
                        for column, value in zip(out, (int(keys[at].astype(np.int64)), size, plain, ids[k], at - int(starts[k]), slots), strict=True):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], ["key", "size", "plain", *names])
        vocabulary.clear()
        give_back()  # the worker stays beside what needs the room next

    return rows.mapInArrow(find, _FOUND.format(id=names[0], pos=names[1], slots=names[2]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, windows): benchmark items found in documents, and how many of their windows.

    Where an item is met by its templates, these are counted, else its windows as they stand.
    Items of fewer than eight tokens are one window of all their tokens. Null and empty
    texts, and those without letters or digits, match nothing. Rows that repeat a doc_id or an
    item_id count as one document or item. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).where("item_id is not null")
    known = materialize(_template_windows(items, [], None, ("item_id", "ipos", "islots"), whole_short=True).distinct(), "benchmark-windows")
    sizes = [r.size for r in known.select("size").distinct().orderBy("size").collect()]  # eight at most
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where("doc_id is not null")
    wanted, n_known = None, known.count()
    if 0 < n_known <= SMALL_BENCHMARK:
        keys = known.select("key").distinct().toArrow()["key"].to_numpy().astype(np.uint64)
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(keys))
    small = n_known <= SMALL_WINDOWS
    met = _template_windows(source, sizes, wanted, ("doc_id", "dpos", "dslots"), whole_short=False)
    hits = met.join(F.broadcast(known) if small else known, ["key", "size", "plain"])
    # One alignment of a document with an item: slots must agree one to one.
    pairs = F.zip_with("islots", "dslots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    lined = hits.groupBy("doc_id", "item_id", "plain", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.size(F.collect_set("ipos")).alias("matched"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    one_to_one = (F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")) & (F.size(F.array_distinct(F.transform("pairs", lambda x: x["b"]))) == F.size("pairs"))
    total = known.groupBy("item_id", "plain").agg(F.countDistinct("ipos").alias("windows"))
    sums = lined.groupBy("doc_id", "item_id", "plain").agg(F.max(F.when(one_to_one, F.col("matched"))).alias("matched"), F.max(~one_to_one).alias("clash"))
    enough = F.expr(f"matched >= {MIN_SHARE} * windows or matched >= {MIN_RUN}")
    counts = F.struct("matched", "windows")
    both = sums.join(F.broadcast(total) if small else total, ["item_id", "plain"]).groupBy("doc_id", "item_id").agg(F.max("clash").alias("clash"), F.min(F.when(enough & ~F.col("plain"), counts)).alias("open"), F.min(F.when(enough & F.col("plain"), counts)).alias("plain"))
    # A part of an item beside slots that clash is no copy; the whole item is.
    by = F.coalesce("open", F.when(~F.col("clash") | (F.col("plain.matched") == F.col("plain.windows")), F.col("plain")))
    return both.select("doc_id", "item_id", by.alias("by")).where("by is not null").select("doc_id", "item_id", "by.matched", "by.windows")
