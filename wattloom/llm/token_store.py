"""Token-ID output as directly addressable codes (DAC).

Ids are cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of
every id, level k the k-th chunk of those ids that have one. A bitmap at each level
says which ids go on, and a rank directory over it turns a position at one level into
the position at the next. So any id is read by a few array accesses, without decoding
its neighbours.

The store is a Parquet table of segments in the shared folder. A segment holds whole
documents in ascending `doc_id` and is readable by itself, so a lost task only rewrites
its own segments. Segments are stored as they are, without a codec, so that nothing stands
between a position and its bytes; `tokens_at` reads single tokens of the whole store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattloom.llm.common import materialize, shared_path, slices, text_or_empty
from wattloom.llm.tokens import encoder

MAGIC = b"DAC1"
#: One rank entry for so many bits.
RANK_BITS = 512
#: A segment is closed once it holds so many ids.
SEGMENT_TOKENS = 1 << 18

STORE_SCHEMA = "part int, seg int, before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """The file form of `ids` (unsigned, up to 32 bits)."""
    values, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        chunk, rest = (values & 0xFF).astype(np.uint8), values >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        per_block = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if len(more) else np.zeros(0, "<u4")
        levels.append(struct.pack("<QII", len(chunk), len(bits), len(ranks)) + chunk.tobytes() + bits + ranks.tobytes())
        if not more.any():
            break
        values = rest[more]
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class DacReader:
    """Random access to the ids of one segment."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self._levels, at = [], 5
        for _ in range(payload[4]):
            n, n_bits, n_ranks = struct.unpack_from("<QII", payload, at)
            at += 16
            chunk = np.frombuffer(payload, np.uint8, n, at)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(payload, "<u4", n_ranks, at + n + n_bits)
            at += n + n_bits + 4 * n_ranks
            self._levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self._levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            first = block * RANK_BITS // 8
            ones = int(np.bitwise_count(bits[first : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + ones
        return value

    def all(self) -> np.ndarray:
        """Every id of the segment, for sequential readers."""
        out = self._levels[0][0].astype(np.uint32)
        where = np.arange(len(out))
        for k, (_, bits, _) in enumerate(self._levels[:-1]):
            where = where[np.unpackbits(bits, count=len(where), bitorder="little").astype(bool)]
            out[where] |= self._levels[k + 1][0].astype(np.uint32) << np.uint32(8 * (k + 1))
        return out


def write_token_store(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> str:
    """Encode `docs` (doc_id, text) and write the store; returns its path.

    Each document ends with `end_id`. A null text counts as empty, so it is one end id.
    A null `doc_id` sorts first. Rows that repeat a `doc_id` all stay, in the order of
    their texts. Other columns are ignored. An empty table gives an empty store.
    """
    path = path or shared_path(docs.sparkSession, "token-store")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        held, ids, count, seg, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = dac_encode(np.frombuffer(b"".join(held), dtype="<u4"))
            row = {"part": part, "seg": seg, "before": before, "n_tokens": count, "doc_ids": [i for i, _ in ids], "doc_tokens": [n for _, n in ids], "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(encode.ids(text) + end)
                n = len(held[-1]) // 4
                ids.append((doc_id, n))
                count += n
                if count >= SEGMENT_TOKENS:
                    yield flush()
                    held, ids, count, seg, before = [], [], 0, seg + 1, before + count
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Ranges of doc_id keep the order across partitions; equal ids share a partition.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, STORE_SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return path


#: Partitions of a store whose sizes may be sent to every task (12 bytes each).
SMALL_PARTS = 1_000_000


def part_bases(store: DataFrame) -> DataFrame:
    """(part, base): ids that come before each partition of the writer.

    One row per partition meets in one task; within a partition the writer has kept the sum.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids (little-endian uint32 bytes), read from the store."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, lengths, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = DacReader(payload).all()
                ends = np.cumsum(lengths)
                raw = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    # The sizes are read from narrow columns; the payload goes straight from file to task.
    bases = materialize(part_bases(store), "bases")
    whole = store.join(F.broadcast(bases) if bases.count() <= SMALL_PARTS else bases, "part")
    return whole.select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "doc_tokens", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(store: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, id) for the `positions` (position long) of the store's one long sequence of ids.

    Segments and positions meet by the stretch of SEGMENT_TOKENS that they lie in, so no range
    is compared with all others; each id is then read by a few array accesses. Repeated
    positions give one row, those outside the store and null ones none.
    """
    bases = materialize(part_bases(store), "bases")
    start = F.col("base") + F.col("before")
    segments = store.select("part", "seg", "before", "n_tokens").join(F.broadcast(bases) if bases.count() <= SMALL_PARTS else bases, "part")
    segments = segments.select("part", "seg", start.alias("start"), (start + F.col("n_tokens")).alias("end"))
    stretch = F.explode(F.sequence(F.floor(F.col("start") / SEGMENT_TOKENS), F.floor((F.col("end") - 1) / SEGMENT_TOKENS)))
    asked = positions.where("position >= 0").select("position").distinct().withColumn("stretch", F.floor(F.col("position") / SEGMENT_TOKENS))
    found = asked.join(segments.withColumn("stretch", stretch), "stretch").where("position >= start and position < end")
    # Distinct positions: a segment is asked for as many as it has, at most.
    lists = found.groupBy("part", "seg", "start").agg(F.collect_list(F.col("position") - F.col("start")).alias("places"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, places, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                segment = DacReader(payload)
                yield pa.RecordBatch.from_arrays([pa.array([first + p for p in places], pa.int64()), pa.array([segment[p] for p in places], pa.int64())], ["position", "id"])

    return store.select("part", "seg", "payload").join(lists, ["part", "seg"]).select("start", "places", "payload").mapInArrow(read, "position long, id long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the store, read it back and return (doc_id, start, n_tokens, ids_crc32) per document."""
    store = docs.sparkSession.read.schema(STORE_SCHEMA).parquet(write_token_store(docs, tokenizer, end_id))
    return read_documents(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
