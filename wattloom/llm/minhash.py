"""Near-duplicate documents: MinHash banding, verified links, connected components.

Documents with equal shingle sets are one class, represented by the least doc_id.
Classes that share a band meet in its bucket, where each is compared with its most
central member only: first on signatures, then on whole sets. A linked class needs no further
comparison inside its component, so a group of n copies costs n comparisons.

Buckets that then still hold several components are searched whole, in blocks of bounded
size whose members are alike in length: signatures and sets of two blocks are compared as arrays in one task, and only
likely links leave it, to be verified. So no link between members of a bucket is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import hold, join_hot, materialize, release, slices, text_or_empty
from wattloom.llm.components import connected_components

#: 40 bands of 5 minima: a pair at the threshold 0.8 shares none with odds of about 1e-7.
BANDS, ROWS = 40, 5
#: A pair whose signatures agree less than this is not compared on sets. At a true
#: similarity of 0.8 that needs a deviation of over six standard errors.
SIGNATURE_FLOOR = 0.62
#: Shingles of the documents in one block of a bucket.
BLOCK_SHINGLES = 300_000
#: So many pairs (16 bytes each) may be broadcast.
SMALL_PAIRS = 200_000
#: A pivot is stored once for so many of its members.
SALT_ROWS = 256

_SEED = np.random.default_rng(20240607)
_A = (_SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
#: Words of the cache of hashes, about 150 bytes each.
_CACHE = 100_000


class _WordHash(dict):
    """word -> 64-bit hash, emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `size` words.

    Words are runs without ASCII white space, with A-Z lower-cased. Fewer words than
    `size` make one shingle; none make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([_WORDS[w] for w in words], np.uint64)
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of universal hashes a*x+b modulo 2^32 (a odd) over the set, folded to 16 bits.

    Two minima that differ agree after folding with odds of 2^-16; the bands, of 80 bits,
    and the counts of agreement hardly change.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):  # blocks that stay in the processor's cache
        np.minimum(low, (x[k : k + 256, None] * _A + _B).min(axis=0), out=low)
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig): the set's size, its 128-bit digest and its minima; null digest if empty."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("word hashes", _WORDS.clear)
        for batch in slices(batches):
            sizes, digests, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, size)
                sizes.append(len(found))
                digests.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found).astype("<u2").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, sig binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures agree enough."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
                good = (a == b).mean(axis=1) >= SIGNATURE_FLOOR
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], ["u", "v"])

    return _with_both(pairs, sigs, "sig").mapInArrow(agree, "u long, v long")


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """(u, v, a, b): `column` of u and of v.

    Up to SMALL_PAIRS pairs are broadcast, so that the wide side stays where it is; more
    are joined by shuffles. A v of many pairs is stored once for each SALT_ROWS of them.
    """
    pairs = materialize(pairs, "pairs")
    shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("shares"))
    salted = pairs.join(shares, "v").withColumn("share", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int")).select("u", "v", "share")
    if pairs.count() <= SMALL_PAIRS:
        shares, salted = F.broadcast(shares), F.broadcast(salted)
    hot = values.select(F.col("doc_id").alias("v"), F.col(column).alias("b")).join(shares, "v")
    hot = hot.select("v", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    own = values.select(F.col("doc_id").alias("u"), F.col(column).alias("a")).join(salted, "u")
    return own.join(hot, ["v", "share"]).select("u", "v", "a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union on whole sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            good = []
            for v, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if v != last:
                    last, pivot = v, shingle_set(b, size)
                own = shingle_set(a, size)
                both = len(np.intersect1d(own, pivot, assume_unique=True))
                good.append(100 * both >= percent * (len(own) + len(pivot) - both) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], ["u", "v"])

    return _with_both(pairs, texts, "text").mapInArrow(compare, "u long, v long")


def _selected(ids: DataFrame, texts: DataFrame) -> DataFrame:
    small = ids.count() <= SMALL_PAIRS
    return texts.join(F.broadcast(ids) if small else ids, "doc_id")


def _block_links(rows: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Likely links among one bucket's two blocks: rows of (band, i, j, block, doc_id, n, part, sig, low)."""
    band, i, j = rows[0][:3]
    sides = [[r for r in rows if r[3] == i], [r for r in rows if r[3] == j]]
    sig, n, part, doc = ([np.array([np.frombuffer(r[7], "<u2") for r in x]) for x in sides], *([np.array([r[k] for r in x]) for x in sides] for k in (5, 6, 4)))
    sets = [[np.frombuffer(r[8], "<u4") for r in x] for x in sides]
    if not len(sides[0]) or not len(sides[1]):
        return [], []
    lost = [size - np.array([len(x) for x in own]) for size, own in zip(n, sets, strict=True)]
    found: tuple[list[int], list[int]] = ([], [])
    step = max(1, 4_000_000 // (len(sides[1]) * BANDS * ROWS))
    for k in range(0, len(sides[0]), step):
        own = slice(k, k + step)
        small, large = np.minimum(n[0][own, None], n[1]), np.maximum(n[0][own, None], n[1])
        open_ = (part[0][own, None] != part[1]) & (100 * small >= percent * large)
        if i == j:
            open_ &= doc[0][own, None] < doc[1]
        if not open_.any():
            continue
        same = sig[0][own, None, :] == sig[1]
        open_ &= same.mean(axis=2) >= SIGNATURE_FLOOR
        # A pair is judged in the bucket of the first band that it shares.
        open_ &= same.reshape(*same.shape[:2], BANDS, ROWS).all(axis=3).argmax(axis=2) == band
        left, right = np.nonzero(open_)
        if not len(left):
            continue
        both = _intersections(sets[0][own], sets[1], left, right)
        # No more common shingles can have met by the cut to 32 bits than either set lost by it.
        both = both + np.minimum(lost[0][own][left], lost[1][right])
        good = 100 * both >= percent * (n[0][own][left] + n[1][right] - both)
        found[0].extend(doc[0][own][left[good]].tolist())
        found[1].extend(doc[1][right[good]].tolist())
    return found


def _intersections(a: list[np.ndarray], b: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of a[left] and b[right]: by merging for few pairs, else as a matrix product."""
    rows, columns = np.unique(left), np.unique(right)
    if 20 * len(left) < len(rows) * len(columns) or len(left) < 200:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(left, right, strict=True)])
    a, b = [a[x] for x in rows], [b[y] for y in columns]
    words = np.intersect1d(np.concatenate(a), np.concatenate(b))
    total = np.zeros((len(a), len(b)), np.float32)

    def marks(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(part)), np.float32)
        for k, x in enumerate(sets):
            at = np.searchsorted(part, x).clip(max=len(part) - 1)
            out[k, at[part[at] == x]] = 1
        return out

    for k in range(0, len(words), 4096):
        part = words[k : k + 4096]
        total += marks(a, part) @ marks(b, part).T
    return total[np.searchsorted(rows, left), np.searchsorted(columns, right)].astype(np.int64)


def _level(percent: int) -> F.Column:
    """The class of a set by its size: linked sets have equal or neighbouring levels.

    Linked sizes differ by a factor of 100 / percent at most; a level is a little wider, so
    that rounding moves no set across two.
    """
    return F.floor(F.log("n") / (math.log(100 / percent) + 0.001)).cast("int")


def _block_name(level: F.Column, block: F.Column) -> F.Column:
    return F.shiftleft(level.cast("long"), 32) + block


def _blocks_of(members: DataFrame, percent: int) -> DataFrame:
    """(bucket, size, whole, blocks): its rows, whether one block holds all of it, and else how many blocks each level has.

    Levels grow with the logarithm of the longest text, so the map is small.
    """
    levels = members.groupBy("bucket", _level(percent).alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("size"))
    share = F.struct("level", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    out = levels.groupBy("bucket").agg(F.sum("size").alias("size"), (F.sum("n") <= BLOCK_SHINGLES).alias("whole"), F.map_from_entries(F.collect_list(share)).alias("blocks"))
    return out.withColumn("blocks", F.when(F.col("whole"), F.create_map(F.lit(0), F.lit(1))).otherwise(F.col("blocks")))


def block_pairs(members: DataFrame, sigs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): likely links between components, from `members` (bucket, band, doc_id, n, part) of mixed buckets.

    A bucket is dealt into blocks of bounded size, by level and hash. Two blocks of one level or
    of neighbouring ones are compared as a whole in one place, by arrays; members further apart
    in size cannot be linked and never meet. Only what looks linked leaves the task.
    """
    ids = materialize(members.select("doc_id").distinct(), "open")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            low = [np.unique(shingle_set(x, size).astype(np.uint32)).astype("<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["doc_id", "low"])

    low = _selected(ids, texts).select("doc_id", "text").mapInArrow(cut, "doc_id long, low binary")
    sets = materialize(_selected(ids, sigs).select("doc_id", "sig").join(low, "doc_id"), "open-sets")
    blocks = materialize(_blocks_of(members, percent), "blocks")
    dealt = join_hot(members, blocks, ["bucket"], "size", members.count())
    level = F.when(F.col("whole"), 0).otherwise(_level(percent))
    dealt = dealt.withColumn("level", level).withColumn("block", _block_name(F.col("level"), F.pmod(F.xxhash64("doc_id"), F.try_element_at("blocks", "level"))))
    near = F.filter(F.array(*(F.col("level") + k for k in (-1, 0, 1))), lambda x: F.try_element_at("blocks", x).isNotNull())
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", x) - 1), lambda b: _block_name(x, b))))
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "n", "part")
    dealt = dealt.join(sets, "doc_id").select("bucket", "band", "i", "j", "block", "doc_id", "n", "part", "sig", "low")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, u, v = None, [], [], []

        def judge() -> None:
            for out, found in zip((u, v), _block_links(rows, percent), strict=True):
                out.extend(found)

        for batch in slices(batches):
            columns = [batch.column(k).to_pylist() for k in range(10)]
            for bucket, *row in zip(*columns, strict=True):
                if (bucket, *row[:3]) != key:
                    if len(rows) > 1:
                        judge()
                    key, rows = (bucket, *row[:3]), []
                rows.append(row)
        if len(rows) > 1:
            judge()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "band", "i", "j")
    pairs = grouped.mapInArrow(compare, "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle_size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their shingle
    sets; component_id is the least doc_id reachable, kept says that it is the document's
    own. Null, empty and blank texts have an empty set and no links. Rows that repeat a
    doc_id are one document with several texts: it has the links of each. A null doc_id
    stays by itself. Texts of any length are read whole. Other columns are ignored. Empty in, empty out.
    """
    sketch = materialize(sketches(docs, shingle_size), "sketch")
    # Documents without shingles or id have no class, so they never meet under a null key.
    classed = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    real, total = sketch.where(classed), sketch.count()
    classes = materialize(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
    members = join_hot(real, classes, ["digest"], "copies", total)
    members = materialize(members.select("doc_id", "n_shingles", "digest", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "classes")
    sigs = members.where("sig is not null").select("doc_id", "n_shingles", "sig")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    bands = sigs.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode(keys).alias("band", "bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    # Only what shares a bucket goes on, next to the number of classes there.
    first = materialize(bands.join(shared, "bucket"), "buckets")

    # The pivot of a bucket is its member with most company over all buckets: of edited copies,
    # the one nearest to all others.
    company = first.groupBy("doc_id").agg(F.sum("size").alias("company"))
    order = F.struct("company", -F.col("doc_id"))
    met = materialize(first.join(company, "doc_id").select("bucket", "band", "doc_id", "n", "company"), "company")
    release(first)
    central = met.groupBy("bucket").agg(F.max_by("doc_id", order).alias("v"))
    stars = met.join(central, "bucket").where("doc_id <> v").groupBy(F.col("doc_id").alias("u"), "v").agg(F.count("*").alias("bands"))
    # One candidate for each class first, the one it shares most bands with.
    best = stars.groupBy("u").agg(F.max_by("v", F.struct("bands", -F.col("v"))).alias("v"))
    links = materialize(verified(_agreeing(best, sigs), texts, shingle_size, percent), "links")
    parts = connected_components(links)

    # Buckets that still hold several components are searched whole.
    placed = met.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket")
    open_ = materialize(placed.join(mixed, "bucket").select("bucket", "band", "doc_id", "n", "part"), "mixed")
    found = materialize(verified(block_pairs(open_, sigs, texts, shingle_size, percent), texts, shingle_size, percent), "links")
    if not found.isEmpty():
        links = links.unionByName(found)
        parts = connected_components(links)

    # A document with several texts holds its classes together.
    several = members.where("rep is not null and doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    repeated = several.join(members.groupBy("doc_id").agg(F.countDistinct("digest").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("u")), "u", "left_semi")
    repeated = materialize(repeated, "repeated")
    if not repeated.isEmpty():
        parts = connected_components(links.unionByName(repeated))
    # A representative with its component; it may stand for a third of all documents.
    named = classes.groupBy("rep").agg(F.sum("copies").alias("copies")).join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "rep")), "named")
    release(met, placed, open_, repeated)
    single = sketch.where(~classed).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"))
    out = join_hot(members.select("doc_id", "n_shingles", "rep"), named, ["rep"], "copies", total).drop("rep").unionByName(single)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
