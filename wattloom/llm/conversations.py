"""The prefix trie of conversations, as the Cartesian tree over their sorted order.

Conversations are rebuilt, sorted, and for each the length of the prefix that it shares with
the one before (LCP) is taken. Nearest smaller LCPs, found by blocks of which only the minima
meet, give the interval of conversations that share a prefix; positions of equal LCP within
one interval are one node. A node of the Cartesian tree stands for all depths down from its
parent's; those are filled in, and what is summed over a subtree is a difference of running
sums over its interval.

A prefix is known by a running sum of 256 bits over digests of its turns and their places, so
a conversation with most of the turns is read by many tasks. For sorting, a conversation is
the list of places where it parts from others; the turns between are left out, which keeps the
order and the LCPs. That list has to fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import join_hot, materialize
from wattloom.llm.scans import nearest_smaller, running

#: A rebuilt conversation begins with turns of one in so many; how many turns, goes by a checksum modulo HEADS.
FAMILY, HEADS = 5, 9
#: Values of conv_id whose ids are put together before they meet at a node.
IDS = 4096
#: Depths that one row of the Cartesian tree is spread to at once.
DEPTHS = 4096

_LIMBS = [f"l{k}" for k in range(8)]
_NODE = ["a", "b"]
_START = sha256(b",".join([b"0"] * len(_LIMBS))).hexdigest()
#: The name of the empty prefix, as `_node` gives it.
_ROOT = [int(_START[15 * k : 15 * k + 15], 16) for k in range(len(_NODE))]


def _limbs(digest: F.Column) -> list[F.Column]:
    """256 bits as eight longs, so that sums of up to 2^31 of them do not overflow."""
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(_LIMBS)]


def _node(sums: list[F.Column], a: str, b: str) -> list[F.Column]:
    """The name of the prefix with these sums: 120 bits as two longs."""
    digest = F.sha2(F.concat_ws(",", *sums).cast("binary"), 256)
    return [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long").alias(c) for k, c in enumerate((a, b))]


def _root() -> list[F.Column]:
    return [F.lit(x).alias(c) for x, c in zip(_ROOT, _NODE, strict=True)]


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, bytes) of the turns of rebuilt conversations, and (conv_id, length) of all of them, as tables."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.lit(1).cast("long").alias("one"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")).cast("binary"), 256)
    ranked = running(turns, [F.col("turn").asc_nulls_first(), "role", "text"], ["one"], "conv_id")
    ranked = materialize(ranked.select("conv_id", F.col("one_run").alias("rn"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    own = ranked.groupBy("conv_id").agg(F.max("rn").alias("n"))
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    known = own.select("conv_id", "n", first.alias("first"), head.alias("head"))
    known = known.join(own.select(F.col("conv_id").alias("first"), F.col("n").alias("there")), "first", "left").withColumn("begun", F.least("head", F.coalesce("there", F.lit(0))))
    known = materialize(known.select("conv_id", "n", "head", "begun"), "heads")
    rest = join_hot(ranked, known, ["conv_id"], "n", ranked.count()).where("rn > head").select("conv_id", (F.col("begun") + F.col("rn") - F.col("head")).alias("d"), "digest", "bytes")
    shared = ranked.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("rn") < HEADS))
    shared = shared.select(F.explode(F.sequence("conv_id", F.col("conv_id") + FAMILY - 1)).alias("conv_id"), F.col("rn").alias("d"), "digest", "bytes")
    begin = shared.join(known.select("conv_id", "head"), "conv_id").where("d <= head").drop("head")
    lengths = known.select("conv_id", (F.col("begun") + F.greatest(F.lit(0), F.col("n") - F.col("head"))).alias("length"))
    return begin.unionByName(rest), materialize(lengths, "lengths")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, bytes, a, b, pa, pb): the names of the prefix that ends at each turn, and of the one before it."""
    placed = turns.select("conv_id", "d", "bytes", F.sha2(F.concat_ws(" ", "d", "digest").cast("binary"), 256).alias("term"))
    summed = running(placed.select("conv_id", "d", "bytes", *_limbs(F.col("term"))), ["d"], _LIMBS, "conv_id")
    run = [F.col(f"{c}_run") for c in _LIMBS]
    return materialize(summed.select("conv_id", "d", "bytes", *_node(run, "a", "b"), *_node([r - F.col(c) for r, c in zip(run, _LIMBS, strict=True)], "pa", "pb")), "prefixes")


def sorted_conversations(lines: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct conversations in order, (pos, conv_id, length, n_ends, ends_run, lcp), and the prefixes of one conversation of each.

    `lines` are prefixes, `ends` (conv_id, length, a, b) the whole ones.
    """
    classes = materialize(ends.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length"), F.count("*").alias("n_ends")).select("conv_id", "length", "n_ends"), "classes")
    own = materialize(join_hot(lines, classes.select("conv_id", "length"), ["conv_id"], "length", lines.count()), "own")
    total = own.count()
    met = materialize(own.groupBy(*_NODE).agg(F.count("*").alias("met"), F.count("*").alias("_w")), "met")
    here = join_hot(own, met, _NODE, "_w", total)
    above = met.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("met").alias("above"), "_w")
    here = materialize(here, "here")
    # Conversations part where fewer of them go on than came.
    parted = join_hot(here.where("d > 1"), above, ["pa", "pb"], "_w", total).where("met < above")
    steps = here.where("d = 1").select("conv_id", "d", *_NODE).unionByName(parted.select("conv_id", "d", *_NODE))
    keys = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", *_NODE))).alias("path"))
    strings = classes.join(keys, "conv_id", "left").withColumn("path", F.coalesce("path", F.array().cast("array<struct<d:long,a:long,b:long>>"))).withColumn("one", F.lit(1).cast("long"))
    ordered = materialize(running(strings, ["path"], ["one", "n_ends"]).withColumn("pos", F.col("one_run") - 1), "sorted")
    before = ordered.select((F.col("pos") + 1).alias("pos"), F.col("path").alias("earlier"))
    pairs = ordered.join(before, "pos", "left")
    differ = F.array_position(F.zip_with("path", "earlier", lambda x, y: x.eqNullSafe(y)), False).cast("int")
    lcp = F.when(F.col("pos") == 0, -1).otherwise(F.try_element_at("path", differ)["d"] - 1)
    return materialize(pairs.select("pos", "conv_id", "length", "n_ends", F.col("n_ends_run").alias("ends_run"), lcp.cast("long").alias("lcp")), "lcps"), own


def cartesian_tree(strings: DataFrame) -> DataFrame:
    """(lo, hi, depth, above): the intervals of sorted conversations with a common prefix of `depth` turns; `above` is the parent's depth, -1 at the top.

    A conversation that others go on from is a node of these; every other one is a node of its own.
    """
    lcps = strings.select("pos", F.col("lcp").alias("value"))
    inner = nearest_smaller(lcps)
    at = lambda c, name: lcps.select(F.col("pos").alias(c), F.col("value").alias(name))
    inner = inner.join(at("left", "_l"), "left").join(at("right", "_r"), "right", "left")
    inner = inner.select(F.col("left").alias("lo"), (F.col("right") - 1).alias("hi"), F.col("value").alias("depth"), F.greatest("_l", F.coalesce("_r", F.lit(-1))).alias("above"))
    after = lcps.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("_next"))
    leaves = strings.join(after, "pos", "left").select(F.col("pos").alias("lo"), F.col("pos").alias("hi"), F.col("length").alias("depth"), F.greatest("lcp", F.coalesce("_next", F.lit(-1))).alias("above"))
    return inner.unionByName(leaves.where("depth > above"))


def _digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the conv_ids that end at a node, in ascending order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, sha256()
        for batch in batches:
            done: list[tuple] = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (a, b) == own:
                    held.update(b"," + ids.encode())
                    continue
                if own is not None:
                    done.append((*own, held.hexdigest()))
                own, held = (a, b), sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["a", "b", "ends_sha256"])
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([own[1]]), pa.array([held.hexdigest()])], ["a", "b", "ends_sha256"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = ends.withColumn("bucket", F.floor(F.col("conv_id") / IDS)).groupBy(*_NODE, "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = some.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "bucket")
    return dealt.select(*_NODE, "ids").mapInArrow(digest, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix of the rebuilt `conversations` (conv_id, turn, role, text).

    Turns are in the order of `turn`, nulls first, equal ones by role and text; a repeated row is
    a turn of its own. Null roles and texts are empty, rows without a conv_id are left out.
    Conversation c begins with the first h turns of conversation c - c mod 5 (the remainder is
    never negative) and goes on with its own after its first h, h being crc32 of c in decimal, mod 9.
    A conversation left without turns ends at the root. Texts and conversations may be long: only
    digests of turns move. Other columns are ignored. Empty in, empty out.
    """
    turns, lengths = rebuilt(conversations)
    lines = prefixes(turns)
    last = lines.select("conv_id", "d", *_NODE).join(lengths.select("conv_id", F.col("length").alias("d")), ["conv_id", "d"]).withColumnRenamed("d", "length")
    ends = materialize(last.unionByName(lengths.where("length = 0").select("conv_id", "length", *_root())), "ends")
    strings, own = sorted_conversations(lines, ends)

    # Sums over an interval of conversations: those that end in it, and those that none goes on from.
    after = strings.select((F.col("pos") - 1).alias("pos"), F.col("lcp").alias("next"))
    leaf = strings.join(after, "pos", "left").withColumn("leaf", (F.coalesce("next", F.lit(-1)) < F.col("length")).cast("long"))
    counted = materialize(running(leaf, ["pos"], ["leaf"]), "counted")
    tree = cartesian_tree(strings)
    low = counted.select(F.col("pos").alias("lo"), (F.col("ends_run") - F.col("n_ends")).alias("_e"), (F.col("leaf_run") - F.col("leaf")).alias("_f"))
    high = counted.select(F.col("pos").alias("hi"), "ends_run", "leaf_run")
    tree = tree.join(low, "lo").join(high, "hi").select("lo", "hi", "depth", "above", (F.col("ends_run") - F.col("_e")).alias("n_convs"), (F.col("leaf_run") - F.col("_f")).alias("n_leaves"))

    # A row for each depth. The conversation at `lo` is the first to hold the prefix, so its turns name it.
    some = tree.withColumn("from", F.explode(F.sequence(F.col("above") + 1, F.col("depth"), F.lit(DEPTHS).cast("long"))))
    filled = some.withColumn("d", F.explode(F.sequence("from", F.least("depth", F.col("from") + DEPTHS - 1)))).select("lo", "hi", "d", "n_convs", "n_leaves")
    places = strings.select("conv_id", F.col("pos").alias("lo"), "lcp", F.col("length").alias("_w"))
    named = join_hot(own, places, ["conv_id"], "_w", own.count()).where("d > lcp").select("lo", "d", "bytes", *_NODE, "pa", "pb")
    nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    named = named.unionByName(strings.where("pos = 0").select(zero.alias("lo"), zero.alias("d"), zero.alias("bytes"), *_root(), nothing.alias("pa"), nothing.alias("pb")))
    nodes = filled.join(named, ["lo", "d"]).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))

    # In this order a subtree is one stretch: from its top to the end of its last conversation.
    nodes = materialize(running(nodes, ["lo", "d"], ["saved"]), "nodes")
    total = nodes.count()
    until = nodes.groupBy("lo").agg(F.max("saved_run").alias("until")).withColumnRenamed("lo", "hi")
    until = materialize(until.join(nodes.groupBy("hi").agg(F.count("*").alias("_w")), "hi"), "until")
    nodes = join_hot(nodes, until, ["hi"], "_w", total).withColumn("saved_tokens", F.col("until") - F.col("saved_run") + F.col("saved"))

    least = lines.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"))
    least = least.unionByName(lengths.agg(F.min("conv_id").alias("conv_id")).select(*_root(), "conv_id"))
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    known = nodes.join(least, _NODE).join(children, _NODE, "left").join(_digests(ends), _NODE, "left")
    known = materialize(known.select(*_NODE, "pa", "pb", "conv_id", F.col("d").alias("depth"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256")), "known")
    parents = known.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_w"))
    out = join_hot(known.where("pa is not null"), parents, ["pa", "pb"], "_w", total)
    out = out.unionByName(known.where("pa is null").withColumn("parent_conv_id", nothing))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
