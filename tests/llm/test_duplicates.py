"""op2 and op6 against brute force."""

import glob
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import minhash, repeats
from wattloom.llm.common import CLEANUP_KEY
from wattloom.llm.components import connected_components
from wattloom.llm.minhash import near_duplicates
from wattloom.llm.repeats import LENGTH, remove_repeats


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent=80):
    own = [(d, sets_of(t, size)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), root(d), root(d) == d) for d, s in own)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "ÉTÉ été"), (7, "été été")]
    base = [rnd.choice(words) for _ in range(150)]
    shared = [rnd.choice(words) for _ in range(60)]
    for k in range(10, 130):  # copies with several edits each: linked to the base, not to each other
        own = list(base)
        for _ in range(rnd.randint(0, 12)):
            own[rnd.randrange(150)] = rnd.choice(words)
        rows.append((k, " ".join(own)))
    for k in range(200, 240):  # a passage that is most of the text
        rows.append((k, " ".join(shared + [rnd.choice(words) for _ in range(rnd.randint(5, 25))])))
    rows += [(k, " ".join(base).upper().replace("W", "w")) for k in range(300, 306)]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, corpus, size):
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in corpus], "doc_id long, text string, sig binary, rep int")
    got = sorted(tuple(r) for r in near_duplicates(docs, size).collect())
    assert got == brute(corpus, size)


def test_large_pair_sets_are_shuffled(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_PAIRS", 0)
    monkeypatch.setattr(minhash, "SALT_ROWS", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs, 2).collect()) == brute(corpus, 2)


def test_blocks_of_unlike_lengths(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 150)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(420)]
    lengths = (50, 62, 63, 64, 100, 101, 126, 127, 158, 159, 250, 312, 313, 314, 400)
    rows = [(10 * k + n, " ".join(base[:n])) for k, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(docs, 2).collect()) == brute(rows, 2)
    for percent in (50, 80, 95, 100):  # the largest set that a link allows is one level up at most
        small = spark.range(1, 50_000).select("id", F.col("id").alias("n")).withColumn("a", minhash._level(percent))
        large = small.withColumn("n", F.expr(f"id * 100 div {percent}")).withColumn("b", minhash._level(percent))
        assert large.where("abs(b - a) > 1").isEmpty()


def test_repeated_ids_nulls_and_no_rows(spark):
    long = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(1, long), (2, "a b c"), (2, long), (3, "a b c"), (None, long), (3, "a b c")], "doc_id long, text string")
    got = near_duplicates(docs, 2).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id} == {1}
    assert near_duplicates(docs.where("false"), 2).count() == 0


def test_components(spark):
    pairs = [(2, 1), (2, 3), (3, 9), (9, 9), (20, 21), (21, 20), *((k, k + 1) for k in range(100, 140)), *((500, k) for k in range(501, 600))]
    edges = spark.createDataFrame([*pairs, (None, 4)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = {n: 1 for n in (1, 2, 3, 9)} | {20: 20, 21: 20} | {k: 100 for k in range(100, 141)} | {k: 500 for k in range(500, 600)}
    assert got == want
    assert connected_components(edges.where("false")).count() == 0


def removed(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[s : s + LENGTH] for x in data for s in range(len(x) - LENGTH + 1))
    out = []
    for (doc_id, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - LENGTH + 1):
            if seen[x[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = True
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc_id, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("small", [0, 20_000])
def test_repeats(spark, monkeypatch, small):
    monkeypatch.setattr(repeats, "SMALL_ENTRIES", small)
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    passage, other = text(500), text(260)
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "y" * 260), (4, "ab" * 300), (5, text(400))]
    rows += [(10, text(50) + passage + text(80)), (11, passage[:199]), (12, passage[100:300]), (13, text(30) + passage[50:420] + text(20))]
    rows += [(20, other), (21, other), (21, other), (22, text(10) + other[:230]), (23, other[20:] + text(5)), (24, other + text(40) + other)]
    for k in range(30, 60):  # copies, each with an edit of its own
        at = rnd.randrange(20, 480)
        rows.append((k, passage[:at] + "Z" + passage[at + 1 :]))
    docs = spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, mark string")
    got = remove_repeats(docs)
    assert sorted(tuple(r)[:5] for r in got.collect()) == removed(rows)
    assert remove_repeats(docs.where("false")).count() == 0


def test_spans_are_told_apart_by_their_bytes(spark):
    """Swapped blocks in the order of Thue and Morse: a polynomial modulo a power of two can't tell such texts apart."""
    order = [0]
    while len(order) < 32:
        order += [1 - x for x in order]
    tail = "".join(random.Random(11).choices("abcdefghijklmnopqrstuvwxyz", k=240))
    rows = [(k, "".join(("jcfg", "kopc")[x ^ k] for x in order) + tail) for k in (0, 1)]
    got = sorted(tuple(r)[:5] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == removed(rows) and [r[2] for r in got] == [240, 240]
    # Around one anchor, wherever it lies: the least gram of both texts is made the same.
    data = [t.encode() for _, t in rows]
    for x in data:
        first, last, at, _ = repeats.spans_of(x)
        digests = repeats.span_digests(x, first, last, at)
        assert len(set(digests)) == len(digests)
    one, other = (repeats.span_digests(x, np.array([0]), np.array([168]), np.array([168]))[0] for x in data)
    assert one != other


def test_large_groups_are_not_sorted_in_one_task(spark, monkeypatch):
    whole = repeats.repeated_starts

    def bounded(group, strings, offset):
        assert len(strings) <= 16
        return whole(group, strings, offset)

    monkeypatch.setattr(repeats, "BATCH", 8)
    monkeypatch.setattr(repeats, "repeated_starts", bounded)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = text(320)
    rows = [(k, text(150) + passage[rnd.choice((0, 0, 7)) : rnd.choice((320, 320, 305))] + text(150)) for k in range(40)]
    rows += [(50, text(300)), (51, passage), (51, passage), (51, passage), (None, passage[10:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(-1 if r[0] is None else r[0], *r[1:5]) for r in remove_repeats(docs).collect()]
    assert sorted(got) == removed([(-1 if d is None else d, t) for d, t in rows])


def passages():
    """Copies of few kinds of a passage, edited ones, equal rows, and texts of their own."""
    rnd = random.Random(23)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, other = text(420), text(300)
    rows = [(k, passage) for k in range(14)] + [(20, text(60) + passage + text(40)), (21, passage[90:350]), (22, passage[:250] + "Z" + passage[251:])]
    rows += [(30 + k, text(150) + other[: rnd.choice((300, 260))] + text(30)) for k in range(12)]
    return rows + [(50, other), (50, other), (-1, None), (51, text(700)), (52, "x" * 350)]


@pytest.mark.parametrize("share, batch", [(0, 20_000), (0, 4), (1, 4), (10**9, 4)])
def test_rare_and_frequent_anchors_are_judged_alike(spark, monkeypatch, share, batch):
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    monkeypatch.setattr(repeats, "BATCH", batch)
    docs = spark.createDataFrame(passages(), "doc_id long, text string")
    rows = docs.select("text", F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark")).where("text is not null")
    spans = repeats._spans(rows)
    often = repeats._frequent_anchors(spans).count()
    # One text repeats a letter, so that one anchor has most of all spans.
    assert often == (share if share < 2 else spans.select("anchor").distinct().count())
    assert sorted(tuple(r)[:5] for r in remove_repeats(docs).collect()) == removed(passages())


def test_spans_of_rare_anchors_are_dealt_out_once(spark):
    spans = spark.createDataFrame([], "key long, mark long, place long, anchor long, span binary")
    plan = repeats._judged(spans)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_copies_of_few_kinds_make_no_large_group(spark, monkeypatch):
    """14 places but few kinds: the texts aren't read once more to count the strings of groups."""

    def sides(batches):
        raise AssertionError("texts are read for nothing")
        yield

    monkeypatch.setattr(repeats, "BATCH", 8)
    monkeypatch.setattr(repeats, "_sides", sides)
    rows = [r for r in passages() if not 30 <= r[0] <= 50]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:5] for r in got) == removed(rows)


@pytest.mark.parametrize("batch", [4, 20_000])
def test_texts_are_read_once_for_open_spans(spark, monkeypatch, batch):
    """Once for spans, once for the open ones and once for what is left, also where groups are too large to be sorted."""
    monkeypatch.setattr(repeats, "SMALL_ENTRIES", 0)
    monkeypatch.setattr(repeats, "BATCH", batch)
    rnd = random.Random(31)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage = text(230)
    rows = [(k, text(120) + passage + text(120)) for k in range(24)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in remove_repeats(docs).collect()) == removed(rows)
    assert read.value == 3 * len(rows)


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SMALL_ENTRIES", 0)
    monkeypatch.setattr(repeats, "BATCH", 4)
    folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    docs = spark.createDataFrame(passages(), "doc_id long, text string")
    before, setting = files(), spark.conf.get(CLEANUP_KEY)
    got = remove_repeats(docs)
    left = [files() - before]
    while left[-1] and len(left) < 50:  # they are deleted in the background
        time.sleep(0.2)
        left.append(files() - before)
    assert not left[-1] and spark.conf.get(CLEANUP_KEY) == setting
    assert sorted(tuple(r)[:5] for r in got.collect()) == removed(passages())


def test_no_link_is_lost_by_cutting_sets_to_32_bits():
    """At the threshold, with many shingles that meet when cut: the pair has to leave the block."""
    rng = np.random.default_rng(8)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    both[400:] = both[:400] ^ np.uint64(1 << 50)  # the low halves meet
    sets = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2)]
    assert 100 * 800 == 80 * len(np.union1d(*sets))
    sig = np.zeros(minhash.BANDS * minhash.ROWS, "<u2").tobytes()
    rows = [(0, 0, 0, 0, k, len(x), k, sig, np.unique(x.astype(np.uint32)).astype("<u4").tobytes()) for k, x in enumerate(sets)]
    assert minhash._block_links(rows, 80) == ([0], [1])
