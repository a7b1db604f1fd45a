"""The trie of rebuilt conversations, and the scans it stands on, against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wattloom.llm import scans
from wattloom.llm.conversations import prefix_trie
from wattloom.llm.scans import nearest_smaller, running, smaller_neighbours

SCHEMA = "conv_id long, turn long, role string, text string, lo string, d int"


def plain(rows):
    """The contract, node by node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members, ends = {(): set(own)}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], set()).add(c)
        ends.setdefault(whole, []).append(c)
    if not own:
        return []
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), len(leaves), saved, digest))
    return sorted(out, key=str)


def _got(spark, rows, parts=6):
    out = prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_nearest_smaller_in_a_block():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50):
        for _ in range(30):
            v = rng.integers(0, 6, n)
            before, after = smaller_neighbours(v)
            for k in range(n):
                assert before[k] == max((j for j in range(k) if v[j] < v[k]), default=-1)
                assert after[k] == min((j for j in range(k + 1, n) if v[j] < v[k]), default=n)


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "flat", "valley"])
def test_nearest_smaller_over_blocks(spark, shape):
    rng = np.random.default_rng(4)
    v = {"random": rng.integers(0, 9, 120), "rising": np.arange(60), "falling": np.arange(60)[::-1], "flat": np.full(70, 3), "valley": np.abs(np.arange(80) - 40)}[shape]
    v = np.concatenate([[-1], v])
    before, after = smaller_neighbours(v)
    want = sorted({(int(v[k]), int(before[k]), int(after[k])) for k in range(1, len(v))})
    df = spark.createDataFrame([(k, int(x)) for k, x in enumerate(v)], "pos long, value long").repartition(3)
    got = nearest_smaller(df, block=7)
    assert sorted(map(tuple, got.select("value", "left", "right").collect())) == want


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 1, 2, -3]), rng.randrange(40), rng.randrange(5)) for _ in range(900)] + [(1, 7, 1)] * 300
    df = spark.createDataFrame(rows, "k long, o long, x long").repartition(9)
    for within in ("k", None):
        got = running(df, ["o"], ["x"], within).collect()
        for k in {r.k for r in got} if within else [None]:
            own = [r for r in got if not within or r.k == k]
            assert sum(r.x for r in own) == max(r.x_run for r in own)
            for o in range(40):
                upto = sum(r.x for r in own if r.o <= o)
                assert max((r.x_run for r in own if r.o <= o), default=0) == upto
                there = sorted((r.x_run, r.x) for r in own if r.o == o)
                assert not there or there[0][0] >= upto - sum(x for _, x in there)
        assert len(got) == len(rows)


@pytest.mark.parametrize("seed, block", [(1, 65_536), (2, 5)])
def test_trie_equals_plain_loops(spark, monkeypatch, seed, block):
    monkeypatch.setattr(scans.nearest_smaller, "__defaults__", (block,))
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 90), 60):
        kind = rng.randrange(5)
        for t in range(rng.randrange(1, 14)):
            text = rng.choice(["hello", "é", "long text", None]) if kind < 3 else f"own {c if kind == 3 else c // 10} {t}"
            rows.append((c, t, rng.choice(["user", "assistant", None]) if kind == 0 else ["user", "assistant"][t % 2], text))
    rows += rows[:9] + [(1000, None, "user", "null first"), (1000, 0, "user", "x"), (1000, None, "a", "null first"), (None, 1, "user", "nowhere")]
    rng.shuffle(rows)
    assert _got(spark, rows) == plain(rows)


def test_long_conversation_and_copies(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in (6, 7, 8, 9, 10, 11) for t in range(200 + 10 * c)]
    rows += [(c, 0, "user", "same first") for c in range(100, 160)] + [(c, t, "user", "chain " * t) for c in range(200, 230) for t in range(c - 199)]
    assert _got(spark, rows) == plain(rows)


def test_few(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(None, 1, "user", "x")]) == []
    # Conversation 7 takes all its turns from conversation 5, which is not there.
    h = zlib.crc32(b"7") % 9
    for n in (1, h, h + 1):
        rows = [(7, t, "user", f"t{t}") for t in range(n)]
        assert _got(spark, rows) == plain(rows)
