"""Word sequences that an earlier document holds: automata and the operator against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wattloom.llm import substrings
from wattloom.llm.substrings import LENGTH, SuffixAutomaton, held_earlier, remove_held_earlier


def plain(rows):
    """The contract, window by window."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - LENGTH + 1):
            w = tuple(words[i : i + LENGTH])
            if doc is not None:
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - LENGTH + 1):
            if doc is not None and first[tuple(words[i : i + LENGTH])] < doc:
                gone.update(range(i, i + LENGTH))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_matching_statistics():
    rng = random.Random(3)
    for size in (2, 3, 8):
        automaton, added = SuffixAutomaton(), []
        for _ in range(12):
            s = [rng.randrange(size) for _ in range(rng.randrange(30))]
            parts = {tuple(t[a:b]) for t in added for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
            want = [max(k for k in range(e + 2) if not k or tuple(s[e + 1 - k : e + 1]) in parts) for e in range(len(s))]
            assert automaton.matching(s) == want
            automaton.add(s)
            added.append(s)
        assert len(automaton.length) <= 2 * sum(map(len, added)) + 1


def test_only_smaller_keys_count():
    words = [b"%d" % k for k in range(20)]
    assert held_earlier([(1, words), (1, words[2:18]), (2, words[3:])]) == [[], [], [(0, 17)]]


def _rows(seed, n=150):
    """Prose over a small vocabulary with copies, edited copies, shared passages and a common beginning."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "über", " x"]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages, opening, texts = [prose(rng.randrange(13, 60)) for _ in range(8)], prose(9), []
    for k in range(n):
        words = prose(rng.randrange(0, 90))
        kind = rng.randrange(6)
        if kind == 0 and texts:
            words = list(rng.choice(texts))
        elif kind == 1 and texts:
            words = list(rng.choice(texts))
            for _ in range(3):
                words[rng.randrange(len(words)) :][:1] = ["edited"]
            if words:
                words[rng.randrange(len(words))] = "edited"
        elif kind == 2:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        elif kind == 3:
            words = opening + prose(rng.randrange(20, 40)) + opening
        elif kind == 4:
            words = words[:20] * 3
        texts.append(words or ["alone"])
    seps = [" ", "\n", "\t ", "  ", "\x0b", "\r\n"]
    rows = [(k, "".join(w + rng.choice(seps) for w in t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def _got(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, key string, mark int").repartition(5)
    out = remove_held_earlier(df)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
    found = out.collect()
    assert all(r.n_removed == sum(x.end - x.start for x in r.removed) for r in found)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=str)


@pytest.mark.parametrize("shard", [4096, 3])
def test_operator_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    rows = _rows(shard)
    twice = rows[:7]  # repeated rows, and another text under a doc_id
    rows = rows + twice + [(3, rows[20][1]), (None, rows[5][1]), (None, None), (500, ""), (501, None), (502, " \n ")]
    assert _got(spark, rows) == plain(rows)


def test_long_text_and_word(spark):
    words = [f"v{k % 977}x{k % 89}" for k in range(60_000)]
    long_word = "z" * 300_000
    rows = [(1, " ".join(words)), (2, " ".join(words[:30_000]) + " " + long_word), (3, " ".join([long_word, *words[5:40], long_word])), (4, " ".join(["same"] * 5000)), (5, " ".join(["same"] * 40))]
    assert _got(spark, rows) == plain(rows)


def test_empty(spark):
    assert _got(spark, [(1, "a b c")]) == plain([(1, "a b c")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_held_earlier(df).collect() == []


def test_rows_of_two_texts():
    batch = lambda anchors, keys: pa.RecordBatch.from_arrays([pa.array(keys), pa.array([0] * len(keys)), pa.array(range(len(keys))), pa.array(anchors)], ["key", "mark", "place", "anchor"])
    out = list(substrings._of_two_texts(iter([batch([1, 1, 2, 2], [5, 5, 1, 2]), batch([2, 3, 4, 4], [9, 1, 1, 1]), batch([4, 5], [1, 1])])))
    got = [tuple(r.values()) for b in out for r in b.select(["anchor", "key", "edge"]).to_pylist()]
    assert got == [(1, 5, True), (1, 5, True), (2, 1, False), (2, 2, False), (2, 9, False), (5, 1, True)]


def test_very_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 7)
    text = " ".join(f"w{k % 31}" for k in range(200))
    windows = []
    for index, start, hashes in substrings._hashed([text, "short", text]):
        own, first, last, at, _ = substrings.spans_of(np.concatenate(hashes), np.array([len(h) for h in hashes]))
        base = np.array(start)[own]
        for t, a, b in zip(np.array(index)[own].tolist(), (first + base).tolist(), (last + base).tolist(), strict=True):
            windows += [(t, x) for x in range(a, b + 1)]
        place = substrings.pack(first + base, last + base, at + base)
        assert [substrings.unpack(int(p)) for p in place] == list(zip(first + base, last + base, at + base, strict=True))
    assert sorted(windows) == [(t, x) for t in (0, 2) for x in range(188)]
