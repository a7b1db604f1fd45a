"""Codes of vectors: the tree against all entries, the whole operator against plain loops."""

import hashlib

import numpy as np
import pytest

from wattloom.llm.vector_codes import BallTree, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract, one vector at a time, in Python's integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[k * size : (k + 1) * size] for k in range(parts)]
    books = [list(b) for b in zip(*(cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]), strict=True)]

    def nearest(book, p):
        return min((sum((a - b) ** 2 for a, b in zip(e, p, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v, _ in kept:
            for k, p in enumerate(cut(v)):
                groups[k].setdefault(nearest(books[k], p)[1], []).append(p)
        for k in range(parts):
            for e, own in groups[k].items():
                books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(books[k], p) for k, p in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, d, sum(x[2] for x in out if x[3] == label), digest) for i, c, d, label in out)


@pytest.mark.parametrize("low, high", [(-3, 4), (-2000, 2000), (-(2**28), 2**28)])
def test_tree_equals_comparing_all(low, high):
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (40, 1), (256, 2), (256, 16)):
        entries, x = rng.integers(low, high, (n, k)), rng.integers(low, high, (300, k))
        entries[n // 2 :] = entries[: n - n // 2]  # ties
        x[:50] = entries[rng.integers(0, n, 50)]
        index, away = BallTree(entries).nearest(x)
        for p, i, d in zip(x.tolist(), index.tolist(), away.tolist(), strict=True):
            assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(e, p, strict=True)), j) for j, e in enumerate(entries.tolist()))


def test_tree_leaves_branches_out():
    rng = np.random.default_rng(6)
    entries = np.concatenate([c + rng.integers(-20, 20, (16, 4)) for c in rng.integers(-5000, 5000, (16, 4))])
    tree = BallTree(entries)
    tree.nearest(entries[rng.integers(0, 256, 500)] + rng.integers(-5, 5, (500, 4)))
    assert tree.compared < tree.possible / 4


def test_codes_equal_plain_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], [None, 1, 2][i % 3]) for i in rng.permutation(400)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, 2), *rows[:3], (5, rows[9][1], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(7)
    got = vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(rows)
    few = rows[:9]
    assert sorted(map(tuple, vector_codes(spark.createDataFrame([(*r, "x", "y") for r in few], SCHEMA), parts=2, rounds=1).collect())) == plain(few, parts=2, rounds=1)


def test_odd_vectors(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
    empty = vector_codes(spark.createDataFrame([(1, [], 1, "", ""), (2, [], None, "", "")], SCHEMA)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in empty) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    # Another length than the first takes no part; five components are filled up to eight; no vec_id comes last.
    odd = [(1, [1.0] * 5, 1, "", ""), (2, [2.0] * 6, 1, "", ""), (None, [0.5] * 5, None, "", "")]
    got = sorted((r.vec_id or -1, r.code, r.error) for r in vector_codes(spark.createDataFrame(odd, SCHEMA)).collect())
    assert got == [(-1, "01010100", 0), (1, "00000000", 0)]
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([(1, [1e30], 1, "", "")], SCHEMA))
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([], SCHEMA), entries=300)
