"""op1 and op3 against the tokenizers library; the store's random access; windows without padding."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wattloom.llm.packing import Piece, pack_documents, pack_pool, split_by_powers, step_groups
from wattloom.llm import token_store
from wattloom.llm.token_store import STORE_SCHEMA, DacReader, dac_encode, token_digests, tokens_at, write_token_store
from wattloom.llm.tokens import encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [" ", "\n", "'s", "a", "B", "é", "1", "!", "***", "  ", "\t", " ", "<|endoftext|>", "word", "ß", "́", "中", "\r\n", "İ", "Σ", "!'", "_", "\x1c"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_librarys_ids(path):
    plain, own, rnd = Tokenizer.from_file(path), encoder(path), random.Random(7)
    texts = ["", " ", "Stdd, and the 'words' re-done.\nNew line  two spaces"] + ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(0)
    for n in (1, 7, 512, 513, 5000):
        ids = rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32)
        reader = DacReader(dac_encode(ids))
        assert (reader.all() == ids).all() and len(reader) == n
        for i in [0, n - 1, *rng.integers(0, n, 50)]:
            assert reader[int(i)] == ids[i]
    with pytest.raises(IndexError):
        reader[5000]
    with pytest.raises(ValueError):
        DacReader(b"none")
    assert len(DacReader(dac_encode(np.zeros(0, np.uint32)))) == 0


DOCS = [(3, "Three words here", 1), (1, None, 2), (2, "", 3), (7, "long text, " * 9000, 4), (5, "same", 5), (5, "same", 6), (5, "other", 7)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, part int")  # a column named as one of the store's


def test_store_round_trip(spark, docs):
    plain = Tokenizer.from_file(BYTE)
    want, start = [], 0
    for doc_id, text, _ in sorted(DOCS, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_digests(docs, BYTE).collect())) == want
    path = write_token_store(docs, BYTE)
    assert spark.read.schema(STORE_SCHEMA).parquet(path).count() >= 1


def test_tokens_of_the_whole_store(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 500)  # stretches shorter than segments, and segments of several stretches
    rows = [(k, f"text number {k} has words " * (1 + k % 40)) for k in range(200)] + [(None, "no id"), (500, "long " * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = spark.read.schema(STORE_SCHEMA).parquet(write_token_store(docs, BYTE))
    plain = Tokenizer.from_file(BYTE)
    all_ids = [i for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*plain.encode(t, add_special_tokens=False).ids, 0]]
    rnd = random.Random(1)
    asked = [0, len(all_ids) - 1, len(all_ids), -1, None, 7, 7, *(rnd.randrange(len(all_ids)) for _ in range(300))]
    got = tokens_at(store, spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert {r.position: r.id for r in got} == {p: all_ids[p] for p in asked if p is not None and 0 <= p < len(all_ids)} and len(got) == len({r.position for r in got})


def test_packing_of_repeated_and_nameless_rows(spark):
    rows = [(5, "same words"), (5, "same words"), (None, "same words"), (None, None), (6, "")]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD).collect()
    ids = np.array([*Tokenizer.from_file(WORD).encode("same words", add_special_tokens=False).ids, 2], "<u4")
    whole = [(r.doc_id, bytes(r.ids)) for r in got if r.start == 0 and r.length == r.doc_tokens]
    assert sum(r.length for r in got) == 3 * len(ids) + 2 and {r.doc_tokens for r in got} == {len(ids), 1}
    assert all(raw == ids.tobytes() or raw == ids[-1:].tobytes() for _, raw in whole)
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0 for a, b in zip(spots, spots[1:]))


def test_empty_table(docs):
    none = docs.where("false")
    assert token_digests(none, BYTE).count() == 0 and pack_documents(none, WORD).count() == 0


def test_packing_covers_every_id_once(docs):
    plain = Tokenizer.from_file(WORD)
    rows = pack_documents(docs, WORD).drop("ids").toPandas()
    lengths = rows.groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 and n <= 4096 for n in lengths)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all()
    for doc_id, text in {(d, t) for d, t, _ in DOCS if d != 5}:
        ids, at = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in rows[rows.doc_id == doc_id].sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_pool_fills_windows():
    rng = np.random.default_rng(2)
    pieces = [Piece(k, int(n), 0, np.arange(n, dtype=np.uint32)) for k, n in enumerate(rng.integers(1, 4096, 300))]
    windows, rest = pack_pool(pieces, (256, 512, 1024, 2048, 4096))
    assert all(sum(map(len, w)) in (256, 512, 1024, 2048, 4096) for w in windows)
    tail = split_by_powers(rest)
    assert sum(len(p) for w in windows + tail for p in w) == sum(map(len, pieces))
    assert all(n & (n - 1) == 0 for n in (sum(map(len, w)) for w in tail))
    steps = step_groups([4096] * 33 + [256] * 100, 16 * 4096)
    assert sorted(steps[:33].count(s) for s in set(steps[:33])) == [11, 11, 11]
    with pytest.raises(ValueError):
        pack_documents(None, WORD, tiers=(100,))


def test_small_caches_hold_what_they_are_told_to_and_give_the_same_ids():
    plain = Tokenizer.from_file(WORD)
    own = encoder(WORD, 50)
    for k in range(0, 2000, 5):
        text = f"Word{k} word{k + 1}, and again; {'x' * (k % 40)}y re-done{k}."
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(own._words) <= 50 and len(own._words._old) <= 50


def test_pipeline_packs_without_moving_ids(spark, docs):
    """Ids that no one reads stay in the worker; all other columns are those of the whole operator."""
    got = corpus_pipeline.packing(spark, docs, "unused")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ids_crc32#" in plan and " ids#" not in plan
    want = pack_documents(docs, WORD, end_id=2)
    assert got.columns == [c for c in want.columns if c != "ids"]
    want = want.withColumn("own", F.crc32("ids"))
    assert want.where("own <> ids_crc32").count() == 0
    assert sorted(got.collect()) == sorted(want.drop("ids", "own").collect())
