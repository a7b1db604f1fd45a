"""Toxic spans by a linear-chain conditional random field; scores from its marginals.

Labels mark documents. A bounded sample of labelled documents gives labelled tokens: a
token of a toxic document is toxic if its word, or the word's beginning, stands in more
different toxic texts than clean ones, and not by chance. (Copies of a text count once.)
A two-state chain is fitted to those tokens by its exact gradient. Over any document,
forward-backward gives each token's probability; their sum and the second
largest of them (one token alone is often chance), through a logistic curve fitted on the
sample, give the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import hold, materialize, slices, text_or_empty

#: Most labelled documents of either class that training reads, the first by a hash of doc_id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2800
#: Most of these whose tokens fit the chain.
CHAIN_TOXIC, CHAIN_CLEAN = 400, 500
#: Lengths of the beginnings of words that are features besides whole words.
PREFIXES = range(4, 9)
MAX_FEATURES = 2000
#: A telling word's texts are toxic at least so often, and not so by chance.
MIN_TOXIC_SHARE, MARGIN = 0.4, 3.0
#: Tokens from here on belong to a span.
SPAN_AT = 0.5

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_TOKEN = re.compile(r"\S+")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SHAPES = 4  # lower, title, upper, with other characters inside; what surrounds a word does not count


def word_of(chunk: str) -> str:
    """A token's letters, in lower case."""
    return _NOT_LETTERS.sub("", chunk).lower()


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, the most specific first."""
    return [f"={word}", *(f"^{word[:k]}" for k in reversed(PREFIXES) if k < len(word))]


def hash_of(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shape(chunk: str) -> int:
    chunk = _EDGES.sub("", chunk)
    if not chunk.isalpha():
        return 3
    return 0 if chunk.islower() else 1 if chunk[1:].islower() or len(chunk) == 1 else 2


class _Codes(dict):
    """token -> feature code: its lexicon number (0: none) and its shape."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        known = next((self.lexicon[f] for f in features_of(word_of(chunk)) if f in self.lexicon), 0)
        self[chunk] = code = known * _SHAPES + _shape(chunk)
        return code

    def of(self, text: str) -> np.ndarray:
        chunks = text.split()
        return np.fromiter(map(self.__getitem__, chunks), np.int32, len(chunks))


@dataclass
class Chain:
    """The fitted model. Weights are log odds of the toxic state."""

    lexicon: dict[str, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shapes: np.ndarray = field(default_factory=lambda: np.zeros(_SHAPES))
    start: float = -3.0
    moves: np.ndarray = field(default_factory=lambda: np.array([[0.0, -3.0], [0.0, -3.0]]))  # from clean or toxic, to clean or toxic
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def odds(self) -> np.ndarray:
        """Emission odds by feature code."""
        return np.exp(self.words[:, None] + self.shapes[None, :]).ravel()

    def score(self, p: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(_summaries(p) @ self.curve)))


def _summaries(p: list[np.ndarray]) -> np.ndarray:
    """What the curve sees of each document's probabilities."""
    second = [np.partition(x, -2)[-2] if len(x) > 1 else 0.0 for x in p]
    return np.column_stack([np.ones(len(p)), np.log1p([x.sum() for x in p]), second])


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by step and document, longest first; how many documents reach each step."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    lengths = np.array([len(docs[i]) for i in order])
    codes = np.zeros((lengths[0] if len(lengths) else 0, len(docs)), np.int32)
    for column, i in enumerate(order):
        codes[: len(docs[i]), column] = docs[i]
    alive = np.searchsorted(-lengths, -np.arange(len(codes)), side="left")
    return codes, alive, order


def _blocks(docs: list[np.ndarray], cells: int = 500_000) -> Iterator[list[int]]:
    """Indices of documents of like length, so that padding stays small."""
    block: list[int] = []
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        if block and len(docs[block[0]]) * (len(block) + 1) > cells:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def _forward_backward(codes: np.ndarray, alive: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the toxic state from what precedes (with the token), from what follows, and the emission odds."""
    emit = chain.odds()[codes]
    (cc, ct), (tc, tt) = np.exp(chain.moves)
    ahead, behind = np.empty_like(emit), np.ones_like(emit)
    for t in range(len(codes)):
        n = alive[t]
        if t == 0:
            ahead[0] = emit[0] * math.exp(chain.start)
        else:
            f = ahead[t - 1, :n]
            ahead[t, :n] = emit[t, :n] * (f * tt + ct) / (f * tc + cc)
    for t in range(len(codes) - 2, -1, -1):
        n = alive[t + 1]
        u = emit[t + 1, :n] * behind[t + 1, :n]
        behind[t, :n] = (tt * u + tc) / (ct * u + cc)
    return ahead, behind, emit


def marginals(docs: list[np.ndarray], chain: Chain) -> list[np.ndarray]:
    """Each token's probability of the toxic state, by document."""
    out: list[np.ndarray] = [np.zeros(0)] * len(docs)
    for block in _blocks(docs):
        own = [docs[i] for i in block]
        codes, alive, order = _padded(own)
        if not len(codes):
            continue
        ahead, behind, _ = _forward_backward(codes, alive, chain)
        odds = ahead * behind
        p = odds / (1 + odds)
        for column, i in enumerate(order):
            out[block[i]] = p[: len(own[i]), column]
    return out


def _fit_chain(docs: list[np.ndarray], tags: list[np.ndarray], lexicon: dict[str, int], rounds: int = 40, ridge: float = 1.0) -> Chain:
    """Maximum likelihood with a ridge, by Adam on the exact gradient."""
    chain = Chain(lexicon, np.zeros(len(lexicon) + 1), np.zeros(_SHAPES))
    params = lambda: np.concatenate([chain.words, chain.shapes, [chain.start], chain.moves[:, 1]])  # noqa: E731  the clean column stays 0
    n_words = len(lexicon) + 1
    blocks = []
    for block in _blocks(docs):
        own = [docs[i] for i in block]
        if not len(own[0]):
            continue
        codes, alive, order = _padded(own)
        truth = np.zeros(codes.shape, bool)
        for column, i in enumerate(order):
            truth[: len(own[i]), column] = tags[block[i]]
        blocks.append((codes, alive, truth, np.arange(codes.shape[1])[None, :] < alive[:, None]))
    tokens = max(1, sum(int(b[3].sum()) for b in blocks))
    m = v = np.zeros(n_words + _SHAPES + 3)
    for k in range(1, rounds + 1):
        grad = np.zeros_like(m)
        for codes, alive, truth, real in blocks:
            ahead, behind, emit = _forward_backward(codes, alive, chain)
            odds = ahead * behind
            miss = np.where(real, truth - odds / (1 + odds), 0)
            by_code = np.bincount(codes.ravel(), miss.ravel(), n_words * _SHAPES).reshape(n_words, _SHAPES)
            grad[:n_words] += by_code.sum(axis=1)
            grad[n_words : n_words + _SHAPES] += by_code.sum(axis=0)
            grad[n_words + _SHAPES] += miss[0].sum()
            # Probability of each move: previous state, transition, emission, what follows.
            (cc, ct), (tc, tt) = np.exp(chain.moves)
            f, u, both = ahead[:-1], emit[1:] * behind[1:], real[1:]
            z = cc + ct * u + f * (tc + tt * u)
            before, now = truth[:-1], truth[1:]
            grad[-2] += np.where(both, (~before & now) - ct * u / z, 0).sum()
            grad[-1] += np.where(both, (before & now) - f * tt * u / z, 0).sum()
        grad = (grad - ridge * params()) / tokens * 1000
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        new = params() + 0.4 / math.sqrt(k) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        chain.words, chain.shapes, chain.start = new[:n_words], new[n_words : n_words + _SHAPES], float(new[n_words + _SHAPES])
        chain.moves = np.array([[0.0, new[-2]], [0.0, new[-1]]])
    return chain


def _fit_curve(x: np.ndarray, label: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression of the label on the summaries, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (label - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def is_held_out(doc_id: F.Column) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(text, toxic, chain) of a bounded sample; ids come from the labels alone, so no text is moved for them."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("rank", F.xxhash64("doc_id"))
    some = [known.where(F.col("toxic") == k).orderBy("rank", "doc_id").limit(n) for k, n in ((1, toxic), (0, clean))]
    ids = materialize(some[0].unionByName(some[1]), "sample-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return materialize(rows.select("doc_id", "text", "toxic", "rank"), "sample")


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Chain:
    """Fit on at most `sample_toxic` + `sample_clean` labelled documents outside the held-out third.

    Without toxic examples, or without words that tell, scores are the smoothed share of toxic labels.
    """
    sample = _sample(docs, labels, sample_toxic, sample_clean)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                words = [w for w in map(word_of, text.split()) if w]
                # Copies of a text share this mark nearly always: the least hash of its word pairs.
                mark = min((hash_of(f"{a} {b}") for a, b in zip(words, words[1:])), default=0)
                found = sorted({f for w in set(words) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32()), pa.array([mark] * len(found), pa.int64())], ["feature", "toxic", "mark"])

    n_toxic, n = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    chain = Chain(curve=np.array([math.log((n_toxic + 1) / (n - n_toxic + 1)), 0.0, 0.0]))
    if not n_toxic or n_toxic == n:
        return chain
    texts = sample.select("text", "toxic").mapInArrow(features, "feature string, toxic int, mark long").distinct()
    counts = texts.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = materialize(counts, "word-counts")
    # Likelihood ratio against the share of toxic documents. With so many words tested, chance
    # alone passes the bar for one in e^-MARGIN of all trainings.
    n_words, t, all_ = max(2, counts.count()), F.col("t"), F.col("t") + F.col("c")
    share = n_toxic / n
    ratio = 2 * (t * F.log((t + 1e-9) / (all_ * share)) + F.col("c") * F.log((F.col("c") + 1e-9) / (all_ * (1 - share))))
    telling = counts.withColumn("ratio", ratio).where((t >= MIN_TOXIC_SHARE * all_) & (F.col("ratio") >= 2 * (math.log(n_words) + MARGIN)))
    lexicon = {r.feature: k for k, r in enumerate(telling.orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES).collect(), 1)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(lexicon)
        for batch in batches:
            raw = [codes.of(x).astype("<u2").tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), batch.column(1), batch.column(2)], ["codes", "toxic", "rank"])

    # Feature codes of the bounded sample, two bytes a token.
    rows = sample.select("text", "toxic", "rank").mapInArrow(encode, "codes binary, toxic int, rank long").collect()
    rows.sort(key=lambda r: (r.rank, bytes(r.codes)))
    docs_, label = [np.frombuffer(r.codes, "<u2").astype(np.int32) for r in rows], np.array([r.toxic for r in rows])
    chosen = [*np.flatnonzero(label == 1)[:CHAIN_TOXIC], *np.flatnonzero(label == 0)[:CHAIN_CLEAN]]
    tags = [(docs_[i] >= _SHAPES) & bool(label[i]) for i in chosen]
    if lexicon:
        curve = chain.curve
        chain = _fit_chain([docs_[i] for i in chosen], tags, lexicon)
        chain.curve = curve
    p = marginals(docs_, chain)
    chain.curve = _fit_curve(_summaries(p), label)
    return chain


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, score, expected, spans) for every row: spans are the (start, end) offsets of toxic tokens, in characters, runs joined.

    Null and empty texts get the score of a text without toxic tokens. Every row gives a row; other columns are ignored.
    """
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def spans(text: str, p: np.ndarray) -> list[dict]:
        out: list[dict] = []
        last = -2
        for k, found in enumerate(_TOKEN.finditer(text)):
            if k < len(p) and p[k] >= SPAN_AT:
                if last == k - 1:
                    out[-1]["end"] = found.end()
                else:
                    out.append({"start": found.start(), "end": found.end()})
                last = k
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", None)
        codes = _Codes(chain.lexicon)
        for part in slices(batches):
            if not part.num_rows:
                continue
            texts = part.column(1).to_pylist()
            p = marginals([codes.of(x) for x in texts], chain)
            total, most = np.array([x.sum() for x in p]), np.array([x.max(initial=0) for x in p])
            found = [spans(x, q) if m >= SPAN_AT else [] for x, q, m in zip(texts, p, most, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chain.score(p), pa.float64()), pa.array(total, pa.float64()), pa.array(found, spans_type)], ["doc_id", "score", "expected", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(score, "doc_id long, score double, expected double, spans array<struct<start:int,end:int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of `docs`, learnt from `labels` (doc_id, toxic)."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
