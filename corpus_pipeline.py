"""A corpus pipeline over `documents`: toxicity, near duplicates, decontamination, personal data, packing.

Each stage works on all that the one before kept, written as Parquet and read again. In every
stage null and empty texts are documents without words: they are neither toxic, nor near
duplicates, nor contaminated, hold no personal data and are one end id in a sequence. Rows
without a doc_id are never rejected. Rows that repeat a doc_id are rejected together, and
otherwise all stay. Empty tables give empty tables, and columns of any name pass through.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import materialize, small_batches, surrogate_key, table
from wattloom.llm.decontamination import contaminated
from wattloom.llm.minhash import near_duplicates
from wattloom.llm.packing import pack_documents
from wattloom.llm.pii import replace_personal_data
from wattloom.llm.toxicity import score_documents, train

#: Keys of documents that may be sent to every task (8 bytes each).
SMALL_KEYS = 1_000_000
#: Chunks that a worker's encoder keeps: by the time of packing the executor's JVM has grown by all stages before.
SMALL_CACHE = 100_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id is in `keys`; rows without a doc_id stay."""
    keys = materialize(keys.select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys, "doc_id", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score 0.7 or more."""
    small_batches(spark)
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return _without(docs, scored.where("score >= 0.7"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return _without(docs, near_duplicates(docs, shingle_size=5, percent=80).where("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark item."""
    small_batches(spark)
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text."""
    columns = docs.columns
    return replace_personal_data(docs, surrogate_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of at most 4096 tokens."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, with_ids=False, cached=SMALL_CACHE)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages learn, iterate and tokenise: SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
