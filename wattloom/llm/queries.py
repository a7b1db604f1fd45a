"""The registered queries of this subpackage: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from wattloom.llm.common import surrogate_key, table
from wattloom.llm.conversations import prefix_trie
from wattloom.llm.decontamination import contaminated
from wattloom.llm.html import extract_main_text
from wattloom.llm.minhash import near_duplicates
from wattloom.llm.packing import pack_documents
from wattloom.llm.pii import replace_personal_data
from wattloom.llm.repeats import remove_repeats
from wattloom.llm.substrings import remove_held_earlier
from wattloom.llm.token_store import token_digests
from wattloom.llm.toxicity import toxicity
from wattloom.llm.url_templates import Rule, url_verdicts
from wattloom.llm.vector_codes import vector_codes
from wattloom.llm.vector_search import top_k


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_size=2, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), surrogate_key(spark)).select("doc_id", "text", "n_entities", "kinds")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: (verdict, host, path) of the URL query.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_held_earlier(table(spark, sf_dir, "documents")).drop("removed")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_minhash": op2_minhash,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_html": op5_html,
    "op6_repeats": op6_repeats,
    "op7_toxicity": op7_toxicity,
    "op8_url_templates": op8_url_templates,
    "op9_decontamination": op9_decontamination,
    "op10_vector_search": op10_vector_search,
    "op11_substrings": op11_substrings,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}

def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The rounds of op13 as a chain of joins with all entries."""
    near = lambda k: f"""near{k} AS MATERIALIZED (
            SELECT s.vec_id, s.p, any_value(s.x) AS x, min((s.sq - 2 * list_inner_product(s.x, b.x) + b.sq, b.e)) AS best
            FROM parts s JOIN book{k} b USING (p) GROUP BY s.vec_id, s.p)"""  # noqa: E731
    book = lambda k: f"""mean{k} AS (
            SELECT p, e, list(m ORDER BY i) AS x FROM (
                SELECT p, best[2] AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k - 1}, (SELECT unnest(range(1, (SELECT any_value(w) + 1 FROM good))) AS i) GROUP BY p, best[2], i) GROUP BY p, e
        ), book{k} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.x, b.x) AS x, list_inner_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS sq FROM book{k - 1} b LEFT JOIN mean{k} m USING (p, e))"""  # noqa: E731
    steps = ",\n        ".join(f"{near(k)},\n        {book(k + 1)}" for k in range(rounds))
    return f"""
        WITH good AS (
            SELECT vec_id, label, len(embedding) // {parts} AS w, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT vec_id, p, v[p * w + 1 : p * w + w] AS x, list_inner_product(v[p * w + 1 : p * w + w], v[p * w + 1 : p * w + w]) AS sq FROM good, (SELECT unnest(range({parts})) AS p)
        ), book0 AS MATERIALIZED (
            SELECT p, e, x, sq FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x, sq FROM parts) WHERE e < {entries}
        ), {steps},
        {near(rounds)},
        coded AS MATERIALIZED (
            SELECT vec_id, string_agg(lower(printf('%02x', CAST(best[2] AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
        ), digest AS (
            SELECT sha256(string_agg(array_to_string([CAST(c AS BIGINT) FOR c IN x], ','), ',' ORDER BY p, e)) AS d FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
        FROM coded JOIN good USING (vec_id), digest"""


#: DuckDB SQL for those that it can express.
ORACLES: dict[str, str] = {
    "op10_vector_search": """
        WITH good AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_substrings": r"""
        WITH texts AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS MATERIALIZED (
            SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts)
        ), held AS (
            SELECT w, min(doc_id) AS first FROM windows GROUP BY w
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN held USING (w), (SELECT unnest(range(13)) AS k) WHERE first < doc_id
        ), spread AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM spread ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (doc_id)""",
    "op12_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS first, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)
        ), rebuilt AS (
            SELECT i.conv_id, 0 AS part, rn, role, text FROM ids i JOIN turns t ON t.conv_id = i.first AND rn <= h
            UNION ALL SELECT conv_id, 1, rn, role, text FROM ids JOIN turns USING (conv_id) WHERE rn > h
        ), whole AS MATERIALIZED (
            SELECT conv_id, coalesce(s, []) AS s FROM ids LEFT JOIN (SELECT conv_id, list(sha256(concat(length(role), ' ', role, text)) ORDER BY part, rn) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)
        ), bytes AS MATERIALIZED (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, rn) AS d, octet_length(encode(text)) AS n FROM rebuilt
        ), prefixes AS MATERIALIZED (
            SELECT conv_id, d, sha256(array_to_string(s[1 : d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(s[1 : d - 1], ',')) END AS up, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM whole)
        ), nodes AS MATERIALIZED (
            SELECT k, any_value(d) AS d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY k
        ), children AS (
            SELECT up AS k, count(*) AS n_children FROM nodes GROUP BY up
        ), weighed AS (
            SELECT m.k, m.conv_id, m.d, coalesce((m.n - 1) * b.n, 0) AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM nodes m LEFT JOIN bytes b USING (conv_id, d) LEFT JOIN children USING (k)
        ), below AS (
            SELECT p.k, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM weighed w JOIN prefixes p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.k
        )
        SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
        FROM nodes m JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes u ON u.k = m.up""",
    "op13_vector_codes": _codes_sql(),
}
