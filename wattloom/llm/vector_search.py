"""Exact top-k by inner product over quantised vectors, with MaxScore pruning in shards.

A component is a term, a vector its weights. Within a shard every term has bounds on what
it can add to a query's score. The terms with the largest bounds are essential: without
them a vector cannot reach the score that k others are known to have. All vectors are
scored on the essential terms; the other terms are probed, largest bound first, only for
vectors that can still compete. Shards' lists are merged at the end.

Queries come in blocks, candidates in shards, and each pair of the two is one bounded
group; the search is exact whatever the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries of a block and vectors of a shard, at most: what one task holds. Each vector is sent once for each
#: block and each query once for each shard, so larger ones move less; LEAST keeps small tables in several tasks.
QUERY_BLOCK, SHARD, LEAST = 16_384, 65_536, 4096
SCALE = 256
_PROBE = 8


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of floor(256 x), shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * out)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def max_score(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of `vectors` for one query, ties to the smaller id; `own` takes no part."""
    upper, lower = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
    terms = np.argsort(-np.maximum(upper, -lower), kind="stable")
    up, down = upper[terms], lower[terms]
    rest_up, rest_down = np.append(np.cumsum(up[::-1])[::-1], 0), np.append(np.cumsum(down[::-1])[::-1], 0)
    alive = np.flatnonzero(ids != own)
    if len(alive) > k:
        seeds = vectors[alive[: 16 * k]] @ query
        need = np.partition(seeds, -k)[-k]
        # Essential: the shortest head after which the other terms alone stay below what is needed.
        essential = int(np.argmax(rest_up < need)) if (rest_up < need).any() else len(terms)
    else:
        need, essential = -np.inf, len(terms)
    done = max(essential, 1)
    partial = vectors[np.ix_(alive, terms[:done])] @ query[terms[:done]] if done < len(terms) else vectors[alive] @ query
    while done < len(terms):
        if len(alive) > k:
            need = max(need, np.partition(partial, -k)[-k] + rest_down[done])
        stay = partial + rest_up[done] >= need
        alive, partial = alive[stay], partial[stay]
        probe = terms[done : done + _PROBE]
        partial = partial + vectors[np.ix_(alive, probe)] @ query[probe]
        done += len(probe)
    if len(alive) > k:
        stay = partial >= np.partition(partial, -k)[-k]
        alive, partial = alive[stay], partial[stay]
    best = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive[best]], partial[best]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by `query_every`, its k best others.

    `vectors` has vec_id and embedding (array of numbers). A score is the inner product of
    floor(256 x) over both; equal scores rank by vec_id. Vectors that are null, or hold null, NaN
    or infinite components, take no part, nor do rows without a vec_id. A shorter vector counts as
    filled up with zeros. Rows with the query's vec_id are its own; of repeated query rows one asks.
    Products are exact as long as they stay below 2^53. Other columns are ignored.
    """
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    asks = rows.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id"])
    n, n_asks = rows.count(), asks.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_asks // QUERY_BLOCK))
    shards = max(1, -(-n // SHARD), min(-(-tasks // blocks), n // LEAST))
    place = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = asks.select(place(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), place(shards).alias("shard"), "vec_id", "v")

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and candidates.num_rows:
            q, c = _same_width(_matrix(queries["v"]), _matrix(candidates["v"]))
            ids = candidates["vec_id"].to_numpy()
            high, low = c.max(axis=0, initial=-np.inf), c.min(axis=0, initial=np.inf)
            for own, query in zip(queries["vec_id"].to_pylist(), q, strict=True):
                best, score = max_score(query, own, ids, c, high, low, k)
                out[0].append(np.full(len(best), own))
                out[1].append(best)
                out[2].append(score.astype(np.int64))
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
