"""What the training-data operators share: shared-folder tables and small column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/wattloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can see."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED_DIR


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage: what follows can be recomputed from replicated files
    when an executor goes, and nothing upstream runs twice.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; plans that still read one would fail."""
    for df in tables:
        spark, path = df.sparkSession, df._shared_path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Whether Spark deletes an execution's shuffle files at its end; else they lie on disk until the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end_with_their_job(spark: SparkSession):
    """Executions inside leave no shuffle files behind. One DataFrame should be executed once there; a second time would shuffle again."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


#: A key with more than one in so many rows is hot: there are at most so many of them, whatever the size.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """`rows` joined (inner) with `unique`, one row a key; its column `weight` says how many of `total` rows the key has.

    Hot keys, at most HOT_SHARE of them, are broadcast, so that their rows stay where they are;
    all others are joined by a shuffle. Both inputs should be tables, as each is read twice.
    """
    is_hot = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(unique.where(is_hot).drop(weight))
    cold = rows.join(F.broadcast(unique.where(is_hot).select(*keys)), keys, "left_anti").join(unique.where(~is_hot).drop(weight), keys)
    return rows.join(hot, keys).unionByName(cold)


#: Rows of a batch between Spark and Python where documents are long; Spark's own default is ten times as many.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def small_batches(spark: SparkSession) -> None:
    """Let batches hold fewer documents, unless the session asks for fewer still: both sides hold a batch whole."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def text_or_empty(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The secret of surrogates, from the session's spark.wattloom.surrogateKey; a fixed one where it is unset, as in tests."""
    return spark.conf.get("spark.wattloom.surrogateKey", "no secret")


_held: list = [None, None]


def give_back() -> None:
    """Return what is free in this process to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def hold(name: str, drop) -> None:
    """Let `name` keep a large cache in this worker process; the one that another operator kept goes, by its own `drop`."""
    if _held[0] not in (None, name):
        if _held[1] is not None:
            _held[1]()
        give_back()
    _held[:] = [name, drop]


def slices(batches, rows: int = 1024):
    """Arrow batches in parts of `rows`, so that few texts are Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
