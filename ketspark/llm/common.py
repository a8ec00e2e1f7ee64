"""Shared helpers of the training-data operators.

Words everywhere are maximal runs of characters other than space and U+0009..U+000D.
``bytes.split()`` cuts at exactly those bytes, so Python passes work on the UTF-8 bytes of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Java character class of the word separators.
SPACE = r"[\x20\x09-\x0D]+"


#: folders made where none is configured, by application
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        found = OWN[app] = OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="ketspark-")
    return found


#: setting by which Spark removes the shuffle files of a query as soon as it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query in the block go with its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. The shuffle files of
    the write aren't needed any more and go with its end."""
    path = new_path(df.sparkSession, name)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove ``stored`` tables that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def observed(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, dict]:
    """``stored``, and the aggregates ``sums`` of all rows, which the write takes on its way."""
    seen = Observation()
    out = stored(df.observe(seen, *sums), name)
    return out, seen.get


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; else the join is left to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def as_bytes(col: str):
    """UTF-8 bytes of a string column, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


#: a key with over one in HOT_SHARE of all records is joined by broadcast; so there are fewer than that
HOT_SHARE = 1000


def join_spread(left: DataFrame, key: Column, right: DataFrame, n: int, salt: Column) -> DataFrame:
    """Left join with ``right`` (key, value, rows: how many of the ``n`` rows of ``left`` have the key),
    whose column value is added. Keys with many rows are joined by broadcast, there are under
    HOT_SHARE of them; their rows are then spread by ``salt`` over the shuffle of the rest."""
    many = F.col("rows") * HOT_SHARE > F.lit(n)
    hot = right.where(many).select(F.col("key").alias("__hot"), F.col("value").alias("__hot_value"))
    cold = right.where(~many).select(F.col("key").alias("__cold"), F.col("value").alias("__cold_value"))
    keyed = left.withColumn("__key", key).join(F.broadcast(hot), F.col("__key") == F.col("__hot"), "left")
    spread = F.when(F.col("__hot").isNull() & F.col("__key").isNotNull(), F.col("__key").cast("string")).otherwise(F.concat(F.lit("-"), salt))
    joined = keyed.withColumn("__key", spread).join(cold, F.col("__key") == F.col("__cold").cast("string"), "left")
    return joined.withColumn("value", F.coalesce("__hot_value", "__cold_value")).drop("__key", "__hot", "__hot_value", "__cold", "__cold_value")


#: rows and bytes of texts that a worker has in hand at a time; a longer text comes alone
PORTION_ROWS, PORTION_BYTES = 1000, 4 << 20


def portions(batches: Iterator[pa.RecordBatch], col: int, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes by the binary or string column ``col``; none is empty."""
    for batch in batches:
        size = np.cumsum(pa.compute.binary_length(batch.column(col)).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else ()
        lo = 0
        while lo < batch.num_rows:
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + PORTION_ROWS, int(np.searchsorted(size, done + most, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


#: bytes of a batch of rows on its way to a worker and back
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends batches of at most BATCH_BYTES to Python workers, if it doesn't say otherwise. By default a batch
    is 64 MB, held by the JVM and by the worker for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Hand freed memory back at the end of a task: workers live on between the stages of a job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """64-bit hash of a word; a bounded memo, as most words of a text are frequent ones."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: base of the rolling hash and its inverse modulo 2^64, and their powers for a stretch of units
BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 16
POWERS = np.cumprod(np.array([1] + [BASE] * (STRETCH + 4096), np.uint64))
INVERSES = np.cumprod(np.array([1] + [pow(BASE, -1, 1 << 64)] * STRETCH, np.uint64))


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every run of ``k`` units (words or bytes; ``k`` is 4096 at most)."""
    n = len(units) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, STRETCH):
        part = units[lo : lo + STRETCH + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * POWERS[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[lo : lo + m] = (sums[k:] - sums[:m]) * INVERSES[:m]
    return mix(out)
