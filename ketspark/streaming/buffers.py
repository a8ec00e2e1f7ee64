"""Sliding buffers and batch aggregates; batch forms and Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.functions.arrays import total
from ketspark.plans.numbering import batch_ids, numbered, shuffle_key
from ketspark.plans.storage import stored
from ketspark.streaming.ring import ring


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by ``order``: a top-n, no sort of the whole."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def buffer_statistics(df: DataFrame, cols: Sequence[str], capacity: int) -> DataFrame:
    """(size, capacity, utilization, mean_c and std_c of each column, min, max over all)."""
    x = [F.col(c).cast("double") for c in cols]
    least = lambda vs: F.least(*vs) if len(vs) > 1 else vs[0]
    most = lambda vs: F.greatest(*vs) if len(vs) > 1 else vs[0]
    each = [f(v).alias(f"{n}_{c}") for c, v in zip(cols, x, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.agg(F.count("*").alias("size"), F.lit(capacity).cast("long").alias("capacity"), (F.count("*") / capacity).alias("utilization"), *each, least([F.min(v) for v in x]).alias("min"), most([F.max(v) for v in x]).alias("max"))


def shuffled_batches(df: DataFrame, key: str, batch_size: int, seed: int = 42) -> DataFrame:
    """``df`` with batch ids in a fixed pseudo-random order."""
    rows = numbered(df.withColumn("__r", shuffle_key(key, seed)), "__r", key)
    return rows.withColumn("batch_id", F.floor(F.col("rn") / batch_size).cast("long")).drop("rn", "__r")


def aggregate_batches(df: DataFrame, batch: str, cols: Sequence[str], method: str = "mean") -> DataFrame:
    """One row: each column over all batches by 'mean', 'max', 'min' or 'sum'; any other method means. Every batch is
    reduced to its sums, counts and extremes first, in one pass; without rows the result is null."""
    x = [F.col(c).cast("double") for c in cols]
    each = [f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("s", F.sum), ("n", F.count), ("a", F.min), ("b", F.max))]
    merged = {"max": lambda i: F.max(f"b{i}"), "min": lambda i: F.min(f"a{i}"), "sum": lambda i: F.sum(f"s{i}")}.get(method, lambda i: F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")))
    return df.groupBy(batch).agg(*each).agg(*[merged(i).alias(c) for i, c in enumerate(cols)])


def batch_statistics(df: DataFrame, batch: str, cols: Sequence[str]) -> DataFrame:
    """(n_batches, n_samples, mean, std, min, max) over all cells."""
    x = [F.col(c).cast("double") for c in cols]
    n = F.count("*") * len(cols)
    mean = F.sum(total(x)) / n
    return df.agg(F.count_distinct(batch).alias("n_batches"), F.count("*").alias("n_samples"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(total([v * v for v in x])) / n - mean * mean)).alias("std"))


def process_batches(df: DataFrame, key: str, batch_size: int, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` of each batch in key order, run on the executors; its results in one table, which a caller may
    reduce further by ``merge``."""
    return batch_ids(df, key, batch_size).groupBy("batch_id").applyInPandas(lambda b: function(b.sort_values(key)), schema)


def merge_batches(results: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 10_000) -> DataFrame:
    """Results of batches reduced to one by a caller's ``function`` (frame -> smaller frame of ``schema``), which must not
    mind in which order and in how many steps it is applied: it meets ``rows`` rows at a time, then the outcomes of that,
    until one step takes all. Without results there is nothing."""
    while True:
        left = results.count()
        parts = -(-left // rows)
        dealt = results.repartition(max(1, parts)).mapInPandas(lambda frames: (function(pd.concat(own)) for own in [list(frames)] if own), schema)
        results = stored(dealt, "merged")
        if parts <= 1:
            return results
        if results.count() >= left:
            raise ValueError("the function must return fewer rows than it gets")


def flushed(df: DataFrame, order: Sequence[str], capacity: int) -> DataFrame:
    """``df`` with flush_id: a buffer that takes rows by ``order`` is emptied each time it holds ``capacity``; the rows
    that it still holds at the end are the last flush."""
    return numbered(df, *order).withColumn("flush_id", F.floor(F.col("rn") / capacity).cast("long")).drop("rn")


def stream_tail(stream: DataFrame, by: str, value: str, size: int) -> DataFrame:
    """(by, n, mean) over the last ``size`` values of each key after each micro-batch ('update' mode); see ``ring``."""
    return ring(stream, by, value, capacity=size, mode="Update").select(by, F.col("size").alias("n"), "mean")


def windowed(stream: DataFrame, at: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark: (start, n, mean); for batches and streams alike."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide or width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
