"""Row numbers and random order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.plans.storage import stored

LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """``df`` with row numbers from 0 in the given order.

    Rows are dealt by range and sorted in their partitions, numbered there, and shifted by the sizes of the
    partitions before; only these sizes are gathered. The dealt rows are stored, since the ranges come
    from a sample and would differ from one evaluation to the next.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("__part", F.shiftright("__at", 33)), "numbered")
    sizes = sorted(tuple(r) for r in dealt.groupBy("__part").count().collect())  # one row a partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = dealt.sparkSession.createDataFrame(starts, "__part long, __start long")
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(LOCAL)).drop("__at", "__part", "__start")


def shuffle_key(key: str | Column, seed: int = 42) -> Column:
    """Portable pseudo-random order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}-"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def batch_ids(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return numbered(df, key).withColumn("batch_id", F.floor(F.col("rn") / batch_size).cast("long")).drop("rn")
