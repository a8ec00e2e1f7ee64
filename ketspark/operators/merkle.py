"""Digest of a table in a given order: a tree of digests, whose root changes with any cell and with the order of rows.

Rows are numbered in order, every ``fan`` of them make a leaf, every ``fan`` leaves a node, and so on up to one root. A
node's digest is that of its children's digests in order, so a task puts together ``fan`` of them at a time, and the work grows with the rows.
``first_difference`` walks down two trees and names the first range of rows in which they differ, reading ``fan`` nodes a level.

Cells are written with their length, so neighbouring cells can't be mistaken for each other; null is different from any text. Numbers with
fractions are rounded to ``decimals`` digits. Rows that are equal in ``order`` are put in order by their digests. An empty table has the digest
of nothing. Names of columns don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.plans.numbering import numbered
from ketspark.plans.storage import stored

FAN = 1024


def cell(df: DataFrame, name: str, decimals: int) -> Column:
    x = F.col(f"`{name}`")
    kind = df.schema[name].dataType.typeName()
    if kind in ("float", "double"):
        # what isn't a number, or too large to be scaled, is written as it is
        scaled = F.round(x * 10**decimals)
        text = F.when(F.abs(scaled) < 9e15, scaled.cast("long").cast("string")).otherwise(x.cast("string"))
    elif kind in ("array", "map", "struct", "variant"):
        text = F.to_json(F.struct(x))
    elif kind == "binary":
        text = F.hex(x)
    else:
        text = x.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _up(level: DataFrame, at: str, fan: int) -> DataFrame:
    """(idx, first_row, n_rows, digest) of the nodes above."""
    children = F.array_sort(F.collect_list(F.struct(at, "first_row", "n_rows", "digest")))  # ``fan`` of them
    return (
        level.groupBy(F.floor(F.col(at) / fan).alias("idx"))
        .agg(children.alias("own"))
        .select("idx", F.get("own.first_row", F.lit(0)).alias("first_row"), F.aggregate("own.n_rows", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_rows"), F.sha2(F.array_join("own.digest", ""), 256).alias("digest"))
    )


def merkle_tree(df: DataFrame, order: Sequence[str], cols: Sequence[str], decimals: int = 6, fan: int = FAN) -> DataFrame:
    """(level, idx, first_row, n_rows, digest): leaves are level 0, the root is alone on the highest level."""
    if fan < 2:
        raise ValueError("fan must be at least 2")
    digest = F.sha2(F.concat(*[cell(df, c, decimals) for c in cols]), 256)
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)]
    rows = numbered(df.select(*keys, digest.alias("digest")), *[f"k{i}" for i in range(len(order))], "digest")
    level = stored(_up(rows.select("rn", F.col("rn").alias("first_row"), F.lit(1).cast("long").alias("n_rows"), "digest"), "rn", fan), "merkle")
    tree, k, n = level.select(F.lit(0).alias("level"), "*"), 0, level.count()
    if not n:
        none = df.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("first_row"), F.lit(0).cast("long").alias("n_rows"))
        return none.withColumn("digest", F.sha2(F.lit("").cast("binary"), 256))
    while n > 1:
        k += 1
        level = stored(_up(level, "idx", fan), "merkle")
        tree, n = tree.unionByName(level.select(F.lit(k).alias("level"), "*")), -(-n // fan)
    return tree


def root(tree: DataFrame) -> DataFrame:
    """(n_rows, root): one row."""
    return tree.orderBy(F.desc("level")).limit(1).select("n_rows", F.col("digest").alias("root"))


def first_difference(a: DataFrame, b: DataFrame, fan: int = FAN) -> dict | None:
    """{first_row, n_rows} of the first leaf in which two trees of one ``fan`` differ (n_rows of the longer one), None if they are equal."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    level = min(tops)
    low, high = 0, None  # nodes of the level to look at: all of the highest common one, then the children of one
    while True:
        own = [t.where((F.col("level") == level) & (F.col("idx") >= low) & (F.lit(True) if high is None else F.col("idx") < high)).select("idx", F.col("first_row").alias(f"f{k}"), F.col("n_rows").alias(f"n{k}"), F.col("digest").alias(f"d{k}")) for k, t in enumerate((a, b))]
        found = own[0].join(own[1], "idx", "full").where(~F.col("d0").eqNullSafe(F.col("d1"))).orderBy("idx").limit(1).collect()
        if not found:
            return None
        (node,) = found
        if level == 0:
            return {"first_row": node.f0 if node.f0 is not None else node.f1, "n_rows": max(node.n0 or 0, node.n1 or 0)}
        level, low, high = level - 1, node.idx * fan, (node.idx + 1) * fan
