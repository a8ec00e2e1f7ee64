"""Checks that encodings keep the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squares(v: Column) -> Column:
    return F.transform(v, lambda a: a * a)


def matches(p: Column, q: Column, tolerance: float = 1e-5) -> Column:
    return F.forall(F.zip_with(p, q, lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False)))


def fidelity(p: Column, q: Column) -> Column:
    """Struct of the Bhattacharyya coefficient and of p's extremes, entropy (base 2) and purity."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        add(F.zip_with(p, q, lambda a, b: F.sqrt(a * b))).alias("fidelity"), F.array_min(p).alias("min_probability"), F.array_max(p).alias("max_probability"),
        (-add(F.transform(F.filter(p, lambda x: x > 0), lambda x: x * F.log2(x + 1e-10)))).alias("entropy"), add(squares(p)).alias("purity"),
    )


def batch_counts(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
