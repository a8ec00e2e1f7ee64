"""Vector functions over array<double> columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def norm1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))


def scaled(v: Column, by: Column) -> Column:
    """v / by, with 1 instead of a zero."""
    return F.transform(v, lambda x: x / F.when(by == 0, F.lit(1.0)).otherwise(by))


def features(col: str, n: int) -> Column:
    """First ``n`` elements of an array column as doubles."""
    return F.transform(F.slice(F.col(col), 1, n), lambda x: x.cast("double"))


def total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def product(values: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, values)


def argmin(values: Column) -> Column:
    """Index from 0 of the first smallest element."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("long")


def complete(values: list[Column]) -> Column:
    """Whether none of the numbers is null or NaN."""
    return reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v.cast("double")) for v in values], F.lit(True))
