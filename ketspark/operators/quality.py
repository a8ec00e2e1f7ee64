"""Validation, quality, profiles, checksums and provenance."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.plans.stats import exact_percentiles
from ketspark.plans.storage import stored


def missing(c: Column) -> Column:
    """Null or NaN; both count as missing."""
    return c.isNull() | F.isnan(c.cast("double"))


def infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == float("inf")


def stacked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) for every cell of numeric columns."""
    return df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column", "value")


class DataValidator:
    """Checks columns for presence, type, missing and infinite values in one aggregate."""

    def __init__(self, expected: dict[str, str], allow_nan: bool = False):
        self.expected, self.allow_nan = expected, allow_nan
        self.errors: list[str] = []

    def report(self, df: DataFrame) -> DataFrame:
        """(column, n_missing, n_infinite, ok) of the expected columns that there are."""
        own = [c for c in self.expected if c in df.columns]
        counts = df.agg(*[f(F.col(c)).alias(f"{k}_{c}") for c in own for k, f in (("m", lambda x: F.count_if(missing(x))), ("i", lambda x: F.count_if(F.coalesce(infinite(x), F.lit(False)))))])
        rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("n_missing"), F.col(f"i_{c}").alias("n_infinite")) for c in own]))
        ok = (F.col("n_infinite") == 0) & ((F.col("n_missing") == 0) | F.lit(self.allow_nan))
        return counts.select(rows).withColumn("ok", ok)

    def validate(self, df: DataFrame) -> bool:
        types = dict(df.dtypes)
        self.errors = [f"missing column {c}" for c in self.expected if c not in types]
        self.errors += [f"{c} is {types[c]}, not {t}" for c, t in self.expected.items() if c in types and types[c] != t]
        self.errors += [f"{r['column']}: {r['n_missing']} missing, {r['n_infinite']} infinite" for r in self.report(df).where("not ok").collect()]
        return not self.errors


def quality_report(df: DataFrame, cols: Sequence[str], min_completeness: float = 0.95, max_outlier_ratio: float = 0.05) -> DataFrame:
    """(completeness, valid, outlier_ratio, overall): missing cells, finite values, and the share of all
    cells outside Tukey's fences around the quartiles of all cells. With any missing cell the fences are unknown: ratio 0."""
    value = F.when(~missing(F.col("value")), F.col("value"))
    # the cells are stored once, as each step of the percentiles reads them
    q = exact_percentiles(stored(stacked(df, cols), "cells"), {"value": value}, (0.25, 0.75))["value"] or [0.0, 0.0]
    width = 1.5 * (q[1] - q[0])
    outside = lambda x: (x < q[0] - width) | (x > q[1] + width)
    over = lambda test: reduce(lambda a, b: a + b, [F.count_if(F.coalesce(test(F.col(c).cast("double")), F.lit(False))) for c in cols])
    counts = df.agg(over(missing).alias("n_missing"), (F.count("*") * len(cols)).alias("n"), over(infinite).alias("n_infinite"), over(lambda x: ~missing(x) & outside(x)).alias("n_out"))
    out = counts.select(
        (1 - F.try_divide("n_missing", "n")).alias("completeness"), ((F.col("n_missing") == 0) & (F.col("n_infinite") == 0)).alias("valid"),
        F.when(F.col("n_missing") > 0, 0.0).otherwise(F.try_divide("n_out", "n")).alias("outlier_ratio"),
    )
    overall = (F.col("completeness") >= min_completeness) & F.col("valid") & (F.col("outlier_ratio") <= max_outlier_ratio)
    return out.withColumn("overall", overall)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, population std, min, quartiles, max, population skewness and excess kurtosis."""
    one = []
    quartiles = exact_percentiles(df, {c: F.col(c) for c in cols}, (0.25, 0.5, 0.75))
    for c in cols:
        x = F.col(c).cast("double")
        q = [F.lit(v).cast("double") for v in quartiles[c] or (None, None, None)]
        flat = F.stddev_pop(x) == 0
        one.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"),
            F.max(x).alias("max"), F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skewness"), F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"),
        ))
    return df.agg(F.array(*one).alias("rows")).select(F.inline("rows"))


def checksum(df: DataFrame, cols: Sequence[str], decimals: int = 6) -> DataFrame:
    """(n_rows, checksum): order-free digest; each row's digest is cut into numbers, which are summed.

    Sums combine before the shuffle, so no list of all rows is ever formed."""
    cell = lambda c: F.coalesce(F.round(F.col(c).cast("double") * 10**decimals).cast("long").cast("string"), F.lit("null"))
    digest = F.sha2(F.concat_ws("|", *[cell(c) for c in cols]), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    sums = df.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"p{k}") for k, p in enumerate(parts)])
    return sums.select("n_rows", F.sha2(F.concat_ws("-", "p0", "p1", "p2", "p3"), 256).alias("checksum"))


class MetadataTracker:
    """Append-only provenance of one source."""

    SCHEMA = "source string, kind string, detail string, n_records long, n_features long, at timestamp"

    def __init__(self, source: str):
        self.source = source
        self.records: list[tuple] = []

    def _add(self, kind: str, detail: str, n: int | None, d: int | None) -> None:
        self.records.append((self.source, kind, detail, n, d, datetime.datetime.now(datetime.UTC)))

    def record_load(self, path: str, df: DataFrame) -> None:
        self._add("load", path, df.count(), len(df.columns))

    def record_transformation(self, kind: str, params: dict | None = None) -> None:
        self._add("transformation", f"{kind} {params or {}}", None, None)

    def metadata(self, spark) -> DataFrame:
        return spark.createDataFrame(self.records, self.SCHEMA)

    def lineage(self, spark) -> DataFrame:
        """Loads only."""
        return self.metadata(spark).where("kind = 'load'")
