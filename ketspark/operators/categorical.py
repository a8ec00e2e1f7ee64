"""Categorical encoders, binning and feature hashing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ketspark.base import Transformer, one_of
from ketspark.plans.stats import column_stats, exact_percentiles

#: categories that are fitted as literals or broadcast; above it joins are left to a shuffle
MAX_BROADCAST = 100_000


def lookup(df: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    return df.join(F.broadcast(table) if n <= MAX_BROADCAST else table, key, "left")


class CategoricalEncoder(Transformer):
    """'label' or 'ordinal' (index in sorted order), 'onehot', or 'binary' (bits of the index, lowest first)."""

    def __init__(self, cols: Sequence[str], method: str = "label", handle_unknown: str = "error"):
        super().__init__(cols)
        self.method, self.handle_unknown = one_of(method, ("label", "ordinal", "onehot", "binary"), "method"), handle_unknown

    def fit(self, df):
        self.params = {}
        for c in self.cols:
            values = df.select(c).where(F.col(c).isNotNull()).distinct()
            n = values.count()
            if self.method in ("onehot", "binary") and n > MAX_BROADCAST:
                raise ValueError(f"{c} has {n} categories, too many for columns of their own")
            index = values.withColumn("__index", (F.row_number().over(W.orderBy(c)) - 1).cast("long")) if n <= MAX_BROADCAST else self._ranked(values, c)
            self.params[c] = {"n": n, "index": index, "values": [r[0] for r in values.orderBy(c).collect()] if self.method == "onehot" else None}
        return self

    @staticmethod
    def _ranked(values: DataFrame, c: str) -> DataFrame:
        from ketspark.plans.numbering import numbered

        return numbered(values, c, name="__index")

    def transform(self, df):
        for c, p in self.fitted().items():
            if self.method == "onehot":
                df = df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in p["values"]})
                continue
            if self.handle_unknown == "error" and df.join(p["index"], c, "left_anti").limit(1).count():
                raise ValueError(f"{c} has unknown categories")
            df = lookup(df, p["index"], c, p["n"]).withColumn("__index", F.coalesce("__index", F.lit(0)))
            if self.method == "binary":
                df = df.withColumns({f"{c}_bit{k}": F.shiftright("__index", k).bitwiseAND(1).cast("long") for k in range(self.width(p["n"]))})
                df = df.drop("__index")
            else:
                df = df.withColumn(f"{c}_label", F.col("__index").cast("long")).drop("__index")
        return df

    @staticmethod
    def width(n: int) -> int:
        return math.ceil(math.log2(n)) if n > 1 else 0

    def n_features_out(self) -> int:
        if self.params is None:
            return 0
        size = {"onehot": lambda n: n, "binary": self.width}.get(self.method, lambda n: 1)
        return sum(size(p["n"]) for p in self.params.values())


class TargetEncoder(Transformer):
    """Smoothed mean of the target; rare and unknown categories get the global mean."""

    def __init__(self, cols: Sequence[str], target: str, smoothing: float = 1.0, min_samples_leaf: int = 1):
        super().__init__(cols)
        self.target, self.smoothing, self.least = target, smoothing, min_samples_leaf

    def fit(self, df):
        y = F.col(self.target).cast("double")
        self.mean = df.agg(F.avg(y)).first()[0]
        self.params = {}
        for c in self.cols:
            table = df.groupBy(c).agg(F.count(y).alias("n"), F.avg(y).alias("m")).where((F.col("n") >= self.least) & F.col(c).isNotNull())
            table = table.select(c, ((F.col("n") * F.col("m") + self.smoothing * self.mean) / (F.col("n") + self.smoothing)).alias("__enc"))
            self.params[c] = table
        return self

    def transform(self, df):
        for c, table in self.fitted().items():
            df = df.join(table, c, "left").withColumn(f"{c}_target", F.coalesce("__enc", F.lit(self.mean))).drop("__enc")
        return df


class FrequencyEncoder(Transformer):
    """Relative frequency, or count, of each category; 0 if unknown."""

    def __init__(self, cols: Sequence[str], normalize: bool = True):
        super().__init__(cols)
        self.normalize = normalize

    def fit(self, df):
        total = float(df.count()) if self.normalize else 1.0
        self.params = {c: df.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") / F.lit(total)).alias("__freq")) for c in self.cols}
        return self

    def transform(self, df):
        for c, table in self.fitted().items():
            df = df.join(table, c, "left").withColumn(f"{c}_freq", F.coalesce("__freq", F.lit(0.0))).drop("__freq")
        return df


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges up to x, less one: below the first edge -1, at the last edge one more bin. Null without edges or x."""
    if not edges:
        return F.lit(None).cast("long")
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1).cast("long")


class BinningEncoder(Transformer):
    """Bins by 'quantile', 'uniform' width, or 'kmeans' centres (as inner edges)."""

    def __init__(self, cols: Sequence[str], n_bins: int = 5, method: str = "quantile"):
        super().__init__(cols)
        self.n_bins, self.method = n_bins, one_of(method, ("quantile", "uniform", "kmeans"), "method")

    def fit(self, df):
        k = self.n_bins
        exact = exact_percentiles(df, {c: F.col(c) for c in self.cols}, [i / k for i in range(k + 1)]) if self.method == "quantile" else {}
        ranges = {} if exact else column_stats(df, self.cols)
        self.params = {}
        for c in self.cols:
            if self.method == "quantile":
                q = exact[c] or []
            else:
                low, high = ranges[c]["min"], ranges[c]["max"]
                inner = [] if low is None else self._centres(df, c) if self.method == "kmeans" else [low + (high - low) / k * i for i in range(1, k)]
                q = [] if low is None else [low, *inner, high]
            self.params[c] = sorted(set(q))
        return self

    def _centres(self, df: DataFrame, c: str) -> list[float]:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("x")))
        return sorted(float(v[0]) for v in KMeans(k=self.n_bins, seed=42).fit(rows).clusterCenters())

    def transform(self, df):
        return df.withColumns({f"{c}_bin": digitize(F.col(c).cast("double"), e) for c, e in self.fitted().items()})


def hash_features(df: DataFrame, cols: Sequence[str], n_features: int = 1024, out_col: str = "hashed") -> DataFrame:
    """Signed feature hashing of "column=value" by md5, so that it is portable and stateless: buckets in ascending order,
    each once, with the sum of its values. Null cells have no bucket."""
    digest = lambda c: F.md5(F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    number = lambda c, at: F.conv(F.substring(digest(c), at, 8), 16, 10).cast("long")
    cells = F.array(*[F.struct((number(c, 1) % n_features).alias("bucket"), F.when(number(c, 9) % 2 == 0, 1.0).otherwise(-1.0).alias("value")) for c in cols])
    some = F.filter(cells, lambda x: x["bucket"].isNotNull())
    total = lambda b: F.aggregate(F.filter(some, lambda x: x["bucket"] == b), F.lit(0.0), lambda a, x: a + x["value"])
    buckets = F.array_sort(F.array_distinct(F.transform(some, lambda x: x["bucket"])))
    return df.withColumn(out_col, F.transform(buckets, lambda b: F.struct(b.alias("bucket"), total(b).alias("value"))))
