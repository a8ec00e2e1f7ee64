"""Outlier filters and flags, and kernel-nearest-centroid imputation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer, one_of
from ketspark.operators.kernel import kernel_distance
from ketspark.functions.arrays import argmin
from ketspark.operators.quality import missing
from ketspark.plans.stats import column_stats


class OutlierRemover(Transformer):
    """Keeps rows inside 'iqr' fences, with all 'zscore' under the threshold, or whose 'distance' to the mean
    is at most its mean plus threshold deviations."""

    def __init__(self, cols: Sequence[str], method: str = "iqr", threshold: float = 3.0):
        super().__init__(cols)
        self.method, self.threshold = one_of(method, ("iqr", "zscore", "distance"), "method"), threshold

    def fit(self, df):
        self.params = column_stats(df, self.cols, (0.25, 0.75) if self.method == "iqr" else ())
        if self.method == "distance":
            m, s = df.agg(F.avg(self._distance()), F.stddev_pop(self._distance())).first()
            self.limit = m + self.threshold * s
        return self

    def _distance(self) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c).cast("double") - self.params[c]["mean"], F.lit(2.0)) for c in self.cols]))

    def inside(self) -> Column:
        p = self.fitted()
        if self.method == "distance":
            return self._distance() <= self.limit
        tests = []
        for c in self.cols:
            x, s = F.col(c).cast("double"), p[c]
            if self.method == "iqr":
                w = 1.5 * (s["q"][0.75] - s["q"][0.25])
                tests.append(x.between(s["q"][0.25] - w, s["q"][0.75] + w))
            else:
                tests.append(F.abs(x - s["mean"]) / (s["std"] + 1e-10) < self.threshold)
        return reduce(lambda a, b: a & b, tests)

    def transform(self, df):
        return df.where(self.inside())

    def outlier_ratio(self, df: DataFrame) -> DataFrame:
        return df.agg((1 - F.avg(F.coalesce(self.inside(), F.lit(False)).cast("double"))).alias("outlier_ratio"))


class OutlierDetection(Transformer):
    """Flag and score by the largest absolute z-score."""

    def __init__(self, cols: Sequence[str], threshold: float = 2.0):
        super().__init__(cols)
        self.threshold = threshold

    def fit(self, df):
        self.params = column_stats(df, self.cols)
        return self

    def transform(self, df):
        p = self.fitted()
        z = [F.abs(F.col(c).cast("double") - p[c]["mean"]) / (p[c]["std"] or 1.0) for c in self.cols]
        score = F.greatest(*z) if len(z) > 1 else z[0]
        return df.withColumn("score", score).withColumn("is_outlier", F.col("score") > self.threshold)


class KernelImputer(Transformer):
    """Fills missing cells from the nearest centroid by kernel distance, missing cells read as 0.

    Centroids are given, or fitted by kernel k-means on the complete rows."""

    def __init__(self, cols: Sequence[str], n_clusters: int = 3, centroids: list[list[float]] | None = None, n_qubits: int = 4):
        super().__init__(cols)
        self.n_clusters, self.centroids, self.n_qubits = n_clusters, centroids, n_qubits
        self.params = {} if centroids else None

    def fit(self, df):
        from ketspark.operators.kernel import KernelKMeans

        whole = df.where(~reduce(lambda a, b: a | b, [missing(F.col(c)) for c in self.cols]))
        self.centroids = KernelKMeans(self.cols, self.n_clusters, self.n_qubits).fit(whole).centroids
        self.params = {}
        return self

    def transform(self, df):
        self.fitted()
        n = min(self.n_qubits, len(self.cols))
        zero = [F.when(missing(F.col(c)), 0.0).otherwise(F.col(c).cast("double")) for c in self.cols[:n]]
        near = argmin(F.array(*[kernel_distance(zero, [F.lit(float(v)) for v in centre[:n]]) for centre in self.centroids]))
        out = df.withColumn("__near", near)
        fill = lambda i: F.get(F.array(*[F.lit(float(centre[i])) for centre in self.centroids]), F.col("__near").cast("int"))
        return out.withColumns({c: F.when(missing(F.col(c)), fill(i)).otherwise(F.col(c).cast("double")) for i, c in enumerate(self.cols)}).drop("__near")
