"""Fidelity kernels of product states in closed form, and what is built on them.

K(x, y) = prod cos^2((x_i - y_i)/2) over the first n features, since cos^2(d/2) = (1 + cos d)/2. With
phi(x) = tensor of (1, cos x_i, sin x_i), K(x, y) = 2^-n <phi(x), phi(y)>: mean kernels, drift, ridge
regression and kernel PCA are then linear-time aggregates over 3^n features.

Rows with a null or NaN feature (or target) are left out of every fit and mean, and get null for what is computed of
them. Repeated rows count as often as they are there. Means over no rows are null, and models can't be fitted to none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer
from ketspark.functions.arrays import argmin, complete, product
from ketspark.plans.numbering import shuffle_key
from ketspark.plans.storage import stored

#: 3^n columns are planned for each row up to this n
MAX_MAP = 6


def ry_kernel(x: Sequence[Column], y: Sequence[Column]) -> Column:
    return product([F.pow(F.cos((a - b) / 2), F.lit(2.0)) for a, b in zip(x, y, strict=True)])


def regressor_kernel(x: Sequence[Column], y: Sequence[Column]) -> Column:
    return product([F.pow(F.cos((a - b) * math.pi), F.lit(2.0)) for a, b in zip(x, y, strict=True)])


def kernel_distance(x: Sequence[Column], y: Sequence[Column]) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * ry_kernel(x, y)))


def kernel_matrix(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], kernel=ry_kernel, broadcast_rows: int = 100_000) -> DataFrame:
    """(i, j, k) for all rows of ``left``, a query set, against all of ``right``. The pairs are the result, so ``left`` should be
    small: it is broadcast if it has up to ``broadcast_rows`` rows, else Spark pairs the partitions of both sides."""
    side = lambda df, p: df.select(F.col(key).alias(p), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in cols])
    a, b = side(left, "i"), side(right, "j")
    a = F.broadcast(a) if left.count() <= broadcast_rows else a
    return b.crossJoin(a).select("i", "j", kernel([F.col(f"i_{c}") for c in cols], [F.col(f"j_{c}") for c in cols]).alias("k"))


def feature_map(x: Sequence[Column], scale: float = 1.0) -> list[Column]:
    """phi(x): 3^n products."""
    if len(x) > MAX_MAP:
        raise ValueError(f"the feature map is planned for up to {MAX_MAP} features")
    one = [(F.lit(1.0), F.cos(c * scale), F.sin(c * scale)) for c in x]
    return [product(list(p)) for p in itertools.product(*one)]


def mean_map(df: DataFrame, cols: Sequence[str], by: Column | None = None) -> DataFrame:
    """Mean of phi, of all rows or by group ``g``: (g, n, phi array)."""
    means = [F.avg(f).alias(f"f{i}") for i, f in enumerate(feature_map([F.col(c).cast("double") for c in cols]))]
    grouped = df.where(complete([F.col(c) for c in cols])).groupBy((F.lit(0) if by is None else by).alias("g"))
    return grouped.agg(F.count("*").alias("n"), *means).select("g", "n", F.array(*[f"f{i}" for i in range(len(means))]).alias("phi"))


class DriftDetector(Transformer):
    """Squared maximum mean discrepancy between a reference and new data, from two mean feature maps."""

    def __init__(self, cols: Sequence[str], threshold: float = 0.1):
        super().__init__(cols)
        self.set_threshold(threshold)

    def set_threshold(self, threshold: float) -> None:
        if threshold < 0:
            raise ValueError("the threshold must not be negative")
        self.threshold = threshold

    def config(self) -> dict:
        return {"n_qubits": len(self.cols), "threshold": self.threshold, "fitted": self.params is not None}

    def fit(self, df):
        self.params = {"reference": mean_map(df, self.cols)}
        return self

    def detect(self, df: DataFrame) -> DataFrame:
        """(reference_size, new_size, mmd_score, drift_detected, status)."""
        ref = self.fitted()["reference"].select(F.col("n").alias("reference_size"), F.col("phi").alias("__a"))
        if lacking := [c for c in self.cols if c not in df.columns]:
            raise ValueError(f"missing features {lacking}")
        new = mean_map(df, self.cols).select(F.col("n").alias("new_size"), F.col("phi").alias("__b"))
        gap = F.aggregate(F.zip_with("__a", "__b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        mmd = F.greatest(F.lit(0.0), gap / float(2 ** len(self.cols)))
        out = ref.crossJoin(new).withColumn("__mmd", mmd)  # one row each
        hit = F.col("__mmd") > self.threshold
        return out.select("reference_size", "new_size", F.col("__mmd").alias("mmd_score"), hit.alias("drift_detected"), F.when(hit, "DRIFT DETECTED").otherwise("STABLE").alias("status"))


def assign(df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]], n_qubits: int = 4) -> DataFrame:
    """``df`` with the index of the nearest centroid; ties go to the lowest."""
    n = min(n_qubits, len(cols))
    x = [F.col(c).cast("double") for c in cols[:n]]
    return df.withColumn("cluster", F.when(complete(x), argmin(F.array(*[kernel_distance(x, [F.lit(float(v)) for v in c[:n]]) for c in centroids]))))


class KernelKMeans(Transformer):
    """Lloyd's loop by kernel distance, one aggregate a step. It starts from the rows with the smallest md5 of their key."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], n_clusters: int = 3, n_qubits: int = 4, max_iter: int = 10, key: str | None = None, seed: int = 42):
        super().__init__(cols)
        self.k, self.n_qubits, self.max_iter, self.key, self.seed = n_clusters, n_qubits, max_iter, key, seed
        self.centroids: list[list[float]] = []

    def fit(self, df):
        df = stored(df.select(*dict.fromkeys([*self.cols, *([self.key] if self.key else [])])).where(complete([F.col(c) for c in self.cols])), "clustered")  # read at every step
        order = shuffle_key(F.col(self.key) if self.key else F.concat_ws(",", *self.cols), self.seed)
        self.centroids = [[float(v) for v in r] for r in df.select(*self.cols, order.alias("__r")).orderBy("__r", *self.cols).limit(self.k).drop("__r").collect()]
        if not self.centroids:
            raise ValueError("no rows to fit")
        for _ in range(self.max_iter):
            means = {r[0]: [float(v) for v in r[1:]] for r in assign(df, self.cols, self.centroids, self.n_qubits).groupBy("cluster").agg(*[F.avg(c) for c in self.cols]).collect()}
            moved = [means.get(i, c) for i, c in enumerate(self.centroids)]
            if np.allclose(moved, self.centroids):
                break
            self.centroids = moved
        self.params = {}
        return self

    def transform(self, df):
        self.fitted()
        return assign(df, self.cols, self.centroids, self.n_qubits)

    predict = transform


def second_moments(features: Sequence[Column], y: Column | None, df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean of (features, y) and mean of their products, over one aggregate of partition sums. Rows that lack any of them don't count."""
    import pyarrow as pa

    d = len(features) + (y is not None)
    rows = df.select(F.array(*features, *([y] if y is not None else [])).alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def sums(batches):
        n, s, ss = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + x.T @ x
        yield pa.record_batch([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], ["n", "s", "ss"])

    n, s, ss = 0, np.zeros(d), np.zeros(d * d)
    for r in rows.mapInArrow(sums, "n long, s array<double>, ss array<double>").toLocalIterator():  # one row a partition
        n, s, ss = n + r[0], s + np.array(r[1]), ss + np.array(r[2])
    return n, s / max(1, n), ss.reshape(d, d) / max(1, n)


class KernelRidge(Transformer):
    """Ridge regression with the regressor's kernel, solved in the primal: a 3^n system on the driver."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], target: str, alpha: float = 1.0):
        super().__init__(cols)
        self.target, self.alpha = target, alpha

    def _map(self) -> list[Column]:
        norm = 2.0 ** (-len(self.cols) / 2)
        return [f * norm for f in feature_map([F.col(c).cast("double") for c in self.cols], 2 * math.pi)]

    def fit(self, df):
        n, _, m = second_moments(self._map(), F.col(self.target).cast("double"), df)
        if not n:
            raise ValueError("no rows to fit")
        a, b = m[:-1, :-1] * n, m[:-1, -1] * n
        self.params = {"w": np.linalg.solve(a + self.alpha * np.eye(len(a)), b).tolist()}
        return self

    def transform(self, df):
        w = self.fitted()["w"]
        known = complete([F.col(c) for c in self.cols])
        return df.withColumn("prediction", F.when(known, sum((f * v for f, v in zip(self._map(), w, strict=True)), F.lit(0.0))))


class KernelPCA(Transformer):
    """Kernel PCA as linear PCA on the feature map; the largest weight of each component is positive."""

    def __init__(self, cols: Sequence[str], n_components: int = 2):
        super().__init__(cols)
        self.n_components = n_components

    def _map(self) -> list[Column]:
        norm = 2.0 ** (-len(self.cols) / 2)
        return [f * norm for f in feature_map([F.col(c).cast("double") for c in self.cols])]

    def fit(self, df):
        n, mean, m = second_moments(self._map(), None, df)
        if not n:
            raise ValueError("no rows to fit")
        values, vectors = np.linalg.eigh(m - np.outer(mean, mean))
        top = vectors[:, np.argsort(values)[::-1][: self.n_components]]
        top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
        self.params = {"mean": mean, "top": top}
        return self

    def transform(self, df):
        p = self.fitted()
        fs = self._map()
        known = complete([F.col(c) for c in self.cols])
        return df.withColumns({f"pc{k}": F.when(known, sum(((f - float(m)) * float(v) for f, m, v in zip(fs, p["mean"], p["top"][:, k], strict=True)), F.lit(0.0))) for k in range(p["top"].shape[1])})
