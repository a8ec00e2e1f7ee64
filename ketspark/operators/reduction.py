"""Projections, coresets and the shape-driven choice between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer
from ketspark.operators.kernel import second_moments


def project(df: DataFrame, cols: Sequence[str], matrix: np.ndarray, prefix: str) -> DataFrame:
    """Linear combinations of the columns with literal weights."""
    parts = {f"{prefix}{k}": sum((F.col(c).cast("double") * float(w) for c, w in zip(cols, matrix[:, k], strict=True)), F.lit(0.0)) for k in range(matrix.shape[1])}
    return df.withColumns(parts)


def gaussian_matrix(n_features: int, n_components: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n_features, n_components)) / np.sqrt(n_components)


class RandomProjector(Transformer):
    """Gaussian random projection with entries of variance 1/k."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], n_components: int = 8, seed: int = 42):
        super().__init__(cols)
        self.n_components, self.seed = n_components, seed

    def fit(self, df=None):
        self.params = {"matrix": gaussian_matrix(len(self.cols), self.n_components, self.seed)}
        return self

    def transform(self, df):
        return project(df, self.cols, self.fitted()["matrix"], "rp")


class CoresetReducer(Transformer):
    """k-means centres with the weight of each."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], target_size: int = 100, seed: int = 42):
        super().__init__(cols)
        self.target_size, self.seed = target_size, seed

    def fit(self, df):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        rows = VectorAssembler(inputCols=self.cols, outputCol="features", handleInvalid="skip").transform(df.select(*[F.col(c).cast("double").alias(c) for c in self.cols]))
        model = KMeans(k=self.target_size, seed=self.seed, initMode="k-means||").fit(rows)
        self.params = {"centres": [c.tolist() for c in model.clusterCenters()], "weights": list(model.summary.clusterSizes)}
        return self

    def transform(self, df):
        p = self.fitted()
        rows = [(*map(float, c), int(w)) for c, w in zip(p["centres"], p["weights"], strict=True)]
        return df.sparkSession.createDataFrame(rows, [*self.cols, "weight"])


class AutoReducer(Transformer):
    """Projects if there are more columns than ``target``, then takes a coreset if there are more rows than ``max_rows``."""

    def __init__(self, cols: Sequence[str], target: int = 10, max_rows: int = 500):
        super().__init__(cols)
        self.target, self.max_rows = target, max_rows

    def fit(self, df):
        self.steps: list[Transformer] = []
        cols = self.cols
        if len(cols) > self.target:
            self.steps.append(RandomProjector(cols, self.target).fit(df))
            df, cols = self.steps[-1].transform(df), [f"rp{k}" for k in range(self.target)]
        if df.count() > self.max_rows:
            self.steps.append(CoresetReducer(cols, self.max_rows).fit(df))
        self.out_cols = cols
        self.params = {"strategy": f"{len(self.steps)} step(s)" if self.steps else "none"}
        return self

    def transform(self, df):
        self.fitted()
        for s in self.steps:
            df = s.transform(df)
        return df.select(*self.out_cols)


class IterativeReduction(Transformer):
    """Random projection rotated again and again by the eigenvectors of its second moments."""

    def __init__(self, cols: Sequence[str], n_components: int = 2, iterations: int = 10, seed: int = 42):
        super().__init__(cols)
        self.n_components, self.iterations, self.seed = n_components, iterations, seed

    def fit(self, df):
        _, _, m = second_moments([F.col(c).cast("double") for c in self.cols], None, df)
        p = gaussian_matrix(len(self.cols), self.n_components, self.seed)
        for _ in range(self.iterations):
            _, v = np.linalg.eigh(p.T @ m @ p)
            v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1, 1)
            p = p @ v
        self.params = {"matrix": p}
        return self

    def transform(self, df):
        return project(df, self.cols, self.fitted()["matrix"], "dim")
