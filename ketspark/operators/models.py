"""Kernel classifiers and anomaly detection, and seeded models whose reference behaviour is a contract of shape and range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ketspark.base import Transformer, one_of
from ketspark.functions.arrays import total
from ketspark.operators.kernel import MAX_MAP, feature_map, ry_kernel
from ketspark.plans.numbering import numbered, shuffle_key
from ketspark.plans.storage import stored


def gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.prod(np.cos((x[:, None] - y[None]) / 2) ** 2, axis=2)


def bounded_sample(df: DataFrame, cols: Sequence[str], n: int, extra: Sequence[str] = (), seed: int = 42) -> np.ndarray:
    """At most ``n`` rows in md5 order, for solvers that need a Gram matrix."""
    picked = df.select(*[F.col(c).cast("double").alias(c) for c in (*cols, *extra)]).withColumn("__r", shuffle_key(F.concat_ws(",", *cols), seed))
    return np.array([r[:-1] for r in picked.orderBy("__r", *cols).limit(n).collect()], float).reshape(-1, len(cols) + len(extra))


def kernel_sum(cols: Sequence[str], vectors: np.ndarray, weights: np.ndarray) -> Column:
    """Sum of weight * K(row, vector): a projection, no join."""
    x = [F.col(c).cast("double") for c in cols]
    return total([ry_kernel(x, [F.lit(float(v)) for v in vec]) * float(w) for vec, w in zip(vectors, weights, strict=True)] or [F.lit(0.0)])


def solve_box(q: np.ndarray, p: np.ndarray, upper: float, y: np.ndarray, a: np.ndarray, steps: int = 20_000) -> np.ndarray:
    """min a'Qa/2 + p'a with 0 <= a <= upper and y'a fixed: pairs that violate the conditions most, in turn."""
    g = q @ a + p
    for _ in range(steps):
        up = ((y > 0) & (a < upper - 1e-12)) | ((y < 0) & (a > 1e-12))
        down = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < upper - 1e-12))
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(down, v, np.inf).argmin()
        if not up.any() or not down.any() or v[i] - v[j] < 1e-6:
            break
        curve = max(q[i, i] + q[j, j] - 2 * y[i] * y[j] * q[i, j], 1e-12)
        t = (v[i] - v[j]) / curve
        room_i = upper - a[i] if y[i] > 0 else a[i]
        room_j = a[j] if y[j] > 0 else upper - a[j]
        t = min(t, room_i, room_j)
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += t * (y[i] * q[:, i] - y[j] * q[:, j])
    return a


class KernelSVC(Transformer):
    """Two-class support vector machine with the RY kernel, solved over a bounded sample of rows."""

    def __init__(self, cols: Sequence[str], label: str, C: float = 1.0, max_rows: int = 500):
        super().__init__(cols)
        self.label, self.C, self.max_rows = label, C, max_rows

    def fit(self, df):
        self.classes = [r[0] for r in df.select(self.label).where(F.col(self.label).isNotNull()).distinct().orderBy(self.label).limit(3).collect()]
        if len(self.classes) != 2:
            raise ValueError("two classes are needed")
        rows = bounded_sample(df.withColumn("__y", F.when(F.col(self.label) == self.classes[1], 1.0).otherwise(-1.0)), self.cols, self.max_rows, ["__y"])
        x, y = rows[:, :-1], rows[:, -1]
        k = gram(x, x)
        a = solve_box(k * np.outer(y, y), -np.ones(len(y)), self.C, y, np.zeros(len(y)))
        free = (a > 1e-8) & (a < self.C - 1e-8)
        f = k @ (a * y)
        self.params = {"b": float(np.mean((y - f)[free] if free.any() else (y - f))), "x": x[a > 1e-8], "w": (a * y)[a > 1e-8]}
        return self

    def transform(self, df):
        p = self.fitted()
        out = df.withColumn("decision", kernel_sum(self.cols, p["x"], p["w"]) + p["b"])
        return out.withColumn("prediction", F.when(F.col("decision") > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))

    def score(self, df: DataFrame) -> float:
        return self.transform(df).agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0]


class KernelAnomalyDetector(Transformer):
    """One-class support vector machine with the RY kernel, fitted on all rows; +1 inside, -1 outside.

    In the feature map the dual weights are at most 1/(nu n) each, so w is the shortest of the weighted means of the rows.
    It is found by adding, in turn, the mean of the nu n rows with the lowest decision (three aggregates), and taking the
    shortest point of the hull, until the gap shows that w is within ``tol`` of the optimum. rho is the nu quantile of the
    decision over all rows. Rows with a null are left out of the fit."""

    BINS = 4096

    def __init__(self, cols: Sequence[str], nu: float = 0.1, tol: float = 1e-4, max_steps: int = 500):
        super().__init__(cols)
        if len(self.cols) > MAX_MAP:
            raise ValueError(f"the feature map is planned for up to {MAX_MAP} features")
        self.nu, self.tol, self.max_steps = nu, tol, max_steps

    def _map(self) -> list[Column]:
        norm = 2.0 ** (-len(self.cols) / 2)
        return [f * norm for f in feature_map([F.col(c).cast("double") for c in self.cols])]

    def _sums(self, rows: DataFrame, w: np.ndarray, width: int, of) -> np.ndarray:
        """Sum over all rows of ``of(features, decisions)``, an array of ``width``; one row a partition is gathered."""
        d = len(self.cols)

        def sums(batches):
            out = np.zeros(width)
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:d]], axis=1)
                phi = np.ones((len(x), 1))
                for k in range(d):
                    own = np.stack((np.ones(len(x)), np.cos(x[:, k]), np.sin(x[:, k])), axis=1)
                    phi = (phi[:, :, None] * own[:, None, :]).reshape(len(x), -1)
                phi *= 2.0 ** (-d / 2)
                out += of(phi, phi @ w)
            yield pa.record_batch([pa.array([out.tolist()])], ["v"])

        return sum((np.array(r[0]) for r in rows.mapInArrow(sums, "v array<double>").toLocalIterator()), np.zeros(width))

    def _tail(self, rows: DataFrame, w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
        """The nu quantile of the decision, and the mean of the nu n rows with the lowest (of those as low as the quantile, a share)."""
        bins, low, size, rest = self.BINS, -1e-9, 1 + 2e-9, self.nu * n
        for _ in range(2):  # decisions are means of kernel values, from 0 to 1
            size /= bins
            cell = lambda f, low=low, size=size: np.floor((f - low) / size).astype(np.int64)

            def histogram(phi, f, cell=cell):
                at = cell(f)
                return np.bincount(at[(at >= 0) & (at < bins)], minlength=bins)

            below = np.concatenate(([0.0], np.cumsum(self._sums(rows, w, bins, histogram))))
            at = int(np.clip(np.searchsorted(below, rest, "left") - 1, 0, bins - 1))
            rest, low = rest - below[at], low + at * size
        m = len(w)

        def moments(phi, f):
            under, equal = f < low, (f >= low) & (f < low + size)
            return np.concatenate((phi[under].sum(axis=0), phi[equal].sum(axis=0), [under.sum(), equal.sum()]))

        s = self._sums(rows, w, 2 * m + 2, moments)
        share = min(1.0, max(0.0, (self.nu * n - s[-2]) / max(1.0, s[-1])))
        return low, (s[:m] + share * s[m : 2 * m]) / (s[-2] + share * s[-1])

    def fit(self, df):
        rows = stored(df.select(*[F.col(c).cast("double").alias(c) for c in self.cols]).dropna(), "anomaly")
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit")
        m = 3 ** len(self.cols)
        w = self._sums(rows, np.zeros(m), m, lambda phi, f: phi.sum(axis=0)) / n
        points, a = w[None], np.ones(1)
        for _ in range(self.max_steps):
            rho, lowest = self._tail(rows, w, n)
            if w @ w - w @ lowest <= self.tol * (w @ w):
                self.params = {"rho": rho, "w": w}
                return self
            points, a = np.vstack((points, lowest)), np.append(a, 0.0)
            g = points @ points.T
            a = solve_box(g, np.zeros(len(a)), 1.0, np.ones(len(a)), a)
            w = a @ points
            points, a = points[a > 1e-12], a[a > 1e-12]
            w, a = w / a.sum(), a / a.sum()
        raise RuntimeError(f"not within {self.tol} of the optimum after {self.max_steps} steps")

    def transform(self, df):
        p = self.fitted()
        decision = sum((f * float(v) for f, v in zip(self._map(), p["w"], strict=True)), F.lit(0.0)) - p["rho"]
        return df.withColumn("decision", decision).withColumn("prediction", F.when(F.col("decision") >= 0, 1).otherwise(-1))


class Autoencoder(Transformer):
    """Compression to the first columns and zeros for the rest."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], n_latent: int):
        super().__init__(cols)
        if not 0 < n_latent <= len(self.cols):
            raise ValueError("n_latent must be between 1 and the number of columns")
        self.n_latent = n_latent

    def fit(self, df):
        if lacking := [c for c in self.cols if c not in df.columns]:
            raise ValueError(f"missing columns {lacking}")
        return super().fit(df)

    def transform(self, df):
        self.fitted()
        return df.drop(*self.cols[self.n_latent :])

    compress = transform

    def decompress(self, df: DataFrame) -> DataFrame:
        self.fitted()
        return df.withColumns({c: F.lit(0.0) for c in self.cols[self.n_latent :]})

    def compression_ratio(self) -> float:
        return self.n_latent / len(self.cols)


class SeededModel(Transformer):
    """tanh(sum of features * sum of seeded weights): weights stay as they were drawn, as in the reference."""

    def __init__(self, cols: Sequence[str], n_weights: int = 8, seed: int = 42, scale: float = 0.1, mean: bool = False):
        super().__init__(cols)
        self.n_weights, self.seed, self.scale, self.mean = n_weights, seed, scale, mean

    def fit(self, df=None):
        w = np.random.default_rng(self.seed).standard_normal(self.n_weights) * self.scale
        self.params = {"weight": float(w.mean() if self.mean else w.sum())}
        return self

    def transform(self, df):
        w = self.fitted()["weight"]
        return df.withColumn("prediction", F.tanh(total([F.col(c).cast("double") for c in self.cols]) * w))


class NeuralNetwork(SeededModel):
    def __init__(self, cols: Sequence[str], n_qubits: int = 4, layers: int = 2, seed: int = 42):
        super().__init__(list(cols)[:n_qubits], n_qubits * layers, seed)


class MetaLearner(SeededModel):
    def __init__(self, cols: Sequence[str], seed: int = 42):
        super().__init__(cols, max(1, len(list(cols))), seed, mean=True)


class TransferLearning(Transformer):
    """tanh of a fixed seeded projection."""

    def __init__(self, cols: Sequence[str], seed: int = 42):
        super().__init__(cols)
        self.seed = seed

    def fit(self, df=None):
        self.params = {"w": np.random.default_rng(self.seed).standard_normal(len(self.cols)).tolist()}
        return self

    def transform(self, df):
        w = self.fitted()["w"]
        return df.withColumn("prediction", F.tanh(total([F.col(c).cast("double") * v for c, v in zip(self.cols, w, strict=True)])))


def ensemble_shards(df: DataFrame, key: str, n_models: int = 3) -> DataFrame:
    """``df`` with the model that learns from each row: rows in turn."""
    return numbered(df, key).withColumn("model", F.col("rn") % n_models).drop("rn")


class Ensemble(Transformer):
    """Votes of classifiers fitted on shards of the rows; 'majority' or 'average' of decisions."""

    def __init__(self, cols: Sequence[str], label: str, key: str, n_models: int = 3, voting: str = "majority"):
        super().__init__(cols)
        self.label, self.key, self.n_models, self.voting = label, key, n_models, one_of(voting, ("majority", "average"), "voting")

    def fit(self, df):
        shards = ensemble_shards(df, self.key, self.n_models)
        self.params = {"models": [KernelSVC(self.cols, self.label).fit(shards.where(F.col("model") == m)) for m in range(self.n_models)]}
        return self

    def transform(self, df):
        models = self.fitted()["models"]
        parts = [kernel_sum(self.cols, m.params["x"], m.params["w"]) + m.params["b"] for m in models]
        votes = total([F.signum(p) for p in parts] if self.voting == "majority" else parts)
        low, high = models[0].classes
        return df.withColumn("votes", votes).withColumn("prediction", F.when(F.col("votes") > 0, F.lit(high)).otherwise(F.lit(low)))


def series_windows(df: DataFrame, order: str, value: str, lookback: int = 5, horizon: int = 1, *, by: Sequence[str]) -> DataFrame:
    """(by, order, x, y): sliding windows of ``lookback`` values and the next ``horizon``; series ``by`` key, which is needed
    as one window over a whole table would be one task."""
    if not by:
        raise ValueError("series need a key")
    frame = W.partitionBy(*by).orderBy(order).rowsBetween(0, lookback + horizon - 1)
    rows = df.select(*by, order, F.collect_list(F.col(value)).over(frame).alias("__v")).where(F.size("__v") == lookback + horizon)
    return rows.select(*by, order, F.slice("__v", 1, lookback).alias("x"), F.slice("__v", lookback + 1, horizon).alias("y"))
