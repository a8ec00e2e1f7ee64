"""Feature maps of product kernels in any number of features, by landmarks with a stated error.

A pivoted Cholesky factor of the kernel is built from some rows, the landmarks: phi(x) = K(x, Z) R^-1 with R R' = K(Z, Z). Its
inner products are the kernel's but for a rest, whose matrix has no negative eigenvalue; so no entry of the rest is larger than the largest
rest on the diagonal, 1 - |phi(x)|^2, which is measured over all rows. Landmarks are added until that is at most ``tol``: every
pass over the rows brings the ``batch`` rows with the largest rests, of which the driver takes one after the other while their own rest is
still over half of the pass's largest. The driver holds landmarks only, ``most`` of them at most; beyond that an error tells the rest that is left.

Rows with a null or NaN feature are left out of a fit and have a null map. Repeated rows have no rest after the first of them. Rows of
equal rests are taken in order of their features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer
from ketspark.plans.storage import stored


def ry(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """prod cos^2((a_i - b_i) / 2) of all rows of both."""
    out = np.ones((len(a), len(b)))
    for i in range(a.shape[1]):
        out *= np.cos((a[:, i, None] - b[None, :, i]) / 2) ** 2
    return out


def regressor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """prod cos^2(pi (a_i - b_i)) of all rows of both."""
    return ry(2 * math.pi * a, 2 * math.pi * b)


def known(df: DataFrame, cols: Sequence[str], *others: Column) -> DataFrame:
    """(v: the features as an array, others), without rows that lack a feature."""
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return df.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x))).select(v.alias("v"), *others)


class LandmarkMap(Transformer):
    """phi of all rows; ``params``: landmarks, factor, largest (rest of any row of the fit) and total (their sum)."""

    #: rows of a task in hand at a time
    ROWS = 4096

    def __init__(self, cols: Sequence[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = ry, tol: float = 1e-3, most: int = 2000, batch: int = 64):
        super().__init__(cols)
        self.kernel, self.tol, self.most, self.batch = kernel, tol, most, batch

    def fit(self, df):
        rows, d = stored(known(df, self.cols), "landmarks"), len(self.cols)
        z, factor = np.empty((0, d)), np.empty((0, 0))
        while True:
            rests = rows.select("v", self._rest(z, factor)("v").alias("rest"))
            n, largest, total = rests.agg(F.count("*"), F.max("rest"), F.sum("rest")).first()
            if not n or largest <= self.tol:
                self.params = {"landmarks": z, "factor": factor, "n": n, "largest": largest or 0.0, "total": total or 0.0}
                return self
            if len(z) >= self.most:
                raise ValueError(f"after {len(z)} landmarks a rest of {largest:.3g} is left, over tol = {self.tol}")
            found = rests.dropDuplicates(["v"]).orderBy(F.desc("rest"), "v").limit(self.batch).collect()
            z = self._grown(z, factor, np.array([r.v for r in found]), largest)
            factor = np.linalg.cholesky(self.kernel(z, z) + 1e-10 * np.eye(len(z)))

    def _grown(self, z: np.ndarray, factor: np.ndarray, candidates: np.ndarray, largest: float) -> np.ndarray:
        own = self._phi(candidates, z, factor)
        rest = self.kernel(candidates, candidates) - own @ own.T
        taken: list[int] = []
        while len(z) + len(taken) < self.most:
            diagonal = np.diag(rest)
            p = int(diagonal.argmax())
            if diagonal[p] < max(self.tol / 2, largest / 2) and taken:
                break
            taken.append(p)
            rest = rest - np.outer(rest[:, p], rest[p]) / diagonal[p]
        return np.concatenate((z, candidates[taken]))

    def _phi(self, x: np.ndarray, z: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return np.linalg.solve(factor, self.kernel(z, x)).T if len(z) else np.zeros((len(x), 0))

    def _rest(self, z: np.ndarray, factor: np.ndarray):
        phi, d, step = self._phi, len(self.cols), self.ROWS

        @F.arrow_udf("double")
        def rest(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            parts = [(phi(x[at : at + step], z, factor) ** 2).sum(axis=1) for at in range(0, len(x), step)]
            return pa.array(1 - np.concatenate(parts) if parts else np.empty(0))

        return rest

    def moments(self, df: DataFrame, y: Column | None = None) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows, mean of (phi, y) and mean of their products; a row a partition comes to the driver."""
        p, d, phi, step = self.fitted(), len(self.cols), self._phi, self.ROWS
        z, factor = p["landmarks"], p["factor"]
        m = len(z) + (y is not None)
        rows = known(df, self.cols, *([y.cast("double").alias("y")] if y is not None else []))
        rows = rows.where("y is not null") if y is not None else rows

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, ss = 0, np.zeros(m), np.zeros((m, m))
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for at in range(0, len(x), step):
                    f = phi(x[at : at + step], z, factor)
                    if m > len(z):
                        f = np.column_stack((f, b.column(1).to_numpy(zero_copy_only=False)[at : at + step]))
                    n, s, ss = n + len(f), s + f.sum(axis=0), ss + f.T @ f
            yield pa.record_batch([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "ss"])

        n, s, ss = 0, np.zeros(m), np.zeros(m * m)
        for r in rows.mapInArrow(sums, "n long, s array<double>, ss array<double>").toLocalIterator():
            n, s, ss = n + r[0], s + np.array(r[1]), ss + np.array(r[2])
        return n, s / max(1, n), ss.reshape(m, m) / max(1, n)

    def projected(self, df: DataFrame, weights: np.ndarray, names: Sequence[str], shift: np.ndarray | None = None) -> DataFrame:
        """``df`` with a column for every column of ``weights``: (phi(x) - shift) weights; null for rows that lack a feature."""
        p, d, phi, step = self.fitted(), len(self.cols), self._phi, self.ROWS
        z, factor = p["landmarks"], p["factor"]
        off = np.zeros(weights.shape[1]) if shift is None else shift @ weights

        @F.arrow_udf("array<double>")
        def values(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            out = np.full((len(x), weights.shape[1]), np.nan)
            for at in range(0, len(x), step):
                own = x[at : at + step]
                out[at : at + step] = phi(own, z, factor) @ weights - off
            flat = pa.array(out.ravel(), mask=np.isnan(out.ravel()))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * weights.shape[1]), flat)

        # the function gets NaN for what is lacking, and gives null
        v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.cols])
        out = df.withColumn("__values", values(v))
        return out.withColumns({name: F.get("__values", F.lit(k)) for k, name in enumerate(names)}).drop("__values")

    def transform(self, df):
        m = len(self.fitted()["landmarks"])
        return self.projected(df, np.eye(m), [f"phi{i}" for i in range(m)])


class LandmarkRidge(Transformer):
    """Kernel ridge regression in any number of features.

    With E the rest's matrix, predictions of the rows of the fit differ from those of the whole kernel by at most
    total(E) |y| / alpha in norm; ``params["bound"]`` is that number."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], target: str, alpha: float = 1.0, tol: float = 1e-3, most: int = 2000):
        super().__init__(cols)
        self.target, self.alpha, self.map = target, alpha, LandmarkMap(cols, regressor, tol, most)

    def fit(self, df):
        rows = df.where(F.col(self.target).isNotNull() & ~F.isnan(F.col(self.target).cast("double")))
        own = self.map.fit(rows).params
        n, _, m = self.map.moments(rows, F.col(self.target))
        a, b = m[:-1, :-1] * n, m[:-1, -1] * n
        w = np.linalg.solve(a + self.alpha * np.eye(len(a)), b)
        self.params = {"w": w, "n_landmarks": len(w), "bound": own["total"] * math.sqrt(m[-1, -1] * n) / self.alpha}
        return self

    def transform(self, df):
        return self.map.projected(df, self.fitted()["w"][:, None], ["prediction"])


class LandmarkPCA(Transformer):
    """Kernel PCA in any number of features; the largest weight of each component is positive. Eigenvalues of the centred
    kernel differ from those found by at most the sum of all rests, ``params["bound"]``."""

    def __init__(self, cols: Sequence[str], n_components: int = 2, tol: float = 1e-3, most: int = 2000):
        super().__init__(cols)
        self.n_components, self.map = n_components, LandmarkMap(cols, ry, tol, most)

    def fit(self, df):
        own = self.map.fit(df).params
        n, mean, m = self.map.moments(df)
        values, vectors = np.linalg.eigh(m - np.outer(mean, mean))
        order = np.argsort(values)[::-1][: self.n_components]
        top = vectors[:, order]
        top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
        self.params = {"mean": mean, "top": top, "values": values[order] * n, "bound": own["total"]}
        return self

    def transform(self, df):
        p = self.fitted()
        return self.map.projected(df, p["top"], [f"pc{k}" for k in range(p["top"].shape[1])], p["mean"])


def mmd(reference: DataFrame, new: DataFrame, cols: Sequence[str], tol: float = 1e-3, most: int = 2000) -> DataFrame:
    """(reference_size, new_size, mmd_score, bound): the squared distance of mean maps in any number of features. The exact
    score is at most ``bound`` larger: the rests of both means together."""
    own = LandmarkMap(cols, ry, tol, most).fit(reference.select(*cols).unionByName(new.select(*cols)))
    (n, a, _), (m, b, _) = own.moments(reference), own.moments(new)
    return reference.sparkSession.createDataFrame([(n, m, float(((a - b) ** 2).sum()), 4 * float(own.params["largest"]))], "reference_size long, new_size long, mmd_score double, bound double")
