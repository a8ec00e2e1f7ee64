"""A two-class support vector machine with the RY kernel over all rows, solved in the primal.

The kernel becomes a feature map by landmarks (``landmarks``), in which the decision is linear: w phi(x) + b. The hinge loss is rounded
over a small width around its corner; for each width Newton steps lead to the optimum, every step being one aggregate of value, gradient and
second derivatives over all rows, of which a task sends one sum. At an optimum the rows' slopes are weights between 0 and C that both
classes share equally, so they are a feasible dual solution; the gap between the true primal and this dual value shows how far the
optimum can be, and the width is narrowed until the gap is at most ``tol`` of the value.

Rows with a null or NaN feature or a null label are left out of a fit, and have a null decision and prediction. Exactly two classes are needed.
Repeated rows count as often as they are there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer
from ketspark.operators.landmarks import LandmarkMap, known, ry
from ketspark.plans.storage import stored


class PrimalSVC(Transformer):
    """``params``: w, b, value (of the primal), gap, steps."""

    def __init__(self, cols: Sequence[str], label: str, C: float = 1.0, tol: float = 1e-3, rest: float = 1e-6, most: int = 2000, max_steps: int = 300):
        super().__init__(cols)
        if C <= 0 or tol <= 0:
            raise ValueError("C and tol must be positive")
        self.label, self.C, self.tol, self.max_steps = label, C, tol, max_steps
        self.map = LandmarkMap(cols, ry, rest, most)

    def _sums(self, rows: DataFrame, w: np.ndarray, width: float) -> tuple[float, float, np.ndarray, np.ndarray, float]:
        """Hinge loss, rounded loss, its gradient and second derivatives in (w, b), and the sum of all slopes."""
        p, d, m, phi, step = self.map.fitted(), len(self.cols), len(w), self.map._phi, LandmarkMap.ROWS
        z, factor = p["landmarks"], p["factor"]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, second = np.zeros(3 + m), np.zeros((m, m))
            for batch in batches:
                x, y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), batch.column(1).to_numpy(zero_copy_only=False)
                for at in range(0, len(x), step):
                    own = y[at : at + step]
                    f = np.column_stack((phi(x[at : at + step], z, factor), np.ones(len(own))))
                    short = 1 - own * (f @ w)
                    bend = np.abs(short) <= width
                    slope = np.where(bend, (short + width) / (2 * width), (short > 0).astype(float))
                    rounded = np.where(bend, (short + width) ** 2 / (4 * width), np.maximum(short, 0.0))
                    out += np.concatenate(([np.maximum(short, 0.0).sum(), rounded.sum(), slope.sum()], -(slope * own) @ f))
                    second += f[bend].T @ f[bend] / (2 * width)
            yield pa.record_batch([pa.array([[*out.tolist(), *second.ravel().tolist()]], pa.list_(pa.float64()))], ["v"])

        total = sum((np.array(r[0]) for r in rows.mapInArrow(sums, "v array<double>").toLocalIterator()), np.zeros(3 + m + m * m))
        return total[0], total[1], total[3 : 3 + m], total[3 + m :].reshape(m, m), total[2]

    def fit(self, df):
        labels = df.select(self.label).where(F.col(self.label).isNotNull())
        self.classes = [r[0] for r in labels.distinct().orderBy(self.label).limit(3).collect()]
        if len(self.classes) != 2:
            raise ValueError("two classes are needed")
        rows = df.where(F.col(self.label).isNotNull())
        self.map.fit(rows)
        rows = stored(known(rows, self.cols, F.when(F.col(self.label) == self.classes[1], 1.0).otherwise(-1.0).alias("y")), "svc")
        w, width, steps = np.zeros(len(self.map.params["landmarks"]) + 1), 1.0, 0  # at first all rows are in the bend
        flat = np.append(np.ones(len(w) - 1), 0.0)  # b is free
        value = lambda w, loss: 0.5 * (flat * w) @ w + self.C * loss
        now = self._sums(rows, w, width)
        floor = np.append(np.zeros(len(w) - 1), 1e-3 * self.C * rows.count())  # for b, where no row is in the bend
        while True:
            # Newton's steps for this width
            while True:
                gradient = flat * w + self.C * now[2]
                move = np.linalg.solve(np.diag(flat + floor) + self.C * now[3], -gradient)
                if -gradient @ move <= 1e-4 * self.tol * max(value(w, now[1]), 1e-12):
                    break
                share = 1.0
                while True:
                    if (steps := steps + 1) > self.max_steps:
                        raise RuntimeError(f"not within {self.tol} of the optimum after {self.max_steps} steps")
                    new = self._sums(rows, w + share * move, width)
                    if value(w + share * move, new[1]) <= value(w, now[1]) + 1e-4 * share * (gradient @ move):
                        w, now = w + share * move, new
                        break
                    share /= 4
                    if share < 1e-6:
                        break
                if share < 1e-6:  # as near as doubles can tell
                    break
            dual_w = -self.C * now[2][:-1]
            primal, dual = value(w, now[0]), self.C * now[4] - 0.5 * dual_w @ dual_w
            if primal - dual <= self.tol * max(primal, 1e-12):
                self.params = {"w": w[:-1], "b": float(w[-1]), "value": primal, "gap": primal - dual, "steps": steps}
                return self
            width /= 4
            now, steps = self._sums(rows, w, width), steps + 1

    def transform(self, df):
        p = self.fitted()
        out = self.map.projected(df, p["w"][:, None], ["decision"]).withColumn("decision", F.col("decision") + p["b"])
        low, high = self.classes
        return out.withColumn("prediction", F.when(F.col("decision").isNotNull(), F.when(F.col("decision") > 0, F.lit(high)).otherwise(F.lit(low))))

    def score(self, df: DataFrame) -> float:
        return self.transform(df).agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0]
