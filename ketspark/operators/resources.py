"""Error mitigation, calibration, layout, scheduling, allocation, privacy and noise parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import CapacityError, Transformer, one_of
from ketspark.plans.numbering import numbered


class ErrorMitigation(Transformer):
    """Zero-noise extrapolation: clip(result / (1 - mean error), 0, 1); other methods pass through."""

    def __init__(self, col: str, method: str = "zero_noise_extrapolation"):
        super().__init__([col])
        self.method = method

    def fit(self, df):
        self.params = {"error": df.agg(F.avg(1 - F.col(self.cols[0]))).first()[0] or 0.0}
        return self

    def transform(self, df):
        e, c = self.fitted()["error"], F.col(self.cols[0])
        if self.method != "zero_noise_extrapolation" or e >= 1:
            return df.withColumn("mitigated", c)
        return df.withColumn("mitigated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c / (1 - e))))


def damped(v: Column, rate: float) -> Column:
    """Amplitude damping and renormalisation of an amplitude array."""
    low = F.transform(v, lambda x: x * (1 - rate))
    norm = F.sqrt(F.aggregate(low, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, low).otherwise(F.transform(low, lambda x: F.try_divide(x, norm)))


def depolarized(v: Column, key: Column, rate: float, seed: int = 42) -> Column:
    """Swaps two amplitudes of a row with probability ``rate``, by md5 of seed and key."""
    number = lambda at: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), at, 8), 16, 10).cast("long")
    i, j = (number(9) % F.size(v)).cast("int"), (number(17) % F.size(v)).cast("int")
    swapped = F.transform(v, lambda x, k: F.when(k == i, F.get(v, j)).when(k == j, F.get(v, i)).otherwise(x))
    return F.when(number(1) / float(2**32) < rate, swapped).otherwise(v)


def circuit_fidelity(n_gates: Column, gate_error: Column | float = 1e-3, readout_error: Column | float = 1e-2) -> Column:
    """max(0, 1 - (e + r (1 - e))) with e = 1 - (1 - g)^n."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    e = 1 - F.pow(1 - col(gate_error), n_gates)
    return F.greatest(F.lit(0.0), 1 - (e + col(readout_error) * (1 - e)))


def best_qubits(calibration: DataFrame, qubit: str, error: str, n: int) -> DataFrame:
    """The ``n`` qubits with the lowest readout error; a missing error counts as 1."""
    return calibration.select(F.col(qubit).alias("qubit"), F.coalesce(F.col(error), F.lit(1.0)).alias("error")).orderBy("error", "qubit").limit(n)


def schedule_order(tasks: DataFrame, priority: str, seq: str) -> DataFrame:
    """``tasks`` with their place: by priority, highest first, then first come first served."""
    return numbered(tasks, F.desc(priority), F.asc(seq), name="place")


def admitted(tasks: DataFrame, seq: str, need: str, capacity: int) -> DataFrame:
    """``tasks`` with what all up to each need, and whether that is within the capacity.

    Sums go by range of ``seq`` first, so that no window spans all tasks."""
    from pyspark.sql import Window as W

    placed = numbered(tasks, seq, name="__rn").withColumn("__block", F.floor(F.col("__rn") / 10_000))
    blocks = placed.groupBy("__block").agg(F.sum(need).alias("__sum"))
    before = blocks.select(F.col("__block"), (F.sum("__sum").over(W.orderBy("__block")) - F.col("__sum")).alias("__before"))  # a row for 10,000 tasks
    own = F.sum(need).over(W.partitionBy("__block").orderBy("__rn"))
    out = placed.withColumn("__own", own).join(before, "__block").withColumn("allocated", F.col("__before") + F.col("__own"))
    return out.withColumn("fits", F.col("allocated") <= capacity).drop("__rn", "__block", "__own", "__before")


def degraded_accuracy(accuracy: Column, p: float = 0.01) -> Column:
    """max(0, accuracy (1 - 30 p))."""
    return F.greatest(F.lit(0.0), accuracy * (1 - 30 * p))


class DifferentialPrivacy:
    """Flip probability and loss of a privacy budget."""

    def __init__(self, epsilon: float = 1.0):
        if epsilon <= 0:
            raise ValueError("epsilon must be positive")
        self.epsilon = epsilon

    def parameters(self) -> dict:
        level = "HIGH" if self.epsilon < 0.5 else "MEDIUM" if self.epsilon < 2 else "LOW"
        return {"epsilon": self.epsilon, "noise_probability": 1 / (1 + math.exp(self.epsilon)), "privacy_level": level}

    def loss(self, n_queries: Column) -> Column:
        return F.when(n_queries > 0, self.epsilon * F.sqrt(n_queries))


def check_capacity(n_features: int, max_qubits: int = 127) -> bool:
    if n_features > max_qubits:
        raise CapacityError(f"{n_features} features need more than {max_qubits} qubits")
    return True


def calibration(backend: dict | None, gate: str = "average") -> tuple[float, float]:
    """(gate error, readout error) of stored calibration data, with the defaults for what it lacks."""
    if backend is None:
        return 0.01, 0.01
    one_of(gate, ("average", "single", "two"), "gate")
    return backend.get("gate_error", {"average": 1e-3, "single": 1e-3, "two": 5e-3}[gate]), backend.get("readout_error", 1e-2)
