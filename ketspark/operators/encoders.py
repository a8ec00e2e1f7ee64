"""Row to circuit encoders as Column expressions over a feature array.

A circuit is a struct (n_qubits, gates); a gate is a struct (type, qubits, params). Which gates a circuit has
follows from the encoder's settings; only the parameters depend on the row, so each encoder is a fixed
array of structs and stays inside the projection. ``n_features`` is the length of the feature array.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import one_of
from ketspark.functions.arrays import norm2

GATE = "struct<type:string,qubits:array<int>,params:array<double>>"
CIRCUIT = f"struct<n_qubits:int,gates:array<{GATE}>>"


def gate(kind: str, qubits: Sequence[int], *params: Column | float) -> Column:
    values = [p if isinstance(p, Column) else F.lit(float(p)) for p in params]
    return F.struct(F.lit(kind).alias("type"), F.array(*[F.lit(q) for q in qubits]).alias("qubits"), F.array(*values).cast("array<double>").alias("params")).cast(GATE)


def gates(items: Sequence[Column]) -> Column:
    return F.array(*items) if items else F.array().cast(f"array<{GATE}>")


class Encoder:
    """``encode(v)``: gates of the feature array ``v``; ``transform`` adds the circuit to a DataFrame."""

    def __init__(self, n_qubits: int, n_features: int | None = None):
        if n_qubits < 1:
            raise ValueError("n_qubits must be positive")
        self.n_qubits, self.n_features = n_qubits, n_qubits if n_features is None else n_features

    @property
    def used(self) -> int:
        return min(self.n_features, self.n_qubits)

    def x(self, v: Column, i: int) -> Column:
        return F.get(v, F.lit(i))

    def chain(self, n: int | None = None) -> list[Column]:
        return [gate("cx", (i, i + 1)) for i in range((self.n_qubits if n is None else n) - 1)]

    def encode(self, v: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame, col: str = "features", out_col: str = "circuit") -> DataFrame:
        return df.withColumn(out_col, F.struct(F.lit(self.n_qubits).alias("n_qubits"), self.encode(F.col(col)).alias("gates")).cast(CIRCUIT))


class RotationEncoder(Encoder):
    """RY of each feature; the angles are bound from the row."""

    def encode(self, v):
        return gates([gate("ry", (i,), self.x(v, i)) for i in range(self.used)])


def amplitudes(v: Column, size: int, normalize: bool = True, zero_state: bool = False) -> Column:
    """``v`` padded or cut to ``size`` and of norm 1; a zero vector stays, or becomes the zero state."""
    padded = F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)
    if not normalize:
        return padded
    norm = norm2(padded)
    zero = F.array(F.lit(1.0), *[F.lit(0.0)] * (size - 1)) if zero_state else padded
    return F.when(norm == 0, zero).otherwise(F.transform(padded, lambda a: F.try_divide(a, norm)))


class StatevectorEncoder(Encoder):
    """One initialise gate with the features as amplitudes, padded to the next power of two."""

    def __init__(self, n_features: int):
        super().__init__(max(1, math.ceil(math.log2(max(1, n_features)))), n_features)

    def amplitudes(self, v: Column) -> Column:
        return amplitudes(v, 2**self.n_qubits)

    def encode(self, v):
        g = F.struct(F.lit("initialize").alias("type"), F.array(*[F.lit(q) for q in range(self.n_qubits)]).alias("qubits"), self.amplitudes(v).alias("params"))
        return F.array(g.cast(GATE))


class AmplitudeEncoder(StatevectorEncoder):
    """Amplitudes padded or cut to 2^n_qubits; nothing at all becomes the zero state."""

    def __init__(self, n_qubits: int, normalize: bool = True):
        Encoder.__init__(self, n_qubits, 2**n_qubits)
        self.normalize = normalize

    def amplitudes(self, v):
        return amplitudes(v, 2**self.n_qubits, self.normalize, zero_state=True)


class DensityMatrixEncoder(Encoder):
    """RY(pi x) of the normalised features and a CX chain; ``density`` gives the outer product."""

    def unit(self, v: Column) -> Column:
        norm = norm2(v)
        return F.transform(v, lambda a: a / F.when(norm == 0, 1.0).otherwise(norm))

    def encode(self, v):
        u = self.unit(v)
        return gates([*[gate("ry", (i,), self.x(u, i) * math.pi) for i in range(self.used)], *self.chain()])

    def density(self, df: DataFrame, key: str, col: str) -> DataFrame:
        """(key, i, j, value) of the 2^n x 2^n matrix."""
        size = 2**self.n_qubits
        u = amplitudes(F.col(col), size)
        rows = df.select(key, u.alias("__u")).select(key, "__u", F.posexplode("__u").alias("i", "__a"))
        return rows.select(key, "i", "__a", F.posexplode("__u").alias("j", "__b")).select(key, "i", "j", (F.col("__a") * F.col("__b")).alias("value"))


class BasisChangeEncoder(Encoder):
    """RY(pi x / largest) and the change to basis 'x', 'y' or 'z'."""

    def __init__(self, n_qubits: int, basis: str = "z", n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.basis = one_of(basis, ("x", "y", "z"), "basis")

    def encode(self, v):
        top = F.array_max(F.transform(v, F.abs)) + 1e-10
        out = [gate("ry", (i,), self.x(v, i) / top * math.pi) for i in range(self.used)]
        out += [gate("sdg", (i,)) for i in range(self.n_qubits) if self.basis == "y"]
        out += [gate("h", (i,)) for i in range(self.n_qubits) if self.basis in ("x", "y")]
        return gates(out)


class FeatureMapEncoder(Encoder):
    """H, RZ of the mapped features, CX chain, ``reps`` times."""

    def __init__(self, n_qubits: int, mapping: str = "linear", power: int = 1, reps: int = 1, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.mapping, self.power, self.reps = one_of(mapping, ("linear", "polynomial", "trigonometric"), "mapping"), power, reps

    def mapped(self, x: Column) -> Column:
        return {"linear": lambda: x, "polynomial": lambda: F.pow(x, F.lit(float(self.power))), "trigonometric": lambda: F.sin(x)}[self.mapping]()

    def encode(self, v):
        layer = [gate("h", (i,)) for i in range(self.n_qubits)] + [gate("rz", (i,), self.mapped(self.x(v, i))) for i in range(self.used)] + self.chain()
        return gates(layer * self.reps)


class AngleEncoder(Encoder):
    """Rotation by each feature, 'rx', 'ry', 'rz' or 'auto' (in turn)."""

    TURN = ("rx", "ry", "rz")

    def __init__(self, n_qubits: int, angle_type: str = "rx", reps: int = 1, scale: float = 1.0, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.kind, self.reps, self.scale = one_of(angle_type, (*self.TURN, "auto"), "angle_type"), reps, scale

    def encode(self, v):
        kind = lambda i: self.TURN[i % 3] if self.kind == "auto" else self.kind
        return gates([gate(kind(i), (i,), self.x(v, i) * self.scale) for i in range(self.used)] * self.reps)


class PhaseEncoder(Encoder):
    """P of the features scaled to 2 pi, and CP of half of it to the next qubit."""

    def __init__(self, n_qubits: int, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        if self.n_features < n_qubits:
            raise IndexError("the phase encoder needs a feature for each qubit")

    def encode(self, v):
        top = F.array_max(F.transform(v, F.abs))
        x = [self.x(v, i) * 2 * math.pi / F.when(top == 0, 1.0).otherwise(top) for i in range(self.used)]
        return gates([gate("p", (i,), a) for i, a in enumerate(x)] + [gate("cp", (i, i + 1), x[i] / 2) for i in range(self.n_qubits - 1)])


class HybridAnglePhaseEncoder(Encoder):
    """RY and P of each feature by weights of sum 1, and a CX chain."""

    def __init__(self, n_qubits: int, angle_weight: float = 0.5, phase_weight: float = 0.5, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        whole = angle_weight + phase_weight
        self.weights = angle_weight / whole, phase_weight / whole

    def encode(self, v):
        a, p = self.weights
        return gates([g for i in range(self.used) for g in (gate("ry", (i,), self.x(v, i) * a), gate("p", (i,), self.x(v, i) * p))] + self.chain())


class MultiAxisRotationEncoder(Encoder):
    """For each axis a rotation by x (1 + a/4) and a CX chain over the used qubits."""

    def __init__(self, n_qubits: int, axes: Sequence[str] = ("x", "y", "z"), n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.axes = [one_of(a, ("x", "y", "z"), "axis") for a in axes]

    def encode(self, v):
        return gates([g for a, axis in enumerate(self.axes) for g in [*[gate(f"r{axis}", (i,), self.x(v, i) * (1 + 0.25 * a)) for i in range(self.used)], *self.chain(self.used)]])


class ParametricAngleEncoder(Encoder):
    """RY of the features and RZ of trainable parameters, drawn once from a seed."""

    def __init__(self, n_qubits: int, n_params: int | None = None, sharing: bool = False, seed: int = 42, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.sharing = sharing
        self.parameters = (0.1 * np.random.default_rng(seed).standard_normal(n_params or n_qubits)).tolist()

    def update_parameters(self, values: Sequence[float]) -> None:
        if len(values) != len(self.parameters):
            raise ValueError(f"{len(self.parameters)} parameters are needed")
        self.parameters = list(map(float, values))

    def encode(self, v):
        n = len(self.parameters)
        k = lambda i: i % n if self.sharing else min(i, n - 1)
        return gates([g for i in range(self.used) for g in (gate("ry", (i,), self.x(v, i)), gate("rz", (i,), self.parameters[k(i)]))])


class IQPEncoder(Encoder):
    """H, RZ of each feature, RZZ of neighbours' products, ``reps`` times."""

    def __init__(self, n_qubits: int, reps: int = 2, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.reps = reps

    def encode(self, v):
        layer = [gate("h", (i,)) for i in range(self.n_qubits)] + [gate("rz", (i,), self.x(v, i)) for i in range(self.used)]
        layer += [gate("rzz", (i, i + 1), self.x(v, i) * self.x(v, i + 1)) for i in range(self.used - 1)]
        return gates(layer * self.reps)


class CompositeEncoder(Encoder):
    """Circuits of several encoders one after the other."""

    def __init__(self, n_qubits: int, encoders: Sequence[Encoder] = ()):
        super().__init__(n_qubits)
        self.encoders = list(encoders)

    def add(self, encoder: Encoder) -> CompositeEncoder:
        self.encoders.append(encoder)
        return self

    def encode(self, v):
        return F.concat(*[e.encode(v) for e in self.encoders]) if self.encoders else gates([])


class LayeredEncoder(Encoder):
    """Layers of RY, entanglement ('linear', 'full' or 'chain' of even pairs) and P."""

    def __init__(self, n_qubits: int, n_layers: int = 2, entangle: str = "linear", n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.n_layers, self.entangle = n_layers, one_of(entangle, ("linear", "full", "chain"), "entangle")

    def pairs(self) -> list[tuple[int, int]]:
        n = self.n_qubits
        if self.entangle == "full":
            return [(i, j) for i in range(n) for j in range(i + 1, n)]
        return [(i, i + 1) for i in range(0, n - 1, 1 if self.entangle == "linear" else 2)]

    def encode(self, v):
        out = []
        for layer in range(self.n_layers):
            out += [gate("ry", (i,), self.x(v, i) * (1 + 0.5 * layer)) for i in range(self.used)]
            out += [gate("cx", p) for p in self.pairs()]
            out += [gate("p", (i,), self.x(v, i % self.n_features) * layer) for i in range(self.n_qubits)]
        return gates(out)


class DataReuseEncoder(Encoder):
    """Blocks of qubits that take the features in turn: RX in even, RY in odd blocks."""

    def __init__(self, n_qubits: int, n_reuses: int = 2, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.n_reuses = n_reuses

    def encode(self, v):
        size = self.n_qubits // self.n_reuses
        return gates([gate("rx" if r % 2 == 0 else "ry", (r * size + k,), self.x(v, k % self.n_features) * (1 + r * math.pi / self.n_reuses)) for r in range(self.n_reuses) for k in range(size)])


class AdaptiveEncoder(Encoder):
    """Sparse rows RX of what is not zero; rows with values over 2 RY and RZ of pi x; others dense."""

    def __init__(self, n_qubits: int, n_features: int | None = None, strategies: dict[str, Callable[[Column], Column]] | None = None, strategy: str = "auto"):
        super().__init__(n_qubits, n_features)
        self.strategies = {"sparse": self.sparse, "normalized": self.normalized, "dense": self.dense} | (strategies or {})
        self.strategy = strategy

    def sparse(self, v: Column) -> Column:
        own = [F.when(self.x(v, i) != 0, gate("rx", (i,), self.x(v, i))) for i in range(self.used)]
        return F.filter(F.array(*own), lambda g: g.isNotNull())

    def normalized(self, v: Column) -> Column:
        return gates([gate(k, (i,), self.x(v, i) * math.pi) for i in range(self.used) for k in ("ry", "rz")])

    def dense(self, v: Column) -> Column:
        norm = norm2(v)
        by = F.when(norm == 0, 1.0).otherwise(norm)
        return gates([gate("ry", (i,), self.x(v, i % self.n_features) / by) for i in range(self.n_qubits)] + self.chain())

    @staticmethod
    def sparsity(v: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.filter(v, lambda x: x == 0)), F.size(v)), F.lit(0.0))

    def encode(self, v):
        if self.strategy in self.strategies:
            return self.strategies[self.strategy](v)
        top = F.array_max(F.transform(v, F.abs))
        return F.when(self.sparsity(v) > 0.7, self.sparse(v)).when(top > 2, self.normalized(v)).otherwise(self.dense(v))

    def analyze(self, v: Column) -> Column:
        """Struct (sparsity, mean, std, max, norm) of a row."""
        n = F.size(v)
        mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), n)
        var = F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)), n)
        return F.struct(self.sparsity(v).alias("sparsity"), mean.alias("mean"), F.sqrt(var).alias("std"), F.array_max(F.transform(v, F.abs)).alias("max"), norm2(v).alias("norm"))


class HierarchicalEncoder(Encoder):
    """A block of qubits for each level: rotations RX, RY, RZ in turn by level, then CX inside the block, with
    steps that halve from level to level."""

    def __init__(self, n_qubits: int, levels: int = 2, n_features: int | None = None):
        super().__init__(n_qubits, n_features)
        self.levels = levels

    def encode(self, v):
        size, out = self.n_qubits // self.levels, []
        for level in range(self.levels):
            block, step = range(level * size, (level + 1) * size), 2 ** (self.levels - level - 1)
            out += [gate(("rx", "ry", "rz")[level % 3], (q,), self.x(v, k % self.n_features) / (level + 1)) for k, q in enumerate(block)]
            out += [gate("cx", (q, q + step)) for q in block[:-step:step]]
        return gates(out)


def exploded(df: DataFrame, key: str, circuit: str = "circuit") -> DataFrame:
    """(key, gate_no, type, q0, q1, param): one row a gate."""
    rows = df.select(key, F.posexplode(F.col(circuit)["gates"]).alias("gate_no", "g"))
    return rows.select(key, F.col("gate_no").cast("long").alias("gate_no"), F.col("g")["type"].alias("type"), F.get(F.col("g")["qubits"], F.lit(0)).cast("long").alias("q0"), F.get(F.col("g")["qubits"], F.lit(1)).cast("long").alias("q1"), F.get(F.col("g")["params"], F.lit(0)).alias("param"))


def _product(x: float | None, y: float | None) -> float | None:
    return None if x is None or y is None else x * y


def _iqp(x: list, repeats: int) -> list[tuple]:
    layer = [("h", i, None, None) for i in range(len(x))] + [("rz", i, None, v) for i, v in enumerate(x)]
    return (layer + [("rzz", i, i + 1, _product(x[i], x[i + 1])) for i in range(len(x) - 1)]) * repeats


#: gates (type, q0, q1, param) of one row of features, for table functions; the columns' own forms are the classes above
PROGRAMS = {
    "iqp": _iqp,
    "rotation": lambda x, _: [("ry", i, None, v) for i, v in enumerate(x)],
    "angle": lambda x, _: [(("rx", "ry", "rz")[i % 3], i, None, v) for i, v in enumerate(x)],
}
