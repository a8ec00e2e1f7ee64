"""Circuit rewriting, metrics, cost and OpenQASM over gate arrays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.operators.encoders import GATE, gate

ROTATIONS = ("rx", "ry", "rz", "p")
#: a gate of OpenQASM: name, parameters, qubits
GATE_LINE = r"^([a-z]\w*)\s*(?:\(([^)]*)\))?\s+(\w+\[\d+\].*)$"


def bare(kind: str, angle: float) -> Column:
    """A replacement gate: it has no qubit."""
    return gate(kind, (), angle)


def replaced(gates: Column, rules: dict[str, list[Column]], native: Sequence[str]) -> Column:
    def one(g: Column) -> Column:
        out = F.array(g)
        for kind, instead in rules.items():
            if kind not in native:
                out = F.when(g["type"] == kind, F.array(*instead)).otherwise(out)
        return out

    return F.flatten(F.transform(gates, one))


def compile_gates(gates: Column, native: Sequence[str] = ("rx", "ry", "rz", "cx")) -> Column:
    """Gates outside the native set become rotations, as far as there is a rule."""
    half, pi = math.pi / 2, math.pi
    return replaced(gates, {"h": [bare("ry", half), bare("rz", pi)], "x": [bare("rx", pi)], "y": [bare("ry", pi)], "z": [bare("rz", pi)]}, native)


def transpile_gates(gates: Column, native: Sequence[str] = ("rx", "ry", "rz", "cx")) -> Column:
    return replaced(gates, {"h": [bare("ry", math.pi / 2), bare("rz", math.pi)], "t": [bare("rz", math.pi / 4)]}, native)


def is_rotation(g: Column) -> Column:
    return g["type"].isin(*ROTATIONS[:3])


def param(g: Column) -> Column:
    return F.coalesce(F.get(g["params"], F.lit(0)), F.lit(0.0))


def qubit(g: Column) -> Column:
    return F.get(g["qubits"], F.lit(0))


def cancel_inverses(gates: Column, strict: bool = False) -> Column:
    """Drops neighbouring rotations of one type whose angles sum to 2 pi; qubits are compared only if strict."""
    start = F.struct(F.array().cast(f"array<{GATE}>").alias("out"), F.lit(None).cast(GATE).alias("held"))

    def step(a: Column, g: Column) -> Column:
        h = a["held"]
        undone = h.isNotNull() & is_rotation(g) & (h["type"] == g["type"]) & (F.abs(param(h) + param(g) - 2 * math.pi) < 1e-6)
        if strict:
            undone = undone & h["qubits"].eqNullSafe(g["qubits"])
        undone = F.coalesce(undone, F.lit(False))
        out = F.when(undone | h.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(h)))
        return F.struct(out.alias("out"), F.when(~undone, g).alias("held"))

    return F.aggregate(gates, start, step, lambda a: F.when(a["held"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["held"]))))


def merge_rotations(gates: Column, strict: bool = False) -> Column:
    """Adds neighbouring rotations on one qubit, across axes unless strict, under the first one's type."""
    start = F.array().cast(f"array<{GATE}>")

    def step(out: Column, g: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        same = is_rotation(last) & is_rotation(g) & qubit(last).eqNullSafe(qubit(g))
        if strict:
            same = same & (last["type"] == g["type"])
        joined = F.struct(last["type"].alias("type"), last["qubits"].alias("qubits"), F.array(param(last) + param(g)).alias("params")).cast(GATE)
        return F.when(F.coalesce(same, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(g)))

    return F.aggregate(gates, start, step)


def optimize_gates(gates: Column, passes: int = 5, strict: bool = False) -> Column:
    for _ in range(passes):
        gates = merge_rotations(cancel_inverses(gates, strict), strict)
    return gates


def depth(gates: Column, n_qubits: int) -> Column:
    """Longest chain of gates over shared qubits."""

    def step(levels: Column, g: Column) -> Column:
        at = F.array_max(F.transform(g["qubits"], lambda q: F.get(levels, q))) + 1
        return F.transform(levels, lambda old, i: F.when(F.array_contains(g["qubits"], i), at).otherwise(old))

    return F.coalesce(F.array_max(F.aggregate(gates, F.array_repeat(F.lit(0), n_qubits), step)), F.lit(0)).cast("long")


def metrics(df: DataFrame, key: str, n_qubits: int, circuit: str = "circuit") -> DataFrame:
    """(key, depth, n_gates, n_cx)."""
    g = F.col(circuit)["gates"]
    return df.select(key, depth(g, n_qubits).alias("depth"), F.size(g).cast("long").alias("n_gates"), F.size(F.filter(g, lambda x: x["type"] == "cx")).cast("long").alias("n_cx"))


def count_ops(df: DataFrame, circuit: str = "circuit") -> DataFrame:
    """(type, n) over all circuits."""
    return df.select(F.explode(F.col(circuit)["gates"]["type"]).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def job_cost(depth_: Column, shots: int = 1024, hardware_rate: float = 0.5) -> tuple[Column, Column]:
    """Modelled seconds and price, to 4 places."""
    seconds = depth_ * 1e-6 * shots + 0.1
    return F.round(seconds, 4), F.round(seconds * hardware_rate, 4)


def linear_cost(n_gates: Column, n_qubits: Column | int, per_gate: float = 0.01, per_qubit: float = 0.001) -> Column:
    return n_gates * per_gate + (n_qubits if isinstance(n_qubits, Column) else F.lit(n_qubits)) * per_qubit


def feasibility(n_samples: Column, n_features: Column, max_features: int = 127, many: int = 10_000) -> Column:
    return F.when(n_features > max_features, "INFEASIBLE: Too many features").when(n_samples > many, "EXPENSIVE: Consider reducing samples").otherwise("FEASIBLE")


def savings(before: Column, after: Column) -> Column:
    """Percent saved."""
    return F.when(before == 0, 0.0).otherwise((before - after) / before * 100)


def qasm(circuit: Column, n_qubits: int) -> Column:
    """OpenQASM 2 text."""
    line = lambda g: F.concat(g["type"], F.when(F.size(g["params"]) > 0, F.concat(F.lit("("), F.concat_ws(",", F.transform(g["params"], lambda p: p.cast("string"))), F.lit(")"))).otherwise(""), F.lit(" "), F.concat_ws(",", F.transform(g["qubits"], lambda q: F.concat(F.lit("q["), q.cast("string"), F.lit("]")))), F.lit(";"))
    return F.concat_ws("\n", F.lit("OPENQASM 2.0;"), F.lit('include "qelib1.inc";'), F.lit(f"qreg q[{n_qubits}];"), F.concat_ws("\n", F.transform(circuit["gates"], line)))


def product_probabilities(angles: Column, n_qubits: int) -> Column:
    """Probabilities of all 2^n outcomes after RY of each angle on its own qubit, qubit 0 lowest: products of squared
    cosines (bit 0) and sines (bit 1). Null if an angle is missing."""
    bit = lambda q, one: F.pow((F.sin if one else F.cos)(F.get(angles, F.lit(q)) / 2), F.lit(2.0))
    return F.array(*[reduce(lambda a, b: a * b, [bit(q, k >> q & 1) for q in range(n_qubits)]) for k in range(2**n_qubits)])


def from_qasm(text: Column) -> Column:
    """Gates of an OpenQASM 2 text, as ``qasm`` writes it; lines without a gate on a register, such as headers, comments
    and declarations, are passed over. Null stays null, an empty text has no gates."""
    lines = F.filter(F.transform(F.split(text, "[;\\n]"), F.trim), lambda x: x.rlike(GATE_LINE) & ~x.rlike(r"^(qreg|creg|include|//)"))
    values = lambda x, at, kind: F.transform(F.filter(F.split(F.regexp_extract(x, GATE_LINE, at), ","), lambda v: v != ""), lambda v: F.trim(v).cast(kind))
    one = lambda x: F.struct(F.regexp_extract(x, GATE_LINE, 1).alias("type"), F.transform(F.regexp_extract_all(F.regexp_extract(x, GATE_LINE, 3), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda q: q.cast("int")).alias("qubits"), values(x, 2, "double").alias("params"))
    return F.transform(lines, one)


def cost_breakdown(df: DataFrame, n_gates: str, n_qubits: str, per_gate: float = 0.01, per_qubit: float = 0.001) -> DataFrame:
    """(n_tasks, gate_cost, qubit_cost, total_cost) over all tasks; zeros without any."""
    gate_cost, qubit_cost = (F.coalesce(F.sum(F.col(c) * each), F.lit(0.0)) for c, each in ((n_gates, per_gate), (n_qubits, per_qubit)))
    return df.agg(F.count("*").alias("n_tasks"), gate_cost.alias("gate_cost"), qubit_cost.alias("qubit_cost"), (gate_cost + qubit_cost).alias("total_cost"))
