"""Weighted samples of rows that stand for a table when clusters are sought, built by merging and reducing.

A task reads its rows a chunk at a time, reduces every chunk to ``size`` weighted rows, and two such sets of one level to one
of the next, so it holds a few sets whatever the number of rows. The sets of all tasks are merged in the same way, FAN of
them in a task, until one is left: one pass over the table, and rounds in the logarithm of the tasks.

A set is reduced by sensitivity: some centres are drawn by their distance from each other, a row is drawn with a chance that grows with
its share of the cost and with the share of its centre's cluster, and stands for as much weight as its chance was small. The centres of
the clusters drawn from are kept right by giving each cluster's rows its whole weight, so weights sum to the number of rows.

Rows with a null or NaN feature are left out. Repeated rows may be drawn more than once and are then one row of more weight. A
table of at most ``size`` rows is its own coreset, with weights of 1; an empty one gives no rows. Draws follow a seed and the rows a task has, so a
result is repeatable for a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer
from ketspark.plans.storage import stored

#: sets that one task merges
FAN = 8


def distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance to the nearest centre, and its number."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]
    near = d.argmin(axis=1)
    return np.maximum(d[np.arange(len(x)), near], 0.0), near


def reduced(x: np.ndarray, w: np.ndarray, size: int, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``size`` weighted rows at most for the rows ``x`` with weights ``w``."""
    if len(x) <= size:
        return x, w
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    d, near = distances(x, centres)
    while len(centres) < k and (cost := float((w * d).sum())) > 0:
        new = x[[rng.choice(len(x), p=w * d / cost)]]
        closer, _ = distances(x, new)
        near, d = np.where(closer < d, len(centres), near), np.minimum(d, closer)
        centres = np.concatenate((centres, new))
    weight_of = np.bincount(near, w, len(centres))
    cost = float((w * d).sum())
    share = w / weight_of[near] / len(centres)  # an equal part of the draws for every cluster
    if cost > 0:
        share = 0.5 * share + 0.5 * w * d / cost
    share /= share.sum()
    drawn, times = np.unique(rng.choice(len(x), size, p=share), return_counts=True)
    new_w = times * w[drawn] / (size * share[drawn])
    # every cluster keeps its weight; one of which nothing was drawn hands it to all
    have = np.bincount(near[drawn], new_w, len(centres))
    new_w *= (weight_of[near[drawn]] / have[near[drawn]]) * (w.sum() / weight_of[have > 0].sum())
    return x[drawn], new_w


class Levels:
    """Sets by level, as the digits of a counter: two of one level become one of the next."""

    def __init__(self, size: int, k: int, rng: np.random.Generator):
        self.size, self.k, self.rng = size, k, rng
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = []

    def add(self, x: np.ndarray, w: np.ndarray) -> None:
        own = reduced(x, w, self.size, self.k, self.rng)
        for at, there in enumerate(self.held):
            if there is None:
                self.held[at] = own
                return
            own = reduced(np.concatenate((there[0], own[0])), np.concatenate((there[1], own[1])), self.size, self.k, self.rng)
            self.held[at] = None
        self.held.append(own)

    def all(self) -> tuple[np.ndarray, np.ndarray] | None:
        own = [h for h in self.held if h is not None]
        return reduced(np.concatenate([x for x, _ in own]), np.concatenate([w for _, w in own]), self.size, self.k, self.rng) if own else None


class SensitivityCoreset(Transformer):
    """The coreset as a table: the columns and ``weight_col``. Costs of any centres on it are those on all rows, nearly (see ``cost_ratios``)."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], size: int = 1000, n_centres: int = 10, chunk: int = 20_000, seed: int = 42, weight_col: str = "weight"):
        super().__init__(cols)
        if not 0 < n_centres <= size <= chunk:
            raise ValueError("there must be at most as many centres as rows kept, and a chunk must hold these")
        if weight_col in self.cols:
            raise ValueError(f"the weights need another name than {weight_col}")
        self.size, self.n_centres, self.chunk, self.seed, self.weight_col = size, n_centres, chunk, seed, weight_col

    def _pass(self, level: int):
        size, k, chunk, seed, d = self.size, self.n_centres, self.chunk, self.seed, len(self.cols)

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            levels = Levels(size, k, np.random.default_rng((seed, level, TaskContext.get().partitionId())))
            held, rows = [], 0

            def flush() -> None:
                nonlocal held, rows
                own = np.concatenate(held)
                for at in range(0, len(own), chunk):
                    levels.add(own[at : at + chunk, :d], own[at : at + chunk, d])
                held, rows = [], 0

            for f in frames:
                if len(f):
                    held.append(f.to_numpy(np.float64))
                    rows += len(f)
                    if rows >= chunk:
                        flush()
            if held:
                flush()
            found = levels.all()
            if found:
                yield pd.DataFrame(np.column_stack(found), columns=[*[f"x{i}" for i in range(d)], "weight"])

        return work

    def fit(self, df):
        x = [F.col(c).cast("double") for c in self.cols]
        known = [c.isNotNull() & ~F.isnan(c) for c in x]
        ok = known[0]
        for c in known[1:]:
            ok &= c
        rows = df.where(ok).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.lit(1.0).alias("weight"))
        level, sets = 0, stored(rows.mapInPandas(self._pass(0), rows.schema), "coreset")
        parts = -(-sets.count() // self.size)
        while parts > 1:
            level, parts = level + 1, -(-parts // FAN)
            sets = stored(sets.repartition(parts).mapInPandas(self._pass(level), sets.schema), "coreset")
        self.params = {"coreset": sets.toDF(*self.cols, self.weight_col), "levels": level}
        return self

    def transform(self, df=None):
        return self.fitted()["coreset"]


def centre_cost(df: DataFrame, cols: Sequence[str], sets: dict[str, Sequence[Sequence[float]]], weight: str | None = None) -> DataFrame:
    """(name, cost): the weighted squared distance of all rows to the nearest of each set's centres, in one pass."""
    x = [F.col(c).cast("double") for c in cols]
    parts = []
    for centres in sets.values():
        gaps = [sum(((a - float(v)) * (a - float(v)) for a, v in zip(x, c, strict=True)), F.lit(0.0)) for c in centres]
        parts.append(F.sum((F.least(*gaps) if len(gaps) > 1 else gaps[0]) * (F.col(weight) if weight else 1)))
    row = df.dropna(subset=list(cols)).agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("cost")) for i, n in enumerate(sets)])))


def cost_ratios(df: DataFrame, coreset: DataFrame, cols: Sequence[str], sets: dict[str, Sequence[Sequence[float]]]) -> DataFrame:
    """(name, cost, ratio): cost on all rows, and the coreset's share of it."""
    own = centre_cost(coreset, cols, sets, "weight").select("name", F.col("cost").alias("__c"))
    return centre_cost(df, cols, sets).join(own, "name").select("name", "cost", (F.col("__c") / F.col("cost")).alias("ratio"))
