"""Statistics of columns: one aggregate for moments and ranges, a few narrow passes for exact percentiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: distinct values around a rank that may come to the driver
FEW = 20_000
#: accuracy of the first approximate percentiles that bound a rank, and the share of rows left on either side of it; finer ones have less
ACCURACY = 2_000
SLACK = 2.0 / ACCURACY


def column_stats(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = ()) -> dict[str, dict]:
    """n, mean, population std, min, max, largest absolute value and exact percentiles of each column.

    Nulls don't count; a column without values has None throughout and no percentiles. NaN is the largest value."""
    if not cols:
        return {}
    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        parts += [F.count(x), F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.max(F.abs(x))]
    row = df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
    exact = exact_percentiles(df, {c: F.col(c) for c in cols}, percentiles) if percentiles else {}
    out = {}
    for i, c in enumerate(cols):
        n, mean, std, low, high, top = row[i * 6 : (i + 1) * 6]
        out[c] = {"n": n, "mean": mean, "std": std, "min": low, "max": high, "top": top, "q": dict(zip(percentiles, exact[c], strict=True)) if exact.get(c) else {}}
    return out


def exact_percentiles(df: DataFrame, cols: Mapping[str, Column], percentiles: Sequence[float]) -> dict[str, list[float] | None]:
    """Percentiles of each expression, interpolated between neighbours in order; None without values.

    No task gathers a column: the two ranks beside each percentile are closed in between two values by approximate percentiles, again and
    again inside the last bounds, with exact counts below and inside; only when few distinct values are left between
    the bounds are these counted and brought to the driver. Where an approximation missed or came no closer, the next one is
    asked to be finer. A column of few values is counted at once."""
    rows = df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(cols.values())])
    every = [(i, p) for i in range(len(cols)) for p in percentiles]
    asked = [_approximate(F.col(f"v{i}"), p, p, ACCURACY) for i, p in every]
    row = rows.agg(*[F.count(c).alias(c) for c in rows.columns], *[a.alias(f"p{k}") for k, a in enumerate(asked)]).first()
    sizes, ends = row[: len(cols)], dict(zip(every, row[len(cols) :], strict=True))
    ranks = {(i, p): (math.floor(p * (sizes[i] - 1)), math.ceil(p * (sizes[i] - 1))) for i, p in every if sizes[i]}
    # (column, percentile) -> (lower bound, upper bound, rows below the lower one, rows inside)
    bounds: dict[tuple[int, float], tuple] = {(i, p): (None, None, 0, sizes[i]) for i, p in ranks}
    few = {k: b for k, b in bounds.items() if b[3] <= FEW}
    found = _looked_up(rows, few, ranks)
    bounds = {k: b for k, b in bounds.items() if k not in few}
    accuracy = dict.fromkeys(bounds, ACCURACY)
    while bounds:
        keys, parts = list(bounds), []
        for k in keys:
            (i, _), (low, high) = k, ends[k]
            parts += [F.count_if(F.col(f"v{i}") < F.lit(low)), F.count_if(_inside(i, low, high)), F.approx_count_distinct(F.when(_inside(i, low, high), F.col(f"v{i}")))]
        counts, few = rows.agg(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).first(), {}
        for at, k in enumerate(keys):
            below, n, distinct = counts[3 * at : 3 * at + 3]
            (low, high), (first, last) = ends[k], ranks[k]
            if below <= first and last < below + n and low == high:
                found[k] = (low, low)
            elif below <= first and last < below + n and n < bounds[k][3]:
                bounds[k] = (low, high, below, n)
                if distinct <= FEW:
                    few[k] = bounds[k]
            else:
                accuracy[k] *= 8
        found |= _looked_up(rows, few, ranks)
        bounds = {k: b for k, b in bounds.items() if k not in found}
        if bounds:
            asked = [_approximate(F.when(_inside(k[0], low, high), F.col(f"v{k[0]}")), *[(r - below) / max(1, n - 1) for r in ranks[k]], accuracy[k]) for k, (low, high, below, n) in bounds.items()]
            ends = dict(zip(bounds, rows.agg(*[a.alias(f"p{k}") for k, a in enumerate(asked)]).first(), strict=True))
    out: dict[str, list[float] | None] = {}
    for i, name in enumerate(cols):
        out[name] = [_between(*found[i, p], p * (sizes[i] - 1)) for p in percentiles] if sizes[i] else None
    return out


def _approximate(x: Column, low: float, high: float, accuracy: int) -> Column:
    """Two values between which the shares from ``low`` to ``high`` lie, nearly always."""
    slack = SLACK * ACCURACY / accuracy
    return F.percentile_approx(x, F.array(F.lit(max(0.0, low - slack)), F.lit(min(1.0, high + slack))), accuracy)


def _between(low: float, high: float, at: float) -> float:
    share = at - math.floor(at)
    return low if share == 0 or low == high else (1 - share) * low + share * high


def _inside(i: int, low: float | None, high: float | None) -> Column:
    x = F.col(f"v{i}")
    ok = x.isNotNull()
    if low is not None:
        ok &= x >= F.lit(low)
    return ok if high is None else ok & (x <= F.lit(high))


def _looked_up(rows: DataFrame, bounds: dict, ranks: dict) -> dict[tuple[int, float], tuple[float, float]]:
    """Values of both ranks, where few distinct values are between the bounds: these are counted by value."""
    keys = list(bounds)
    if not keys:
        return {}
    cells = F.array_compact(F.array(*[F.when(_inside(k[0], *bounds[k][:2]), F.struct(F.lit(n).alias("k"), F.col(f"v{k[0]}").alias("x"))) for n, k in enumerate(keys)]))
    counted = rows.select(F.explode(cells).alias("cell")).groupBy("cell.k", "cell.x").count().orderBy("k", "x").collect()
    out: dict[tuple[int, float], list[float]] = {k: [] for k in keys}
    passed = [bounds[k][2] for k in keys]
    for n, x, times in counted:
        k = keys[n]
        passed[n] += times
        while len(out[k]) < 2 and passed[n] > ranks[k][len(out[k])]:
            out[k].append(x)
    return {k: (low, high) for k, (low, high) in out.items()}
