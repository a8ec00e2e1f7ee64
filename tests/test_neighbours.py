"""Mutual information by neighbours against a quadratic estimator with blocks of a few rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ketspark.operators import neighbours, selection

GAMMA = 0.57721566490153286


def psi(n):
    return -GAMMA + sum(1 / i for i in range(1, n))


def brute(pairs, k):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None and not math.isnan(x)]
    sizes = {y: sum(b == y for _, b in pairs) for _, y in pairs}
    pairs = [(x, y) for x, y in pairs if sizes[y] > 1]
    if not pairs:
        return None
    near = inside = of_class = 0.0
    for i, (x, y) in enumerate(pairs):
        own = sorted(abs(x - a) for j, (a, b) in enumerate(pairs) if b == y and j != i)
        taken = min(k, len(own))
        r = own[taken - 1]
        m = sum(abs(x - a) < r if r > 0 else a == x for a, _ in pairs)
        near, inside, of_class = near + psi(taken), inside + psi(m), of_class + psi(sizes[y])
    n = len(pairs)
    return max(0.0, psi(n) + (near - inside - of_class) / n)


def data(seed, n):
    """Values that doubles hold exactly, with ties, small classes, nulls and NaN."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.choice("aaabbc")
        rows.append((rng.choice([None, float("nan"), *[rng.randrange(400) / 8 + 20 * (y == "a")] * 30]), float(rng.randrange(6)), None if rng.random() < 0.03 else y))
    return rows + [(3.0, 1.0, "alone"), (5.0, 2.0, "two"), (9.0, 2.0, "two"), (7.0, 1.0, "three"), (7.0, 1.0, "three"), (7.5, None, "three")]


@pytest.mark.parametrize("k,block,n", [(3, 50_000, 150), (3, 7, 150), (1, 3, 90), (5, 11, 120)])
def test_against_all_pairs(spark, k, block, n):
    rows = data(k, n)
    df = spark.createDataFrame(rows, "x double, v double, y string").withColumnsRenamed({"x": "rn", "v": "size", "y": "kind"})
    got = {r.feature: r.mi for r in neighbours.mutual_info_knn(df, ["rn", "size"], "kind", k, block).collect()}
    for i, name in enumerate(("rn", "size")):
        assert math.isclose(got[name], brute([(r[i], r[2]) for r in rows], k), abs_tol=1e-9), name
    assert got["rn"] > 0.3


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "x double, y string")
    assert [tuple(r) for r in neighbours.mutual_info_knn(none, ["x"], "y").collect()] == [("x", None)]
    same = spark.createDataFrame([(1.0, i % 2) for i in range(20)], "x double, y int")
    assert abs(neighbours.mutual_info_knn(same, ["x"], "y").first().mi - brute([(1.0, i % 2) for i in range(20)], 3)) < 1e-9
    with pytest.raises(ValueError):
        neighbours.mutual_info_knn(same, ["x"], "y", 3, 6)


def test_selection_by_neighbours(spark):
    rows = data(2, 150)
    df = spark.createDataFrame(rows, "x double, v double, y string")
    own = selection.FeatureSelector(["v", "x"], "y", 1, "mutual_info").fit(df)
    assert own.params["selected"] == ["x"] and own.transform(df).columns == ["x", "y"]
    assert math.isclose(own.params["scores"]["x"], brute([(r[0], r[2]) for r in rows], 3), abs_tol=1e-9)


def test_digamma(spark):
    rows = spark.range(1, 400).select("id", neighbours.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(math.isclose(r.p, psi(r.id), abs_tol=1e-11) for r in rows)
