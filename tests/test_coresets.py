"""Coresets by merging and reducing: weights, costs near those on all rows, and awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.operators import coresets


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (6, 3))
    return centres[rng.integers(0, 6, n)] + rng.normal(0, 1, (n, 3)) * rng.exponential(1, (n, 1))


def table(spark, x, parts):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(parts)


@pytest.mark.parametrize("parts,chunk", [(1, 20_000), (1, 800), (11, 800)])
def test_costs_of_random_centres(spark, parts, chunk):
    x = clustered(6000)
    df = table(spark, x, parts)
    own = coresets.SensitivityCoreset(["a", "b", "c"], 700, 12, chunk).fit(df)
    rng = np.random.default_rng(5)
    assert own.params["levels"] == (2 if parts == 11 else 0)
    core = own.params["coreset"].toPandas().to_numpy()
    assert len(core) <= 700 and np.isclose(core[:, 3].sum(), 6000)
    for _ in range(5):
        centres = x[rng.choice(len(x), 7)]
        on_all, _ = coresets.distances(x, centres)
        on_core, _ = coresets.distances(core[:, :3], centres)
        assert abs((core[:, 3] * on_core).sum() / on_all.sum() - 1) < 0.1
    assert {tuple(r) for r in core[:, :3]} <= {tuple(r) for r in x}


def test_ratios(spark):
    x = clustered(3000)
    df = table(spark, x, 3)
    core = coresets.SensitivityCoreset(["a", "b", "c"], 600).fit_transform(df)
    sets = {"one": [x[0].tolist()], "many": x[:8].tolist()}
    rows = {r.name: r for r in coresets.cost_ratios(df, core, ["a", "b", "c"], sets).collect()}
    for name, c in sets.items():
        assert np.isclose(rows[name].cost, coresets.distances(x, np.array(c))[0].sum()) and abs(rows[name].ratio - 1) < 0.1


def test_awkward_tables(spark):
    few = spark.createDataFrame([(1.0, 2), (1.0, 2), (None, 1), (float("nan"), 3), (5.0, None)], "a double, b int")
    got = coresets.SensitivityCoreset(["a", "b"], 10, 2).fit_transform(few).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 1.0)] * 2
    assert coresets.SensitivityCoreset(["a", "b"], 10, 2).fit_transform(few.limit(0)).count() == 0
    same = spark.range(500).select(F.lit(1.5).alias("a"))
    rows = coresets.SensitivityCoreset(["a"], 20, 5, 100).fit_transform(same).collect()
    assert {r.a for r in rows} == {1.5} and np.isclose(sum(r.weight for r in rows), 500)
    with pytest.raises(ValueError):
        coresets.SensitivityCoreset(["a"], 5, 10)
    with pytest.raises(ValueError, match="another name"):
        coresets.SensitivityCoreset(["a", "weight"], 10, 2)
    named = coresets.SensitivityCoreset(["weight"], 10, 2, weight_col="w").fit_transform(few.withColumnRenamed("b", "weight"))
    assert named.columns == ["weight", "w"] and named.count() == 4
    with pytest.raises(RuntimeError):
        coresets.SensitivityCoreset(["a"], 10, 2).transform()
