"""Kernel models in twelve features against the whole Gram matrix, within their stated bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.operators import landmarks, models, svm

D = 12
COLS = [f"x{i}" for i in range(D)]


def points(n, seed=1, spread=0.3):
    return np.random.default_rng(seed).normal(0, spread, (n, D))


def table(spark, x, *more, lacking=True):
    rows = [(*map(float, r), *(float(m[i]) for m in more)) for i, r in enumerate(x)]
    if lacking:
        rows += [(*[0.1] * (D - 1), None, *[1.0] * len(more)), (*[0.1] * (D - 1), float("nan"), *[1.0] * len(more))]
    return spark.createDataFrame(rows, [*COLS, *[f"y{i}" for i in range(len(more))]]).repartition(3)


def test_rest_is_within_tol_for_every_pair(spark):
    x = points(150)
    own = landmarks.LandmarkMap(COLS, tol=1e-2, batch=16).fit(table(spark, np.concatenate((x, x[:20]))))
    phi = own._phi(x, own.params["landmarks"], own.params["factor"])
    rest = landmarks.ry(x, x) - phi @ phi.T
    assert 10 < len(own.params["landmarks"]) < 150 and np.abs(rest).max() <= 1e-2 and own.params["n"] == 170
    assert np.isclose(own.params["largest"], np.diag(rest).max(), atol=1e-9)
    got = own.transform(table(spark, x[:5])).orderBy(*COLS).select([f"phi{i}" for i in range(3)]).collect()
    assert sum(r.phi0 is None for r in got) == 2
    with pytest.raises(ValueError, match="is left"):
        landmarks.LandmarkMap(COLS, tol=1e-6, most=5).fit(table(spark, x))


def test_ridge_within_its_bound(spark):
    x = points(120, spread=0.02)
    y = np.sin(20 * x.sum(axis=1))
    df = table(spark, x, y)
    own = landmarks.LandmarkRidge(COLS, "y0", 0.5, 1e-4).fit(df)
    k = landmarks.regressor(x, x)
    exact = k @ np.linalg.solve(k + 0.5 * np.eye(len(x)), y)
    got = {tuple(r[c] for c in COLS): r.prediction for r in own.transform(df).collect()}
    gap = np.linalg.norm(exact - np.array([got[tuple(map(float, r))] for r in x]))
    assert own.params["n_landmarks"] < 120 and gap <= own.params["bound"] and gap < 0.05
    assert sum(v is None for v in got.values()) == 2


def test_components_within_their_bound(spark):
    x = points(100)
    own = landmarks.LandmarkPCA(COLS, 3, 1e-4).fit(table(spark, x))
    k = landmarks.ry(x, x)
    centred = k - k.mean(axis=0) - k.mean(axis=1)[:, None] + k.mean()
    exact = np.linalg.eigvalsh(centred)[::-1][:3]
    assert np.abs(own.params["values"] - exact).max() <= own.params["bound"] + 1e-9
    scores = np.array([[r.pc0, r.pc1, r.pc2] for r in own.transform(table(spark, x, lacking=False)).collect()])
    assert np.allclose((scores**2).sum(axis=0), exact, rtol=1e-2) and np.allclose(scores.mean(axis=0), 0, atol=1e-6)


def test_drift_within_its_bound(spark):
    a, b = points(90, 1), points(110, 2) + 0.1
    r = landmarks.mmd(table(spark, a), table(spark, b), COLS, 1e-3).first()
    exact = landmarks.ry(a, a).mean() + landmarks.ry(b, b).mean() - 2 * landmarks.ry(a, b).mean()
    assert (r.reference_size, r.new_size) == (90, 110) and -1e-9 <= exact - r.mmd_score <= r.bound


@pytest.mark.parametrize("c", [0.5, 10.0])
def test_machine_on_all_rows_equals_the_dual(spark, c):
    x = points(90, 3, 0.6)[:, :4]
    y = np.where(np.sin(3 * x[:, 0]) + x[:, 1] + 0.3 * np.random.default_rng(1).normal(size=90) > 0, 1.0, -1.0)
    rows = [(*map(float, r), "up" if s > 0 else "down") for r, s in zip(x, y, strict=True)] + [(None, 0.0, 0.0, 0.0, "up"), (0.0, 0.0, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, label string").repartition(3)
    own = svm.PrimalSVC(COLS[:4], "label", c, 2e-3).fit(df)
    k = landmarks.ry(x, x)
    a = models.solve_box(k * np.outer(y, y), -np.ones(len(y)), c, y, np.zeros(len(y)))
    f = k @ (a * y)
    free = (a > 1e-6) & (a < c - 1e-6)
    b = np.mean((y - f)[free])
    best = a.sum() - 0.5 * (a * y) @ f
    assert abs(own.params["value"] - best) <= 2e-3 * best and own.params["gap"] <= 2e-3 * own.params["value"]
    got = {tuple(r[col] for col in COLS[:4]): r for r in own.transform(df).collect()}
    exact = f + b
    found = np.array([got[tuple(map(float, r))].decision for r in x])
    clear = np.abs(exact) > 0.1
    assert (np.sign(found) == np.sign(exact))[clear].all() and np.abs(found - exact).max() < 0.3
    assert got[None, 0.0, 0.0, 0.0].prediction is None and np.isclose(own.score(df.where("x0 is not null")), (np.sign(found) == y).mean())


def test_machine_needs_two_classes(spark):
    with pytest.raises(ValueError):
        svm.PrimalSVC(["x0"], "y").fit(spark.createDataFrame([(1.0, 1)], "x0 double, y int"))
    two = spark.createDataFrame([(0.0, 0), (3.0, 1)], "x0 double, y int").withColumn("v", F.lit(1))
    assert [r.prediction for r in svm.PrimalSVC(["x0"], "y").fit(two).transform(two).orderBy("x0").collect()] == [0, 1]
