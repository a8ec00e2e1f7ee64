"""Kernel operators on nulls, NaN, empty tables and names that they use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.operators import encoders, kernel

COLS = ["n", "phi"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(6)
    whole = [(float(a), float(b), float(np.sin(6 * a) + b)) for a, b in rng.uniform(0, 1, (60, 2))]
    holes = [(None, 0.5, 1.0), (0.5, float("nan"), 1.0), (float("nan"), None, None)]
    schema = "n double, phi double, prediction double"
    return spark.createDataFrame(whole, schema), spark.createDataFrame(whole + holes, schema).repartition(3), spark.createDataFrame([], schema)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_models_leave_out_what_lacks_a_feature(tables):
    whole, holes, none = tables
    for make in (lambda: kernel.KernelRidge(COLS, "prediction", 0.1), lambda: kernel.KernelPCA(COLS, 2)):
        a, b = make().fit(whole), make().fit(holes)
        x, y = (np.array([tuple(r) for r in m.transform(whole).drop("prediction" if "pc0" in m.transform(whole).columns else "none").orderBy(*COLS).collect()]) for m in (a, b))
        assert np.allclose(x, y)
        out = b.transform(holes).drop(*([] if isinstance(b, kernel.KernelRidge) else ["prediction"]))
        assert out.where(F.col(out.columns[2]).isNull()).count() == 3
        with pytest.raises(ValueError, match="no rows"):
            make().fit(none)


def test_drift(tables):
    whole, holes, none = tables
    a, b = kernel.DriftDetector(COLS).fit(whole).detect(whole).first(), kernel.DriftDetector(COLS).fit(holes).detect(holes).first()
    assert (a.reference_size, a.status) == (b.reference_size, b.status) == (60, "STABLE") and abs(a.mmd_score - b.mmd_score) < 1e-12
    assert kernel.DriftDetector(COLS).fit(whole).detect(none).count() == 0


def test_clusters(tables):
    whole, holes, none = tables
    a, b = (kernel.KernelKMeans(COLS, 3, 2).fit(df) for df in (whole, holes))
    assert np.allclose(a.centroids, b.centroids)
    got = b.transform(holes)
    assert got.where("cluster is null").count() == 3 and rows(got.where("cluster is not null")) == rows(a.transform(whole))
    with pytest.raises(ValueError, match="no rows"):
        kernel.KernelKMeans(COLS, 3, 2).fit(none)


def test_encoders(tables, spark):
    schema = "key long, circuit array<double>, gates int"
    df = spark.createDataFrame([(1, [0.5, 1.0], 7), (2, [None, 1.0], 7), (3, None, 7), (None, [float("nan"), 0.0], 7), (1, [0.5, 1.0], 7)], schema)
    for make in (lambda: encoders.RotationEncoder(2), lambda: encoders.IQPEncoder(2), lambda: encoders.PhaseEncoder(2), lambda: encoders.AngleEncoder(2, "auto")):
        out = make().transform(df.withColumnRenamed("circuit", "features"))
        assert out.count() == 5 and out.where("circuit is null").count() <= 1
        assert make().transform(df.withColumnRenamed("circuit", "features").limit(0)).count() == 0
