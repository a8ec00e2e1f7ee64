"""Library operators against numpy, and on nulls, NaN, empty tables, ties and clashing names."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ketspark.governance import audit, workflow
from ketspark.operators import categorical, circuits, kernel, models, outliers, quality, reduction, resources, sampling, scaling, selection
from ketspark.operators import encoders as enc
from ketspark.plans import stats
from ketspark.sources import loaders
from ketspark.streaming import buffers

RNG = np.random.default_rng(12)
X = RNG.uniform(-1.5, 1.5, (60, 3))
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, *map(float, v), int(v.sum() > 0)) for i, v in enumerate(X)]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int").repartition(3)


def gram(x, z, scale=0.5):
    return np.prod(np.cos((x[:, None] - z[None]) * scale) ** 2, axis=2)


def test_kernel_ridge(points):
    y = X.sum(1) > 0
    k = gram(X, X, math.pi)
    expected = k @ np.linalg.solve(k + np.eye(60), y.astype(float))
    got = [r.prediction for r in kernel.KernelRidge(COLS, "y").fit_transform(points).orderBy("i").collect()]
    assert np.allclose(got, expected, atol=1e-8)


def test_kernel_pca(points):
    k = gram(X, X)
    h = np.eye(60) - 1 / 60
    values, vectors = np.linalg.eigh(h @ k @ h)
    expected = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :2]
    got = np.array([(r.pc0, r.pc1) for r in kernel.KernelPCA(COLS, 2).fit_transform(points).orderBy("i").collect()])
    assert np.allclose(abs(got), abs(expected), atol=1e-8)  # up to the sign of a component


def test_kernel_kmeans(points):
    model = kernel.KernelKMeans(COLS, 3, key="i").fit(points)
    c = np.array(model.centroids)
    got = np.array([r.cluster for r in model.transform(points).orderBy("i").collect()])
    assert np.array_equal(got, gram(X, c).argmax(1))
    assert all(np.allclose(c[k], X[got == k].mean(0)) for k in range(3))  # a fixed point of the steps


def test_iterative_reduction(points):
    got = np.array([(r.dim0, r.dim1) for r in reduction.IterativeReduction(COLS, 2).fit_transform(points).orderBy("i").collect()])
    p = reduction.gaussian_matrix(3, 2, 42)
    q, r = np.linalg.qr(p)
    assert np.allclose(got @ got.T, X @ p @ p.T @ X.T)  # rotations keep the projection's inner products
    m = got.T @ got
    assert abs(m[0, 1]) < 1e-6 * m.max() and q.shape == (3, 2) and r.shape == (2, 2)


def test_parametric_encoder(spark):
    e = enc.ParametricAngleEncoder(3)
    row = e.transform(spark.createDataFrame([(1, [0.5, -0.25, 2.0])], "i long, features array<double>")).first()
    gates = [(g["type"], list(g["qubits"]), list(g["params"])) for g in row["circuit"]["gates"]]
    angles = 0.1 * np.random.default_rng(42).standard_normal(3)
    assert [g[:2] for g in gates] == [x for q in range(3) for x in (("ry", [q]), ("rz", [q]))]
    assert np.allclose([g[2][0] for g in gates[1::2]], angles)


def test_seeded_models(points):
    total = X.sum(1)
    own = np.random.default_rng(42)
    for model, w in ((models.NeuralNetwork(COLS), own.standard_normal(8).sum() * 0.1), (models.MetaLearner(COLS), np.random.default_rng(42).standard_normal(3).mean() * 0.1)):
        got = [r.prediction for r in model.fit_transform(points).orderBy("i").collect()]
        assert np.allclose(got, np.tanh(total * w))
    got = [r.prediction for r in models.TransferLearning(COLS).fit_transform(points).orderBy("i").collect()]
    assert np.allclose(got, np.tanh(X @ np.random.default_rng(42).standard_normal(3)))


@pytest.mark.parametrize("voting", ["majority", "average"])
def test_ensemble(points, voting):
    model = models.Ensemble(COLS, "y", "i", 3, voting).fit(points)
    rows = model.transform(points).orderBy("i").collect()
    f = np.array([[gram(X, m.params["x"]) @ m.params["w"] + m.params["b"]] for m in model.params["models"]])[:, 0]
    votes = (np.sign(f) if voting == "majority" else f).sum(0)
    assert np.allclose([r.votes for r in rows], votes)
    assert np.mean([r.prediction == r.y for r in rows]) > 0.8


def test_feature_selector_and_imputer(points):
    picked = selection.FeatureSelector(COLS, "y", 2).fit(points).params
    assert len(picked["selected"]) == 2 and set(picked["selected"]) <= set(COLS)
    holes = points.withColumn("a", F.when(F.col("i") % 5 != 0, F.col("a")))
    model = outliers.KernelImputer(COLS, 2).fit(holes)
    out = model.transform(holes).orderBy("i").collect()
    centres = {round(c[0], 9) for c in model.centroids}
    assert all(round(r.a, 9) in centres if r.i % 5 == 0 else r.a == X[r.i, 0] for r in out)


@pytest.mark.parametrize("few", [20_000, 3])
def test_exact_percentiles(spark, few, monkeypatch):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "ACCURACY", 20 if few == 3 else 2_000)
    monkeypatch.setattr(stats, "SLACK", 0.1 if few == 3 else 0.001)
    rng = random.Random(4)
    columns = {"u": [rng.random() for _ in range(997)], "ties": [float(rng.choice([1, 2, 2, 2, 5])) for _ in range(997)], "one": [7.0] * 997, "heavy": [0.0 if rng.random() < 0.7 else rng.expovariate(1) for _ in range(997)], "gaps": [None if rng.random() < 0.3 else rng.gauss(0, 1e6) for _ in range(997)], "none": [None] * 997}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(4)
    ps = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = stats.exact_percentiles(df, {c: F.col(c) for c in columns}, ps)
    for c, values in columns.items():
        own = [v for v in values if v is not None]
        assert got[c] is None if not own else np.allclose(got[c], np.quantile(own, ps), rtol=1e-12), c
    assert stats.exact_percentiles(df.limit(0), {"u": F.col("u")}, ps) == {"u": None}


def test_inverse_transforms(spark):
    df = spark.createDataFrame([(1.0, 250.0), (2.5, 0.5), (80.0, 3.0)], "x double, y double")
    for model in (scaling.DecimalScaler(["x", "y"]), scaling.LogTransformer(["x", "y"], "log2"), scaling.LogTransformer(["x", "y"]), scaling.PowerTransformer(["x", "y"], 0.5), scaling.PowerTransformer(["x", "y"], 0)):
        back = model.inverse_transform(model.fit_transform(df)).collect()
        assert np.allclose(sorted(map(tuple, back)), sorted([(1.0, 250.0), (2.5, 0.5), (80.0, 3.0)]))
    out = scaling.VectorNormalizer("v", "l2", (0.0, 1.0)).fit_transform(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")).collect()
    assert np.allclose(out[0][0], [0.8, 0.9]) and out[2][0] is None


def test_unknown_categories(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    new = spark.createDataFrame([("x",), ("z",)], "k string")
    with pytest.raises(ValueError):
        categorical.CategoricalEncoder(["k"]).fit(df).transform(new)
    known = categorical.CategoricalEncoder(["k"], handle_unknown="ignore").fit(df)
    assert sorted((r.k, r.k_label) for r in known.transform(new).collect()) == [("x", 0), ("z", 0)]
    assert categorical.CategoricalEncoder(["k"], "onehot").fit(df).n_features_out() == 2
    rows = spark.createDataFrame([(1, "a", "b"), (2, None, None)], "i long, p string, q string")
    hashed = {r.i: r.hashed for r in categorical.hash_features(rows, ["p", "q"], 1).collect()}
    assert len(hashed[1]) == 1 and hashed[1][0]["value"] in (-2.0, 0.0, 2.0) and hashed[2] == []


def test_awkward_tables(spark):
    rows = [(1, 1.0, None), (2, float("nan"), 2.0), (3, 3.0, 3.0), (3, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "key long, value double, count double")  # names that the operators use themselves
    none = df.limit(0)
    assert quality.quality_report(df, ["value", "count"]).first().completeness == 0.75
    assert quality.quality_report(none, ["value"]).first().completeness is None
    assert [r["column"] for r in quality.profile(none, ["value", "count"]).collect()] == ["value", "count"]
    assert quality.checksum(none, ["value"]).first().n_rows == 0
    assert not quality.DataValidator({"value": "double", "gone": "int"}).validate(df)
    assert quality.DataValidator({"count": "double"}, allow_nan=True).validate(df)
    for method in ("iqr", "zscore", "distance"):
        assert outliers.OutlierRemover(["count"], method).fit_transform(df).count() <= 4
    for method in ("standard", "minmax", "robust", "quantum"):
        assert scaling.FeatureScaler(["count"], method).fit_transform(df).count() == 4
    for method in ("quantile", "uniform"):
        assert {r.count_bin for r in categorical.BinningEncoder(["count"], 2, method).fit_transform(none).collect()} == set()
        assert categorical.BinningEncoder(["count"], 2, method).fit_transform(df).where("count is null and count_bin is not null").count() == 0
    assert sampling.split(none, "key").count() == 0
    assert sampling.stratified_split(none, "key", "value").count() == 0
    assert sampling.sample(df, "key", 10).count() == 4 and sampling.sample(df, "key", 6, replace=True).count() == 6
    assert sampling.sample(none, "key", 6, replace=True).count() == 0
    assert buffers.aggregate_batches(none, "key", ["value"]).first().value is None
    assert resources.ErrorMitigation("value").fit_transform(none).count() == 0
    assert buffers.flushed(none, ["key"], 3).count() == 0


def test_large_classes_are_ranked_in_buckets(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7 > 0).cast("int").alias("label"))
    whole = sorted(map(tuple, sampling.ranked_in_class(df, "id", "label", 1).select("id", "__rank", "__n").collect()))
    monkeypatch.setattr(sampling, "BUCKET", 10)
    assert sorted(map(tuple, sampling.ranked_in_class(df, "id", "label", 1).select("id", "__rank", "__n").collect())) == whole


def test_smote_mixes_rows_of_the_class(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(40)] + [(100 + i, 1, 1000.0 + 10 * i) for i in range(8)], "i long, label int, x double")
    out = sampling.balance(df, "i", "label", "smote", ["x"])
    new = [r.x for r in out.where("synthetic").collect()]
    assert len(new) == 32 and all(1000 <= x <= 1070 for x in new) and len(set(new)) > 25


def test_qasm(spark):
    text = 'OPENQASM 2.0;\ninclude "qelib1.inc";\nqreg q[3];\n// a comment\nh q[0];\nrx(0.5) q[1];\ncp(-1.5e-3) q[0],q[2];\nbarrier;\n'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i long, t string").select("i", circuits.from_qasm(F.col("t")).alias("g")).orderBy("i").collect()
    assert [(g["type"], list(g["qubits"]), list(g["params"])) for g in df[0].g] == [("h", [0], []), ("rx", [1], [0.5]), ("cp", [0, 2], [-0.0015])]
    assert df[1].g == [] and df[2].g is None


def test_files(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "t.csv").write_text('"a","b"\n1,x\n2,\n')
    assert [tuple(r) for r in loaders.read_csv(spark, f"{base}/t.csv", "a int, b string").collect()] == [(1, "x"), (2, None)]
    assert loaders.read_csv(spark, f"{base}/t.csv").dtypes == [("a", "int"), ("b", "string")]
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0, -1.0])], "i long, features array<double>")
    encoded = enc.RotationEncoder(2).transform(rows)
    loaders.save_circuits(encoded, f"{base}/circuits", "i", 2)
    back = {r.id: r.circuit for r in loaders.load_circuits(spark, f"{base}/circuits").collect()}
    assert back == {r.i: r.circuit for r in encoded.collect()}
    table = categorical.FrequencyEncoder(["i"]).fit(rows).params
    loaders.save_params({"n": 3, "deep": {"x": [1.5, 2]}} | table, f"{base}/params", spark)
    params = loaders.load_params(f"{base}/params", spark)
    assert params["n"] == 3 and params["deep"] == {"x": [1.5, 2]} and params["i"].count() == 2
    with pytest.raises(ValueError):
        loaders.ParquetLoader(spark, f"{base}/nothing", "i")
    events = spark.createDataFrame([("u", "read")], "user string, kind string")
    audit.export_trail(events, f"{base}/trail")
    workflow.export(events, f"{base}/tasks")
    assert spark.read.json(f"{base}/trail").count() == spark.read.json(f"{base}/tasks").count() == 1


def test_loader_batches(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"k": list(range(25))}), tmp_path / "f.parquet", row_group_size=10)
    loader = loaders.ParquetLoader(spark, f"file://{tmp_path}/f.parquet", "k", 4)
    got = {}
    for r in loader.row_group_batches().collect():
        got.setdefault(r.batch_id, []).append(r.k)
    assert got == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9], 3: [10, 11, 12, 13], 4: [14, 15, 16, 17], 5: [18, 19], 6: [20, 21, 22, 23], 7: [24]}
    assert loader.metadata().first().num_row_groups == 3
    assert [sorted(r.k for r in b.collect()) for b in loader] == [list(range(i, min(25, i + 4))) for i in range(0, 25, 4)]
    with loaders.SqlLoader(spark, "select id from range(9)", "id", 4) as sql:
        assert len(sql) == 3 and sql.circuits is not None
    loaders.Connectors.register("nine", lambda spark: spark.range(9))
    assert loaders.Connectors.create("nine", spark).count() == 9 and "csv" in loaders.Connectors.available()
    with pytest.raises(ValueError):
        loaders.Connectors.create("unheard", spark)


def test_merged_batches(spark):
    parts = spark.range(95).select(F.col("id").alias("n"), (F.col("id") * 2.0).alias("largest"))
    merge = lambda p: pd.DataFrame({"n": [p["n"].sum()], "largest": [p["largest"].max()]})
    for rows in (10_000, 10):
        assert [tuple(r) for r in buffers.merge_batches(parts, merge, "n long, largest double", rows).collect()] == [(95 * 47, 188.0)]
    with pytest.raises(ValueError):
        buffers.merge_batches(parts, lambda p: p, "n long, largest double", 10)


def test_streams(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("a", 4.0)], "k string, value double").select("k", F.timestamp_seconds(F.col("value") * 1000).alias("ts"), "value").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = buffers.stream_tail(stream, "k", "value", 2).writeStream.format("memory").queryName("tails").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert {(r.k, r.n) for r in spark.table("tails").collect()} == {("a", 2), ("b", 1)}
    q = buffers.windowed(stream, "ts", "value").writeStream.format("memory").queryName("hours").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("hours").collect()) == 4


def test_access_and_monitor(spark):
    own = audit.AccessControl()
    own.add_user("ann", "secret", "viewer")
    assert own.authenticate("ann", "secret") and not own.authenticate("ann", "wrong") and not own.authenticate("bob", "secret")
    assert own.check_permission("ann", "read") and not own.check_permission("ann", "write")
    with pytest.raises(ValueError):
        own.add_user("ann", "x", "viewer")
    monitor = workflow.JobMonitor(10)
    monitor.update(4)
    assert monitor.status()["percent"] == 40
    assert '"success"' in workflow.run_job("t", lambda s: s.range(3), spark) and '"failed"' in workflow.run_job("t", lambda s: 1 / 0, spark)
    tracker = quality.MetadataTracker("s")
    tracker.record_load("p", spark.range(3))
    tracker.record_transformation("scale")
    assert tracker.metadata(spark).count() == 2 and tracker.lineage(spark).count() == 1
    assert resources.check_capacity(5) and resources.calibration(None) == (0.01, 0.01)
    with pytest.raises(Exception, match="qubits"):
        resources.check_capacity(500)
