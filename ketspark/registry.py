"""All queries over the reference's own operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.functions import tables
from ketspark.functions.arrays import features
from ketspark.governance import audit, integrity, workflow
from ketspark.operators import categorical, circuits, kernel, models, outliers, quality, reduction, resources, sampling, scaling, selection
from ketspark.operators import encoders as enc
from ketspark.operators import coresets, landmarks, merkle, neighbours, svm
from ketspark.plans.numbering import numbered
from ketspark.plans.storage import new_path
from ketspark.sources import record_log
from ketspark.sources.loaders import ParquetLoader, SqlLoader, to_lists, to_long
from ketspark.streaming import buffers, ring

QUERIES: dict = {}
DIMS = 4
X = [f"x{i}" for i in range(DIMS)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), n) + 0.0 for c in cols})


def vectors(spark: SparkSession, d: str, n: int = DIMS) -> DataFrame:
    """(vec_id, label, x0..)"""
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(n)])


def feature_rows(spark: SparkSession, d: str, n: int = DIMS) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", features("embedding", n).alias("features"))


# A: sources


@query
def sql_loader_batches(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ketspark_orders")
    loader = SqlLoader(spark, "select o_orderkey, o_totalprice from ketspark_orders where o_orderstatus = 'O'", "o_orderkey", 100)
    return loader.batches().groupBy("batch_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query
def parquet_loader_batches(spark, d):
    return ParquetLoader(spark, f"{d}/orders.parquet", "o_orderkey", 1000).batches().select("o_orderkey", "batch_id")


@query
def batch_count(spark, d):
    return ParquetLoader(spark, f"{d}/orders.parquet", "o_orderkey", 1000).count()


@query
def sql_limit(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("ketspark_customer")
    return SqlLoader(spark, "select c_custkey, c_name from ketspark_customer where c_acctbal > 0", "c_custkey").execute(20)


@query
def parquet_metadata(spark, d):
    return ParquetLoader(spark, f"{d}/part.parquet", "p_partkey").metadata()


@query
def parquet_row_group_batches(spark, d):
    rows = ParquetLoader(spark, f"{d}/part.parquet", "p_partkey", 300).row_group_batches()
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


@query
def parquet_schema(spark, d):
    return ParquetLoader(spark, f"{d}/part.parquet", "p_partkey").schema()


@query
def read_sample(spark, d):
    return ParquetLoader(spark, f"{d}/part.parquet", "p_partkey").sample(5)


@query
def format_unpivot(spark, d):
    return to_long(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query
def format_lists(spark, d):
    return to_lists(table(spark, d, "nation"), "n_regionkey", "n_name")


# B: batches and buffers


@query
def buffer_sliding_window(spark, d):
    return buffers.last_rows(table(spark, d, "events").select("event_id", "value", "ts"), ["ts", "event_id"], 100).select("event_id", "value")


@query
def buffer_statistics(spark, d):
    tail = buffers.last_rows(table(spark, d, "events").select("event_id", "value", "ts"), ["ts", "event_id"], 1000)
    return rounded(buffers.buffer_statistics(tail, ["value"], 1000), "mean_value", "std_value")


@query
def stream_batches_shuffled(spark, d):
    return buffers.shuffled_batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 32)


@query
def validate_frame(spark, d):
    return quality.DataValidator({"l_quantity": "double", "l_discount": "double", "l_tax": "double"}).report(table(spark, d, "lineitem"))


def _aggregate(method):
    def run(spark, d):
        e = table(spark, d, "events")
        return rounded(buffers.aggregate_batches(e, "event_type", ["value"], method), "value")

    return run


for _m in ("mean", "max", "min", "sum"):
    QUERIES[f"batch_aggregate_{_m}"] = _aggregate(_m)


@query
def batch_process(spark, d):
    def stats(b):
        return b.groupby("batch_id", as_index=False).agg(n=("o_orderkey", "size"), largest=("o_totalprice", "max"))

    return buffers.process_batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, stats, "batch_id long, n long, largest double")


@query
def batch_statistics(spark, d):
    return rounded(buffers.batch_statistics(table(spark, d, "lineitem"), "l_returnflag", ["l_discount", "l_tax"]), "mean", "std")


@query
def batch_merge(spark, d):
    def stats(b):
        return b.groupby("batch_id", as_index=False).agg(n=("o_orderkey", "size"), largest=("o_totalprice", "max"))[["n", "largest"]]

    def merge(parts):
        return parts.agg({"n": "sum", "largest": "max"}).to_frame().T.astype({"n": "int64"})

    results = buffers.process_batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, stats, "n long, largest double")
    return buffers.merge_batches(results, merge, "n long, largest double")


@query
def buffer_flush(spark, d):
    rows = buffers.flushed(table(spark, d, "events").select("event_id", "value", "ts"), ["ts", "event_id"], 128)
    return rounded(rows.groupBy("flush_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


# C: quality


def _transformed(kind):
    return lambda spark, d: rounded(scaling.DataTransformer(["c_acctbal"], kind).fit_transform(table(spark, d, "customer")).select("c_custkey", "c_acctbal"), "c_acctbal")


QUERIES["transform_normalize"] = _transformed("normalize")
QUERIES["transform_standardize"] = _transformed("standardize")


@query
def table_checksum(spark, d):
    return quality.checksum(table(spark, d, "orders"), ["o_orderkey", "o_totalprice"], 2)


@query
def quality_report(spark, d):
    return rounded(quality.quality_report(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "completeness", "outlier_ratio")


@query
def profile_columns(spark, d):
    out = quality.profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(out, "mean", "std", "skewness", "kurtosis", "q25", "median", "q75", n=4)


# D: samples


@query
def split_random(spark, d):
    return sampling.split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query
def split_stratified(spark, d):
    return sampling.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query
def sample_random(spark, d):
    return sampling.sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query
def sample_stratified(spark, d):
    return sampling.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 100)


@query
def balance_undersample(spark, d):
    return sampling.balance(table(spark, d, "labels"), "doc_id", "quality")


@query
def balance_oversample(spark, d):
    return sampling.balance(table(spark, d, "labels"), "doc_id", "quality", "oversample").select("doc_id", "quality", "copy")


@query
def balance_smote(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return sampling.balance(rows, "doc_id", "quality", "smote", ["n_chars", "toxic"]).groupBy("quality", "synthetic").agg(F.count("*").alias("n"))


@query
def balance_info(spark, d):
    return rounded(sampling.balance_info(table(spark, d, "labels"), "quality"), "imbalance")


@query
def augment_gaussian(spark, d):
    return rounded(sampling.augment(table(spark, d, "part"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice", n=4)


# E: scaling

PART = ["p_size", "p_retailprice"]


def _scaled(make):
    return lambda spark, d: rounded(make().fit_transform(table(spark, d, "part")).select("p_partkey", *PART), *PART)


for _m in ("standard", "minmax", "robust", "quantum"):
    QUERIES[f"scale_{_m}"] = _scaled(lambda m=_m: scaling.FeatureScaler(PART, m))
for _m in ("minmax", "robust", "clip", "sigmoid"):
    QUERIES[f"range_{_m}"] = _scaled(lambda m=_m: scaling.RangeNormalizer(PART, -1.0, 1.0, m))
QUERIES["decimal_scale"] = _scaled(lambda: scaling.DecimalScaler(PART))
for _m, _k in (("ln", "natural"), ("log10", "log10"), ("log2", "log2")):
    QUERIES[f"log_{_m}"] = _scaled(lambda k=_k: scaling.LogTransformer(PART, k))
QUERIES["power_sqrt"] = _scaled(lambda: scaling.PowerTransformer(PART, 0.5))
QUERIES["power_log"] = _scaled(lambda: scaling.PowerTransformer(PART, 0))


def _normalized(method):
    def run(spark, d):
        out = scaling.VectorNormalizer("features", method)
        rows = out.fit_transform(feature_rows(spark, d))
        return rounded(rows.select("vec_id", *[F.get("features", F.lit(i)).alias(x) for i, x in enumerate(X)]), *X)

    return run


for _m in ("l1", "l2", "probability", "amplitude", "angle"):
    QUERIES[f"normalize_{_m}"] = _normalized(_m)


@query
def scaling_params(spark, d):
    return rounded(scaling.FeatureScaler(PART).fit(table(spark, d, "part")).params_frame(spark), "mean", "std", "min", "max")


# F: categories


@query
def encode_label(spark, d):
    return categorical.CategoricalEncoder(["c_mktsegment"]).fit_transform(table(spark, d, "customer")).select("c_custkey", "c_mktsegment_label")


@query
def encode_onehot(spark, d):
    out = categorical.CategoricalEncoder(["c_mktsegment"], "onehot").fit_transform(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    return out.select("c_custkey", *[F.col(f"`{c}`").alias(c.lower()) for c in out.columns if c.startswith("c_mktsegment_")])


@query
def encode_binary(spark, d):
    return categorical.CategoricalEncoder(["o_orderpriority"], "binary").fit_transform(table(spark, d, "orders").select("o_orderkey", "o_orderpriority")).drop("o_orderpriority")


@query
def encode_target(spark, d):
    out = categorical.TargetEncoder(["o_orderpriority"], "o_totalprice").fit_transform(table(spark, d, "orders"))
    return rounded(out.select("o_orderkey", "o_orderpriority_target"), "o_orderpriority_target", n=4)


@query
def encode_frequency(spark, d):
    return rounded(categorical.FrequencyEncoder(["p_type"]).fit_transform(table(spark, d, "part")).select("p_partkey", "p_type_freq"), "p_type_freq")


@query
def bin_quantile(spark, d):
    return categorical.BinningEncoder(["p_retailprice"]).fit_transform(table(spark, d, "part")).select("p_partkey", "p_retailprice_bin")


@query
def bin_uniform(spark, d):
    return categorical.BinningEncoder(["p_size"], 4, "uniform").fit_transform(table(spark, d, "part")).select("p_partkey", "p_size_bin")


@query
def bin_kmeans(spark, d):
    return categorical.BinningEncoder(["p_retailprice"], 3, "kmeans").fit_transform(table(spark, d, "part")).select("p_partkey", "p_retailprice_bin")


@query
def hash_features(spark, d):
    rows = categorical.hash_features(table(spark, d, "part"), ["p_brand", "p_type"], 64)
    return rows.select("p_partkey", F.explode("hashed").alias("h")).select("p_partkey", "h.bucket", "h.value")


# G: selection, outliers, reduction

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def feature_anova_f(spark, d):
    return rounded(selection.anova_f(table(spark, d, "lineitem"), LINE, "l_returnflag"), "f_score")


@query
def feature_mutual_info(spark, d):
    return rounded(selection.mutual_info(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag"), "mi")


@query
def feature_corr_matrix(spark, d):
    return rounded(selection.correlations(table(spark, d, "lineitem"), LINE), "corr")


@query
def feature_relevance(spark, d):
    picked = selection.RelevanceSelector(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3).fit(table(spark, d, "lineitem")).report(spark)
    return rounded(picked, "relevance")


def _kept(method):
    return lambda spark, d: outliers.OutlierRemover(["o_totalprice"], method, 2.0).fit_transform(table(spark, d, "orders")).select("o_orderkey")


for _m in ("iqr", "zscore", "distance"):
    QUERIES[f"outliers_{_m}"] = _kept(_m)


@query
def outlier_ratio(spark, d):
    e = table(spark, d, "events")
    return rounded(outliers.OutlierRemover(["value"]).fit(e).outlier_ratio(e), "outlier_ratio")


@query
def outlier_flags(spark, d):
    return rounded(outliers.OutlierDetection(["o_totalprice"]).fit_transform(table(spark, d, "orders")).select("o_orderkey", "score", "is_outlier"), "score")


def centroids(spark, d):
    """Mean vector of each label."""
    rows = vectors(spark, d).groupBy("label").agg(*[F.avg(x).alias(x) for x in X]).orderBy("label").collect()
    return [[float(v) for v in r[1:]] for r in rows]


@query
def impute_nearest_centroid(spark, d):
    rows = vectors(spark, d).withColumn("x0", F.when(F.col("vec_id") % 7 != 0, F.col("x0")))
    return rounded(outliers.KernelImputer(X, centroids=centroids(spark, d)).transform(rows).select("vec_id", *X), *X)


@query
def coreset(spark, d):
    return reduction.CoresetReducer(["p_size", "p_retailprice"], 10).fit_transform(table(spark, d, "part"))


@query
def random_projection(spark, d):
    return rounded(reduction.RandomProjector(X, 2).fit_transform(vectors(spark, d)).select("vec_id", "rp0", "rp1"), "rp0", "rp1")


@query
def auto_reduce(spark, d):
    cols = [f"x{i}" for i in range(16)]
    return reduction.AutoReducer(cols, 10, 100).fit_transform(vectors(spark, d, 16))


@query
def kernel_pca(spark, d):
    return rounded(kernel.KernelPCA(X, 2).fit_transform(vectors(spark, d)).select("vec_id", "pc0", "pc1"), "pc0", "pc1")


@query
def dimension_reduction(spark, d):
    return rounded(reduction.IterativeReduction(X, 2).fit_transform(vectors(spark, d)).select("vec_id", "dim0", "dim1"), "dim0", "dim1")


# H: kernels


def _kernel(f):
    def run(spark, d):
        rows = vectors(spark, d)
        return rounded(kernel.kernel_matrix(rows.where("vec_id % 50 = 0"), rows, "vec_id", X, f), "k")

    return run


QUERIES["kernel_ry"] = _kernel(kernel.ry_kernel)
QUERIES["kernel_regressor"] = _kernel(kernel.regressor_kernel)


@query
def mmd_drift(spark, d):
    rows = vectors(spark, d)
    return rounded(kernel.DriftDetector(X).fit(rows.where("label % 2 = 0")).detect(rows.where("label % 2 = 1")), "mmd_score", n=9)


@query
def kmeans_assign(spark, d):
    return kernel.assign(vectors(spark, d), X, centroids(spark, d)).select("vec_id", "cluster")


@query
def kmeans_step(spark, d):
    moved = kernel.assign(vectors(spark, d), X, centroids(spark, d)).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in X])
    return rounded(moved, *X)


@query
def kernel_kmeans(spark, d):
    return kernel.KernelKMeans(X, 3, key="vec_id").fit_transform(vectors(spark, d)).select("vec_id", "cluster")


@query
def kernel_ridge(spark, d):
    rows = vectors(spark, d)
    return rounded(kernel.KernelRidge(X, "label").fit_transform(rows).select("vec_id", "prediction"), "prediction")


@query
def kernel_svc(spark, d):
    rows = vectors(spark, d).withColumn("half", (F.col("label") % 2).cast("int"))
    return models.KernelSVC(X, "half", max_rows=200).fit_transform(rows).select("vec_id", "prediction")


@query
def kernel_anomaly(spark, d):
    return models.KernelAnomalyDetector(X).fit_transform(vectors(spark, d)).select("vec_id", "prediction")


# J: models


@query
def autoencoder_compress(spark, d):
    return models.Autoencoder(X, 2).fit_transform(vectors(spark, d)).select("vec_id", "x0", "x1")


@query
def autoencoder_decompress(spark, d):
    model = models.Autoencoder(X, 2)
    return model.decompress(model.fit_transform(vectors(spark, d))).select("vec_id", *X)


@query
def neural_net(spark, d):
    return rounded(models.NeuralNetwork(X).fit_transform(vectors(spark, d)).select("vec_id", "prediction"), "prediction")


@query
def meta_learner(spark, d):
    return rounded(models.MetaLearner(X).fit_transform(vectors(spark, d)).select("vec_id", "prediction"), "prediction")


@query
def transfer_learning(spark, d):
    return rounded(models.TransferLearning(X).fit_transform(vectors(spark, d)).select("vec_id", "prediction"), "prediction")


@query
def ensemble_shards(spark, d):
    return models.ensemble_shards(vectors(spark, d), "vec_id", 3).groupBy("model").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query
def series_windows(spark, d):
    daily = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    rows = models.series_windows(daily, "day", "v", 3, 1, by=["event_type"])
    return rows.select("event_type", F.col("day").cast("string").alias("day"), *[F.get("x", F.lit(i)).alias(f"lag{3 - i}") for i in range(3)], F.get("y", F.lit(0)).alias("next"))


# L: encoders


def _encoded(make):
    return lambda spark, d: rounded(enc.exploded(make().transform(feature_rows(spark, d)), "vec_id"), "param")


ENCODERS = {
    "rotation": lambda: enc.RotationEncoder(DIMS),
    "angle": lambda: enc.AngleEncoder(DIMS, "auto"),
    "basis_change": lambda: enc.BasisChangeEncoder(DIMS, "y"),
    "feature_map": lambda: enc.FeatureMapEncoder(DIMS, "polynomial", 2, 2),
    "density": lambda: enc.DensityMatrixEncoder(DIMS),
    "phase": lambda: enc.PhaseEncoder(DIMS),
    "hybrid": lambda: enc.HybridAnglePhaseEncoder(DIMS, 1.0, 3.0),
    "multi_axis": lambda: enc.MultiAxisRotationEncoder(DIMS),
    "parametric": lambda: enc.ParametricAngleEncoder(DIMS),
    "iqp": lambda: enc.IQPEncoder(DIMS),
    "composite": lambda: enc.CompositeEncoder(DIMS, [enc.RotationEncoder(DIMS), enc.AngleEncoder(DIMS, "rz")]),
    "layered": lambda: enc.LayeredEncoder(DIMS, 2, "full"),
    "data_reuse": lambda: enc.DataReuseEncoder(DIMS),
    "adaptive": lambda: enc.AdaptiveEncoder(DIMS),
    "hierarchical": lambda: enc.HierarchicalEncoder(DIMS),
}
for _m, _k in ENCODERS.items():
    QUERIES[f"encode_{_m}"] = _encoded(_k)


@query
def statevector_amplitudes(spark, d):
    rows = feature_rows(spark, d, 3).select("vec_id", F.posexplode(enc.StatevectorEncoder(3).amplitudes(F.col("features"))).alias("i", "amplitude"))
    return rounded(rows.withColumn("i", F.col("i").cast("long")), "amplitude")


@query
def amplitude_encoding(spark, d):
    rows = feature_rows(spark, d).select("vec_id", F.posexplode(enc.AmplitudeEncoder(3).amplitudes(F.col("features"))).alias("i", "amplitude"))
    return rounded(rows.withColumn("i", F.col("i").cast("long")), "amplitude")


@query
def density_matrix(spark, d):
    rows = enc.DensityMatrixEncoder(2).density(feature_rows(spark, d), "vec_id", "features")
    return rounded(rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value"), "value")


@query
def analyze_rows(spark, d):
    rows = feature_rows(spark, d).select("vec_id", enc.AdaptiveEncoder(DIMS).analyze(F.col("features")).alias("a")).select("vec_id", "a.*")
    return rounded(rows, "sparsity", "mean", "std", "max", "norm")


# M: circuits and resources


def iqp(spark, d):
    return enc.IQPEncoder(DIMS).transform(feature_rows(spark, d))


@query
def circuit_compile(spark, d):
    rows = iqp(spark, d).withColumn("circuit", F.struct(F.lit(DIMS).alias("n_qubits"), circuits.compile_gates(F.col("circuit")["gates"]).alias("gates")))
    return circuits.count_ops(rows)


@query
def circuit_transpile(spark, d):
    rows = iqp(spark, d).withColumn("circuit", F.struct(F.lit(DIMS).alias("n_qubits"), circuits.transpile_gates(F.col("circuit")["gates"]).alias("gates")))
    return rows.select("vec_id", F.size(F.col("circuit")["gates"]).cast("long").alias("n_gates"))


@query
def circuit_optimize(spark, d):
    twice = enc.CompositeEncoder(DIMS, [enc.AngleEncoder(DIMS, "ry"), enc.AngleEncoder(DIMS, "rz")]).transform(feature_rows(spark, d, 1).withColumn("features", F.array_repeat(F.get("features", F.lit(0)), DIMS)))
    out = twice.select("vec_id", F.size(F.col("circuit")["gates"]).cast("long").alias("n_before"), circuits.optimize_gates(F.col("circuit")["gates"], 1).alias("g"))
    return out.select("vec_id", "n_before", F.size("g").cast("long").alias("n_after"))


@query
def circuit_metrics(spark, d):
    return circuits.metrics(iqp(spark, d), "vec_id", DIMS)


@query
def circuit_cost(spark, d):
    seconds, price = circuits.job_cost(F.col("depth"))
    out = circuits.metrics(enc.DensityMatrixEncoder(DIMS).transform(feature_rows(spark, d)), "vec_id", DIMS)
    return out.select("vec_id", seconds.alias("seconds"), price.alias("price"), F.round(circuits.linear_cost(F.col("n_gates"), DIMS), 6).alias("cost"))


@query
def cost_breakdown(spark, d):
    out = circuits.metrics(iqp(spark, d), "vec_id", DIMS).withColumn("n_qubits", F.col("vec_id") % 5 + 1)
    return rounded(circuits.cost_breakdown(out, "n_gates", "n_qubits"), "gate_cost", "qubit_cost", "total_cost")


@query
def qasm_round_trip(spark, d):
    rows = iqp(spark, d)
    text = rows.select("vec_id", circuits.qasm(F.col("circuit"), DIMS).alias("qasm"))
    back = text.select("vec_id", F.struct(F.lit(DIMS).alias("n_qubits"), circuits.from_qasm(F.col("qasm")).alias("gates")).alias("circuit"))
    return rounded(enc.exploded(back, "vec_id"), "param")


@query
def feasibility(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return rows.select("l_suppkey", circuits.feasibility(F.col("n") * 100, F.col("l_suppkey") % 150).alias("verdict"))


@query
def simulated_probabilities(spark, d):
    rows = feature_rows(spark, d, 2).select("vec_id", circuits.product_probabilities(F.col("features"), 2).alias("probabilities"))
    return rounded(rows.select("vec_id", *[F.get("probabilities", F.lit(i)).alias(f"p{i}") for i in range(4)]), "p0", "p1", "p2", "p3")


@query
def distributed_encode(spark, d):
    rows = enc.IQPEncoder(DIMS, 1).transform(feature_rows(spark, d).repartition(4))
    return circuits.count_ops(rows)


@query
def scheduler_order(spark, d):
    return resources.schedule_order(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query
def allocation(spark, d):
    tasks = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 + 1).alias("need"))
    return resources.admitted(tasks, "s_suppkey", "need", 127).select("s_suppkey", "allocated", "fits")


@query
def fidelity_estimate(spark, d):
    rows = table(spark, d, "part").select("p_partkey", resources.circuit_fidelity(F.col("p_size"), 1e-3, 1e-2).alias("fidelity"))
    return rounded(rows, "fidelity")


@query
def layout_topk(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 100_000).alias("error"))
    return resources.best_qubits(rows, "s_suppkey", "error", 5)


@query
def zne_mitigate(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg((1 - F.avg("l_discount")).alias("result"))
    return rounded(resources.ErrorMitigation("result").fit_transform(rows), "result", "mitigated", n=9)


@query
def accuracy_degradation(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg((1 - F.avg("l_tax")).alias("accuracy"))
    return rounded(rows.select("l_suppkey", resources.degraded_accuracy(F.col("accuracy")).alias("degraded")), "degraded")


@query
def noise_damping(spark, d):
    rows = feature_rows(spark, d).select("vec_id", resources.damped(F.col("features"), 0.1).alias("v"))
    return rounded(rows.select("vec_id", *[F.get("v", F.lit(i)).alias(x) for i, x in enumerate(X)]), *X)


@query
def noise_depolarizing(spark, d):
    rows = feature_rows(spark, d).select("vec_id", resources.depolarized(F.col("features"), F.col("vec_id"), 0.3).alias("v"))
    return rows.select("vec_id", *[F.get("v", F.lit(i)).alias(x) for i, x in enumerate(X)])


@query
def privacy_loss(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(rows.select("user_id", resources.DifferentialPrivacy(0.5).loss(F.col("n")).alias("loss")), "loss")


# N: governance


@query
def integrity_batch(spark, d):
    rows = feature_rows(spark, d).withColumn("a", enc.AmplitudeEncoder(2).amplitudes(F.col("features")))
    ok = integrity.matches(integrity.squares(F.col("a")), integrity.squares(enc.amplitudes(F.col("features"), 4)))
    return integrity.batch_counts(rows, ok)


@query
def encoding_fidelity(spark, d):
    p = integrity.squares(enc.amplitudes(F.col("features"), 4))
    rows = feature_rows(spark, d).select("vec_id", integrity.fidelity(p, p).alias("f")).select("vec_id", "f.*")
    return rounded(rows, "fidelity", "min_probability", "max_probability", "entropy", "purity")


def failed() -> Column:
    return F.col("event_type") == "error"


@query
def audit_statistics(spark, d):
    e = table(spark, d, "events").withColumn("resource", F.get_json_object("props", "$.k"))
    return rounded(audit.audit_statistics(e, "user_id", "resource", "event_type", ~failed()), "success_rate")


@query
def user_activity(spark, d):
    return audit.activity(table(spark, d, "events"), "user_id", "event_type")


@query
def audit_retention(spark, d):
    return audit.retained(table(spark, d, "events"), ["ts", "event_id"], 500).select("event_id", "user_id")


@query
def compliance_sensitivity(spark, d):
    labelled = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Email_"), "c_name")).otherwise(F.col("c_name")).alias("name"))
    return labelled.where(audit.is_sensitive(F.col("name")))


@query
def resource_limit_violations(spark, d):
    usage = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("used"))
    limits = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.abs("s_acctbal") * 2).alias("most"))
    return audit.limit_violations(usage, limits, "l_suppkey", "used", "most").select("l_suppkey", "used")


@query
def retention_violations(spark, d):
    return audit.retention_violations(table(spark, d, "orders"), "o_orderdate", "2000-01-01", 2000).select("o_orderkey", "age_days")


@query
def governance_catalog(spark, d):
    sets = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("owner"), F.col("lang").alias("classification"), F.lit(None).cast("string").alias("created_date"), "source")
    return audit.catalog(sets)


@query
def governance_owners(spark, d):
    return audit.owners(table(spark, d, "supplier"), F.col("s_nationkey"), "s_suppkey")


@query
def lineage_of_dataset(spark, d):
    sets = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).cast("long").alias("parent")).where("parent > 0")
    return audit.ancestors(sets, "p_partkey", "parent", 150)


def policies(spark):
    return spark.createDataFrame([("discounts", "l_discount", 0.09), ("bulk", "l_quantity", 49.0), ("none", "l_tax", 1.0)], "policy string, measure string, limit double")


@query
def policy_violations(spark, d):
    rows = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return audit.violations(rows, policies(spark), "key", ["l_discount", "l_quantity", "l_tax"])


@query
def compliance_report(spark, d):
    return audit.compliance_report(policy_violations(spark, d), policies(spark))


@query
def lineage_closure(spark, d):
    sets = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).cast("long").alias("parent")).where("parent > 0")
    return audit.closure(sets, "p_partkey", "parent")


def tasks(spark, d):
    """Parts as tasks: each needs the one with half its number."""
    state = F.element_at(F.array(*[F.lit(s) for s in ("success", "pending", "success", "failed", "pending")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), state.alias("status"), F.array(F.floor(F.col("p_partkey") / 2).cast("long")).alias("dependencies"))


@query
def workflow_ready_tasks(spark, d):
    return workflow.ready(tasks(spark, d)).select("task_id")


@query
def workflow_status_counts(spark, d):
    return workflow.status_counts(tasks(spark, d))


@query
def permission_matrix(spark, d):
    role = F.element_at(F.array(*[F.lit(r) for r in ("admin", "developer", "user", "viewer", "guest")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    users = table(spark, d, "customer").select("c_custkey", role.alias("role"))
    return audit.allowed(users, "role", audit.AccessControl().roles(spark), ["read", "write", "delete"])


@query
def security_anomalies(spark, d):
    return audit.failed_attempts(table(spark, d, "events"), "user_id", failed(), 2)


@query
def security_alerts(spark, d):
    e = table(spark, d, "events")
    return audit.alerts(e, "user_id", "event_type", F.when(F.col("value") > 95, "critical").otherwise("info"), failed(), 2)


@query
def security_report(spark, d):
    return audit.security_report(table(spark, d, "events"), security_alerts(spark, d), "event_type")


@query
def key_rotation(spark, d):
    old, new = b"0123456789abcdef", b"fedcba9876543210"
    rows = table(spark, d, "customer").select("c_custkey", audit.rotated(audit.encrypted(F.col("c_name"), old), old, new).alias("secret"))
    return rows.select("c_custkey", audit.decrypted(F.col("secret"), new).alias("name"))


@query
def encryption_round_trip(spark, d):
    key = b"0123456789abcdef"
    rows = table(spark, d, "customer").select("c_custkey", "c_name", audit.encrypted(F.col("c_name"), key).alias("secret"))
    return rows.select("c_custkey", audit.decrypted(F.col("secret"), key).alias("name"))


@query
def schedule_by_time(spark, d):
    return numbered(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", name="place").select("event_id", F.col("place").cast("long").alias("place"))


# Extensions


@query
def ext_event_windows(spark, d):
    out = buffers.windowed(table(spark, d, "events"), "ts", "value", "1 day")
    return rounded(out.withColumn("start", F.col("start").cast("date").cast("string")), "mean")


# Streams, sources and table functions


def event_stream(spark, d):
    """The events as a stream; a pattern, as a stream's folder can't be a single file."""
    return spark.readStream.schema(table(spark, d, "events").schema).option("maxFilesPerTrigger", 100).parquet(f"{d}/event[s].parquet")


@query
def stream_buffer_flush(spark, d):
    flushed = ring.run(ring.flushing(event_stream(spark, d), "event_type", ["ts", "event_id"], ["event_id", "value"], 128), "flushed")
    rows = flushed.select("event_type", "flush_id", "n", F.inline("rows"))
    return rounded(rows.groupBy("event_type", "flush_id", "n").agg(F.min("event_id").alias("first_id"), F.avg("value").alias("mean")), "mean")


@query
def stream_ring_statistics(spark, d):
    rings = ring.run(ring.ring(event_stream(spark, d), "event_type", "value", ["ts", "event_id"], 100, 10), "rings")
    latest = rings.groupBy("event_type").agg(F.max_by(F.struct(*ring.RING), "n_seen").alias("r")).select("event_type", "r.*")
    return rounded(latest.select("event_type", "n_seen", "size", "mean", "std", "min", "max", "window_mean"), "mean", "std", "min", "max", "window_mean")


@query
def record_log_filtered(spark, d):
    """The documents' sizes written to a log in two batches, the first of them twice, and read with a filter that rules out blocks."""
    path = new_path(spark, "log")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    even = F.col("doc_id") % 2 == 0
    for rows, batch in ((docs.where(even), "even"), (docs.where(~even), "odd"), (docs.where(even), "even")):
        record_log.append(rows.sortWithinPartitions("n_chars"), path, batch)
    return record_log.read(spark, path=path).where("n_chars > 3000").select("doc_id", "lang", "n_chars")


@query
def encode_iqp_sql(spark, d):
    tables.register(spark)
    vectors(spark, d).drop("label").createOrReplaceTempView("ketspark_vectors")
    return rounded(spark.sql("select * from encoded_rows(table(ketspark_vectors), 'iqp')"), "param")


@query
def series_windows_sql(spark, d):
    tables.register(spark)
    table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.round(F.sum("value"), 4).alias("v")).createOrReplaceTempView("ketspark_daily")
    return spark.sql("select event_type, cast(day as string) as day, x[0] as lag3, x[1] as lag2, x[2] as lag1, y[0] as next from windows_of(table(ketspark_daily), 'event_type', 'day', 'v', 3, 1)")


# Neighbours and digests


@query
def feature_mutual_info_knn(spark, d):
    return rounded(neighbours.mutual_info_knn(vectors(spark, d), X, "label"), "mi")


def document_tree(spark, d, changed: bool = False):
    rows = table(spark, d, "documents")
    if changed:
        top = rows.agg(F.max("n_chars").alias("top"))  # one row
        rows = rows.join(F.broadcast(top), F.col("n_chars") == F.col("top"), "left").withColumn("text", F.when(F.col("top").isNull(), F.col("text"))).drop("top")
    return merkle.merkle_tree(rows, ["doc_id"], ["doc_id", "text", "lang", "source", "n_chars"], fan=64)


@query
def table_merkle_root(spark, d):
    return merkle.root(document_tree(spark, d))


@query
def table_first_difference(spark, d):
    found = merkle.first_difference(document_tree(spark, d), document_tree(spark, d, True), 64)
    return spark.createDataFrame([(found["first_row"], found["n_rows"])], "first_row long, n_rows long")


@query
def coreset_sensitivity(spark, d):
    """Cost of five sets of centres on all rows, and whether a coreset of 1,000 rows has the same within a tenth; its weights are the rows."""
    rows = vectors(spark, d)
    core = coresets.SensitivityCoreset(X, 1000).fit_transform(rows)
    seeds = [list(r) for r in rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(25).select(*X).collect()]
    found = coresets.cost_ratios(rows, core, X, {f"set {k}": seeds[5 * k : 5 * k + 5] for k in range(5)})
    total = core.agg(F.round(F.sum("weight"), 3).alias("weight"))  # one row
    return rounded(found.withColumn("near", F.abs(F.col("ratio") - 1) < 0.1).crossJoin(F.broadcast(total)).select("name", "cost", "near", "weight"), "cost")


@query
def kernel_pca_landmarks(spark, d):
    cols = [f"x{i}" for i in range(12)]
    return rounded(landmarks.LandmarkPCA(cols, 2, 1e-2).fit_transform(vectors(spark, d, 12)).select("vec_id", "pc0", "pc1"), "pc0", "pc1")


@query
def kernel_svc_all_rows(spark, d):
    rows = vectors(spark, d).withColumn("half", (F.col("label") % 2).cast("int"))
    return svm.PrimalSVC(X, "half", tol=1e-2).fit_transform(rows).select("vec_id", "prediction")
