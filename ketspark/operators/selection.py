"""Feature scores and selection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer, one_of
from ketspark.operators.categorical import BinningEncoder
from ketspark.operators.kernel import second_moments
from ketspark.operators.neighbours import mutual_info_knn


def anova_f(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(feature, f_score): variance between classes over variance inside, in one aggregate by class."""
    by = df.groupBy(label).agg(F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("v", F.var_pop))])
    parts = [F.count("*").alias("k"), F.sum("n").alias("n")]
    for i in range(len(cols)):
        parts += [F.sum(F.col("n") * F.col(f"m{i}")).alias(f"s{i}"), F.sum(F.col("n") * F.pow(f"m{i}", F.lit(2.0))).alias(f"q{i}"), F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}")]
    total = by.agg(*parts)
    score = lambda i: ((F.col(f"q{i}") - F.pow(f"s{i}", F.lit(2.0)) / F.col("n")) / (F.col("k") - 1)) / (F.col(f"w{i}") / (F.col("n") - F.col("k")))
    return total.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), score(i).alias("f_score")) for i, c in enumerate(cols)])))


def mutual_info(df: DataFrame, cols: Sequence[str], label: str, n_bins: int = 5) -> DataFrame:
    """(feature, mi): mutual information in nats of the quantile-binned feature and the class."""
    binned = BinningEncoder(cols, n_bins).fit_transform(df)
    cells = binned.unpivot([label], [f"{c}_bin" for c in cols], "feature", "bin").groupBy("feature", "bin", label).agg(F.count("*").alias("n"))
    nx = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    ny = cells.groupBy("feature", label).agg(F.sum("n").alias("ny"))
    all_ = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    joined = cells.join(nx, ["feature", "bin"]).join(ny, ["feature", label]).join(all_, "feature")
    p = F.col("n") / F.col("total")
    return joined.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi")).withColumn("feature", F.regexp_replace("feature", "_bin$", ""))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs a < b of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


class FeatureSelector(Transformer):
    """The ``n_features`` best by 'f_classif', 'mutual_info' (by nearest neighbours) or 'mutual_info_bins', in their original order."""

    def __init__(self, cols: Sequence[str], label: str, n_features: int = 10, method: str = "f_classif"):
        super().__init__(cols)
        self.label, self.n_features, self.method = label, n_features, one_of(method, ("f_classif", "mutual_info", "mutual_info_bins"), "method")

    def fit(self, df):
        scores = {r[0]: r[1] for r in {"f_classif": anova_f, "mutual_info": mutual_info_knn, "mutual_info_bins": mutual_info}[self.method](df, self.cols, self.label).collect()}
        best = sorted(self.cols, key=lambda c: (-(scores[c] if scores[c] is not None else -1.0), self.cols.index(c)))[: self.n_features]
        self.params = {"scores": scores, "selected": [c for c in self.cols if c in best]}
        return self

    def transform(self, df):
        gone = [c for c in self.cols if c not in self.fitted()["selected"]]
        return df.drop(*gone)


class RelevanceSelector(Transformer):
    """Greedy relevance less mean redundancy, both by absolute correlation; ties go to the first column."""

    unfitted = RuntimeError

    def __init__(self, cols: Sequence[str], target: str, n_features: int = 5):
        super().__init__(cols)
        self.target, self.n_features = target, n_features

    def fit(self, df):
        _, mean, m = second_moments([F.col(c).cast("double") for c in self.cols], F.col(self.target).cast("double"), df)
        cov = m - np.outer(mean, mean)
        sd = np.sqrt(np.diag(cov))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.nan_to_num(np.abs(cov / np.outer(sd, sd)))
        relevance, chosen = r[:-1, -1].round(12), []
        while len(chosen) < min(self.n_features, len(self.cols)):
            score = relevance - (r[:-1, chosen].mean(axis=1) if chosen else 0)
            score[chosen] = -np.inf
            chosen.append(int(score.round(12).argmax()))
        self.params = {"selected": [self.cols[i] for i in chosen], "relevance": dict(zip(self.cols, relevance.tolist(), strict=True))}
        return self

    def transform(self, df):
        return df.select(*self.fitted()["selected"])

    def report(self, spark) -> DataFrame:
        p = self.fitted()
        return spark.createDataFrame([(i, c, p["relevance"][c]) for i, c in enumerate(p["selected"])], "rank long, feature string, relevance double")
