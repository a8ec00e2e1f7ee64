"""Scalers and normalisers: one aggregate to fit, one projection to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.base import Transformer, one_of
from ketspark.functions.arrays import norm1, norm2, scaled
from ketspark.plans.stats import column_stats


def or_one(x: float | None) -> float:
    return x or 1.0


class ColumnScaler(Transformer):
    """Applies ``expression`` to each column, with its statistics."""

    percentiles: tuple[float, ...] = ()

    def fit(self, df: DataFrame):
        self.params = column_stats(df, self.cols, self.percentiles)
        return self

    def expression(self, x: Column, s: dict) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.fitted()
        return df.withColumns({c: self.expression(F.col(c).cast("double"), p[c]) for c in self.cols})

    def params_frame(self, spark) -> DataFrame:
        """Fitted statistics, one row a column."""
        rows = [(c, s["mean"], s["std"], s["min"], s["max"]) for c, s in self.fitted().items()]
        return spark.createDataFrame(rows, "column string, mean double, std double, min double, max double")


class DataTransformer(ColumnScaler):
    """'normalize' (min-max), 'scale' or 'standardize' (z-score with population deviation)."""

    def __init__(self, cols: Sequence[str], kind: str = "normalize"):
        super().__init__(cols)
        self.kind = one_of(kind, ("normalize", "scale", "standardize"), "kind")

    def expression(self, x, s):
        if self.kind == "standardize":
            return (x - s["mean"]) / or_one(s["std"])
        return (x - s["min"]) / or_one(s["max"] - s["min"])


class FeatureScaler(ColumnScaler):
    """'standard', 'minmax' to a range, 'robust' (median, IQR), or 'quantum' (standard, then rows of norm 1)."""

    def __init__(self, cols: Sequence[str], method: str = "standard", feature_range: tuple[float, float] = (0.0, 1.0)):
        super().__init__(cols)
        self.method, self.feature_range = one_of(method, ("standard", "minmax", "robust", "quantum"), "method"), feature_range
        self.percentiles = (0.25, 0.5, 0.75) if method == "robust" else ()

    def expression(self, x, s):
        if self.method == "minmax":
            lo, hi = self.feature_range
            return (x - s["min"]) / or_one(s["max"] - s["min"]) * (hi - lo) + lo
        if self.method == "robust":
            return (x - s["q"][0.5]) / or_one(s["q"][0.75] - s["q"][0.25])
        return (x - s["mean"]) / or_one(s["std"])

    def transform(self, df):
        out = super().transform(df)
        if self.method == "quantum":
            norm = norm2(F.array(*self.cols))
            out = out.withColumn("__norm", F.when(norm == 0, 1.0).otherwise(norm)).withColumns({c: F.col(c) / F.col("__norm") for c in self.cols}).drop("__norm")
        return out


class VectorNormalizer(Transformer):
    """Normalises each row's vector: 'l2', 'amplitude', 'l1', 'probability' or 'angle' (modulo 2 pi)."""

    def __init__(self, col: str, method: str = "l2", scale_range: tuple[float, float] = (-1.0, 1.0)):
        super().__init__([col])
        self.method, self.scale_range = one_of(method, ("l2", "amplitude", "l1", "probability", "angle"), "method"), scale_range

    def transform(self, df):
        self.fitted()
        (c,) = self.cols
        v = F.col(c)
        if self.method in ("l2", "amplitude"):
            out = scaled(v, norm2(v))
        elif self.method == "l1":
            out = scaled(v, norm1(v))
        elif self.method == "probability":
            out = scaled(F.transform(v, F.abs), norm1(v))
        else:
            out = F.transform(v, lambda x: F.pmod(x, F.lit(2 * math.pi)))
        lo, hi = self.scale_range
        if (lo, hi) != (-1.0, 1.0) and self.method not in ("angle", "probability"):
            out = F.transform(out, lambda z: lo + (z + 1) / 2 * (hi - lo))
        return df.withColumn(c, out)


class RangeNormalizer(ColumnScaler):
    """'minmax', 'clip', 'robust' (first quartile and IQR) or 'sigmoid', to [low, high]."""

    def __init__(self, cols: Sequence[str], low: float = 0.0, high: float = 1.0, method: str = "minmax"):
        super().__init__(cols)
        if low >= high:
            raise ValueError("low must be below high")
        self.low, self.high, self.method = low, high, one_of(method, ("minmax", "clip", "robust", "sigmoid"), "method")
        self.percentiles = (0.25, 0.75) if method == "robust" else ()

    def expression(self, x, s):
        z = (x - s["min"]) / or_one(s["max"] - s["min"])
        if self.method == "clip":
            z = F.greatest(F.least(z, F.lit(1.0)), F.lit(0.0))
        elif self.method == "robust":
            z = (x - s["q"][0.25]) / or_one(s["q"][0.75] - s["q"][0.25])
        elif self.method == "sigmoid":
            z = 1 / (1 + F.exp(-z))
        return z * (self.high - self.low) + self.low


class DecimalScaler(ColumnScaler):
    """Divides by the power of ten that brings every value into [-1, 1]."""

    def factor(self, s: dict) -> float:
        return 10.0 ** math.ceil(math.log10(s["top"])) if s["top"] else 0.0

    def expression(self, x, s):
        return x / (self.factor(s) or 1.0)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        p = self.fitted()
        return df.withColumns({c: F.col(c) * (self.factor(p[c]) or 1.0) for c in self.cols})


class LogTransformer(ColumnScaler):
    """Logarithm 'natural', 'log10' or 'log2' of x + shift; NaN where that is negative."""

    BASES = {"natural": math.e, "log10": 10.0, "log2": 2.0}

    def __init__(self, cols: Sequence[str], method: str = "natural", shift: float = 1e-10):
        super().__init__(cols)
        self.method, self.shift = one_of(method, tuple(self.BASES), "method"), shift

    def fit(self, df):
        super().fit(df)
        if self.shift <= 0 and any(s["min"] is not None and s["min"] <= 0 for s in self.params.values()):
            least = df.agg(F.least(*[F.min(F.when(F.col(c) != 0, F.abs(F.col(c).cast("double")))) for c in [*self.cols, self.cols[0]]])).first()[0]
            self.shift = (least or 1.0) / 100
        return self

    def expression(self, x, s):
        y = x + self.shift
        log = {"natural": F.ln, "log10": F.log10, "log2": F.log2}[self.method]
        return F.when(y > 0, log(y)).when(y == 0, F.lit(float("-inf"))).when(y.isNotNull(), F.lit(float("nan")))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.fitted()
        return df.withColumns({c: F.pow(F.lit(self.BASES[self.method]), F.col(c)) - self.shift for c in self.cols})


class PowerTransformer(ColumnScaler):
    """sign(x)|x|^p, or log(|x| + 1e-10) for p = 0; a positive power needs positive values to fit."""

    def __init__(self, cols: Sequence[str], power: float = 0.5):
        super().__init__(cols)
        self.power = power

    def fit(self, df):
        super().fit(df)
        if self.power > 0 and any(s["min"] is not None and s["min"] <= 0 for s in self.params.values()):
            self.params = None
            raise ValueError("a positive power needs positive values")
        return self

    def expression(self, x, s):
        return F.ln(F.abs(x) + 1e-10) if self.power == 0 else F.signum(x) * F.pow(F.abs(x), F.lit(self.power))

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self.fitted()
        back = lambda x: F.exp(x) - 1e-10 if self.power == 0 else F.signum(x) * F.pow(F.abs(x), F.lit(1 / self.power))
        return df.withColumns({c: back(F.col(c)) for c in self.cols})
