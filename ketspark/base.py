"""Errors and the fit/transform protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


class KetsparkError(Exception):
    """Base of the library's own errors."""


class CapacityError(KetsparkError):
    """More features than there are qubits."""


class DriftError(KetsparkError):
    """Drift beyond a threshold, where the caller asked for an error."""


class Transformer:
    """``fit`` learns a few driver-side numbers by one aggregate; ``transform`` is a projection or filter with them."""

    unfitted: type[Exception] = ValueError

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.params: dict | None = None

    def fit(self, df: DataFrame):
        self.params = {}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def fitted(self) -> dict:
        if self.params is None:
            raise self.unfitted(f"{type(self).__name__} is not fitted")
        return self.params


def one_of(value: str, allowed: Sequence[str], name: str) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
    return value
