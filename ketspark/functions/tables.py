"""Table functions for SQL: a row becomes many rows, and a series its windows. Their columns follow from the table that is given.

    select * from encoded_rows(table(select vec_id, x0, x1 from t), 'iqp')
    select * from windows_of(table(t), 'k', 'day', 'v', 3, 1)

The first handles rows alone; the second asks for its rows by series and in order itself, so a caller may leave PARTITION BY
and ORDER BY out. A series is one task, as in every window over a key.

Nulls: a null feature gives a gate with a null parameter; null values stand in windows like others. The row of a null key is encoded like others.
A table without rows gives none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, NumericType, Row, StringType, StructType

from ketspark.operators.encoders import PROGRAMS


def named(table: StructType, column: AnalyzeArgument) -> DataType:
    if column.value not in table.names:
        raise ValueError(f"there is no column {column.value}")
    return table[column.value].dataType


class EncodedRows:
    """(key, gate_no, type, q0, q1, param): the gates of every row; key is the first column, the features are the others."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, program: AnalyzeArgument, *repeats: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument is a table")
        key, *features = rows.dataType.fields
        if not features or any(not isinstance(f.dataType, NumericType) for f in features):
            raise ValueError("all columns after the first must be numbers")
        if program.value not in PROGRAMS:
            raise ValueError(f"unknown encoder {program.value}; there are {', '.join(PROGRAMS)}")
        schema = StructType().add(key.name, key.dataType).add("gate_no", LongType()).add("type", StringType()).add("q0", LongType()).add("q1", LongType()).add("param", DoubleType())
        return AnalyzeResult(schema)

    def eval(self, row: Row, program: str, repeats: int = 2) -> Iterator[tuple]:
        key, *x = row
        x = [None if v is None else float(v) for v in x]
        for no, (kind, q0, q1, param) in enumerate(PROGRAMS[program](x, repeats)):
            yield key, no, kind, q0, q1, param


class WindowsOf:
    """(series, order, x, y): sliding windows of ``lookback`` values and the ``horizon`` after them."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, order: AnalyzeArgument, value: AnalyzeArgument, lookback: AnalyzeArgument, horizon: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(rows.dataType, StructType):
            raise ValueError("the first argument is a table")
        if lookback.value < 1 or horizon.value < 0:
            raise ValueError("lookback must be positive, and horizon not negative")
        kind = ArrayType(named(rows.dataType, value))
        schema = StructType().add(by.value, named(rows.dataType, by)).add(order.value, named(rows.dataType, order)).add("x", kind).add("y", kind)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{by.value}`")], orderBy=[OrderingColumn(f"`{order.value}`")])

    def __init__(self) -> None:
        self.held: deque = deque()

    def eval(self, row: Row, by: str, order: str, value: str, lookback: int, horizon: int) -> Iterator[tuple]:
        self.held.append((row[by], row[order], row[value]))
        if len(self.held) == lookback + horizon:
            values = [v for *_, v in self.held]
            series, at, _ = self.held.popleft()
            yield series, at, values[:lookback], values[lookback:]


def register(spark: SparkSession) -> None:
    """Make both known to a session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("encoded_rows", udtf(EncodedRows))
    spark.udtf.register("windows_of", udtf(WindowsOf))
