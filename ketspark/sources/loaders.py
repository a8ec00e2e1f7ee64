"""Loaders that read by Spark and number batches, format conversion, circuit files, and a registry."""

from __future__ import annotations

import itertools
import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import NumericType

from ketspark.base import one_of
from ketspark.functions.arrays import features
from ketspark.operators.circuits import qasm
from ketspark.operators.encoders import CIRCUIT, RotationEncoder, StatevectorEncoder
from ketspark.plans.numbering import batch_ids
from ketspark.plans.storage import shared_dir, stored
from ketspark.sources import record_log


class DataLoader:
    """Batches of fixed size in key order, with the circuit of each row ('angle' or 'amplitude')."""

    def __init__(self, df: DataFrame, key: str, batch_size: int = 32, encoder: str = "angle"):
        self.df, self.key, self.batch_size = df, key, batch_size
        self.encoder = one_of(encoder, ("angle", "amplitude"), "encoder")

    def batches(self) -> DataFrame:
        return batch_ids(self.df, self.key, self.batch_size)

    def circuits(self, vector: str, n: int) -> DataFrame:
        out = self.batches().withColumn("features", features(vector, n))
        return (RotationEncoder(n) if self.encoder == "angle" else StatevectorEncoder(n)).transform(out)

    def count(self) -> DataFrame:
        """(n_batches)."""
        return self.df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / self.batch_size)).cast("long").alias("n_batches"))

    def __len__(self) -> int:
        return -(-self.df.count() // self.batch_size)

    def __iter__(self) -> Iterator[DataFrame]:
        """Batch after batch; the numbered rows are stored by batch, so that a batch reads its own files alone."""
        spark, path = self.df.sparkSession, f"{shared_dir(self.df.sparkSession)}/batches-{uuid.uuid4().hex}"
        own = self.batches()
        own.repartitionByRange("batch_id").write.partitionBy("batch_id").parquet(path)
        for b in range(len(self)):
            yield spark.read.schema(own.schema).parquet(path).where(F.col("batch_id") == b).drop("batch_id")


class SqlLoader(DataLoader):
    """Batches of a query over registered views, or of a database over JDBC, which many tasks read by ranges of a numeric key."""

    def __init__(self, spark: SparkSession, query: str, key: str, batch_size: int = 100, encoder: str = "angle", url: str | None = None, rows_a_task: int = 100_000, **options: str):
        if url:
            df = read_ranges(spark, url, query, key, rows_a_task, fetchsize=str(batch_size), **options)
        else:
            df = spark.sql(query)
        super().__init__(df, key, batch_size, encoder)

    def execute(self, limit: int | None = None) -> DataFrame:
        return self.df.orderBy(self.key).limit(limit) if limit else self.df

    def close(self) -> None:
        """Spark closes its connections itself."""

    def __enter__(self) -> SqlLoader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def read_ranges(spark: SparkSession, url: str, query: str, key: str, rows: int = 100_000, **options: str) -> DataFrame:
    """A database's ``query``, each task reading a range of ``key`` of about ``rows`` rows.

    The database counts its rows in equal parts of the key's range, and parts that hold too many are halved and counted again, until each is
    small or a single value; small neighbours are put together. Every range is a predicate, so the ranges are read independently, and
    rows with a null key are a range of their own. A key that is no number, or a table without rows, is read as one range.
    """
    ask = lambda text: spark.read.format("jdbc").options(url=url, query=text, **options).load()
    inner = f"({query}) t"
    numeric = isinstance(ask(f"select {key} from {inner} where 1 = 0").schema[0].dataType, NumericType)
    n, known, low, high = ask(f"select count(*) as n, count({key}) as k, min({key}) as a, max({key}) as b from {inner}").first() if numeric else (0, 0, 0, 0)
    if not known:
        predicates = ["1 = 1"]
    else:
        low, high = math.floor(low), math.floor(high) + 1
        done: list[tuple[int, int, int]] = []
        todo = [(low, high, known)]
        while todo:
            parts = []
            for a, b, size in todo:
                if size <= rows or b - a <= 1:
                    done.append((a, b, size))
                else:
                    pieces = min(b - a, 256 if len(todo) == 1 else 2)
                    cuts = [a + (b - a) * i // pieces for i in range(pieces + 1)]
                    parts += [(x, y) for x, y in itertools.pairwise(cuts) if x < y]
            todo = []
            for own in itertools.batched(parts, 64):  # one question for many parts
                counts = ", ".join(f"sum(case when {key} >= {x} and {key} < {y} then 1 else 0 end) as c{i}" for i, (x, y) in enumerate(own))
                found = ask(f"select {counts} from {inner} where {key} >= {own[0][0]} and {key} < {own[-1][1]}").first()
                todo += [(x, y, int(c)) for (x, y), c in zip(own, found, strict=True) if c]
        ranges: list[list[int]] = []
        for a, b, size in sorted(done):
            if ranges and ranges[-1][2] + size <= rows:
                ranges[-1] = [ranges[-1][0], b, ranges[-1][2] + size]
            else:
                ranges.append([a, b, size])
        predicates = [f"{key} >= {a} and {key} < {b}" for a, b, _ in ranges] + ([f"{key} is null"] if known < n else [])
    return spark.read.jdbc(url, inner, predicates=predicates, properties=options)


#: files whose footers one task opens
FOOTERS = 64


def footers(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in paths:
        rows = []
        for path in part["file"]:
            # Spark writes file:/x for what a URI has as file:///x, and signs of its own in place of others
            fs, name = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            with fs.open_input_file(name if fs.get_file_info(name).type == FileType.File else unquote(name)) as f:
                own, first = pq.ParquetFile(f).metadata, 0
                for k in range(own.num_row_groups):
                    n = own.row_group(k).num_rows
                    rows += [(path, k, first, n)] if n else []
                    first += n
        yield pd.DataFrame(rows, columns=["file", "row_group", "first_row", "n_rows"])


class ParquetLoader(DataLoader):
    def __init__(self, spark: SparkSession, path: str, key: str, batch_size: int = 1000, encoder: str = "angle"):
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            raise ValueError(f"could not open {path}") from e
        super().__init__(df, key, batch_size, encoder)

    def metadata(self) -> DataFrame:
        """(num_rows, num_columns, num_row_groups, column_names, batch_size, encoder_type)."""
        names = self.df.columns
        groups = F.lit(self.row_groups().count()).cast("long")
        out = self.df.agg(F.count("*").alias("num_rows")).select("num_rows", F.lit(len(names)).cast("long").alias("num_columns"), F.lit(",".join(names)).alias("column_names"), F.lit(self.batch_size).cast("long").alias("batch_size"))
        return out.withColumns({"num_row_groups": groups, "encoder_type": F.lit(self.encoder)})

    def row_groups(self) -> DataFrame:
        """(file, row_group, first_row, n_rows), from the files' footers alone, which tasks open, FOOTERS files each; row groups
        without rows are left out. Stores that only Spark's own file systems reach are opened by the driver, file by file."""
        spark, schema = self.df.sparkSession, "file string, row_group int, first_row long, n_rows long"
        files = self.df.inputFiles()
        if all(re.match(r"(file|hdfs|s3|gs):/", f) for f in files):
            paths = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, -(-len(files) // FOOTERS)))
            return stored(paths.mapInPandas(footers, schema), "footers")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        rows = []
        for path in files:
            first, reader = 0, jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
            try:
                for k, block in enumerate(reader.getRowGroups()):
                    n = block.getRowCount()
                    rows += [(path, k, first, n)] if n else []
                    first += n
            finally:
                reader.close()
        return spark.createDataFrame(rows, schema)

    def row_group_batches(self) -> DataFrame:
        """Rows with batch_id, in the files' own order: batches of ``batch_size`` rows that never span a row group. Each row
        finds its row group by its file and its place there; nothing is sorted or shuffled."""
        groups = self.row_groups().withColumn("__n", F.ceil(F.col("n_rows") / self.batch_size)).orderBy("file", "row_group").collect()
        spark, by_file, passed = self.df.sparkSession, {}, 0
        for g in groups:
            by_file.setdefault(re.sub("^file:/+", "/", g["file"]), []).append((g["first_row"], passed))
            passed += g["__n"]
        table = spark.createDataFrame(list(by_file.items()), "__file string, __groups array<struct<first:long,batch:long>>")
        own = self.df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        joined = own.join(F.broadcast(table) if len(groups) <= 100_000 else table, "__file")
        group = F.element_at(F.filter("__groups", lambda g: g["first"] <= F.col("__row")), -1)
        return joined.withColumn("batch_id", (group["batch"] + F.floor((F.col("__row") - group["first"]) / self.batch_size)).cast("long")).drop("__file", "__row", "__groups")

    def schema(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.df.dtypes, "column_name string, data_type string")

    def sample(self, n: int = 5) -> DataFrame:
        if self.df.isEmpty():
            raise ValueError("the file has no rows")
        return self.df.orderBy(self.key).limit(n)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def to_lists(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, names): the distinct values of a key in order, joined by commas; for columns of few distinct values."""
    return df.select(key, col).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(col)), ",").alias("names"))


def to_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, column, value): one row a cell."""
    return df.unpivot([key], [F.col(c).cast("double").alias(c) for c in cols], "column", "value")


def save_circuits(df: DataFrame, path: str, key: str, n_qubits: int, circuit: str = "circuit") -> None:
    rows = df.select(F.col(key).alias("id"), F.col(circuit).alias("circuit"), F.lit(n_qubits).alias("n_qubits"), qasm(F.col(circuit), n_qubits).alias("qasm"))
    rows.write.json(path)


def load_circuits(spark: SparkSession, path: str) -> DataFrame:
    """Circuits of a JSON folder; records that can't be parsed are left out."""
    rows = spark.read.schema(f"id long, circuit {CIRCUIT}, n_qubits int, qasm string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and circuit is not null").drop("_corrupt")


def save_params(params: dict, path: str, spark: SparkSession) -> None:
    """Fitted parameters to a folder that the cluster shares: numbers and lists as JSON, tables as Parquet beside it."""
    plain, tables = {}, {}

    def parted(x, name: str):
        if isinstance(x, DataFrame):
            tables[name] = x
            return {"__table": name}
        return {str(k): parted(v, f"{name}-{k}") for k, v in x.items()} if isinstance(x, dict) else x

    plain = parted(params, "params")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.text(f"{path}/params")


def load_params(path: str, spark: SparkSession) -> dict:
    def joined(x):
        if isinstance(x, dict):
            return spark.read.parquet(f"{path}/{x['__table']}") if "__table" in x else {k: joined(v) for k, v in x.items()}
        return x

    return joined(json.loads(spark.read.text(f"{path}/params").first()[0]))


class Connectors:
    """Registry of functions (spark, **options) -> DataFrame, and of data sources that Spark plans."""

    known: dict[str, Callable[..., DataFrame]] = {}

    @classmethod
    def register(cls, name: str, make: Callable[..., DataFrame]) -> None:
        cls.known[name] = make

    @classmethod
    def register_source(cls, spark: SparkSession, source: type[DataSource]) -> None:
        """A data source of Spark's Python API: known to SQL, ``spark.read.format`` and streams by its name, and here as well."""
        spark.dataSource.register(source)
        name = source.name()
        cls.register(name, lambda session, **options: session.read.format(name).options(**options).load())

    @classmethod
    def create(cls, name: str, spark: SparkSession, **options) -> DataFrame:
        if name not in cls.known:
            raise ValueError(f"unknown connector {name}; there are {', '.join(sorted(cls.known))}")
        return cls.known[name](spark, **options)

    @classmethod
    def available(cls) -> list[str]:
        return sorted(cls.known)


Connectors.register("parquet", lambda spark, path: spark.read.parquet(path))
Connectors.register("csv", lambda spark, path, schema=None: read_csv(spark, path, schema))
Connectors.register("sql", lambda spark, query: spark.sql(query))
Connectors.register("record_log", lambda spark, **options: record_log.read(spark, **options))
