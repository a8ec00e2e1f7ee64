"""Table functions from SQL, and reading a database by ranges of a key."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ketspark import oracles, registry
from ketspark.functions import tables
from ketspark.operators import encoders as enc
from ketspark.operators import sampling
from ketspark.sources import loaders


@pytest.fixture
def names(spark):
    tables.register(spark)
    rows = [(1, 0.5, -2.0, 3.0), (2, None, 1.0, 0.25), (None, 1.0, 1.0, 1.0), (1, 0.5, -2.0, 3.0)]
    spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double").createOrReplaceTempView("given")


@pytest.mark.parametrize("program,make", [("iqp", lambda: enc.IQPEncoder(3)), ("rotation", lambda: enc.RotationEncoder(3)), ("angle", lambda: enc.AngleEncoder(3, "auto"))])
def test_rows_of_gates_equal_the_column_form(spark, names, program, make):
    own = spark.table("given").select("id", F.array("x0", "x1", "x2").alias("features"))
    expected = enc.exploded(make().transform(own), "id").select("id", "gate_no", "type", "q0", "q1", "param")
    got = spark.sql(f"select * from encoded_rows(table(given), '{program}')")
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.select(expected.columns).collect())) == sorted(map(key, expected.collect()))
    assert got.schema["id"].dataType == spark.table("given").schema["id"].dataType
    # lateral use with partitions, and repeats
    assert spark.sql("select count(*) as n from encoded_rows(table(given) partition by (id), 'iqp', 3)").first().n == 4 * 3 * 8


def test_wrong_arguments_are_told_at_once(spark, names):
    for text in ("encoded_rows(table(given), 'unheard')", "encoded_rows(table(select id from given), 'iqp')", "encoded_rows(table(select id, 'a' as t from given), 'iqp')", "windows_of(table(given), 'id', 'no', 'x0', 2, 1)", "windows_of(table(given), 'id', 'x0', 'x1', 0, 1)"):
        with pytest.raises(PySparkException):
            spark.sql(f"select * from {text}").collect()
    assert spark.sql("select * from encoded_rows(table(select * from given where id > 5), 'iqp')").count() == 0


def test_windows_of_series(spark, names):
    rows = [(k, t, None if t == 4 else float(t * t)) for k in ("a", "b c", None) for t in range(7 if k == "a" else 3)]
    spark.createDataFrame(rows, "`the key` string, t int, v double").repartition(4).createOrReplaceTempView("series")
    got = spark.sql("select * from windows_of(table(series), 'the key', 't', 'v', 3, 1)").collect()
    value = lambda t: None if t == 4 else float(t * t)
    assert sorted((r["the key"], r.t, r.x, r.y) for r in got) == [("a", t, [value(t + i) for i in range(3)], [value(t + 3)]) for t in range(4)]


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A file database with a skewed key, gaps, nulls and negative numbers."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/shop;create=true"
    keys = [*range(-50, 400), *[7] * 300, *range(10**6, 10**6 + 200), None, None]
    rows = spark.createDataFrame([(k, f"n{i}", i * 0.5) for i, k in enumerate(keys)], "K int, NAME string, PRICE double")
    rows.coalesce(1).write.jdbc(url, "things", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    spark.createDataFrame([], "K int, NAME string").write.jdbc(url, "nothing", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    return url, rows


OPTIONS = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_database_is_read_by_ranges(spark, database):
    url, rows = database
    got = loaders.read_ranges(spark, url, "select k, name, price from things", "k", 60, **OPTIONS)
    same = lambda df: sorted(map(repr, df.collect()))
    assert got.columns == rows.columns and same(got) == same(rows)
    sizes = [n for (n,) in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 8 and sorted(sizes)[-2] <= 60  # one value alone holds 301 rows and can't be parted
    where = loaders.read_ranges(spark, url, "select k, name from things where k > 390 and k < 1000", "k", 60, **OPTIONS)
    assert where.count() == 9
    loader = loaders.SqlLoader(spark, "select k, name, price from things where k is not null", "k", 100, url=url, rows_a_task=60, **OPTIONS)
    assert len(loader) == 10 and loader.df.rdd.getNumPartitions() > 8


def test_databases_without_ranges(spark, database):
    url, _ = database
    assert loaders.read_ranges(spark, url, "select k, name from nothing", "k", 60, **OPTIONS).count() == 0
    assert loaders.read_ranges(spark, url, "select name, price from things", "name", 60, **OPTIONS).count() == 952
    assert loaders.read_ranges(spark, url, "select k from things where k is null", "k", 60, **OPTIONS).count() == 2


def test_footers_are_read_in_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(5):
        (tmp_path / "some files").mkdir(exist_ok=True)
        pq.write_table(pa.table({"k": list(range(100 * k, 100 * k + 25))}), tmp_path / "some files" / f"{k}.parquet", row_group_size=10)
    pq.write_table(pa.table({"k": pa.array([], pa.int64())}), tmp_path / "some files" / "none.parquet")
    loader = loaders.ParquetLoader(spark, str(tmp_path / "some files"), "k", 4)
    groups = loader.row_groups().collect()
    assert len(groups) == 15 and sum(r.n_rows for r in groups) == 125 and loader.metadata().first().num_row_groups == 15
    batches = loader.row_group_batches().groupBy("batch_id").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).collect()
    assert len(batches) == 5 * (3 + 3 + 2) and all(r.b - r.a == r.n - 1 and r.a // 10 == r.b // 10 and r.n <= 4 for r in batches)


@pytest.mark.parametrize("n", [90, 170, 350])
def test_splits_are_cut_exactly(spark, tmp_path, n):
    # in doubles n * 0.7 is less than the whole number it should be
    import duckdb

    rows = [(k, label) for k, label in enumerate("a" * n + "b" * 20)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.QUERIES["split_stratified"](spark, str(tmp_path)).select("o_orderkey", "o_orderpriority", "part").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(oracles.ORACLE_SQL["split_stratified"]).fetchall())
    one = sampling.split(spark.range(n), "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in one} == {"train": n * 7 // 10, "val": n * 15 // 100, "test": n - n * 7 // 10 - n * 15 // 100}
