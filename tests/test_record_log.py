"""The record log: visible rows, pruned blocks, exactly one commit a batch, and streams in both directions."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from ketspark.governance import audit
from ketspark.sources import loaders, record_log


@pytest.fixture
def log(spark, tmp_path):
    record_log.register(spark)
    return str(tmp_path / "log")


def numbers(spark, lo, hi, parts=3):
    return spark.range(lo, hi, 1, parts).select("id", (F.col("id") * 0.5).alias("x"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))


def write(df, path, **options):
    df.write.format("record_log").mode("append").options(**options).save(path)


def read(spark, path, **options):
    return spark.read.format("record_log").options(**options).load(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_come_back_in_several_partitions(spark, log):
    df = numbers(spark, 0, 100)
    write(df, log, rows="10")
    write(numbers(spark, 100, 150), log, rows="10")
    got = read(spark, log, rows="20")
    assert got.dtypes == df.dtypes and rows(got) == rows(numbers(spark, 0, 150)) and got.rdd.getNumPartitions() > 5
    assert read(spark, f"file://{log}").count() == 150


@pytest.mark.parametrize("where", ["id = 42", "id > 95", "id >= 95 and x < 48.5", "id in (3, 77)", "name = 'n41'", "name is null", "day <= date'2024-01-05'", "id < 0", "not (id = 3)", "name > 'n9' or id = 1"])
def test_filters_rule_out_blocks_and_no_rows(spark, log, where):
    write(numbers(spark, 0, 100), log, rows="10")
    assert rows(read(spark, log).where(where)) == rows(numbers(spark, 0, 100).where(where))


def test_blocks_that_a_filter_rules_out_are_not_planned(spark, log):
    write(numbers(spark, 0, 100, 1).withColumn("x", F.when(F.col("id") < 10, F.lit(float("nan"))).otherwise(F.col("x"))), log, rows="10")
    reader = record_log.Reader(log, 1)
    assert list(reader.pushFilters([ds.GreaterThan(("id",), 84), ds.StringContains(("name",), "n")])) and len(reader.partitions()) == 2
    reader = record_log.Reader(log, 1)
    list(reader.pushFilters([ds.LessThan(("x",), 1.0)]))
    assert [p.blocks for p in reader.partitions()] == [[0]]  # a block with NaN has no bounds and stays
    assert read(spark, log).where("id > 84").rdd.getNumPartitions() < read(spark, log, rows="1").rdd.getNumPartitions()


def test_a_batch_is_written_once(spark, log):
    write(numbers(spark, 0, 10), log, batch="first")
    write(numbers(spark, 0, 10), log, batch="first")
    write(numbers(spark, 10, 20), log, batch="second")
    assert read(spark, log).count() == 20 and len(record_log.Folder(log).commits()) == 2
    assert len(os.listdir(f"{log}/data")) == sum(len(c["files"]) for c in record_log.Folder(log).commits())


def test_a_failed_write_leaves_nothing_visible(spark, log):
    write(numbers(spark, 0, 10), log)
    broken = numbers(spark, 10, 40).withColumn("x", F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(PySparkException):
        write(broken, log, rows="2")
    assert read(spark, log).count() == 10 and len(record_log.Folder(log).commits()) == 1
    with pytest.raises(PySparkException, match="another schema"):
        write(spark.range(3), log)
    assert read(spark, log).count() == 10 and len(os.listdir(f"{log}/data")) == sum(len(c["files"]) for c in record_log.Folder(log).commits())


def test_no_rows_odd_names_and_errors(spark, log):
    write(spark.createDataFrame([], "`a b` array<int>, m map<string,double>"), log)
    assert read(spark, log).count() == 0 and read(spark, log).columns == ["a b", "m"]
    write(spark.createDataFrame([([1, None], {"k": 1.0}), (None, None)], "`a b` array<int>, m map<string,double>"), log)
    assert read(spark, log).count() == 2
    with pytest.raises(PySparkException, match="there is no log"):
        read(spark, f"{log}-none").count()
    with pytest.raises(PySparkException, match="only appends"):
        spark.range(2).write.format("record_log").mode("overwrite").save(log)


def test_streams_read_commits_in_order_and_write_once(spark, log, tmp_path):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        query = spark.readStream.format("record_log").load(log).where("id % 2 = 0").writeStream.format("record_log").option("path", out).option("batch", "evens")
        query.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        write(numbers(spark, 10 * k, 10 * k + 10), log)
        run()
        assert rows(read(spark, out)) == rows(numbers(spark, 0, 10 * k + 10).where("id % 2 = 0"))
    # a micro-batch that is written again, as after a crash before the checkpoint, is dropped
    again = record_log.StreamWriter(out, read(spark, out).schema, 10, "evens")
    (batch,) = spark.range(1).select("id", F.lit(1.0).alias("x"), F.lit("a").alias("name"), F.current_date().alias("day")).toArrow().to_batches()
    again.commit([again.write(iter([batch]))], 0)
    assert rows(read(spark, out)) == rows(numbers(spark, 0, 30).where("id % 2 = 0"))


def test_a_user_s_own_source_is_a_connector(spark, log):
    class Squares(ds.DataSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "n long, square long"

        def reader(self, schema):
            return SquaresReader(int(self.options.get("to", 10)))

    class SquaresReader(ds.DataSourceReader):
        def __init__(self, to):
            self.to = to

        def partitions(self):
            return [ds.InputPartition(k) for k in range(0, self.to, 4)]

        def read(self, partition):
            return ((n, n * n) for n in range(partition.value, min(partition.value + 4, self.to)))

    loaders.Connectors.register_source(spark, Squares)
    got = loaders.Connectors.create("squares", spark, to="11")
    assert sorted(map(tuple, got.collect())) == [(n, n * n) for n in range(11)] and got.rdd.getNumPartitions() == 3 and "squares" in loaders.Connectors.available()
    write(numbers(spark, 0, 5), log)
    assert loaders.Connectors.create("record_log", spark, path=log).count() == 5


def test_audit_trail_and_circuits_are_appended_once(spark, log, tmp_path):
    events = spark.createDataFrame([(1, "login", "ann")], "id long, kind string, user string")
    for _ in range(2):
        audit.append_trail(events, log, "day-1")
    audit.append_trail(events, log, "day-2")
    assert read(spark, log).count() == 2
