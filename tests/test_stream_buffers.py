"""Buffers in stream state: over restarts, against the batch forms, and with bounded writes."""

import math
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ketspark.streaming import buffers, ring

SCHEMA = "k string, at timestamp, id long, v double, source string"


def rows(n, seed=1):
    rng = random.Random(seed)
    start = pd.Timestamp("2024-01-01", tz="UTC")
    return [(rng.choice(["a", "a", "b", None]), (start + pd.Timedelta(seconds=i)).to_pydatetime(), i, None if rng.random() < 0.1 else round(rng.random(), 3), f"s{i // 40}") for i in range(n)]


def write(spark, data, folder, k):
    spark.createDataFrame(data, SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/{k}")


def stream(spark, folder, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/*")


def run(df, folder, name, mode="append"):
    sink = df.writeStream.format("memory" if mode == "update" else "parquet").outputMode(mode).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
    sink.start(f"{folder}/{name}-rows").awaitTermination()


def test_flushes_over_restarts_equal_the_batch_form(spark, tmp_path):
    data, folder = rows(300), str(tmp_path)
    for k in range(3):  # each run starts anew from the checkpoint, with one folder of two files more
        write(spark, data[k * 100 : (k + 1) * 100], f"{folder}/in", k)
        # both files of a folder in one micro-batch, as their rows are in no order of files
        run(ring.flushing(stream(spark, f"{folder}/in", 2), "k", ["at", "id"], ["id", "v"], 16, batch="source"), folder, "flush")
    got = spark.read.parquet(f"{folder}/flush-rows")
    found = {(r.k, r.flush_id): ([x.id for x in r.rows], [x.v for x in r.rows], {b.batch: b.size for b in r.batches}) for r in got.collect()}
    all_rows = spark.createDataFrame(data, SCHEMA)
    expected = {}
    for key in ("a", "b", None):
        own = buffers.flushed(all_rows.where(F.col("k").eqNullSafe(F.lit(key))), ["at", "id"], 16).orderBy("at").collect()
        parts = defaultdict(list)
        for r in own:
            parts[r.flush_id].append(r)
        for f, part in parts.items():
            if len(part) == 16:
                sizes = defaultdict(int)
                for r in part:
                    sizes[r.source] += 1
                expected[key, f] = ([r.id for r in part], [r.v for r in part], dict(sizes))
    assert found == expected and all(r.is_full and r.n == 16 for r in got.collect())


def test_idle_buffers_are_flushed_by_a_timer(spark, tmp_path):
    data, folder = rows(100), str(tmp_path)
    write(spark, data, f"{folder}/in", 0)
    late = [("z", pd.Timestamp("2024-01-02", tz="UTC").to_pydatetime(), 999, 1.0, "late")]
    df = lambda: ring.flushing(stream(spark, f"{folder}/in", 2), "k", ["at", "id"], ["id"], 30, idle="1 hour")
    run(df(), folder, "timer")
    before = spark.read.parquet(f"{folder}/timer-rows")
    assert before.where("not is_full").count() == 0
    write(spark, late, f"{folder}/in", 1)
    run(df(), folder, "timer")
    got = spark.read.parquet(f"{folder}/timer-rows").collect()
    by_key = defaultdict(list)
    for r in sorted(got, key=lambda r: r.flush_id):
        by_key[r.k] += [x.id for x in r.rows]
    assert by_key == {key: [r[2] for r in data if r[0] == key] for key in ("a", "b", None)}
    assert sum(not r.is_full for r in got) == 3 and len({(r.k, r.flush_id) for r in got}) == len(got)


@pytest.mark.parametrize("files", [2, 1])
def test_ring_statistics(spark, tmp_path, files):
    data, folder = rows(200), str(tmp_path)
    for k in range(4):
        spark.createDataFrame(data[k * 50 : (k + 1) * 50], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
    run(ring.ring(stream(spark, f"{folder}/in", files), "k", "v", ["at", "id"], 30, 10), folder, "ring")
    got = spark.read.parquet(f"{folder}/ring-rows").collect()
    for key in ("a", "b", None):
        own = [r[3] for r in data if r[0] == key]
        last = max((r for r in got if r.k == key), key=lambda r: r.n_seen)
        now = [x for x in own[-30:] if x is not None]
        mean = sum(now) / len(now)
        tail = [x for x in own[-10:] if x is not None]
        assert (last.n_seen, last.size, last.capacity, last.utilization) == (len(own), min(30, len(own)), 30, min(30, len(own)) / 30)
        for a, b in ((last.mean, mean), (last.std, math.sqrt(sum((x - mean) ** 2 for x in now) / len(now))), (last.min, min(now)), (last.max, max(now)), (last.window_mean, sum(tail) / len(tail))):
            assert math.isclose(a, b, rel_tol=1e-9)


class Fake:
    """State in memory that counts the rows written."""

    def __init__(self):
        self.held, self.value, self.written, self.read = [], None, 0, 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return Value()

    def get(self):
        self.read += len(self.held)
        return iter(self.held)

    def put(self, new):
        self.held, self.written = list(new), self.written + len(new)

    def appendList(self, new):
        self.held, self.written = self.held + list(new), self.written + len(new)

    def clear(self):
        self.held = []


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, new):
        self.now = new


def test_updates_write_little_more_than_the_new_rows():
    fake, own = Fake(), ring.Ring("k", "v", [], 100, 10)
    own.init(fake)
    for i in range(1000):
        (out,) = own.handleInputRows(("a",), iter([pd.DataFrame({"v": [float(i)]})]), None)
    assert out.iloc[0]["mean"] == sum(range(900, 1000)) / 100 and fake.written <= 2 * 1000 + 100 and len(fake.held) <= 200
    fake, own = Fake(), ring.Flushing("k", ["v"], ["v"], "v double", None, None, 100, None)
    own.init(fake)
    flushes = [f for i in range(1000) for f in own.handleInputRows(("a",), iter([pd.DataFrame({"v": [float(i)]})]), None)]
    assert len(flushes) == 10 and fake.written <= 1000 and fake.read <= 1000


def test_a_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in/0")
    out = ring.run(ring.flushing(stream(spark, f"{tmp_path}/in"), "k", ["at"], ["id"], 3), "none")
    assert out.count() == 0 and out.columns == ["k", "flush_id", "is_full", "n", "batches", "rows"]
