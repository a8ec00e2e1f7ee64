"""Buffers over streams as state of Structured Streaming: a ring of the last rows, and a buffer that is flushed when it is full.

State of a key: a list of rows to which every micro-batch only appends, and one small value that tells how many rows it
holds. So an update writes the rows of its micro-batch alone; a ring's list is written anew once as many rows have
left the ring as it holds, and a buffer's when it is flushed. A buffer that doesn't fill isn't read either; a ring is read for its statistics.
Rows of a micro-batch are put in ``order`` first, as a shuffle doesn't keep an order.

These need the RocksDB state store, which ``run`` and both operators switch on for the session if it says nothing else.

Nulls: a null key is a key; null values are kept in flushed rows, and left out of sums, means and extremes. Rows of
equal order come in any order among themselves. A key without rows has no state. With an event time, rows older than the
watermark are left out, as by every operator with a watermark.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ketspark.plans.storage import shared_dir

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    if "HDFSBackedStateStoreProvider" in spark.conf.get(STORE, "HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


def plain(frame: pd.DataFrame, cols: Sequence[str]) -> list[tuple]:
    """Rows as Python values, missing ones as None."""
    own = frame[list(cols)].astype(object)
    return list(own.where(own.notna(), None).itertuples(index=False, name=None))


class Ring(StatefulProcessor):
    """(key, n_seen, size, capacity, utilization, mean, std, min, max, window_mean) after each micro-batch of the key."""

    def __init__(self, key: str, value: str, order: Sequence[str], capacity: int, window: int):
        self.key, self.value, self.order, self.capacity, self.window = key, value, list(order), capacity, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "x double")
        self.head = handle.getValueState("head", "seen long, length int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if self.order:
            new = new.sort_values(self.order, kind="stable")
        values = [(None if pd.isna(x) else float(x),) for x in new[self.value]]
        seen, length = self.head.get() if self.head.exists() else (0, 0)
        held = list(self.rows.get()) if length else []
        now = (held + values)[-self.capacity :]
        if length + len(values) > 2 * self.capacity:
            self.rows.put(now)
            length = len(now)
        else:
            self.rows.appendList(values)
            length += len(values)
        seen += len(values)
        self.head.update((seen, length))
        yield self.summary(key[0], seen, [x for (x,) in now])

    def summary(self, key, seen: int, now: list) -> pd.DataFrame:
        known = [x for x in now if x is not None]
        last = [x for x in now[-self.window :] if x is not None]
        mean = math.fsum(known) / len(known) if known else None
        std = math.sqrt(math.fsum((x - mean) ** 2 for x in known) / len(known)) if known else None
        ends = (min(known), max(known)) if known else (None, None)
        return pd.DataFrame([(key, seen, len(now), self.capacity, len(now) / self.capacity, mean, std, *ends, math.fsum(last) / len(last) if last else None)], columns=[self.key, *RING])

    def close(self) -> None:
        pass


RING = ("n_seen", "size", "capacity", "utilization", "mean", "std", "min", "max", "window_mean")


class Flushing(StatefulProcessor):
    """A row a flush: key, flush_id, is_full, n, batches (id, size) that brought its rows, rows."""

    def __init__(self, key: str, order: Sequence[str], cols: Sequence[str], types: str, batch: str | None, at: str | None, capacity: int, idle_ms: int | None):
        self.key, self.order, self.cols, self.types, self.batch, self.at, self.capacity, self.idle_ms = key, list(order), list(cols), types, batch, at, capacity, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"__batch string, {self.types}")
        self.head = handle.getValueState("head", "flushes long, held int, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        batches = new[self.batch].map(lambda b: None if pd.isna(b) else str(b)) if self.batch else [None] * len(new)
        own = [(b, *r) for b, r in zip(batches, plain(new, self.cols), strict=True)]
        flushes, held, expires = self.head.get() if self.head.exists() else (0, 0, -1)
        if held + len(own) < self.capacity:
            self.rows.appendList(own)
            held += len(own)
        else:
            all_rows = (list(self.rows.get()) if held else []) + own
            full = len(all_rows) // self.capacity
            yield self.flushed(key[0], flushes, [all_rows[k * self.capacity : (k + 1) * self.capacity] for k in range(full)], True)
            flushes, left = flushes + full, all_rows[full * self.capacity :]
            held = len(left)
            self.rows.put(left) if left else self.rows.clear()
        if self.idle_ms is not None:
            if expires >= 0:
                self.handle.deleteTimer(expires)
            last = max(int(new[self.at].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs())
            expires = last + self.idle_ms if held else -1
            if held:
                self.handle.registerTimer(expires)
        self.head.update((flushes, held, expires))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        flushes, held, _ = self.head.get()
        if held:
            yield self.flushed(key[0], flushes, [list(self.rows.get())], False)
            self.rows.clear()
            self.head.update((flushes + 1, 0, -1))

    def flushed(self, key, first: int, parts: list[list[tuple]], full: bool) -> pd.DataFrame:
        out = []
        for k, rows in enumerate(parts):
            sizes: dict = {}
            for r in rows:
                sizes[r[0]] = sizes.get(r[0], 0) + 1
            own = [dict(zip(self.cols, r[1:], strict=True)) for r in rows]
            out.append((key, first + k, full, len(rows), [{"batch": b, "size": n} for b, n in sizes.items()], own))
        return pd.DataFrame(out, columns=[self.key, "flush_id", "is_full", "n", "batches", "rows"])

    def close(self) -> None:
        pass


def ring(stream: DataFrame, by: str, value: str, order: Sequence[str] = (), capacity: int = 1000, window: int = 100, mode: str = "Append") -> DataFrame:
    """What a buffer of the last ``capacity`` values of each key holds after every micro-batch that has rows of the key."""
    with_store(stream.sparkSession)
    kind = dict(stream.dtypes)[by]
    schema = f"`{by}` {kind}, n_seen long, size long, capacity long, utilization double, mean double, std double, min double, max double, window_mean double"
    return stream.groupBy(by).transformWithStateInPandas(Ring(by, value, order, capacity, window), schema, mode, "None")


def flushing(stream: DataFrame, by: str, order: Sequence[str], cols: Sequence[str], capacity: int = 1000, batch: str | None = None, idle: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Buffers by key that are emptied whenever they hold ``capacity`` rows ('append' mode).

    With ``idle`` a buffer that isn't full is flushed when the watermark, ``late`` after the latest event, has passed its last
    row by so long; the first column of ``order`` is then the event time. ``batch``: column that names where a row came from.
    """
    with_store(stream.sparkSession)
    spark, types = stream.sparkSession, dict(stream.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in cols)
    if idle:
        stream = stream.withWatermark(order[0], late)
        idle_ms = int(spark.sql(f"select cast(unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {idle}) / 1000 as long)").first()[0])
    schema = f"`{by}` {types[by]}, flush_id long, is_full boolean, n long, batches array<struct<batch:string,size:long>>, rows array<struct<{', '.join(f'`{c}`:{types[c]}' for c in cols)}>>"
    own = Flushing(by, order, cols, fields, batch, order[0] if idle else None, capacity, idle_ms if idle else None)
    return stream.groupBy(by).transformWithStateInPandas(own, schema, "Append", "EventTime" if idle else "None")


def run(stream: DataFrame, name: str, mode: str = "append", **options: str) -> DataFrame:
    """Run ``stream`` over all there is now, into a table in the shared folder, and read that."""
    with_store(stream.sparkSession)
    path = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").options(**options).trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(StructType(stream.schema.fields)).parquet(f"{path}/rows")
