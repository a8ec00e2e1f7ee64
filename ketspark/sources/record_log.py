"""A data source of one's own: ``spark.read.format("record_log")``, batch and streaming, with a writer that commits exactly once.

A log is a folder that the cluster shares: Arrow files under ``data``, and under ``commits`` a small JSON file for every
write, with the schema, the files, and for every block of rows its size and the least and largest value of each plain
column. Only what a commit names is visible: tasks that fail or are tried again leave files that nobody reads, and an aborted
write removes its own. A write with the option ``batch`` (and every micro-batch of a stream, by its number) is committed
under that name once; the same batch written again is dropped.

Reading plans one partition for some blocks of rows (option ``rows``), opens these blocks alone, and leaves out blocks that
a pushed filter rules out by least and largest values; Spark filters again what is left. A stream reads commits in order.

Options: path; rows (rows of a block when written, of a partition when read; 100,000); batch. Folders can be plain paths
or URIs that pyarrow knows (file, hdfs, s3, gs). One writer at a time may append to a log.

Nulls are values like others; a block of nulls alone has no bounds and is read only where a filter may keep nulls. An empty write makes a commit
without blocks. Columns of any type and name are kept; a log whose commits differ in schema can't be written.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

NAME = "record_log"
ROWS = 100_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Folder:
    """A shared folder by its path or URI."""

    def __init__(self, path: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def commits(self) -> list[dict]:
        """In order; empty where there is no log yet."""
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.endswith(".json"))
        out = []
        for name in names:
            with self.fs.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def commit(self, number: int, content: dict) -> None:
        """The file appears as a whole, by renaming."""
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        draft = f"{self.root}/commits/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(content).encode())
        self.fs.move(draft, f"{self.root}/commits/{number:012d}.json")

    def remove(self, files: list[str]) -> None:
        for name in files:
            path = f"{self.root}/data/{name}"
            if self.fs.get_file_info(path).type == pyarrow.fs.FileType.File:
                self.fs.delete_file(path)


def comparable(x):
    """Values whose order JSON keeps, by kind; None for others, NaN among them."""
    if isinstance(x, bool) or (isinstance(x, (int, float)) and x == x):
        return x
    if isinstance(x, (str, datetime.date)) and not isinstance(x, datetime.datetime):
        return str(x)
    return None


def bounds(batch: pa.RecordBatch) -> dict:
    """column -> [least, largest] without nulls; columns of other kinds, or with NaN, aren't listed."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        kind = column.type
        if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_date(kind) or pa.types.is_boolean(kind)):
            continue
        if pa.types.is_floating(kind) and pa.compute.any(pa.compute.is_nan(column)).as_py():
            continue
        least, largest = (comparable(x.as_py()) for x in pa.compute.min_max(column).values())
        out[name] = [least, largest]
    return out


@dataclass
class Block(ds.InputPartition):
    """Blocks of one file, by number."""

    file: str
    blocks: list[int]


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[dict]


class RecordLog(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def path(self) -> str:
        if "path" not in self.options:
            raise ValueError(f"{NAME} needs the option path")
        return self.options["path"]

    def schema(self) -> StructType:
        commits = Folder(self.path()).commits()
        if not commits:
            raise ValueError(f"there is no log in {self.path()}")
        return StructType.fromJson(json.loads(commits[-1]["schema"]))

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return Reader(self.path(), int(self.options.get("rows", ROWS)))

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        return StreamReader(self.path(), int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError(f"{NAME} only appends")
        return Writer(self.path(), schema, int(self.options.get("rows", ROWS)), self.options.get("batch"))

    def streamWriter(self, schema: StructType, overwrite: bool) -> ds.DataSourceStreamWriter:
        if overwrite:
            raise ValueError(f"{NAME} only appends")
        return StreamWriter(self.path(), schema, int(self.options.get("rows", ROWS)), self.options.get("batch", "stream"))


def planned(commits: list[dict], rows: int, kept=lambda block: True) -> list[Block]:
    out = []
    for c in commits:
        for f in c["files"]:
            own, size = [], 0
            for k, block in enumerate(f["blocks"]):
                if not kept(block):
                    continue
                if own and size + block["n"] > rows:
                    out.append(Block(f["name"], own))
                    own, size = [], 0
                own.append(k)
                size += block["n"]
            if own:
                out.append(Block(f["name"], own))
    return out


def read_blocks(path: str, part: Block | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # nothing was planned
        return
    folder = Folder(path)
    with folder.fs.open_input_file(f"{folder.root}/data/{part.file}") as f, pa.ipc.open_file(f) as blocks:
        for k in part.blocks:
            yield blocks.get_batch(k)


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows, self.filters = path, rows, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """All are left to Spark as well: here they only rule out whole blocks."""
        for f in filters:
            if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In)) and len(f.attribute) == 1:
                self.filters.append(f)
            yield f

    def kept(self, block: dict) -> bool:
        return all(possible(f, *block["bounds"][f.attribute[0]]) for f in self.filters if f.attribute[0] in block["bounds"])

    def partitions(self) -> list[Block]:
        return planned(Folder(self.path).commits(), self.rows, self.kept)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return read_blocks(self.path, partition)


def possible(f: ds.Filter, least, largest) -> bool:
    """Whether a value between the bounds may pass. A block without bounds holds nulls alone, which pass no comparison."""
    if least is None or largest is None:
        return False
    values = [comparable(v) for v in (f.value if isinstance(f, ds.In) else [f.value])]
    if any(v is None or (isinstance(v, str) != isinstance(least, str)) for v in values):
        return True
    if isinstance(f, (ds.EqualTo, ds.In)):
        return any(least <= v <= largest for v in values)
    (v,) = values
    return {ds.GreaterThan: largest > v, ds.GreaterThanOrEqual: largest >= v, ds.LessThan: least < v, ds.LessThanOrEqual: least <= v}[type(f)]


class StreamReader(ds.DataSourceStreamReader):
    """Offsets count commits."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(Folder(self.path).commits())}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return planned(Folder(self.path).commits()[start["commits"] : end["commits"]], self.rows)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return read_blocks(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for what was read."""

    def stop(self) -> None:
        """There is no connection to close."""


def nullable(schema: StructType) -> str:
    """The schema as JSON, with nulls allowed everywhere, as one write may have them and another not."""
    return json.dumps(json.loads(schema.json(), object_hook=lambda d: {k: True if k in ("nullable", "containsNull", "valueContainsNull") else v for k, v in d.items()}))


class Log:
    """What both writers do: a file a task, and one commit on the driver."""

    def __init__(self, path: str, schema: StructType, rows: int, batch: str | None):
        self.path, self.schema, self.rows, self.batch = path, nullable(schema), rows, batch
        self.id = uuid.uuid4().hex  # of this write, on the driver and in its tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, name, blocks, out, sink = Folder(self.path), f"{self.id}-{uuid.uuid4().hex}.arrow", [], None, None
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, self.rows):
                    part = batch.slice(at, self.rows)
                    if out is None:
                        folder.fs.create_dir(f"{folder.root}/data", recursive=True)
                        sink = folder.fs.open_output_stream(f"{folder.root}/data/{name}")
                        out = pa.ipc.new_file(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    out.write_batch(part)
                    blocks.append({"n": part.num_rows, "bounds": bounds(part)})
            if out is not None:
                out.close()
        except BaseException:
            if sink is not None:
                sink.close()
                folder.remove([name])
            raise
        if sink is not None:
            sink.close()
        return Written([{"name": name, "blocks": blocks}] if blocks else [])

    def publish(self, messages: list[Written | None], batch: str | None) -> None:
        folder = Folder(self.path)
        commits, files = folder.commits(), [f for m in messages if m for f in m.files]
        if batch is not None and any(c["batch"] == batch for c in commits):
            folder.remove([f["name"] for f in files])
        elif commits and json.loads(commits[-1]["schema"])["fields"] != json.loads(self.schema)["fields"]:
            folder.remove([f["name"] for f in files])
            raise ValueError(f"the log in {self.path} has another schema")
        else:
            folder.commit(len(commits), {"batch": batch, "schema": self.schema, "files": files})

    def discard(self) -> None:
        """Also what tasks left that were ended before they could tell of it."""
        folder = Folder(self.path)
        found = folder.fs.get_file_info(pyarrow.fs.FileSelector(f"{folder.root}/data", allow_not_found=True))
        folder.remove([f.base_name for f in found if f.base_name.startswith(self.id)])


class Writer(Log, ds.DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.discard()


class StreamWriter(Log, ds.DataSourceStreamArrowWriter):
    """``batch`` names the stream; its micro-batches go by number."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, f"{self.batch}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.discard()


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and switch on the filters that Spark hands to such sources."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RecordLog)


def read(spark: SparkSession, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(**options).load()


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add the rows to a log; once only, if the batch has a name."""
    register(df.sparkSession)
    own = df.write.format(NAME).mode("append")
    (own.option("batch", batch) if batch is not None else own).save(path)
