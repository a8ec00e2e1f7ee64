"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Documents longer than the capacity are cut; nothing else is. Pieces of one length are alike, so the
packing of the whole corpus follows from how many there are of each length: at most ``capacity``
counts come to the driver, which packs them longest first, each into the tightest open sequence,
found in a segment tree over remaining capacities. The outcome is a short list of runs ("of length
l, ranks a.. go to sequences s.., q to each, from offset o"); the executors rank the pieces of a
length and read their places off the runs.

Nulls: a null text is empty and becomes the end id alone; null ids are kept. Repeated rows are packed each for
itself; ties in length are ranked by id, piece and checksum. An empty table gives no rows. Very long texts become many
pieces. Other columns of ``docs`` aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ketspark.llm.common import as_bytes, portions, small_batches, stored
from ketspark.llm.tokens import default_tokenizer, encoder_of

#: pieces that are ranked together at most, about
RANKED = 50_000


class OpenSequences:
    """Segment tree over remaining capacities; a leaf holds blocks (first sequence, how many)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)
        self.blocks: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, n: int) -> None:
        if left and n:
            self.blocks[left].append((first, n))
            self._count(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        self._count(left, -1)
        return self.blocks[left].pop()

    def _count(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.filled[node] += by
            node //= 2

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length`` that any sequence has."""
        node = length + self.size
        if self.filled[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.filled[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset) and the number of sequences."""
    open_, runs, n_sequences = OpenSequences(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            left = open_.tightest(length)
            if left is None:
                left = capacity
                first, n = n_sequences, -(-(count - rank) // (capacity // length))
                n_sequences += n
            else:
                first, n = open_.take(left)
            # the sequence just filled is the tightest for its equals, as long as they fit
            each = left // length
            used = min(n, (count - rank) // each)
            if used:
                runs.append((length, rank, first, each, capacity - left))
                open_.put(left - each * length, first, used)
                rank += used * each
            if used < n and rank < count:
                rest = count - rank
                runs.append((length, rank, first + used, each, capacity - left))
                open_.put(left - rest * length, first + used, 1)
                rank, used = count, used + 1
            open_.put(left, first + used, n - used)
    return runs, n_sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in portions(batches, 1):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"))
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = stored(parts, "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    table = spark.sparkContext.broadcast(np.array(sorted(runs), np.int64).reshape(-1, 5))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        runs, length, rank = table.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted((runs[:, 0] << 44) | runs[:, 1], (length << 44) | rank, "right") - 1
        k, each = rank - runs[at, 1], runs[at, 3]
        return pa.StructArray.from_arrays([pa.array(runs[at, 2] + k // each), pa.array(runs[at, 4] + k % each * length)], ["sequence_id", "offset"])

    buckets = spark.createDataFrame([(n, -(-c // RANKED)) for n, c in counts.items()], "length long, n_buckets long")
    keyed = parts.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_buckets"))).drop("n_buckets")
    sizes = keyed.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "bucket"])
    placed = ranked.withColumn("place", place(F.col("length"), F.col("before") + F.col("rank") - 1))
    return placed.select(*parts.columns, "place.sequence_id", "place.offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, default_tokenizer(), 2048, 0, "doc_id", "text"))
