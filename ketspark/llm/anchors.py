"""Repeated windows without comparing all windows.

Every window of ``length`` units (words or bytes) owns one *anchor*: the smallest hash among its
k-grams, leftmost on ties. Equal windows own equal anchors at equal offsets, so windows can only be
equal inside the group of an anchor, and a window whose anchor occurs once is unique. The anchors of
a text are about 2/(length-k+2) of its positions; only those travel. Consecutive windows with one
anchor form a *segment* [first start, last start + length).

Plan: (1) count anchors with map-side combine; (2) put those found twice, and those found often, in
two filters whose size has a fixed bound (false positives only cost time, because the groups
compare real text); when there are more than ``FILTERED`` the filters would let too much through, and the documents learn by a
shuffle on anchors instead which of theirs are repeated (``marked``); (3) ship the segments of repeated anchors to their groups. For anchors found
more than ``HOT`` times equal segments of one task are merged before the shuffle. Where only later windows go, these segments are
cut into single windows instead, and the groups are keyed by window, so that a key has at most one row a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.llm.common import STRETCH, grams, join_spread, mix, portions, release, small_batches, stored

#: Of an anchor found more often than this equal segments (or windows, where only later ones go) are merged in a task, as they would
#: be a row for each place.
HOT = 4096
#: Bound of one filter, in bits (32 MB): what is broadcast does not grow with the corpus.
MAX_BITS = 1 << 28
#: most anchors that the filters hold well, at 12 bits each
FILTERED = MAX_BITS // 12
SLICES = 64
#: bytes of rows that a task gathers before it passes them on, and windows of frequent anchors that it merges at a time
OUT_BYTES = 4 << 20
LOCAL = 50_000
#: low bits of a hash that hold a place in a stretch
PLACE = np.uint64((1 << 20) - 1)

#: makes for each task a function: a text's bytes -> its units as 64-bit integers, and a function that gives the bytes of units a..b
Units = Callable[[], Callable[[bytes], tuple[np.ndarray, Callable[[int, int], bytes]]]]


def anchor_runs(units: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, first and last window start of each segment of a text."""
    n = len(units) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    g = grams(units, k)
    pos = leftmost_min(g, length - k + 1)
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    at = pos[first]
    return g[at], at, first, last


def leftmost_min(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash (by its upper bits, then by place) in each run of ``w`` hashes."""
    n = len(g) - w + 1
    out = np.empty(n, np.int64)
    for lo in range(0, n, STRETCH):
        part = g[lo : lo + STRETCH + w - 1]
        best, size = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while size * 2 <= w:  # smallest of runs of 2, 4, 8, ...; last of two overlapping runs
            best, size = np.minimum(best[:-size], best[size:]), size * 2
        m = len(part) - w + 1
        out[lo : lo + m] = (np.minimum(best[:m], best[w - size : w - size + m]) & PLACE).astype(np.int64) + lo
    return out


def repeated_anchors(docs: DataFrame, units: Units, length: int, k: int) -> DataFrame:
    """(h, n): anchors found at least twice in ``docs`` (columns: id, data binary); stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units()
        for batch in portions(batches, 1):
            found = [anchor_runs(own(d.as_py())[0], length, k)[0] for d in batch.column(1)]
            h, n = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2")
    return stored(counted, "anchors")


class Filter:
    """Bloom filter over anchors, cut into slices by the anchor's low bits (anchors are minima: their top bits are uneven)."""

    def __init__(self, slice_bits: int, slices: dict[int, bytes]):
        self.slice_bits = slice_bits
        size = slice_bits // 8
        self.bits = np.frombuffer(b"".join(slices.get(i, bytes(size)) for i in range(SLICES)), np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        base = (h & np.uint64(SLICES - 1)).astype(np.int64) * self.slice_bits
        for at in probes(h, self.slice_bits):
            p = base + at
            ok &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return ok


def probes(h: np.ndarray, slice_bits: int) -> list[np.ndarray]:
    a = mix(h)
    b = mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(slice_bits - 1)).astype(np.int64) for i in range(4)]


def make_filter(anchors: DataFrame, n: int) -> Filter:
    """Filter of the ``n`` anchors in column h; slices are built by the executors."""
    bits = 1 << max(16, min(MAX_BITS, 12 * max(n, 1)).bit_length())
    slice_bits = min(bits, MAX_BITS) // SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            at = h & np.uint64(SLICES - 1)
            for i in np.unique(at).tolist():
                bits = own.setdefault(i, np.zeros(slice_bits // 8, np.uint8))
                for p in probes(h[at == i], slice_bits):
                    np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
        for i, bits in own.items():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    sliced = anchors.select("h").repartition(SLICES, F.col("h").bitwiseAND(SLICES - 1))
    rows = sliced.mapInArrow(build, "slice int, bits binary").collect()  # at most MAX_BITS / 8 bytes
    return Filter(slice_bits, {r[0]: bytes(r[1]) for r in rows})


def marked(docs: DataFrame, units: Units, length: int, k: int, found: DataFrame) -> DataFrame:
    """``docs`` that have repeated anchors, with marks: (i, value) for each, the number of its segment and whether it is found
    often. Anchors meet their counts in a shuffle, those with many places by broadcast."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = units()
        for batch in portions(batches, 1):
            hs = [anchor_runs(own(d.as_py())[0], length, k)[0] for d in batch.column(1)]
            n = [len(h) for h in hs]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
            yield pa.record_batch([pa.array(np.concatenate(hs).view(np.int64)), ids, pa.array(at)], ["h", "id", "i"])

    right = found.select(F.col("h").alias("key"), (F.col("n") > HOT).alias("value"), F.col("n").alias("rows"))
    met = join_spread(docs.mapInArrow(places, "h long, id long, i int"), F.col("h"), right, found.agg(F.sum("n")).first()[0], F.xxhash64("id", "i"))
    marks = met.where("value is not null").groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct("i", "value")).alias("marks"))
    return docs.join(marks, F.col("id") == F.col("__id")).select("id", "data", "marks")


#: key: group; id, start: place of the first window; anchor: units from there to the anchor; data:
#: the segment, or nothing in rows that carry a decision already made (windows start..last go).
CANDIDATE = "key long, id long, start int, last int, anchor int, data binary"


def candidates(docs: DataFrame, units: Units, length: int, k: int, first_only: bool, reach: int | None = None) -> DataFrame:
    """Rows of CANDIDATE for all windows whose anchor is repeated.

    ``first_only``: of equal windows only later ones go (else all of them go); decides which rows a
    task can settle by itself. ``reach`` (at least ``length``): windows of that length are wanted too; segments then reach so far
    beyond their last start, as the text has it, and frequent windows come in both lengths. What a task has settled is of kind
    0 for the longer windows and 1 for the shorter ones; the kind stands in place of the anchor.
    """
    reach = reach or length
    kinds = ((0, reach), (1, length)) if reach > length else ((0, length),)
    spark = docs.sparkSession
    found = repeated_anchors(small_batches(docs), units, length, k)
    n, hot = found.agg(F.count("*"), F.count_if(F.col("n") > HOT)).first()
    shared = None
    if n <= FILTERED:
        shared = spark.sparkContext.broadcast((make_filter(found, n), make_filter(found.where(F.col("n") > HOT), hot)))
    else:
        docs = marked(docs, units, length, k, found)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of = units()
        local: dict[bytes, list] = {}  # window of a hot anchor -> key, first place, anchor, its bytes, more than one place, kind
        alike: dict[bytes, list] = {}  # segment of a hot anchor -> key, a place, starts, anchor, its bytes, its units, more than one place
        for batch in portions(batches, 1):
            rows: list[tuple] = []
            held = 0
            marks = batch.column(2) if shared is None else [None] * batch.num_rows
            for id_, data, own_marks in zip(batch.column(0).to_pylist(), batch.column(1), marks, strict=True):
                if held > OUT_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
                own, part = units_of(data.as_py())
                h, at, first, last = anchor_runs(own, length, k)
                if shared is None:
                    many = dict(zip(*(own_marks.values.field(c).to_pylist() for c in ("i", "value")), strict=True))
                    keep = np.array([i for i in many if i < len(h)], np.int64)  # of rows with one id the longest has most
                    often = np.array([many[i] for i in keep.tolist()], bool)
                else:
                    keep = np.flatnonzero(shared.value[0].holds(h))
                    often = shared.value[1].holds(h[keep])
                if not len(keep):
                    continue
                h, at, first, last = h[keep], at[keep], first[keep], last[keep]
                gone = {0: [], 1: []}
                for key, p, a, b, many in zip(h.view(np.int64).tolist(), at.tolist(), first.tolist(), last.tolist(), often.tolist(), strict=True):
                    if not many:
                        segment = part(a, min(b + reach, len(own)))
                        rows.append((key, id_, a, b, p - a, segment))
                        held += len(segment) + 100
                        continue
                    if not first_only:
                        segment, size = part(a, min(b + reach, len(own))), min(b + reach, len(own)) - a
                        name = xxhash.xxh3_128_digest(segment) + (b - a).to_bytes(4, "little")
                        old = alike.setdefault(name, [key, (id_, a), b - a + 1, p - a, segment, size, False])
                        if old[1] != (id_, a):
                            old[6] = True
                            rows += decided(id_, a, b - a + 1, size)
                        continue
                    for s, (kind, n) in itertools.product(range(a, b + 1), kinds):
                        if s + n > len(own):
                            continue
                        window = part(s, s + n)
                        name = xxhash.xxh3_128_digest(window)
                        old = local.get(name)
                        place = (id_, s)
                        if old is None:
                            local[name] = [key ^ int.from_bytes(name[:8], "little", signed=True), place, p - s, window, False, kind]
                        elif old[1] != place:
                            gone[kind].append(max(old[1], place))
                            old[1], old[4] = min(old[1], place), not first_only
                rows += ((0, i, a, b, kind, None) for kind in gone for i, a, b in ranges(gone[kind]))
            yield batch_of(rows)
            if len(local) + len(alike) > LOCAL:
                yield from merged(local)
                yield from kept_once(alike)
                local.clear()
                alike.clear()
        yield from merged(local)
        yield from kept_once(alike)

    def decided(id_: int, s: int, starts: int, size: int) -> Iterator[tuple]:
        """Rows by which all windows go of a segment that is found in two places."""
        for kind, n in kinds:
            if size >= n:
                yield 0, id_, s, s + min(starts, size - n + 1) - 1, kind, None

    def kept_once(alike: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        for own in itertools.batched(alike.values(), 10_000):
            rows = []
            for key, (id_, s), starts, off, segment, size, several in own:
                rows.append((key, id_, s, s + starts - 1, off, segment))
                rows += decided(id_, s, starts, size) if several else ()
            yield batch_of(rows)

    def merged(local: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, (id_, s), off, window, several, kind in local.values():
            rows.append((key, id_, s, s, off, window))
            if several:
                rows.append((0, id_, s, s, kind, None))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
        yield batch_of(rows)

    return docs.mapInArrow(emit, CANDIDATE)


def runs_by_id(found: DataFrame) -> DataFrame:
    """(id, runs, shared): the ranges (start, last) of kinds 0 and 1 of each document."""
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "last")))
    return found.groupBy("id").agg(of(0).alias("runs"), of(1).alias("shared"))


def ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Runs of consecutive starts: (id, first, last)."""
    run = None
    for id_, s in sorted(set(places)):
        if run and run[0] == id_ and run[2] == s - 1:
            run[2] = s
        else:
            if run:
                yield tuple(run)
            run = [id_, s, s]
    if run:
        yield tuple(run)


TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
NAMES = ["key", "id", "start", "last", "anchor", "data"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)


def settled(rows: DataFrame, judge: Callable[[list[list[tuple]]], Iterator[tuple[int, int, int, int]]], gather: int = 0) -> DataFrame:
    """(id, start, last, kind) of the windows found: ``judge`` gets groups, each the rows (id, start, last, anchor,
    data) of one key in order of place, each place once, and yields ranges with their kind; groups are handed over when they hold ``gather`` bytes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, groups, held, out = None, [], [], 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5] is None:
                    out.append(row[1:5])
                    continue
                if row[0] != key:
                    if len(group) > 1:
                        groups.append(group)
                        held += sum(len(r[4]) for r in group)
                    if groups and held >= gather:
                        out += judge(groups)
                        groups, held = [], 0
                    key, group = row[0], []
                if not group or group[-1] != row[1:]:
                    group.append(row[1:])
            if len(out) >= 5_000:
                yield range_batch(out)
                out = []
        if len(group) > 1:
            groups.append(group)
        out += judge(groups)
        yield range_batch(out)
        release()

    # rows that are decided already travel by their document, not by a key of their own
    spread = F.when(F.col("data").isNull(), F.xxhash64("id", "start")).otherwise(F.col("key")).alias("key")
    dealt = rows.select(spread, "id", "start", "last", "anchor", "data").repartition("key").sortWithinPartitions("key", "id", "start")
    return dealt.mapInArrow(walk, "id long, start int, last int, kind int")


def range_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["id", "start", "last", "kind"])


def covered(runs: list[tuple[int, int]] | None, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal unit spans covered by windows that start in ``runs`` (first, last)."""
    out: list[list[int]] = []
    for a, b in sorted(runs or ()):
        b = min(b + length, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
