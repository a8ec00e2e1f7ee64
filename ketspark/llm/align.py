"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level vocabulary, B a vocabulary of pieces; both tokenise a space and the whole text, strings of special
tokens as plain text. Where a token of A and one of B that are marked by a space start at the same byte, both
tokenisations are cut: the windows of token ids between two such anchors are aligned once each and remembered by
their tuples of ids, as most windows are words met before. Inside a window every byte at which tokens of both end
closes a group; all tokens of A in a group are linked with all tokens of B in it. Texts whose tokens don't join to
the bytes of space and text (B writes U+2581 as a space) have no tokens.

``align`` gives one row a document, with the count of every id pair over the corpus: the number of documents that
hold it linked. Distinct pairs of a document are counted by Spark; the counts come back to the documents by broadcast for
the most frequent pairs, at most MOST_SENT of them, and by a shuffle for the others. B's best partner counts per id of A
are at most as many as A has ids.

Nulls: a null or empty text has no tokens, all its numbers are 0 and its groups are ''. Rows with null or equal ids and repeated
rows stay, each with its own row, and count as documents of their own. An empty table gives no rows. Very long texts are
aligned whole; texts go through memory some megabytes at a time. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.llm.byte_bpe import ByteBPE
from ketspark.llm.common import as_bytes, mix, portions, small_batches, stored

#: bits of a pair of ids that hold B's id
B_BITS = 15
FIRST, SECOND = operator.itemgetter(0), operator.itemgetter(1)
#: pairs that are sent to all tasks at most; the others meet their counts in a shuffle
MOST_SENT = 400_000


class Pair:
    """Both tokenizers; ids of texts as bytes of little-endian unsigned 32-bit integers."""

    #: stretches and windows learnt before the older ones are let go, and the longest stretch that is kept
    MEMO, LONGEST = 120_000, 48

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteBPE(a_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.get_piece_size() > 1 << B_BITS:
            raise ValueError(f"B has over {1 << B_BITS} pieces")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # texts are cut between a sign and white space, but before none that a piece has after a sign (as the \r of line ends)
        glue = {x[1] for p in pieces for x in re.findall(r"\S\s", p.replace("▁", " "))}
        if " " in glue:
            raise ValueError("B has pieces that go from a sign to a space")
        tied = "[" + "".join(map(re.escape, sorted(glue))) + "]" if glue else "(?!)"
        self.stretches = re.compile(rf"\s*\S+(?:{tied}\s*\S+)*(?:{tied}\s*\Z)?|\s+")
        self.space = [self.b.piece_to_id("▁")]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [[len(t) for t in tokens] for tokens in (self.a.tokens, self.b_bytes)]
        self.names = [str(i) for i in range(max(map(len, self.sizes)))]
        self.lengths = [np.array(sizes) for sizes in self.sizes]
        self.spaced = [np.array([t[:1] == b" " for t in tokens]) for tokens in (self.a.tokens, self.b_bytes)]
        self.b_offsets = np.concatenate(([0], np.cumsum(self.lengths[1])))
        self.b_all = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.fast_a = self.a.ranked()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.windows: dict[tuple[bytes, bytes], tuple] = {}
        self.older_windows: dict[tuple[bytes, bytes], tuple] = {}

    def single_b(self, text: str) -> bytes:
        """B puts a space before every text that isn't empty: it stands for the stretch's own one, or for a sign that is taken off again."""
        if text == " ":
            ids = self.space
        else:
            ids = self.b.encode(text[1:]) if text[0] == " " else self.b.encode("x" + text)[len(self.b.encode("x")) :]
        return array("I", ids).tobytes()

    def ask(self, texts: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of stretches. Most are encoded in one text, whose tokens end where they end; a stretch that doesn't start with a space
        has a sign before it, as it has in its text, whose token is left out again."""
        found = {}
        plain = [t for t in texts if len(t) > 1 and " " not in t[1:] and "▁" not in t and not t[-1].isspace()]
        for part in itertools.batched(plain, 1000):
            given = [t if t[0] == " " else " x" + t for t in part]
            ends = np.cumsum([len(t.encode("utf-8", "replace")) for t in given])
            put = np.array([t[0] != " " for t in part])
            text, sides = "".join(given), []
            for side, ids in enumerate((self.fast_a.encode_ordinary(text) if self.fast_a else np.frombuffer(self.a.encode(text), "<u4"), self.b.encode(text[1:]))):
                ids = np.array(ids, "<u4")
                sizes = self.lengths[side][ids]
                token_ends = np.cumsum(sizes)
                last = np.searchsorted(token_ends, ends)
                first = np.append(0, last[:-1] + 1)
                if last[-1] >= len(ids) or (token_ends[last] != ends).any() or (sizes[first[put]] != 2).any():
                    break  # texts that a tokenizer changes, such as those that aren't Unicode
                data = ids.tobytes()
                sides.append([data[x:y] for x, y in zip((4 * (first + put)).tolist(), (4 * last + 4).tolist(), strict=True)])
            else:
                found |= zip(part, zip(*sides, strict=True), strict=True)
        others = [t for t in texts if t not in found]
        return found | {t: (a, self.single_b(t)) for t, a in zip(others, self.a.stretches(others), strict=True)}

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B for a space and each text."""
        split = [self.stretches.findall(" " + t) for t in texts]
        stretches = list(itertools.chain.from_iterable(split))
        ids = list(map(self.known.get, stretches))
        new = {stretches[i] for i, x in enumerate(ids) if x is None}
        if new:
            if len(self.known) > self.MEMO:
                self.known, self.older = {}, self.known
            found = {t: x for t in new if (x := self.older.get(t))}
            found |= self.ask([t for t in new if t not in found])
            self.known |= {t: x for t, x in found.items() if len(t) <= self.LONGEST}
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = found[stretches[i]]
        out, at = [], 0
        for own in split:
            part = ids[at : at + len(own)]
            at += len(own)
            out.append((b"".join(map(FIRST, part)), b"".join(map(SECOND, part))))
        return out

    def joined_b(self, ids: np.ndarray) -> bytes:
        start, n = self.b_offsets[ids], self.lengths[1][ids]
        ends = np.cumsum(n)
        return self.b_all[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def window(self, key: tuple[bytes, bytes]) -> tuple[str, int, int, bytes]:
        """The groups of a window as text, their number, the number of links, and the id pairs of all links."""
        a, b = array("I", key[0]).tolist(), array("I", key[1]).tolist()
        a_size, b_size = self.sizes
        names, groups, pairs, i, j, n = self.names, [], [], 0, 0, len(a)
        while i < n:
            x, y = a[i], b[j]
            i0, j0, a_end, b_end = i, j, a_size[x], b_size[y]
            i, j = i + 1, j + 1
            if a_end == b_end:
                groups.append(names[x] + "|" + names[y])
                pairs.append(x << B_BITS | y)
                continue
            while a_end != b_end:
                if a_end < b_end:
                    a_end += a_size[a[i]]
                    i += 1
                else:
                    b_end += b_size[b[j]]
                    j += 1
            own_a, own_b = a[i0:i], b[j0:j]
            groups.append(",".join([names[x] for x in own_a]) + "|" + ",".join([names[y] for y in own_b]))
            pairs += [x << B_BITS | y for x in own_a for y in own_b]
        return ";".join(groups), len(groups), len(pairs), array("i", pairs).tobytes()

    def aligned(self, keys: list[tuple[bytes, bytes]]) -> list[tuple]:
        """Alignments of windows, most of them remembered."""
        if len(self.windows) > self.MEMO:
            self.windows, self.older_windows = {}, self.windows
        windows, older, found = self.windows, self.older_windows, []
        for key in keys:
            x = windows.get(key)
            if x is None:
                x = older.get(key) or self.window(key)
                if len(key[0]) <= 4 * self.LONGEST:
                    windows[key] = x
            found.append(x)
        return found


@functools.cache
def pair_of(a_path: str, b_path: str) -> Pair:
    """One pair a worker process."""
    return Pair(a_path, b_path)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the ranges, in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def cut(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of every window in A and in B: both tokens start with a space at the same byte."""
    a_start, b_start = (np.cumsum(size[ids]) - size[ids] for size, ids in zip(pair.lengths, (a, b), strict=True))
    a_marked, b_marked = np.flatnonzero(pair.spaced[0][a]), np.flatnonzero(pair.spaced[1][b])
    place = np.searchsorted(b_start[b_marked], a_start[a_marked])
    held = b_start[b_marked][np.minimum(place, len(b_marked) - 1)] == a_start[a_marked]
    return a_marked[held], b_marked[place[held]]


def distinct(a: np.ndarray, a0: np.ndarray, b: np.ndarray, b0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that differ, as places of one of each, and for every window the number of its like. Found by hash, compared by ids."""
    sizes, found = [], np.zeros(len(a0), np.uint64)
    for side, (ids, first) in enumerate(((a, a0), (b, b0))):
        n = np.diff(np.append(first, len(ids)))
        inside = np.arange(len(ids)) - np.repeat(first, n)
        code = mix(ids.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(20)) + np.uint64((side + 1) << 60))
        found += np.add.reduceat(code, first)
        sizes.append(n)
    _, first_of, like = np.unique(found, return_index=True, return_inverse=True)
    for ids, first, n in zip((a, b), (a0, b0), sizes, strict=True):
        same = n == n[first_of[like]]
        if same.all():
            same = ids == ids[spans(first[first_of[like]], n)]
        if not same.all():  # two windows with one hash: keep every window for itself
            return np.arange(len(a0)), np.arange(len(a0))
    return first_of, like


def aligned_rows(pair: Pair, texts: list[bytes], whole: bool) -> list[list]:
    """For every text: n_a, n_b, n_groups, n_links, groups (as text, or its digest), distinct pairs of ids, and how often each is linked."""
    ids, given = [], iter(pair.encode([t.decode("utf-8", "replace") for t in texts if t]))
    for t in texts:
        a, b = next(given) if t else (b"", b"")
        if t and not (pair.a.decode(np.frombuffer(a, "<u4")).tobytes() == b" " + t == pair.joined_b(np.frombuffer(b, "<u4"))):
            a = b = b""
        ids.append((a, b))
    none = np.empty(0, np.int32)
    rows: list[list] = [[0, 0, 0, 0, "", none, none] for _ in texts]
    held = [i for i, (a, _) in enumerate(ids) if a]
    if not held:
        return rows
    a, b = (np.frombuffer(b"".join(ids[i][side] for i in held), "<u4") for side in (0, 1))
    a0, b0 = cut(pair, a, b)
    first_of, like = distinct(a, a0, b, b0)
    a_data, b_data, a1, b1 = a.tobytes(), b.tobytes(), np.append(a0[1:], len(a)), np.append(b0[1:], len(b))
    keys = [(a_data[4 * p : 4 * q], b_data[4 * r : 4 * s]) for p, q, r, s in zip(*(x[first_of].tolist() for x in (a0, a1, b0, b1)), strict=True)]
    found = pair.aligned(keys)
    shown = [x[0] for x in found]
    n_groups, n_links = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
    links = np.frombuffer(b"".join(x[3] for x in found), np.int32)
    link_at = np.cumsum(n_links) - n_links
    # documents start at windows, as all tokens of a text's first byte are marked by its space
    a_ends = np.cumsum([len(ids[i][0]) // 4 for i in held])
    window_ends = np.searchsorted(a0, a_ends)
    bounds = np.concatenate(([0], window_ends)).tolist()
    groups_before, links_before = (np.concatenate(([0], np.cumsum(x[like]))) for x in (n_groups, n_links))
    every = links[spans(link_at[like], n_links[like])]
    of_doc = np.repeat(np.arange(len(held), dtype=np.int64), np.diff(links_before[bounds]))
    keyed, times = np.unique(of_doc << 32 | every, return_counts=True)
    pair_ends = np.searchsorted(keyed, np.arange(len(held) + 1, dtype=np.int64) << 32).tolist()
    pairs, times = (keyed & 0xFFFFFFFF).astype(np.int32), times.astype(np.int32)
    like_list = like.tolist()
    for k, i in enumerate(held):
        lo, hi = bounds[k], bounds[k + 1]
        text = ";".join([shown[x] for x in like_list[lo:hi]])
        rows[i] = [
            len(ids[i][0]) // 4, len(ids[i][1]) // 4, int(groups_before[hi] - groups_before[lo]), int(links_before[hi] - links_before[lo]),
            text if whole else hashlib.sha256(text.encode()).hexdigest(), pairs[pair_ends[k] : pair_ends[k + 1]], times[pair_ends[k] : pair_ends[k + 1]],
        ]
    return rows


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))


def token_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times), stored. ``groups`` is `a1,a2|b1;a3|b2` in decimal ids, or its SHA-256."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = pair_of(a_path, b_path), TaskContext.get().partitionId() << 33
        for part in portions(batches, 1):
            columns = list(zip(*aligned_rows(pair, part.column(1).to_pylist(), whole_groups), strict=True))
            numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
            yield pa.record_batch([pa.array(np.arange(row, row + part.num_rows)), part.column(0), *numbers, pa.array(columns[4], pa.string()), lists(list(columns[5])), lists(list(columns[6]))], NAMES)
            row += part.num_rows

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data"))
    return stored(rows.mapInArrow(work, schema), "links")


NAMES = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best), stored: how many documents hold the pair linked, and whether no other pair of its id of A is held by more."""
    counts = stored(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    highest = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("highest"))  # no more rows than A has ids
    joined = counts.join(F.broadcast(highest), F.shiftright(counts["pair"], B_BITS) == highest["a"])
    return stored(joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "counts")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", whole_groups: bool = False) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their id of A),
    count_sum (counts over its links), groups (as text if ``whole_groups``, else its SHA-256; '' without tokens)."""
    links = token_links(docs, a_path, b_path, id_col, text_col, whole_groups)
    counts = pair_counts(links)
    # pairs by the power of two of their count: the frequent ones, as many as may be sent
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    sent, least = 0, 63
    for r in sizes:
        sent += r["count"]
        if sent > MOST_SENT:
            break
        least = r["power"]
    frequent = F.floor(F.log2("n")).cast("int") >= least
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    totals = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    near = F.broadcast(counts.where(frequent))
    found = each.join(near, "pair").groupBy("row").agg(*totals)
    if sent > MOST_SENT:
        others = each.join(near.select("pair"), "pair", "left_anti").join(counts.where(~frequent), "pair").groupBy("row").agg(*totals)
        found = found.unionByName(others).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return links.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")


def default_pair() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_pair()).withColumnRenamed("groups", "groups_sha256")
