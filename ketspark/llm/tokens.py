"""Token ids of whole texts, and a Parquet file format for them.

The tokenizer never joins characters across the word separators (see ``common``), so the ids of a text
are the ids of its words in turn; a bounded memo holds the ids of words already seen.

File format: Parquet files (one a task, or more if Spark is told to split them), documents in ascending id order
over the tasks by number, as it is in the file names. Columns: doc_id; n_tokens; task_start (ids before the document
in the files of its task); ids, a list of 32-bit integers. Ids are dictionary encoded, delta encoded beyond that; row groups and pages have fixed
target sizes and page indexes, so that a range of documents, or the columns without ids, are read alone.

Nulls: a null text is empty and holds the end id only; documents with a null id come first. Equal ids (ties, repeated
rows) are ordered by a hash of their texts. An empty table gives no rows. Very long texts are one list each, of at
most 2^31 ids; texts go through memory some megabytes at a time. Other columns of ``docs`` aren't read.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from itertools import batched, chain, pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ketspark.llm.common import as_bytes, new_path, portions, small_batches


#: signs that the tokenizer parts from the letters before them, and lower-case letters that it leaves as they are
SIGNS = ".,;:!?*#%&$|"
PLAIN = r"\A[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]*\z"
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*")
#: the characters by which a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100
OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARACTERS = {b: b for b in OWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in OWN)}
ALPHABET = "".join(chr(CHARACTERS[b]) for b in range(256))
ID = attrgetter("id")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    #: words learnt before the older ones are let go; those that are met again meanwhile stay
    MEMO = 200_000
    BLOCK = 1000
    #: words whose ids are put together at a time
    STRETCH = 1 << 19

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Distinct words of a block are looked up once; the ids of its texts are gathered by the words' numbers."""
        for at in range(0, len(texts), self.BLOCK):
            data = pa.array(map(folded, texts[at : at + self.BLOCK]), pa.binary())
            # taken for strings as it is: only ASCII bytes are looked at
            split = pa.compute.ascii_split_whitespace(pa.StringArray.from_buffers(len(data), *data.buffers()[1:]))
            coded = split.flatten().dictionary_encode()
            ids = self.of_words(coded.dictionary)
            flat = np.frombuffer(b"".join(ids), "<u4")
            n = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            before, codes = np.cumsum(n) - n, coded.indices.to_numpy()
            ends = np.concatenate(([0], np.cumsum(n[codes])))
            out = np.empty(int(ends[-1]), "<u4")
            for lo in range(0, len(codes), self.STRETCH):
                own, e = codes[lo : lo + self.STRETCH], ends[lo : lo + self.STRETCH + 1]
                out[e[0] : e[-1]] = flat[np.repeat(before[own] - e[:-1], n[own]) + np.arange(e[0], e[-1])]
            bounds = ends[split.offsets.to_numpy()].tolist()
            for lo, hi in pairwise(bounds):
                yield out[lo:hi].tobytes()

    def of_words(self, words: pa.StringArray) -> list[bytes]:
        """Ids of each word. A plain word has the ids of its letters and then those of its signs."""
        letters = pa.compute.ascii_rtrim(words, characters=SIGNS)
        plain = pa.compute.and_(pa.compute.ascii_is_alpha(letters), pa.compute.ascii_is_lower(letters)).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        plain[rest] = pa.compute.match_substring_regex(letters.take(pa.array(rest)), PLAIN).to_numpy(zero_copy_only=False)
        letters = pa.compute.if_else(pa.array(plain), letters, words)
        stems = letters.dictionary_encode()
        of_stem = self.of(as_list(stems.dictionary))
        ids = list(map(of_stem.__getitem__, stems.indices.to_numpy().tolist()))
        size = pa.compute.binary_length(letters).to_numpy()
        parted = np.flatnonzero(size != pa.compute.binary_length(words).to_numpy())
        signs = [w[k:] for w, k in zip(as_list(words.take(pa.array(parted))), size[parted].tolist(), strict=True)]
        distinct = list(set(signs))
        of_signs = dict(zip(distinct, self.of(distinct), strict=True))
        for i, own in zip(parted.tolist(), signs, strict=True):
            ids[i] += of_signs[own]
        return ids

    def of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct words, letters or signs."""
        ids = list(map(self.known.get, parts))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            if len(self.known) > self.MEMO:
                self.known, self.older = {b"": b""}, self.known
            self.learn([parts[i] for i in new])
            for i in new:
                ids[i] = self.known[parts[i]]
        return ids

    def learn(self, parts: list[bytes]) -> None:
        """Plain letters are in the tokenizer's own alphabet already and go to its model alone."""
        known, older, plain, others = self.known, self.older, [], []
        for x in parts:
            if x in older:
                known[x] = older[x]
            elif x.isalpha() and x.islower() or LETTERS.fullmatch(x):
                plain.append(x)
            else:
                others.append(x)
        for own in batched(plain, 10_000):
            found = list(map(self.tokenizer.model.tokenize, [charmap_decode(x, "strict", ALPHABET)[0] for x in own]))
            ids = array("I", map(ID, chain.from_iterable(found))).tobytes()
            lo = 0
            for x, n in zip(own, map(len, found), strict=True):
                known[x] = ids[lo : (lo := lo + 4 * n)]
        for own in batched(others, 10_000):
            self.ask(own)

    def ask(self, words: Sequence[bytes]) -> None:
        for word, e in zip(words, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False), strict=True):
            self.known[word] = array("I", e.ids).tobytes()


def as_list(words: pa.StringArray) -> list[bytes]:
    """``to_pylist`` of the bytes; it makes no scalars on the way, which take longer than all else that is done with a word."""
    return words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def folded(text: bytes) -> bytes:
    """A-Z in lower case, as the tokenizer has them; not in texts with combining marks (U+0300..U+036F),
    which the tokenizer joins with letters before it lowers them."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: loading it takes about a second."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group_mb: int = 64, page_kb: int = 256) -> None:
    """Encode every text, append ``end_id``, and write the files described above."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, end = encoder_of(tokenizer), 0, np.array([end_id], "<u4").tobytes()
        for part in portions(batches, 1):
            ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)
            yield pa.record_batch([part.column(0), pa.array(n.astype(np.int32)), pa.array(start + ends - n), lists], ["doc_id", "n_tokens", "task_start", "ids"])
            start += int(ends[-1])

    ordered = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("data")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("data"))
    files = ordered.mapInArrow(encode, "doc_id long, n_tokens int, task_start long, ids array<int>").write
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": 1, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.page.row.count.limit": 2000}
    files.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before. A filter on
    doc_id and a choice of columns reach the files."""
    task = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    files = spark.read.parquet(path).select("*", task.alias("task"))
    # one row a task of the writer comes to the driver, from the columns without ids
    sizes = sorted(tuple(r) for r in files.groupBy("task").agg(F.sum(F.col("n_tokens").cast("long"))).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))[:-1].tolist()
    starts = spark.createDataFrame([(t, b) for (t, _), b in zip(sizes, before, strict=True)], "task int, before long")
    joined = files.join(F.broadcast(starts), "task")
    return joined.select("doc_id", (F.col("before") + F.col("task_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4")
    ends = ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
