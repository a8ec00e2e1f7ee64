"""Byte-level BPE by backtracking, and decoding through a table of offsets.

A text is cut at the special tokens, each part into words by the vocabulary's pattern, and each word is encoded alone:
an Aho-Corasick automaton over all tokens finds the longest token that starts at every byte; tokens are then taken
from the left, longest first, each checked against the one before. A shorter prefix, or a shorter token before, follows
where the two don't go together; a place from which no tokens go on is tried once only, so the work is linear.
Tokens x, y go together if merging the bytes of both in order of rank gives x, y again; a sequence is the result
of the merges exactly if all its neighbours go together, so the ids are those of the merges.

Decoding: all tokens' bytes lie in one array; a table of offsets tells where each starts, and a text's bytes are gathered
by it. Bytes that aren't UTF-8 become U+FFFD.

Nulls: a null text is empty; empty texts have no ids, and decode to an empty text. Rows with null or equal ids, repeated rows and
other columns stay as they are: both operators add one column to every row, and replace a column of that name.
An empty table gives no rows. Very long texts are encoded word by word, and texts go through memory some megabytes at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ketspark.llm.common import small_batches

#: fixed values: the pattern of words that the vocabulary was made with, and the characters by which it writes bytes
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: stretches that no word crosses: white space and what follows it
STRETCHES = re.compile(r"\s*\S+|\s+")
SIGNS, SPACE = frozenset(".,;:!?"), LETTERS[32]
NEVER = 1 << 40


class ByteBPE:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers, and back."""

    #: stretches learnt before the older ones are let go, and the longest that is kept
    MEMO, LONGEST = 150_000, 48

    def __init__(self, path: str, special: bool = True):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, bytes_of = spec["model"]["vocab"], {c: b for b, c in LETTERS.items()}
        size = 1 + max(*vocab.values(), *(t["id"] for t in spec["added_tokens"]))
        self.tokens = [b""] * size
        self.automaton, self.length, self.shorter = ahocorasick.Automaton(), [0] * size, [-1] * size
        for token, i in vocab.items():
            self.tokens[i], self.length[i] = bytes(bytes_of[c] for c in token), len(token)
            self.automaton.add_word(token, i)
            self.shorter[i] = next((vocab[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in vocab), -1)
        self.automaton.make_automaton()
        self.merges, self.parts, self.rank = {}, [None] * size, [-1] * size
        for rank, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            i = vocab[x + y]
            self.merges[vocab[x], vocab[y]] = rank
            if self.parts[i] is None:
                self.parts[i], self.rank[i] = (vocab[x], vocab[y]), rank
        self.right, self.left = {}, {}
        self.together: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))
        self.all_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts at the right (1) or left (0) end of a token, and the rank at which each is merged into the next larger."""
        found, used = [], NEVER
        while True:
            found.append((token, used))
            if self.parts[token] is None:
                return found
            used, token = self.rank[token], self.parts[token][side]

    def go_together(self, x: int, y: int) -> bool:
        """No part at the end of ``x`` is merged with one at the start of ``y`` while both are there. Of equal ranks the left one is first."""
        right, left = self.right.get(x), self.left.get(y)
        if right is None:
            right = self.right[x] = self.edge(x, 1)
        if left is None:
            left = self.left[y] = self.edge(y, 0)
        get = self.merges.get
        for a, until_a in right:
            for b, until_b in left:
                rank = get((a, b))
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def word(self, letters: str) -> list[int]:
        """Ids of one word, written in the vocabulary's letters for bytes."""
        n, length, shorter, table = len(letters), self.length, self.shorter, self.together
        ids = [token for _, token in self.automaton.iter_long(letters)]  # longest first, without a step back
        if all(map(table.get, itertools.pairwise(ids))):
            return ids
        longest = [0] * n
        for end, token in self.automaton.iter(letters):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest is the last
        ids, at, dead = [], 0, set()
        token = longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if not ids:
                        break
                    pair = (ids[-1], token)
                    fits = table.get(pair)
                    if fits is None:
                        if len(table) > 500_000:
                            table.clear()
                        fits = table[pair] = self.go_together(*pair)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                if at == n:
                    return ids
                token = longest[at]
            else:
                dead.add(at)
                token = ids.pop()
                at -= length[token]
                token = shorter[token]

    def stretch(self, text: str) -> bytes:
        known, found = self.known, []
        bare = text[1:] if text[0] == " " else text
        if bare.isascii() and bare.isalpha():
            words = (text,)
        elif bare[:-1].isascii() and bare[:-1].isalpha() and bare[-1] in SIGNS:
            words = (text[:-1], text[-1])
        else:
            words = WORDS.findall(text)
        for w in words:
            ids = known.get(w) or self.older.get(w)
            if ids is None:
                letters = w.replace(" ", SPACE) if len(w) > 1 and w.isascii() and w[1:].isalpha() else "".join([LETTERS[b] for b in w.encode("utf-8", "replace")])
                ids = array("I", self.word(letters)).tobytes()
                if len(w) <= self.LONGEST:
                    known[w] = ids
            found.append(ids)
        return b"".join(found)

    def stretches(self, texts: list[str]) -> list[bytes]:
        known = self.known
        ids = list(map(known.get, texts))
        for i, x in enumerate(ids):
            if x is None:
                t = texts[i]
                x = known.get(t) or self.older.get(t) or self.stretch(t)
                ids[i] = x
                if len(t) <= self.LONGEST:
                    known[t] = x
        if len(known) > self.MEMO:
            self.known, self.older = {}, known
        return ids

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return b"".join(self.stretches(STRETCHES.findall(text)))
        parts = self.cut.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else b"".join(self.stretches(STRETCHES.findall(p))) for i, p in enumerate(parts))

    def ranked(self):
        """The same vocabulary for the tiktoken library, if ids ascend with the ranks of merges as it demands; else None."""
        import tiktoken

        order = [i for i, t in enumerate(self.tokens) if t and t.decode("utf-8", "replace") not in self.special and self.length[i]]
        if any(self.rank[x] >= self.rank[y] >= 0 for x, y in itertools.pairwise(order)):
            return None
        return tiktoken.Encoding("ranked", pat_str=WORDS.pattern, mergeable_ranks={self.tokens[i]: i for i in order}, special_tokens={})

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in turn."""
        start = self.offsets[ids]
        n = self.offsets[ids + 1] - start
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return np.empty(0, np.uint8)
        return self.all_bytes[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]


@functools.cache
def codec_of(path: str, special: bool = True) -> ByteBPE:
    """One codec a worker process."""
    return ByteBPE(path, special)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


IDS = ArrayType(IntegerType())


def with_ids(docs: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text; strings of special tokens become those tokens.
    The function is declared not deterministic, so that Spark evaluates it once for all uses of its result."""

    @F.arrow_udf(IDS)
    def encode(texts: pa.Array) -> pa.Array:
        codec = codec_of(tokenizer)
        ids = [codec.encode(t.decode("utf-8", "replace")) for t in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return small_batches(docs).withColumn(out_col, encode.asNondeterministic()(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def with_text(tokens: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``tokens`` with the text of every list of ids, special tokens included; a null list has an empty text."""

    @F.arrow_udf(StringType())
    def decode(lists: pa.Array) -> pa.Array:
        codec = codec_of(tokenizer)
        flat = lists.values.to_numpy(zero_copy_only=False)
        ends = lists.offsets.to_numpy().tolist()
        return pa.array([codec.decode(flat[a:b]).tobytes().decode("utf-8", "replace") for a, b in itertools.pairwise(ends)], pa.string())

    return small_batches(tokens).withColumn(out_col, decode(F.coalesce(F.col(ids_col), F.array().cast(IDS))))


@F.arrow_udf(StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """Of the ids as little-endian unsigned 32-bit integers."""
    flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4")
    return pa.array([hashlib.sha256(flat[a:b]).hexdigest() for a, b in itertools.pairwise(ids.offsets.to_numpy().tolist())])


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = with_text(with_ids(docs, default_tokenizer()), default_tokenizer(), out_col="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
