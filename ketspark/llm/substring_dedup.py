"""Substring deduplication over words by suffix automata.

A window is ``min_words`` consecutive words of one document; it goes if the same words also start
earlier (smaller id, or same id and earlier start). Automata of a whole corpus grow with it and
can't be broadcast, so the reference is cut into shards by anchor (see ``anchors``): a shard holds
the first texts of one anchor and is shipped with the later texts that share the anchor. A task
builds the automaton of a shard, streams later segments through it for matching statistics and
removes the spans whose match reaches the threshold; texts that were new extend the automaton.
``match_reference`` is the plain broadcast form for a reference of bounded size.

Nulls: a null text has no words; rows with a null id keep all their words and remove none. Repeated
rows with one id and text count as one place; ties don't arise, as places are in order. Texts under ``min_words`` keep
everything. An empty table gives no rows. Very long texts are cut at their anchors. Other columns are kept; one with the name
of ``out_col`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.llm import anchors
from ketspark.llm.common import WordHashes, as_bytes

#: words of an anchor
GRAM = 10


class SuffixAutomaton:
    """Suffix automaton of several word sequences (generalised: each starts anew at the root)."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """State for the suffix of q that ends in an edge from p."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, known, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][word], word)
            last = new

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """Matching statistics: length of the longest known run that ends at each word."""
        state, length = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            following = self.next[state].get(word)
            if following is None:
                length = 0
            else:
                state, length = following, length + 1
            yield length


def word_units() -> Callable:
    hashes = WordHashes()

    def units(data: bytes):
        words = data.split()
        return hashes.of(words), lambda a, b: b" ".join(words[a:b])

    return units


def later_windows(group: list[tuple], min_words: int) -> Iterator[tuple[int, int, int]]:
    """Windows of one shard that an earlier text of the shard holds as well."""
    shard, seen = SuffixAutomaton(), set()
    for k, (id_, start, last, _, data) in enumerate(group):
        if data in seen:
            yield id_, start, last
            continue
        seen.add(data)
        words = data.split(b" ")
        found = [(id_, start + j - min_words + 1) for j, n in enumerate(shard.matches(words)) if n >= min_words] if k else []
        yield from anchors.ranges(found)
        if len(found) <= last - start and k + 1 < len(group):
            shard.add(words)


def repeated_windows(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs): starts of the windows to remove, as array of (start, last), for documents that have any."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("data"))
    rows = anchors.candidates(own, word_units, min_words, min(GRAM, min_words), first_only=True)
    return anchors.runs_by_id(anchors.settled(rows, lambda groups: ((*w, 0) for group in groups for w in later_windows(group, min_words)))).select("id", "runs")


def kept_words(text: Column, runs: Column, min_words: int) -> Column:
    """Struct (n_words, n_removed, kept, spans): words left joined by one space, and the word spans removed."""

    @F.arrow_udf("n_words long, n_removed long, kept string, spans array<struct<first:int,end:int>>")
    def cut(text: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(text, runs, strict=True):
            words = (t.as_py() or b"").split()
            spans = anchors.covered([(x["start"], x["last"]) for x in r.as_py() or ()], min_words, len(words))
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [{"first": a, "end": b} for a, b in spans]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["n_words", "n_removed", "kept", "spans"])

    return cut(text, runs)


def remove_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", out_col: str = "repeats") -> DataFrame:
    """``docs`` with a struct column ``out_col`` (n_words, n_removed, kept, spans)."""
    gone = repeated_windows(docs, min_words, id_col, text_col).select(F.col("id").alias("__gone_id"), F.col("runs").alias("__gone_runs"))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col("__gone_id"), "left")
    return joined.withColumn(out_col, kept_words(as_bytes(text_col), F.col("__gone_runs"), min_words)).drop("__gone_id", "__gone_runs")


def match_reference(docs: DataFrame, reference: list[str], min_words: int = 20, text_col: str = "text", out_col: str = "repeats", max_words: int = 200_000) -> DataFrame:
    """``docs`` without the word spans that a bounded reference holds: its automata, one a shard of
    ``max_words`` // 4 words, are broadcast and every document is streamed through each of them."""
    texts = [t.encode().split() for t in reference if t]
    if sum(map(len, texts)) > max_words:
        raise ValueError(f"the reference has over {max_words} words; use repeated_windows with it as documents")
    shards: list[tuple[SuffixAutomaton, int]] = []
    for words in texts:
        if not shards or shards[-1][1] > max_words // 4:
            shards.append((SuffixAutomaton(), 0))
        shards[-1][0].add(words)
        shards[-1] = (shards[-1][0], shards[-1][1] + len(words))
    sent = docs.sparkSession.sparkContext.broadcast([a for a, _ in shards])

    @F.arrow_udf("array<struct<start:int,last:int>>")
    def starts(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            words = (t.as_py() or b"").split()
            found = {(0, j - min_words + 1) for a in sent.value for j, n in enumerate(a.matches(words)) if n >= min_words}
            out.append([{"start": a, "last": b} for _, a, b in anchors.ranges(list(found))])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("last", pa.int32())])))

    return docs.withColumn(out_col, kept_words(as_bytes(text_col), starts(as_bytes(text_col)), min_words))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as s, w from d where len(w) >= 20),
r as (select doc_id, s, row_number() over (partition by w[s:s + 19] order by doc_id, s) as place from s),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from r where place > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""
