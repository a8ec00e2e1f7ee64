"""Collocations of two and three words, counted by vertically partitioned suffix subtrees.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs. Every
place in a piece starts a suffix, cut to three words, and before the first word found under ``min_count`` times, as no
phrase that is counted goes on beyond it. The suffixes make one trie, which is built in parts:

1. Words are counted, and pairs that are frequent in some portion of the texts are noted.
2. Vertical partitioning: prefixes get the suffixes' memory budget. Words in order of hash are packed into groups of at most ``budget``
   suffixes. A word with over half a budget is extended by its second word, whose pairs are dealt over several groups; a
   pair so frequent that this isn't enough is extended to three words, its only prefixes left.
3. Tasks build the subtrees of a portion of the texts and hand each group its part; the task of a group merges them, one group at
   a time, and reads the counts of phrases from the totals of leaves.

Words go by 64-bit hashes of language and word; two words of one hash are detected, and another seed is then tried.
Counts, products and quotients are exact (integers, and decimals of 38 digits).

Nulls: a null text is empty, a null language is ``und`` (and counts with rows that say so). Repeated rows and equal or null ids count as often
as they are there. Equal scores and counts are ordered by phrase in UTF-8 order. An empty table, or one without phrases, gives no rows. A very
long text is cut into words at once, alone in its portion. Only text and language are read, so other columns can't clash.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ketspark.llm.common import as_bytes, mix, portions, release, small, small_batches, stored

#: suffixes that the task of a group holds; less where the corpus is small, so that there are GROUPS groups
BUDGET, GROUPS = 1_000_000, 1024
#: a pair that holds one in PAIR_SHARE of all suffixes is extended to three words
PAIR_SHARE = 2000
#: words that a task counts before it hands them on
HELD_WORDS = 250_000
#: bits of the filter of frequent words (16 MB); it lets more rare words pass when it is full, but no frequent one is lost
FILTER_BITS = 1 << 27
#: rows of one language that are ranked in one task before the last ranking
RANKED = 100_000

#: separators of pieces become a byte that UTF-8 doesn't have
APART = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, with a byte 0xFF between pieces. ``split`` cuts at space and tab, as all other white space is between pieces."""
    return text.lower().translate(APART).replace(b"\xff", b" \xff ").split()


class Hashes(dict):
    """64-bit hashes of the words of one language, never 0; a bounded memo. The end of a piece is 0."""

    LIMIT = 150_000

    def __init__(self, lang: str, seed: int):
        super().__init__({b"\xff": 0})
        self.start = xxhash.xxh3_64(lang.encode() + b"\xff", seed=seed)

    def __missing__(self, word: bytes) -> int:
        h = self.start.copy()
        h.update(word)
        value = self[word] = h.intdigest() or 1
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > self.LIMIT:
            self.clear()
            self[b"\xff"] = 0
        return found


def by_language(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of all its texts); texts end as pieces do."""
    found = defaultdict(list)
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        found[lang] += pieces(text)
        found[lang].append(b"\xff")
    yield from found.items()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def rows_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), as_bytes(text_col).alias("data"))


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(h, h2, lang, word, n), stored: words with their counts, and (h2 not 0) pairs with their counts in portions where they are frequent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, Hashes] = {}
        held: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                codes = np.concatenate([hashes[lang].of(w) for w in map(list, itertools.batched(words, 50_000))])
                n = np.fromiter(counts.values(), np.int64, len(words))
                yield pa.record_batch([signed(codes), pa.array(np.zeros(len(words), np.int64)), pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n)], NAMES)
            held.clear()

        for part in portions(batches, 1):
            pairs, total = [], 0
            for lang, words in by_language(part):
                own, counts = hashes.setdefault(lang, Hashes(lang, seed)), held.setdefault(lang, Counter())
                counts.update(words)
                counts.pop(b"\xff", None)
                if not counts:
                    del held[lang]
                    continue
                codes = own.of(words)
                pairs.append(np.stack((codes[:-1], codes[1:]), 1)[(codes[:-1] != 0) & (codes[1:] != 0)])
                total += len(words)
            if pairs:
                flat = np.concatenate(pairs)
                _, first, n = np.unique(joined(flat[:, 0], flat[:, 1]), return_index=True, return_counts=True)
                often = n * PAIR_SHARE >= total
                both = flat[first[often]]
                yield pa.record_batch([signed(both[:, 0].copy()), signed(both[:, 1].copy()), pa.array([""] * len(both), pa.string()), pa.array([b""] * len(both), pa.binary()), pa.array(n[often])], NAMES)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()
        release()

    found = rows.mapInArrow(work, "h long, h2 long, lang string, word binary, n long")
    return stored(found.groupBy("h", "h2", "lang", "word").agg(F.sum("n").alias("n")), "words")


NAMES = ["h", "h2", "lang", "word", "n"]


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash of two."""
    return mix(x * np.uint64(0x9E3779B97F4A7C15) + y)


def frequent_filter(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``words``: FILTER_BITS / 8 bytes at most come to the driver, whatever the number of words."""
    place = F.col("h").bitwiseAND(FILTER_BITS - 1) + 1
    parts = words.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        own = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.bucket - 1) * len(own)
        bits[at : at + len(own)] = own[: len(bits) - at]
    return bits


class Groups:
    """Which group a suffix belongs to. Its size follows the number of groups, which is that of budgets in the corpus."""

    def __init__(self, ends: np.ndarray, long_words: np.ndarray, long_sizes: np.ndarray, long_pairs: np.ndarray):
        self.ends, self.long_words, self.long_pairs = ends, long_words, long_pairs
        self.first = len(ends) + 1 + np.cumsum(long_sizes) - long_sizes
        self.sizes = long_sizes.astype(np.uint64)

    def of(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        group = np.searchsorted(self.ends, w1, "right")
        if len(self.long_words):
            at = np.minimum(np.searchsorted(self.long_words, w1), len(self.long_words) - 1)
            own = np.flatnonzero(self.long_words[at] == w1)
            if len(own):
                code = joined(w1[own], w2[own])
                three = np.isin(code, self.long_pairs)
                code = np.where(three, joined(code, w3[own]), code)
                group[own] = self.first[at[own]] + (code % self.sizes[at[own]]).astype(np.int64)
        return group


def make_groups(frequent: DataFrame, pairs: DataFrame, budget: int) -> Groups:
    """Pack the prefixes. To the driver come at most 16 rows a group, and PAIR_SHARE * 2 pairs."""
    total = frequent.agg(F.sum("n")).first()[0] or 0
    budget = max(1, min(budget, total // GROUPS))
    is_long = F.col("n") * 2 > budget
    long_words = sorted((r.h % (1 << 64), r.n) for r in frequent.where(is_long).select("h", "n").collect())  # under 2 * total / budget
    bits = max(1, math.ceil(math.log2(8 * total / budget + 1)))
    # unsigned order of hashes: the first bits
    buckets = frequent.where(~is_long).groupBy(F.shiftrightunsigned("h", 64 - bits).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    ends, held = [], 0
    for bucket, n in sorted(tuple(r) for r in buckets):
        if held and held + n > budget:
            ends.append(bucket << (64 - bits))
            held = 0
        held += n
    sizes = [max(2, -(-4 * n // budget)) for _, n in long_words]
    over = pairs.where(F.col("n") * 2 * PAIR_SHARE >= total).select("h", "h2").collect()
    codes = joined(*np.array([(r.h % (1 << 64), r.h2 % (1 << 64)) for r in over], np.uint64).reshape(-1, 2).T)
    return Groups(np.array(ends, np.uint64), np.array([h for h, _ in long_words], np.uint64), np.array(sizes, np.int64), codes)


def leaves(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Equal suffixes as one leaf each, in order of the trie (and of groups before)."""
    order = np.lexsort((w3, w2, w1) if group is None else (w3, w2, w1, group))
    w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
    new = np.ones(len(w1), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (w3[1:] != w3[:-1])
    first = np.flatnonzero(new)
    found = (w1[first], w2[first], w3[first], np.add.reduceat(n, first) if len(first) else n)
    return found if group is None else (*found, group[order][first])


def packed(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> bytes:
    """A subtree: the words of its first level once each with their number of leaves, then the leaves."""
    words, first = np.unique(w1, return_index=True)  # w1 is in order
    sizes = np.diff(np.append(first, len(w1))).astype("<u4")
    deep = w3 != 0
    head = np.array([len(words), len(w1), int(deep.sum())], "<u4")
    return b"".join(x.tobytes() for x in (head, words, sizes, w2, w3[deep], np.packbits(deep), n.astype("<u4")))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    k, m, d = np.frombuffer(data, "<u4", 3).tolist()
    at, out = 12, []
    for count, kind in ((k, "<u8"), (k, "<u4"), (m, "<u8"), (d, "<u8"), (-(-m // 8), "u1"), (m, "<u4")):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    words, sizes, w2, deep, flags, n = out
    w3 = np.zeros(m, np.uint64)
    w3[np.unpackbits(flags, count=m).astype(bool)] = deep
    return np.repeat(words, sizes), w2, w3, n.astype(np.int64)


def subtrees(rows: DataFrame, bits: np.ndarray, groups: Groups, seed: int) -> DataFrame:
    """(grp, tree): for every portion of texts, the part of its trie that belongs to the group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, Hashes] = {}
        for part in portions(batches, 1):
            found = []
            for lang, words in by_language(part):
                own = hashes.setdefault(lang, Hashes(lang, seed))
                w1 = own.of(words)
                place = w1 & np.uint64(FILTER_BITS - 1)
                w1[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1) == 0] = 0  # a rare word ends its suffixes
                w2, w3 = np.append(w1[1:], np.zeros(1, np.uint64)), np.append(w1[2:], np.zeros(2, np.uint64))[: len(w1)]
                start = (w1 != 0) & (w2 != 0)
                found.append(np.stack((w1[start], w2[start], w3[start])))
            w1, w2, w3 = np.concatenate(found, 1) if found else np.empty((3, 0), np.uint64)
            if not len(w1):
                continue
            *leaf, group = leaves(w1, w2, w3, np.ones(len(w1), np.int64), groups.of(w1, w2, w3))
            bounds = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
            trees = [packed(*(x[a:b] for x in leaf)) for a, b in itertools.pairwise(bounds)]
            yield pa.record_batch([pa.array(group[bounds[:-1]]), pa.array(trees, pa.binary())], ["grp", "tree"])
        release()

    return rows.mapInArrow(work, "grp long, tree binary")


def read_counts(trees: DataFrame, groups: Groups, min_count: int, budget: int) -> DataFrame:
    """(w1, w2, w3, a), stored: the phrases of every group's subtree found ``min_count`` times or more; w3 is 0 for two words. Of pairs that
    are dealt over several groups there is a row a group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        loose, now = 0, None

        def merged() -> tuple[np.ndarray, ...]:
            return leaves(*map(np.concatenate, zip(*held, strict=True)))

        def totals() -> pa.RecordBatch:
            w1, w2, w3, n = merged()
            first = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            pair_n = np.add.reduceat(n, first)
            shared = np.isin(joined(w1[first], w2[first]), groups.long_pairs)
            pair, deep = first[(pair_n >= min_count) | shared], (w3 != 0) & (n >= min_count)
            a = np.concatenate((pair_n[(pair_n >= min_count) | shared], n[deep]))
            third = np.concatenate((np.zeros(len(pair), np.uint64), w3[deep]))
            return pa.record_batch([signed(np.concatenate((x[pair], x[deep]))) for x in (w1, w2)] + [signed(third), pa.array(a)], ["w1", "w2", "w3", "a"])

        for batch in batches:
            for group, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group != now and held:
                    yield totals()
                    held, loose = [], 0
                now = group
                held.append(unpacked(tree.as_py()))
                loose += len(held[-1][0])
                if loose > max(budget, len(held[0][0])):  # what has come since the last time is more than what there was
                    held, loose = [merged()], 0
        if held:
            yield totals()
        release()

    return stored(trees.repartition("grp").sortWithinPartitions("grp").mapInArrow(work, "w1 long, w2 long, w3 long, a long"), "phrases")


def quotient(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in integers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, top: int = 2000, covered_percent: int = 50, budget: int = BUDGET) -> DataFrame:
    """Each language's first ``top`` phrases by score, count (both descending) and phrase: lang, rank, phrase, a, l, r, n, score."""
    rows = rows_of(docs, text_col, lang_col)
    for seed in itertools.count():
        counted = count_words(rows, seed)
        words = counted.where("h2 = 0").select("h", "lang", "word", "n")
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            break
    frequent = words.where(F.col("n") >= min_count)
    groups = make_groups(frequent, counted.where("h2 != 0").select("h", "h2", "n"), budget)
    phrases = read_counts(subtrees(rows, frequent_filter(frequent), groups, seed), groups, min_count, budget)
    pairs = phrases.where("w3 = 0").groupBy("w1", "w2").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    triples = phrases.where("w3 != 0")
    pairs, known = stored(pairs, "pairs"), small(frequent)
    word = lambda k: known.select(F.col("h").alias(f"w{k}"), F.col("word").cast("string").alias(f"t{k}"), F.col("n").alias(f"f{k}"))
    parts = small(pairs)
    # pairs that a longer candidate covers
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longest"))
    two = pairs.join(inside, ["w1", "w2"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered_percent))
    two = two.join(word(1), "w1").join(word(2), "w2")
    two = two.select("w1", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), quotient(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(parts.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(parts.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = three.join(word(1), "w1").join(word(2).drop("f2"), "w2").join(word(3), "w3")
    three = three.withColumn("s1", quotient(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", quotient(F.col("a"), F.col("f12"), F.col("f3")))
    cut = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    three = three.select("w1", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"), cut("s1", "s2").alias("score"))
    of_word = known.select(F.col("h").alias("w1"), "lang")
    found = stored(two.unionByName(three).join(of_word, "w1").drop("w1"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in parts first
    first = first_by(found, ["lang", F.pmod(F.xxhash64("phrase"), F.lit(-(-found.count() // RANKED) or 1))], order, top)
    ranked = first_by(first, ["lang"], order, top, "rank")
    sizes = F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("n")))  # a row a language of the result
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def first_by(df: DataFrame, keys: list, order: list[Column], top: int, name: str = "__rank") -> DataFrame:
    from pyspark.sql import Window

    found = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)
    return found.drop(name) if name == "__rank" else found


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), words as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), grams as (
    select lang, k, w[i : i + k - 1] as p
    from (select lang, w, unnest(range(1, len(w) + 1)) as i from words), (values (1), (2), (3)) as ks(k)
    where i + k - 1 <= len(w)
), f as (
    select lang, k, p, count(*) as a from grams group by all
), sizes as (
    select lang, sum(a)::bigint as n from f where k = 1 group by lang
), cand as (
    select * from f where k > 1 and a >= 10
), inside as (
    select lang, p[1:2] as p, a from cand where k = 3 union all select lang, p[2:3], a from cand where k = 3
), dropped as (
    select distinct c.lang, c.p from cand c join inside i on c.lang = i.lang and c.p = i.p where 100 * i.a >= 50 * c.a
), cuts as (
    select c.lang, c.p, c.a, x.k as cut, x.a as l, y.a as r, (1000000::hugeint * c.a * c.a // (x.a::hugeint * y.a))::bigint as score
    from cand c join f x on x.lang = c.lang and x.k < c.k and x.p = c.p[1 : x.k] join f y on y.lang = c.lang and y.k = c.k - x.k and y.p = c.p[x.k + 1 : c.k]
    where not exists (select 1 from dropped d where d.lang = c.lang and d.p = c.p)
), scored as (
    select lang, array_to_string(p, ' ') as phrase, a, l, r, score from cuts qualify row_number() over (partition by lang, p order by score, cut) = 1
)
select s.lang, row_number() over (partition by s.lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, z.n, score
from scored s join sizes z on z.lang = s.lang
qualify rank <= 2000
"""
