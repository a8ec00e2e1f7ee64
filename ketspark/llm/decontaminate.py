"""Benchmark decontamination: a BM25 index of the test items, asked with every training passage.

Every whole text is cut into overlapping passages, long enough that any item fits into one. The
items' inverted index has its postings in blocks with the largest impact of each; impacts are
divided by the item's score against itself, so that one threshold serves all items. An item's frequent
terms, which cannot reach the threshold by themselves, are left out of a first test over all
passages of a text at once: its rare terms must add up to the rest. Passages with an item that
passes run block-max WAND and get every item above the threshold; no other passage has one. An item counts
as leaked if the passage then holds its question and its answer: at least ``OVERLAP`` of the 5-word
shingles of both parts; a part of fewer words must be there as it is.

The index is broadcast in blocks of at most ``MAX_ITEM_WORDS`` words of items; a larger benchmark takes
several passes, with the statistics of the whole benchmark in each, so that scores don't depend on the blocks. Documents are never shuffled.

Words are compared in lower case without surrounding signs. Nulls: a null text has no passages, null
or empty items match nothing. Repeated rows are judged each for itself; equal items (ties) are found both. Empty tables
of either kind find nothing. Very long texts are cut into passages, all of which are asked. ``clean_documents`` keeps all
columns, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ketspark.llm.common import as_bytes, portions, small_batches, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
#: share of an item's score that its frequent terms may hold back from the first test
HELD_BACK = 0.2
MAX_ITEM_WORDS = 2_000_000
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»„“”‘’…"


def normal(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(SIGNS)


def shingles(words: list) -> set:
    """Runs of SHINGLE words."""
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and after the last line end, else after the last full stop inside the text; without
    either the whole text is the question."""
    body = text.strip()
    cut = body.rfind("\n")
    if cut < 0:
        cut = body.rstrip(".!?").rfind(". ") + 1
    words = lambda t: [w for w in map(normal, t.encode().split()) if w]
    if cut <= 0:
        return words(body), []
    return words(body[:cut]), words(body[cut:])


class Whole(NamedTuple):
    """What a block of items has to know of the whole benchmark: items, mean and largest number of words, items by term."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """Inverted index with block maxima over items (id, text); BM25's statistics are those of the whole benchmark, if it has more items."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        parts = [(i, *question_and_answer(t)) for i, t in items]
        parts = [p for p in parts if p[1] or p[2]]
        self.ids = [p[0] for p in parts]
        self.terms: dict[str, int] = {}
        bags: list[dict[int, int]] = []
        for _, q, a in parts:
            bag: dict[int, int] = defaultdict(int)
            for w in q + a:
                bag[self.terms.setdefault(w, len(self.terms))] += 1
            bags.append(bag)
        number = lambda words: [self.terms[w] for w in words]
        self.questions = [number(q) for _, q, _ in parts]
        self.answers = [number(a) for _, _, a in parts]
        self.longest = max([1, *(len(q) + len(a) for _, q, a in parts)])
        n, df = len(bags), np.zeros(len(self.terms))
        for bag in bags:
            df[list(bag)] += 1
        size, mean = n, sum(sum(b.values()) for b in bags) / max(1, n)
        if whole:
            size, mean, self.longest, df = whole.n, whole.mean, whole.longest, np.array([whole.df[t] for t in self.terms], float)
        idf = np.log(1 + (size - df + 0.5) / (df + 0.5)) if n else df
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for item, bag in enumerate(bags):
            norm = K1 * (1 - B + B * sum(bag.values()) / mean)
            impact = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in bag.items()}
            own = sum(impact.values())
            for t, w in impact.items():
                self.postings[t].append((item, w / own))
        self.block_max = [[max(w for _, w in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)] for p in self.postings]
        self.top = np.array([max(m) for m in self.block_max] + [0.0])  # the last: any other word

        # first test: of each item the terms that are rarest among items, down to HELD_BACK of its score
        essential: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.rest = np.zeros(max(1, n))
        shares: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for t, p in enumerate(self.postings):
            for item, w in p:
                shares[item].append((t, w))
        for item, own in enumerate(shares):
            for t, w in sorted(own, key=lambda x: (-df[x[0]], x)):
                if self.rest[item] + w <= HELD_BACK:
                    self.rest[item] += w
                else:
                    essential[t].append((item, w))
        self.first = np.cumsum([0, *map(len, essential), 0])
        self.items = np.array([i for p in essential for i, _ in p], np.int64)
        self.shares = np.array([w for p in essential for _, w in p])

    def candidates(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> np.ndarray:
        """Passages in which some item may reach the threshold; passage and term are distinct pairs."""
        n = self.first[term + 1] - self.first[term]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int64)
        at = np.arange(ends[-1]) + np.repeat(self.first[term] - ends + n, n)
        width = len(self.rest)
        keys, inverse = np.unique(np.repeat(passage, n) * width + self.items[at], return_inverse=True)
        scores = np.bincount(inverse, self.shares[at])
        return np.unique(keys[scores + self.rest[keys % width] >= threshold - 1e-9] // width)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items (number, score) above the threshold, by block-max WAND."""
        found = []
        lists = [[self.postings[t], 0, t] for t in terms]
        while True:
            lists = [x for x in lists if x[1] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            # sharper: maxima of the blocks in which the item would be
            sharp, end = 0.0, math.inf
            for p, at, t in lists[: pivot + 1]:
                b = at // BLOCK
                while (b + 1) * BLOCK < len(p) and p[(b + 1) * BLOCK - 1][0] < item:
                    b += 1
                sharp += self.block_max[t][b]
                end = min(end, p[min((b + 1) * BLOCK, len(p)) - 1][0])
            if sharp < threshold:
                # no item up to the first block end can do; go beyond it, but not past the next list
                goal = end + 1
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0][lists[pivot + 1][1]][0])
                goal = max(goal, item + 1) if goal <= item else goal
            elif lists[0][0][lists[0][1]][0] == item:
                score = sum(p[at][1] for p, at, _ in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for x in lists[: pivot + 1]:
                p, at = x[0], x[1]
                while at < len(p) and p[at][0] < goal:
                    at += 1
                x[1] = at


def overlap(part: list[int], passage: list[int], held: set) -> float:
    """Share of a part's shingles in a passage (``held``: the passage's shingles)."""
    if not part:
        return 1.0
    if len(part) < SHINGLE:
        n = len(part)
        return float(any(passage[i : i + n] == part for i in range(len(passage) - n + 1)))
    own = shingles(part)
    return len(own & held) / len(own)


class TermNumbers(dict):
    """Word -> term number; words of no item get the last number, lone signs -1."""

    LIMIT = 200_000

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        name = normal(word)
        value = self[word] = self.terms.get(name, len(self.terms)) if name else -1
        return value


class Matcher:
    """Finds the items that passages of a text hold."""

    def __init__(self, index: Index):
        self.index = index
        self.known = TermNumbers(index.terms)
        self.stride = index.longest
        self.tried = 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """Term numbers, without lone signs."""
        if len(self.known) > TermNumbers.LIMIT:
            self.known.clear()
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return out[out >= 0]

    def leaks(self, data: bytes, threshold: float, least: float) -> dict[int, tuple[float, float, float]]:
        """item number -> (score, share of the question, share of the answer), the best of all passages."""
        index, terms, step = self.index, self.number(data.split()), self.stride
        other = len(index.terms)
        at = np.flatnonzero(terms != other)
        if not len(at):
            return {}
        # passage k covers words k*step .. (k+2)*step, so each word is in passages k and k-1
        k = at // step
        pairs = np.unique(np.concatenate([k, np.maximum(k - 1, 0)]) * (other + 1) + np.concatenate([terms[at]] * 2))
        passage, term = np.divmod(pairs, other + 1)
        found: dict[int, tuple[float, float, float]] = {}
        for p in index.candidates(passage, term, threshold).tolist():
            lo, hi = np.searchsorted(passage, [p, p + 1])
            self.tried += 1
            hits = index.search(term[lo:hi].tolist(), threshold)
            if hits:
                own = terms[p * step : (p + 2) * step].tolist()
                held = shingles(own)
                for item, score in hits:
                    q, a = overlap(index.questions[item], own, held), overlap(index.answers[item], own, held)
                    if q >= least and a >= least and (item not in found or found[item] < (score, q, a)):
                        found[item] = (score, q, a)
        return found


def term_counts(items: DataFrame, text_col: str) -> DataFrame:
    """(term, items, words, longest), stored: items that have each term; the row of the null term is for all items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words, longest = Counter(), 0, 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = [w for part in question_and_answer(text) for w in part]
                held.update(set(own))
                n, words, longest = n + bool(own), words + len(own), max(longest, len(own))
            if len(held) > 200_000:
                yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), *[pa.array([0] * len(held), pa.int64())] * 2], names)
                held.clear()
        sums = [[*held.values(), n], [0] * len(held) + [words], [0] * len(held) + [longest]]
        yield pa.record_batch([pa.array([*held, None], pa.string()), *[pa.array(x, pa.int64()) for x in sums]], names)

    names = ["term", "items", "words", "longest"]
    counted = items.select(text_col).mapInArrow(count, "term string, items long, words long, longest long")
    return stored(counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "terms")


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of at most MAX_ITEM_WORDS words of items each, in id order. Of more than one block all have the statistics of the whole
    benchmark, which Spark counts; the driver gets those of a block's own terms."""
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    size, held, counted = 0, [], None
    rows = items.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator()

    def index() -> Index:
        if counted is None:
            return Index(held)
        own = {w for _, text in held for part in question_and_answer(text) for w in part}
        terms = benchmark.sparkSession.createDataFrame([(w,) for w in own], "term string")
        all_items = counted.where("term is null").first()
        df = {r.term: r["items"] for r in counted.join(F.broadcast(terms), "term").select("term", "items").collect()}
        return Index(held, Whole(all_items["items"], all_items.words / max(1, all_items["items"]), max(1, all_items.longest), df))

    for r in rows:
        if size >= MAX_ITEM_WORDS:
            counted = counted or term_counts(items, text_col)
            yield index()
            size, held = 0, []
        held.append((r[0], r[1]))
        size += len(r[1].split())
    if held:
        yield index()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item that a document holds."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("data"))
    out = None
    for index in item_blocks(benchmark, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in portions(batches, 1):
                rows = []
                for id_, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += ((id_, sent.value.ids[i], *v) for i, v in sorted(matcher.leaks(data.as_py(), threshold, least).items()))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = own.mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for index in item_blocks(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent, at=docs.columns.index(text_col)) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for batch in portions(batches, at):
                yield batch.filter(pa.array([not matcher.leaks((t.as_py() or "").encode(), threshold, least) for t in batch.column(at)], pa.bool_()))

        docs = small_batches(docs).mapInArrow(keep, docs.schema)
    return docs


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
