"""Near-duplicate texts: 5-word shingle sets with Jaccard similarity of 0.8 or more, by chosen path.

Equal texts are one set, held by the smallest id. Each run keeps, of a set x, the shingles whose
hash falls under 1/(0.8 |x|): about 1.25 of them, and a similar set keeps one of the same with
probability over 0.63. Sets that keep the same shingle meet in a bucket. Buckets over ``LEAF`` that are not dense
(see ``dense_links``) are split again by one more sampled shingle a set (a minhash coordinate that the bucket names; two sets
sample the same with the probability of their similarity), so that no set is copied on the way down; what still is large
after ``LEVELS`` is compared block by block, so that nothing is capped. Independent runs bring the recall of pairs at 0.8
to ``recall`` even where all their buckets are split to the last level, and to over 0.9999 where none is.
Leaves are compared by brute force on sketches, with slack; a leaf emits links that join its sets, not all pairs. The
joined sets are then verified on the whole texts: every pair inside a group is compared by exact intersections,
counted, and never emitted.

Nulls: a null text is empty. Texts under 5 words have no shingles and only match equal texts. Rows with
a null id belong to no class. Repeated rows are copies of each other; of equal texts (ties) the smallest id stands for
all. An empty table gives no rows. Very long texts are sets like others. Other columns of ``docs`` aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ketspark.llm.common import WordHashes, as_bytes, grams, join_spread, mix, observed, portions, release, small, small_batches, stored

SHINGLE = 5
SIMILARITY = 0.8
#: minhash coordinates of a sketch, one byte each
SKETCH = 64
#: sketches agree in 0.8 of their coordinates in the mean; 5 standard deviations of slack
ALIKE = 0.55
LEAF = 200
BLOCK = 500
LEVELS = 3
#: sets of a large bucket that every block of it is compared with, about
PIVOTS = 50
#: links that a task joins in memory at a time, some 4 MB
PORTION = 250_000


def shingle_set(data: bytes, hashes: WordHashes) -> np.ndarray:
    return np.unique(grams(hashes.of(data.split()), SHINGLE))


def coefficients(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, (n, 2), np.uint32) | np.uint32(1)


def signatures(docs: DataFrame, runs: int) -> DataFrame:
    """(id, n, sketch, keys) of every text that has shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, perms = WordHashes(), coefficients(SKETCH, 6)
        for part in portions(batches, 1):
            sets = [shingle_set(d.as_py(), hashes) for d in part.column(1)]
            n = np.array([len(s) for s in sets])
            has = np.flatnonzero(n)
            if not len(has):
                continue
            h, n = np.concatenate([sets[i] for i in has]), n[has]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            low = (h >> np.uint64(16)).astype(np.uint32)
            sketch = np.stack([np.minimum.reduceat(low * a + b, first) for a, b in perms], axis=1)
            limit = np.repeat(np.minimum((1 << 32) / (SIMILARITY * n), (1 << 32) - 1).astype(np.uint64), n)
            owner = np.repeat(np.arange(len(has)), n)
            keys: list[list[int]] = [[] for _ in has]
            for r in range(runs):
                u = mix(h ^ np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & (2**64 - 1)))
                chosen = np.flatnonzero((u >> np.uint64(32)) < limit)
                for i, key in zip(owner[chosen].tolist(), u[chosen].view(np.int64).tolist(), strict=True):
                    keys[i].append(key)
            flat = (sketch & np.uint32(255)).astype(np.uint8)
            ids = part.column(0).take(pa.array(has))
            yield pa.record_batch([ids, pa.array(n.astype(np.int32)), pa.array([row.tobytes() for row in flat], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "sketch", "keys"])

    return docs.mapInArrow(sign, "id long, n int, sketch binary, keys array<long>")


def forest(links: np.ndarray, ids: list[int]) -> list[tuple[int, int]]:
    """Links (smallest id of a component, member) of a boolean similarity matrix."""
    m, out = len(ids), []
    label = np.full(m, -1)
    for i in np.argsort(ids, kind="stable").tolist():
        if label[i] >= 0:
            continue
        label[i], front = i, np.array([i])
        while len(front):
            front = np.flatnonzero(links[front].any(axis=0) & (label < 0))
            label[front] = i
            out += [(ids[i], ids[j]) for j in front.tolist()]
    return out


def sketch_links(group: list[tuple]) -> list[tuple[int, int]]:
    """Links among the rows (id, n, sketch) of a leaf."""
    if len(group) == 2:
        (a, n, x), (b, m, y) = group
        same = np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))
        return [(min(a, b), max(a, b))] if same >= ALIKE * SKETCH and SIMILARITY * max(n, m) <= min(n, m) and a != b else []
    ids, n = [g[0] for g in group], np.array([g[1] for g in group])
    x = np.frombuffer(b"".join(g[2] for g in group), np.uint8).reshape(-1, SKETCH)
    links = np.zeros((len(ids), len(ids)), bool)
    for i in range(len(ids)):
        links[i] = ((x == x[i]).sum(axis=1) >= ALIKE * SKETCH) & (SIMILARITY * np.maximum(n, n[i]) <= np.minimum(n, n[i]))
    return forest(links, ids)


def by_key(rows: DataFrame, judge: Callable[[list[tuple]], list[tuple]], schema: str, kinds: tuple, keys: int = 1) -> DataFrame:
    """``judge`` gets the rows of each key (the first ``keys`` columns), without the key."""
    names = rows.columns[:keys]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        columns = [x.split()[0] for x in schema.split(", ")]
        make = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], columns)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    if len(group) > 1:
                        out += judge(group)
                    key, group = row[:keys], []
                group.append(row[keys:])
            if len(out) > 10_000:
                yield make(out)
                out = []
        if len(group) > 1:
            out += judge(group)
        yield make(out)
        release()

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(walk, schema)


def meeting(rows: DataFrame, origin: int, i: Column | None = None, j: Column | None = None) -> DataFrame:
    """(k, origin, i, j, id, n, sketch): rows of one bucket, origin and pair of blocks are compared with each other."""
    none = F.lit(0)
    return rows.select("k", F.lit(origin).alias("origin"), (none if i is None else i).alias("i"), (none if j is None else j).alias("j"), "id", "n", "sketch")


def dense_links(inside: DataFrame, pairs: tuple, origin: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links in the buckets (k, count, id, n, sketch) that are dense, rows of these that still have to be compared (as by ``meeting``),
    and the rows of all other buckets.

    First each block of a bucket is linked inside itself and with a few pivots of the bucket. What is
    connected then needs no more comparisons; if all but at most BLOCK sets of a bucket are one component,
    those few, the minors, are compared with every block, and the bucket is done: each row went once
    to its block, not once to every other block."""
    own = inside.withColumn("m", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("id", "k"), F.col("m")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")
    row = ("k", "i", "id", "n", "sketch")
    pivots = own.where(F.pmod(F.xxhash64("k", "id", F.lit("pivot")), F.col("count")) < PIVOTS).select("k", every, "id", "n", "sketch", F.col("i").alias("home")).where("i <> home").drop("home")
    star = stored(by_key(own.select(*row).unionAll(pivots), sketch_links, "a long, b long", pairs, keys=2).distinct(), "links")
    labelled = stored(own.join(classes_of(star), "id", "left").withColumn("class", F.coalesce("class", "id")), "labelled")
    parts = labelled.groupBy("k", "class").agg(F.count("*").alias("size"), F.first("count").alias("count"))
    major = parts.groupBy("k").agg(F.max_by("class", F.struct("size", "class")).alias("major"), (F.first("count") - F.max("size")).alias("n_minor")).where(F.col("n_minor") <= BLOCK)
    judged = stored(labelled.join(small(stored(major, "major")), "k", "left"), "judged")
    dense = judged.where(F.col("major").isNotNull())
    minors = dense.where(F.col("class") != F.col("major")).select("k", every, "id", "n", "sketch")
    more = dense.where((F.col("class") == F.col("major")) & (F.col("n_minor") > 0)).select(*row).unionAll(minors)
    return star, meeting(more, origin, F.col("i")), judged.where(F.col("major").isNull()).select("k", "count", "id", "n", "sketch")


def candidate_links(signed: DataFrame) -> DataFrame:
    """(a, b): links that join all sets which some leaf holds together and whose sketches agree. What waits to be compared on all
    levels goes through one shuffle."""
    level = signed.select(F.explode(F.array_distinct("keys")).alias("k"), "id", "n", "sketch")
    found, waiting, pairs = [], [], (pa.int64(), pa.int64())
    for depth in range(LEVELS):
        big = stored(level.groupBy("k").count().where(F.col("count") > LEAF), "buckets")
        some = small(big)
        waiting.append(meeting(level.join(some, "k", "left_anti"), 3 * depth))
        inside = stored(level.join(some, "k").select("k", "count", "id", "n", "sketch"), "inside")
        if not inside.limit(1).count():
            break
        links, more, inside = dense_links(inside, pairs, 3 * depth + 1)
        found.append(links)
        waiting.append(more)
        if depth == LEVELS - 1:
            # large and of many parts to the last: all blocks against each other
            blocks = inside.withColumn("m", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
            other = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            waiting.append(meeting(other, 3 * depth + 2, F.least("i", "j"), F.greatest("i", "j")))
            break
        # one sampled shingle a set: the coordinate of the sketch is the same for all sets of a bucket
        at = F.pmod(F.xxhash64("k", F.lit(depth)), F.lit(SKETCH)).cast("int")
        level = inside.select(F.xxhash64("k", F.lit(depth), F.substring("sketch", at + 1, F.lit(1))).alias("k"), "id", "n", "sketch")
    compared = by_key(reduce(lambda a, b: a.unionAll(b), waiting), sketch_links, "a long, b long", pairs, keys=4)
    return stored(reduce(lambda a, b: a.unionAll(b), found, compared).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, class): smallest id connected with each id of the links (a, b), by alternating stars. Count and checksum of a round's
    edges are taken while they are written: a round is one query."""
    seen = lambda: (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    edges, now = observed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", *seen())
    before = {"n": -1} if now["n"] else now
    while now != before:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # rows that come twice change no minimum; they go with the last distinct
        down = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small_ = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        before = now
        edges, now = observed(small_, "edges", *seen())
    return with_roots(edges)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the links a, b, ascending, and the smallest id that each is connected with."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))  # a root goes to a smaller one
        while not np.array_equal(label, after := label[label]):
            label = after
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return ids, ids[label]


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """The links (u, v) as stars (u: id, v: smallest id) of what PORTION of them connect at a time, in so many tasks at most."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            ids, root = roots(*(np.concatenate([np.empty(0, np.int64), *(h.column(i).to_numpy() for h in held)]) for i in (0, 1)))
            out = np.flatnonzero(ids != root)
            return pa.record_batch([pa.array(ids[out]), pa.array(root[out])], ["u", "v"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                held.append(batch.slice(lo, PORTION - size))
                lo, size = lo + held[-1].num_rows, size + held[-1].num_rows
                if size == PORTION:
                    yield stars()
                    held, size = [], 0
        yield stars()

    return links.coalesce(tasks).mapInArrow(contract, "u long, v long")


def classes_of(links: DataFrame) -> DataFrame:
    """``components`` of stored links. Tasks first contract PORTION links at a time, wherever they lie; that is all for links that fit one
    portion, and only what several portions leave is joined in rounds."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    tasks = math.ceil(links.count() / PORTION)
    if tasks > 1:
        return components(contracted(links, tasks).select(F.col("u").alias("a"), F.col("v").alias("b")))
    return with_roots(stored(contracted(links, 1), "stars"))


def with_roots(stars: DataFrame) -> DataFrame:
    """(id, class) of the stars (u, v)."""
    return stars.select(F.col("u").alias("id"), F.col("v").alias("class")).unionAll(stars.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())


def verified(group: list[tuple]) -> list[tuple]:
    """Exact links among the rows (blocks, own, i, j, id, text) of a group: (id, links, class) and, for
    groups in blocks, (member, null, representative) rows to be joined with the other blocks."""
    hashes = WordHashes()
    blocks, i, j = group[0][0], group[0][2], group[0][3]
    sets = [shingle_set(g[5], hashes) for g in group]
    ids, own, n = [g[4] for g in group], np.array([g[1] for g in group]), np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    row, col = np.repeat(np.arange(len(ids)), n), column[inverse]
    row, col = row[col >= 0], col[col >= 0]
    common = np.zeros((len(ids), len(ids)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col, width = row[order], col[order], max(1, 4_000_000 // len(ids))
    for lo in range(0, len(shared), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((len(ids), width), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        common += x @ x.T
    links = common >= SIMILARITY * (n[:, None] + n[None, :] - common) - 1e-4
    np.fill_diagonal(links, False)
    if i != j:
        links &= own[:, None] != own[None, :]  # pairs inside a block are the block's own group's
    joined = forest(links, ids)
    numbers = [(id_, int(k), None) for id_, k in zip(ids, links.sum(axis=1).tolist(), strict=True) if k]
    return numbers + [(b, None, a) for a, b in joined]


def exact_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, links, class): links counted on whole texts inside the candidate classes (id, class)."""
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = stored(classes.join(sizes, "class"), "placed")
    texts = docs.join(small(placed), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = spread.select("class", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "blocks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "data")
    kinds = (pa.int64(), pa.int32(), pa.int64())
    return stored(by_key(rows, verified, "id long, links int, class long", kinds, keys=3), "verified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.99) -> DataFrame:
    """(id_col, class_id, n_links, n_copies) for every row of ``docs``: the smallest id of its class, how
    many different texts are similar to its text, and how many rows have its text."""
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_key"))
    ids = stored(own, "ids")
    copies = ids.where("id is not null").groupBy(F.col("text_key").alias("key")).agg(F.struct(F.min("id").alias("rep"), F.count("*").alias("n")).alias("value"), F.count("*").alias("rows"))
    total = ids.count()
    member = stored(join_spread(ids, F.when(F.col("id").isNotNull(), F.col("text_key")), copies, total, F.xxhash64("id")).select("id", "value.rep", "value.n"), "members")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("data"))
    runs = math.ceil(math.log(1 - recall) / math.log(1 - 0.63 * SIMILARITY ** (LEVELS - 1)))
    copied = member.where("id <> rep").select("id")
    signed = stored(signatures(texts, runs).join(small(copied), "id", "left_anti").dropDuplicates(["id"]), "signed")
    found = exact_links(texts.dropDuplicates(["id"]) if has_repeats(member) else texts, classes_of(candidate_links(signed)))
    classes = classes_of(found.where("class is not null").select(F.col("id").alias("a"), F.col("class").alias("b")))
    links = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    reps = links.join(classes, "id", "full").select("id", "links", "class")
    per_rep = member.groupBy("rep").agg(F.count("*").alias("rows")).join(reps, F.col("rep") == F.col("id")).select(F.col("rep").alias("key"), F.struct("links", "class").alias("value"), "rows")
    out = join_spread(member, F.col("rep"), per_rep, total, F.xxhash64("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("value.class", "rep").alias("class_id"), F.coalesce("value.links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n", F.lit(1)).alias("n_copies"))


def has_repeats(member: DataFrame) -> bool:
    return member.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() > 0


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
with recursive t as (select doc_id, coalesce(text, '') as text from documents),
c as (select text, min(doc_id) as rep, count(*) as n_copies from t group by text),
w as (select rep, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from c),
s as (select distinct rep, w[i:i + 4] as g from (select rep, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
z as (select rep, count(*) as n from s group by rep),
p as (select a.rep as a, b.rep as b, count(*) as shared from s a join s b on a.g = b.g and a.rep < b.rep group by 1, 2),
l as (select a, b from p join z x on x.rep = a join z y on y.rep = b where shared >= 0.8 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
reach as (select a as rep, b as other from e union select r.rep, e.b from reach r join e on e.a = r.other),
k as (select rep, min(least(rep, other)) as class_id from reach group by rep),
n as (select a as rep, count(*) as n_links from e group by a)
select t.doc_id, coalesce(k.class_id, c.rep) as class_id, coalesce(n.n_links, 0) as n_links, c.n_copies from t join c using (text) left join k using (rep) left join n using (rep)
"""
