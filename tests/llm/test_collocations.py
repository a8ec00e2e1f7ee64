"""Collocations by subtrees against plain counting, with small groups, hot pairs and awkward texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, percent=50):
    count, sizes = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang or "und"] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    count[lang or "und", tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in count.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in cand.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                inside[lang, q] = max(inside[lang, q], a)
    found = []
    for (lang, p), a in cand.items():
        if len(p) == 2 and 100 * inside[lang, p] >= percent * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["É", "é", "Straße", "a\x1cb", "\xa0", "日本", "W1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randint(0, 80))) for _ in range(120)]
    rows += [("en", "of the of the of the cat sat") for _ in range(40)] + [("en", "same " * 500), ("en", None), (None, ""), (None, None), ("fr", "one two three"), ("de", "  \n\t ")]
    return rows + [("xx", "rare pair here")] * 10 + [("de", text(3000))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "lang string, text string").select("*", *(F.lit(1).alias(c) for c in ("n", "a", "w1", "h", "rank"))).repartition(5)


@pytest.mark.parametrize("changed", [{}, {"PAIR_SHARE": 40}, {"PAIR_SHARE": 10**9}, {"GROUPS": 3}, {"FILTER_BITS": 64}, {"HELD_WORDS": 20, "RANKED": 7}])
def test_phrases_by_brute_force(docs, changed, monkeypatch):
    for name, value in changed.items():
        monkeypatch.setattr(co, name, value)
    if "FILTER_BITS" in changed:  # all bits are set: every rare word passes
        monkeypatch.setattr(co, "frequent_filter", lambda words: np.full(8, 255, np.uint8))
    expected = brute(corpus(), 5, 40)
    assert len({r[0] for r in expected}) == 4 and any("of the" in r[2] for r in expected)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = co.mine(docs, min_count=5, top=40, budget=50 if "PAIR_SHARE" in changed else co.BUDGET).select(*names).collect()
    assert sorted(map(tuple, got)) == expected


def test_small_portions_merge(docs, monkeypatch):
    from ketspark.llm import common

    monkeypatch.setattr(common, "PORTION_ROWS", 2)
    monkeypatch.setattr(co, "GROUPS", 1)
    got = co.mine(docs, min_count=3, top=1000, budget=30).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(corpus(), 3, 1000)


def test_subtrees_survive_packing():
    rng = np.random.default_rng(1)
    w = [rng.integers(1, 9, 500).astype(np.uint64), rng.integers(1, 5, 500).astype(np.uint64), rng.integers(0, 3, 500).astype(np.uint64)]
    leaf = co.leaves(*w, np.ones(500, np.int64))
    assert leaf[3].sum() == 500 and all((x == y).all() for x, y in zip(leaf, co.unpacked(co.packed(*leaf)), strict=True))


def test_words_of_one_hash_are_told_apart(docs, monkeypatch):
    """Under the first seed all words of a language that start with w have one hash."""
    whole = co.Hashes.__missing__

    class Weak(co.Hashes):
        def __init__(self, lang, seed):
            super().__init__(lang, seed)
            self.seed = seed

        def __missing__(self, word):
            if self.seed == 0 and word.startswith(b"w"):
                return 7
            return whole(self, word)

    monkeypatch.setattr(co, "Hashes", Weak)
    counted = []
    monkeypatch.setattr(co, "count_words", lambda rows, seed, f=co.count_words: counted.append(seed) or f(rows, seed))
    got = co.mine(docs, min_count=5, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute(corpus(), 5, 40) and counted[:2] == [0, 1]


def test_quotients_are_exact(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randrange(10**k), a + rng.randrange(10**k)) for k in range(1, 15) for a in [rng.randrange(10, 10**14)]] + [(10**15, 10**15, 10**15)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("*", co.quotient(F.col("a"), F.col("l"), F.col("r")).alias("q")).collect()
    assert all(x.q == 1_000_000 * x.a * x.a // (x.l * x.r) for x in found)


def test_tables_without_phrases(spark):
    assert co.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert co.mine(spark.createDataFrame([("en", None), (None, "one two"), ("en", "")], "lang string, text string")).count() == 0
