"""Alignments of two tokenizers against the libraries and a plain walk over shared ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ketspark.llm import align, queries

AWKWARD = ["", " ", "\n", "\n\n", "  x  ", "a" * 2000, " " * 1500, "x\r\n y;\r\nz )\r", "<|endoftext|> <s> <0x41>", "a▁b", "a ▁ b", "x \x1c\x85　y", "\U0001f600é日本\x00"]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.default_pair())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(align.default_pair()[0])
    found.encode_special_tokens = True
    return found


def brute(pair, library, text):
    """n_a, n_b, groups, and how often each pair is linked."""
    a, b = library.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spelt = [[pair.a.tokens[i] for i in a], [pair.b_bytes[i] for i in b]]
    if not text or any(b"".join(x) != b" " + text.encode() for x in spelt):
        return 0, 0, [], Counter()
    a_ends, b_ends = (np.cumsum([len(t) for t in x]).tolist() for x in spelt)
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(a_ends) & set(b_ends)):
        i0, j0 = i, j
        i, j = a_ends.index(end) + 1, b_ends.index(end) + 1
        groups.append((a[i0:i], b[j0:j]))
        links.update((x, y) for x in a[i0:i] for y in b[j0:j])
    return len(a), len(b), groups, links


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def random_texts(n):
    rng = random.Random(9)
    letters = "ab  \n\t'stremvdl.,!? é日本  \x1c\x85\r0129\U0001f600-_<|endoftext|>aaaa▁<s>\x00　;)\r"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("memo", [100_000, 50])
def test_groups_and_links(pair, library, memo, monkeypatch):
    monkeypatch.setattr(align.Pair, "MEMO", memo)
    texts = AWKWARD + random_texts(1500)
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        for text, row in zip(part, align.aligned_rows(pair, [t.encode() for t in part], True), strict=True):
            n_a, n_b, groups, links = brute(pair, library, text)
            assert row[:5] == [n_a, n_b, len(groups), links.total(), written(groups)], text
            assert dict(zip(row[5].tolist(), row[6].tolist(), strict=True)) == {x << align.B_BITS | y: n for (x, y), n in links.items()}


def test_windows_of_equal_hash_are_told_apart(pair, monkeypatch):
    texts = [t.encode() for t in random_texts(200)]
    expected = align.aligned_rows(pair, texts, True)
    monkeypatch.setattr(align, "mix", lambda x: x * np.uint64(0))
    assert repr(align.aligned_rows(pair, texts, True)) == repr(expected)


def expected_rows(pair, library, rows):
    found = [(i, *brute(pair, library, t or "")) for i, t in rows]
    held = Counter(p for *_, links in found for p in links)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for i, n_a, n_b, groups, links in found:
        n_best = sum(n for p, n in links.items() if held[p] == highest[p[0]])
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if n_a else ""
        out.append((i, n_a, n_b, len(groups), links.total(), n_best, sum(n * held[p] for p, n in links.items()), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [400_000, 30, 0])
def test_counts_over_the_corpus(spark, pair, library, sent, monkeypatch):
    monkeypatch.setattr(align, "MOST_SENT", sent)
    rows = list(enumerate([*AWKWARD, *random_texts(60), "the same words", "the same words", None])) + [(None, "null id"), (0, "equal id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(7).alias(c) for c in ("row", "pair", "n", "groups", "times"))).repartition(3)
    got = align.align(docs, *align.default_pair()).collect()
    assert sorted(map(tuple, got), key=repr) == expected_rows(pair, library, rows)
    assert align.align(docs.limit(0), *align.default_pair()).count() == 0


def test_whole_groups(spark, pair, library):
    docs = spark.createDataFrame([(1, "some words, here")], "doc_id long, text string")
    assert align.align(docs, *align.default_pair(), whole_groups=True).first().groups == written(brute(pair, library, "some words, here")[2])


def test_query(spark, pair, library):
    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, queries.QUERIES["op13_token_alignment"](spark, data).select(*names).collect()), key=repr) == expected_rows(pair, library, rows)
