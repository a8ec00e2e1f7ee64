"""Digests of tables: equal to a tree built by hand, sensitive to cells and order, and naming where two tables part."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from ketspark.operators import merkle

SCHEMA = "k long, x double, s string"


def rows(n):
    return [(i, i / 4 if i % 5 else None, None if i % 7 == 0 else f"s{i}") for i in range(n)]


def by_hand(data, fan):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    level = [sha(text(k) + text(None if x is None else round(x * 10**6)) + text(s)) for k, x, s in data]
    levels = []
    while not levels or len(level) > 1:
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        levels.append(level)
    return levels


@pytest.mark.parametrize("n,fan", [(1, 4), (4, 4), (5, 4), (70, 4), (300, 3), (300, 1024)])
def test_tree(spark, n, fan):
    df = spark.createDataFrame(rows(n), SCHEMA).orderBy(F.rand(3)).repartition(5)
    tree = merkle.merkle_tree(df, ["k"], ["k", "x", "s"], fan=fan)
    expected = by_hand(rows(n), fan)
    assert {(r.level, r.idx): r.digest for r in tree.collect()} == {(k, i): d for k, level in enumerate(expected) for i, d in enumerate(level)}
    assert tuple(merkle.root(tree).first()) == (n, expected[-1][0])
    for r in tree.collect():
        assert r.first_row == r.idx * fan ** (r.level + 1) and r.n_rows == min(n - r.first_row, fan ** (r.level + 1))


def tree_of(spark, data, fan=4):
    return merkle.merkle_tree(spark.createDataFrame(data, SCHEMA), ["k"], ["x", "s"], fan=fan)


def test_first_difference(spark):
    data = rows(100)
    a = tree_of(spark, data)
    assert merkle.first_difference(a, tree_of(spark, list(reversed(data))), 4) is None
    swapped = [(k, *data[{41: 42, 42: 41}.get(k, k)][1:]) for k, *_ in data]  # two rows in each other's place
    assert merkle.first_difference(a, tree_of(spark, swapped), 4) == {"first_row": 40, "n_rows": 4}
    assert merkle.root(a).first() != merkle.root(tree_of(spark, swapped)).first()
    changed = [(k, x, "" if k in (77, 90) else s) for k, x, s in data]
    assert merkle.first_difference(a, tree_of(spark, changed), 4) == {"first_row": 76, "n_rows": 4}
    for shorter in (99, 64, 63, 16, 1):
        found = merkle.first_difference(a, tree_of(spark, data[:shorter]), 4)
        assert found["first_row"] == shorter // 4 * 4
    assert merkle.first_difference(tree_of(spark, data[:16]), a, 4)["first_row"] == 16


def test_cells_are_told_apart(spark):
    def digest(*row):
        return merkle.root(merkle.merkle_tree(spark.createDataFrame([(1, *row)], "k int, a string, b string"), ["k"], ["a", "b"])).first().root

    assert len({digest("x", "yz"), digest("xy", "z"), digest(None, "xyz"), digest("", "xyz"), digest("-", "xyz"), digest("xyz", None), digest("1:x", "yz")}) == 7


def test_any_types_ties_and_no_rows(spark):
    one = (1, [1, None], {"a": 1.5}, bytearray(b"\x00\xff"), datetime.date(2024, 1, 1), float("nan"), 1e300, True)
    df = spark.createDataFrame([one, one, tuple([None] * 8)], "`a b` int, l array<int>, m map<string,double>, z binary, d date, n double, h double, digest boolean")
    a, b = (merkle.merkle_tree(x, ["a b"], df.columns) for x in (df, df.repartition(3)))
    assert merkle.first_difference(a, b) is None and merkle.root(a).first().n_rows == 3
    none = merkle.merkle_tree(df.limit(0), ["a b"], df.columns)
    assert tuple(merkle.root(none).first()) == (0, hashlib.sha256(b"").hexdigest())
    assert merkle.first_difference(none, a) == {"first_row": 0, "n_rows": 3}
    with pytest.raises(ValueError):
        merkle.merkle_tree(df, ["a b"], ["n"], fan=1)
