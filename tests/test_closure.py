"""Lineage by doubling: any depth in few rounds, cycles, hubs, repeated and null edges."""

import random

import pytest

from ketspark.governance import audit
from ketspark.plans import storage


def shortest(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = {}
    for start in up:
        front, d = up[start], 1
        while front:
            new = {x for x in front if (start, x) not in out}
            out |= {(start, x): d for x in new}
            front, d = {y for x in new for y in up.get(x, ())}, d + 1
    return out


def closed(spark, edges, **options):
    rows = audit.closure(spark.createDataFrame(edges, "child long, parent long").repartition(3), "child", "parent", **options).collect()
    assert len({(r.dataset, r.ancestor) for r in rows}) == len(rows)
    return {(r.dataset, r.ancestor): r.depth for r in rows}


def test_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(53)] + [(100, 101), (101, 100)]
    assert closed(spark, edges) == {(i, j): j - i for i in range(53) for j in range(i + 1, 54)} | {(100, 101): 1, (101, 100): 1, (100, 100): 2, (101, 101): 2}
    with pytest.raises(ValueError):
        closed(spark, edges, max_depth=3)
    assert closed(spark, [(1, 2), (2, 3)], max_depth=2) == {(1, 2): 1, (2, 3): 1, (1, 3): 2}


@pytest.mark.parametrize("hub", [20_000, 3])
def test_graphs_against_a_search(spark, hub, monkeypatch):
    monkeypatch.setattr(audit, "HUB", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(i, 200) for i in range(40)] + [(200, 300 + i) for i in range(10)]
    edges += edges[:20] + [(None, 5), (6, None), (7, 7)]
    assert closed(spark, edges) == shortest(edges)


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: rounds.append(name) or write(df, name))
    n = 1500
    chain = spark.range(n).selectExpr("id as child", "id + 1 as parent")
    found = audit.closure(chain, "child", "parent").selectExpr("count(*) as pairs", "count_if(depth != ancestor - dataset) as wrong", "max(depth) as deepest").first()
    assert tuple(found) == (n * (n + 1) // 2, 0, n) and len(rounds) <= 13


def test_no_edges(spark):
    assert closed(spark, []) == {} and closed(spark, [(None, 1)]) == {}
