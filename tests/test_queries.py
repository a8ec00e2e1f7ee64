"""Every query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from ketspark import oracles, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4) + 0.0
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b and type(a) is type(b)


def test_every_oracle_has_a_query():
    assert not oracles.ORACLE_SQL.keys() - registry.QUERIES.keys()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(set(got.columns)) == len(got.columns)
    if name in oracles.ORACLE_SQL:
        cur = db.execute(oracles.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(got.columns)
        expected = rows(names, cur.fetchall())
        assert len(found) == len(expected)
        assert all(same(x, y) for f, e in zip(found, expected) for x, y in zip(f, e)), next((f, e) for f, e in zip(found, expected) if not all(map(same, f, e)))
