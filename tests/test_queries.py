"""Every query with a DuckDB text gives the same rows, names and values as that text."""

import math
import os

import duckdb
import pytest

from cladespark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    if value is None or isinstance(value, str | bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    (a, x), (b, y) = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert a == b and len(x) == len(y)
    for p, q in zip(x, y, strict=True):
        assert p == q or all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=2e-6)) for u, v in zip(p, q, strict=True)), name
