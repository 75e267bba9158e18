"""Every query with SQL gives DuckDB's rows at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from conftest import SF
from millrace import queries as Q
from millrace.operators import profile

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(rows):
    return sorted(tuple((type(x).__name__, repr(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    asked = duck.execute(Q.ORACLES[name])
    names = [x[0] for x in asked.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in asked.fetchall()]
    assert _plain(got) == _plain(expected)


@pytest.mark.parametrize("name", [n for n in sorted(Q.ORACLES) if n.startswith(("numeric", "long_profile"))])
def test_percentiles_by_radix_equal_sql(spark, duck, name, monkeypatch):
    monkeypatch.setattr(profile, "SMALL", -1)
    test_query_equals_sql(spark, duck, name)


def test_every_query_without_sql_gives_rows(spark):
    for name in set(Q.QUERIES) - set(Q.ORACLES):
        assert Q.QUERIES[name](spark, SF).count() > 0, name
