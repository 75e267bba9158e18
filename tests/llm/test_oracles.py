"""The operators that SQL can express give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF

from millrace.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    asked = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in asked.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(asked.fetchall())
