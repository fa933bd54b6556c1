"""Every query with SQL gives DuckDB's rows and types on the same tables, whole."""

import duckdb
import pytest

from gaplens.llm.oracles import ORACLES
from gaplens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    rows = sorted(map(tuple, got.select(want.columns).collect()), key=str)
    expected = sorted(want.fetchall(), key=str)
    assert len(rows) == len(expected)
    assert [a for a, b in zip(rows, expected, strict=True) if a != b] == [b for a, b in zip(rows, expected, strict=True) if a != b]
