"""Every query with SQL gives DuckDB's rows and types on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gaplens.plans.oracle import ORACLE_SQL
from gaplens.plans.queries import QUERIES
from gaplens.plans.registry import SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WANTED = ORACLE_SQL | SQL
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(values):
    return sorted((tuple(f"{x:.6f}" if isinstance(x, float) else x for x in r) for r in values), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in WANTED])
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(WANTED[name])
    columns = sorted(got.columns)
    assert {c: KINDS[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(columns).collect()) == rows(duck.sql(f"SELECT {quoted} FROM ({WANTED[name]})").fetchall())


def test_only_models_have_no_sql():
    assert {n for n in QUERIES if n not in WANTED} == {"ml04_svd", "ml06_kmeans_select", "ml09_embed_cluster", "ml11_matching_space", "ml12_null_clusters"}


def test_entry(spark):
    out = entry.entry(spark).collect()
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1)) and out
