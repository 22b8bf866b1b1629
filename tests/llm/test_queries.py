"""Every query that SQL can express against its SQL, on small tables."""

import os

import duckdb
import pytest

from tidemark.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    result = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=repr)
    assert got == want and len(got) > 10
