"""Every query against its SQL, on the small tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert got == rows(columns, want.fetchall())
    if name not in ("kv_scan_empty", "kv_get_deleted", "compaction_invariant"):
        assert got[1] or name.startswith("fifo")


def equals_sql(spark, path, name, users):
    """Compare a query with its SQL on a log of the given users, an event each."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT CAST(k AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, CAST(u AS BIGINT) AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, 'p' AS props FROM (SELECT unnest(range(len($u))) AS k, unnest($u) AS u)", {"u": users})
    con.execute(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    df = catalog.queries()[name](spark, str(path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = con.execute(catalog.oracle_sql()[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())
    return [dict(zip(got[0], r)) for r in got[1]]


def test_compaction_of_files_that_share_a_number(spark, tmp_path):
    # The oldest quarter makes files 3000 and 3004 of level 2, the middle ones files 3000 and 2000 of level 1.
    got = equals_sql(spark, tmp_path, "compaction_apply", [0, 100, 10_000, 10_001, 10_002, 5, 0, 20_000])
    assert {(r["level"], r["file_id"]): r["entries"] for r in got} == {(1, 9000): 6, (2, 3004): 1}


def test_bloom_probe_is_not_left_to_chance(spark, tmp_path):
    # Files 2000 + 16840 / 10 and 3000 + 17100 / 25 share number 3684: a filter of 35 keys, of which too many of 35 others passed.
    users = [*range(17_100, 17_125), *[1] * 5, *range(16_840, 16_850), *[16_841] * 50, *[7] * 30]
    got = equals_sql(spark, tmp_path, "bloom_probe", users)
    assert {r["file_id"]: r["n_keys"] for r in got}[3684] == 35 and {r["n_keys"] for r in got} == {1, 35}


def test_bloom_probe_of_many_keys(spark, tmp_path):
    # Files of level 0 with more keys than the least number of others, beside small ones of every level.
    got = equals_sql(spark, tmp_path, "bloom_probe", [k % 5_003 for k in range(40_000)])
    assert max(r["n_keys"] for r in got) > catalog.OTHERS > min(r["n_keys"] for r in got)
