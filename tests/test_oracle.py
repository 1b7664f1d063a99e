"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from kairolog.plans import registry

SF = "/root/testdata/sf0.001"
#: Run as one statement each; the ones that write are slower and covered by test_engine.py.
NAMES = [k for k in registry.oracle_sql() if k in registry.SQL or k in registry.CALLS and k not in ("doc_crud", "exec_all", "stream_replication", "stream_retention", "sink_copy", "proof_linear")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in rel.fetchall())
    assert got == want
