"""What must survive errors, retention and a new session; and what filters push to the scan."""

import glob
import os

import pytest

from kairolog.plans import registry
from kairolog.plans.compiler import QueryError
from kairolog.plans.engine import ConstraintError, Engine

SF = "/root/testdata/sf0.001"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}"


def rows(engine, sql):
    return sorted(tuple(r) for r in engine.query(sql).collect())


def test_a_rejected_row_is_never_committed(spark, root):
    e = Engine(spark, root)
    e.execute("CREATE TABLE p (q INTEGER, r INTEGER, PRIMARY KEY q); CREATE UNIQUE INDEX ON p (r); INSERT INTO p (q, r) VALUES (7, 70)")
    for bad in ("INSERT INTO p (q, r) VALUES (8, 70)", "UPSERT INTO p (q, r) VALUES (9, 90), (10, 90)"):
        with pytest.raises(ConstraintError):
            e.execute(bad)
    e.execute("INSERT INTO p (q, r) VALUES (11, 110)")
    for engine in (e, Engine(spark, root)):
        assert rows(engine, "SELECT q, r FROM p") == [(7, 70), (11, 110)]


def test_retention_survives_a_new_session(spark, root):
    e = Engine(spark, root)
    e.execute("CREATE TABLE p (q INTEGER, r INTEGER, PRIMARY KEY q); INSERT INTO p (q, r) VALUES (1, 10), (2, 20); UPDATE p SET r = 11 WHERE q = 1; DELETE FROM p WHERE q = 2; INSERT INTO p (q, r) VALUES (3, 30)")
    before = rows(e, "SELECT q, r FROM p BEFORE TX 4")
    assert e.db.truncate_before(4) == 2
    assert e.db.truncate_before(4) == 0
    for engine in (e, Engine(spark, root)):
        assert rows(engine, "SELECT q, r FROM p") == [(1, 11), (3, 30)]
        assert rows(engine, "SELECT q, r FROM p BEFORE TX 4") == before == [(1, 11), (2, 20)]
        assert engine.db.verify() == []
    Engine(spark, root).execute("INSERT INTO p (q, r) VALUES (4, 40)")
    assert rows(Engine(spark, root), "SELECT q FROM p") == [(1,), (3,), (4,)]


def test_views_live_and_stay(spark, root):
    e = Engine(spark, root)
    e.execute("CREATE TABLE p (q INTEGER, r VARCHAR, PRIMARY KEY q); INSERT INTO p (q, r) VALUES (1, 'it''s'); CREATE VIEW w AS SELECT q, r FROM p WHERE r <> 'x y'; INSERT INTO p (q, r) VALUES (2, 'b'), (3, 'x y')")
    for engine in (e, Engine(spark, root)):
        assert rows(engine, "SELECT q, r FROM w") == [(1, "it's"), (2, "b")]
    with pytest.raises(QueryError):
        e.execute("CREATE VIEW w AS SELECT q FROM p")
    e.execute("DROP VIEW w; CREATE VIEW IF NOT EXISTS w AS SELECT q FROM p")
    assert rows(Engine(spark, root), "SELECT * FROM w") == [(1,), (2,), (3,)]


def test_users_and_grants_stay(spark, root):
    e = Engine(spark, root)
    e.execute("CREATE USER uma WITH PASSWORD 'Geheim1!' READ; GRANT SELECT, UPDATE ON DATABASE defaultdb TO USER uma; REVOKE UPDATE ON DATABASE defaultdb FROM USER uma")
    other = Engine(spark, root)
    assert rows(other, "SELECT * FROM users()") == [("uma", "READ")] and rows(other, "SELECT privilege FROM grants('uma')") == [("SELECT",)]
    assert other.authenticated("uma", "Geheim1!") and not other.authenticated("uma", "geheim1!") and not other.authenticated("ida", "")
    with pytest.raises(QueryError):
        e.execute("ALTER USER ida WITH PASSWORD 'x' READ")


def test_each_row_draws_its_own_value(spark, root):
    e = Engine(spark, root)
    e.execute("CREATE TABLE p (q INTEGER, r INTEGER, PRIMARY KEY q); CREATE SEQUENCE s START WITH 100 INCREMENT BY 5; INSERT INTO p (q, r) VALUES (1, NEXTVAL('s')), (2, NEXTVAL('s')); INSERT INTO p (q, r) SELECT q + 10, NEXTVAL('s') FROM p")
    assert [r for _, r in rows(e, "SELECT q, r FROM p")][:2] == [100, 105]
    assert sorted(r for _, r in rows(e, "SELECT q, r FROM p")) == [100, 105, 110, 115]
    assert rows(Engine(spark, root), "SELECT NEXTVAL('s') AS v") == [(120,)]


@pytest.mark.parametrize("checksums", [True, False])
def test_a_changed_data_file_is_found(spark, root, tmp_path, checksums):
    e = Engine(spark, root)
    e.execute("CREATE TABLE p (q INTEGER, r INTEGER, PRIMARY KEY q); INSERT INTO p (q, r) VALUES (1, 10); INSERT INTO p (q, r) VALUES (2, 20)")
    assert e.db.verify() == []
    name = glob.glob(f"{tmp_path}/defaultdb/{e.db.manifests[1]['batches'][0]['path']}/*.parquet")[0]
    raw = bytearray(open(name, "rb").read())
    raw[len(raw) // 2] ^= 1
    open(name, "wb").write(raw)
    if not checksums:  # the file system's own, beside the file
        folder, _, own = name.rpartition("/")
        os.remove(f"{folder}/.{own}.crc")
    assert Engine(spark, root).db.verify() == [2]


def test_endless_recursion_is_an_error(spark, root, monkeypatch):
    from kairolog.plans import compiler

    monkeypatch.setattr(compiler, "ROUNDS", 3)
    with pytest.raises(QueryError):
        Engine(spark, root).query("WITH RECURSIVE n (i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n) SELECT i FROM n")


@pytest.mark.parametrize("name", ["scan_range", "filter", "between", "count_fast"])
def test_ranges_reach_the_scan(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and any(x in pushed[0] for x in ("GreaterThan", "LessThan")), plan
