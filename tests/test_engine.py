"""Statements and queries of the dialect, with the rows they must give."""

import pytest

from kairolog.plans.compiler import QueryError
from kairolog.plans.engine import ConstraintError, Engine, KeyExists
from kairolog.sources.versionlog import Database
from kairolog.streaming.replication import replicate


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}")


def rows(engine, sql, params=None):
    return [tuple(r) for r in engine.query(sql, params).collect()]


def test_aggregates_of_nothing_are_a_row_of_zeros(engine):
    engine.execute("CREATE TABLE t (id INTEGER AUTO_INCREMENT, title VARCHAR[128], age INTEGER, PRIMARY KEY id)")
    assert rows(engine, "SELECT COUNT(*), SUM(age), MIN(title), MAX(age), AVG(age) FROM t") == [(0, 0, "", 0, 0)]
    assert rows(engine, "SELECT age, COUNT(*) FROM t GROUP BY age") == []


def test_integer_average_truncates_and_nulls_are_skipped(engine):
    values = ", ".join(f"({i}, {'NULL' if i in (3, 5, 6) else 30 + i})" for i in range(1, 11))
    engine.execute(f"CREATE TABLE t (id INTEGER, age INTEGER, PRIMARY KEY id); INSERT INTO t (id, age) VALUES {values}")
    total = sum(30 + i for i in range(1, 11) if i not in (3, 5, 6))
    assert rows(engine, "SELECT COUNT(*), COUNT(age), SUM(age), MIN(age), MAX(age), AVG(age) FROM t") == [(10, 7, total, 31, 40, total // 7)]


def test_full_outer_join(engine):
    engine.execute("CREATE TABLE l (id INTEGER, val VARCHAR, PRIMARY KEY id); CREATE TABLE r (id INTEGER, data VARCHAR, PRIMARY KEY id)")
    engine.execute("INSERT INTO l (id, val) VALUES (1,'a'),(2,'b'),(3,'c'); INSERT INTO r (id, data) VALUES (2,'x'),(3,'y'),(4,'z')")
    found = rows(engine, "SELECT l.id, l.val, r.id, r.data FROM l FULL OUTER JOIN r ON l.id = r.id")
    assert sorted(found, key=str) == sorted([(1, "a", None, None), (2, "b", 2, "x"), (3, "c", 3, "y"), (None, None, 4, "z")], key=str)


def test_nulls_compare_as_the_least_value(engine):
    engine.execute("CREATE TABLE t (id INTEGER, val INTEGER, PRIMARY KEY id); INSERT INTO t (id, val) VALUES (1, 10), (2, 20), (3, NULL)")
    assert rows(engine, "SELECT id FROM t ORDER BY val ASC NULLS LAST") == [(1,), (2,), (3,)]
    assert rows(engine, "SELECT id FROM t ORDER BY val DESC NULLS FIRST") == [(3,), (2,), (1,)]
    assert rows(engine, "SELECT id FROM t WHERE val < 15 ORDER BY id") == [(1,), (3,)]
    assert rows(engine, "SELECT id FROM t WHERE val NOT IN (10, NULL)") == [(2,)]
    assert rows(engine, "SELECT a.id FROM t a JOIN t b ON a.val = b.val WHERE b.id = 3") == [(3,)]


def test_history_difference_and_past_states(engine):
    engine.execute("CREATE TABLE t (id INTEGER, title VARCHAR[50], active BOOLEAN, PRIMARY KEY id)")
    for sql in ("INSERT INTO t (id, title) VALUES (1,'alice'),(2,'bob'),(3,'carol')", "UPDATE t SET title = 'alice_updated' WHERE id = 1", "INSERT INTO t (id, title, active) VALUES (4,'dave',FALSE)", "DELETE FROM t WHERE id = 2"):
        engine.execute(sql)
    assert rows(engine, "SELECT _diff_action, id, title FROM (DIFF OF t) SINCE TX 3 UNTIL TX 5 ORDER BY id") == [("UPDATE", 1, "alice_updated"), ("DELETE", 2, "bob"), ("INSERT", 4, "dave")]
    assert rows(engine, "SELECT _rev, title FROM (HISTORY OF t) WHERE id = 1 ORDER BY _rev") == [(1, "alice"), (2, "alice_updated")]
    assert rows(engine, "SELECT id FROM t BEFORE TX 3 ORDER BY id") == [(1,), (2,), (3,)]
    assert rows(engine, "SELECT id FROM t SINCE TX 3 UNTIL TX 4 ORDER BY id") == [(1,), (4,)]
    with pytest.raises(QueryError):
        engine.query("SELECT * FROM (DIFF OF t) SINCE TX 3")


def test_constraints_and_conflicts(engine):
    engine.execute("CREATE TABLE t (id INTEGER, n VARCHAR[3] NOT NULL, b FLOAT, CHECK b > 0, PRIMARY KEY id); INSERT INTO t (id, n, b) VALUES (1, 'a', 1.0)")
    for bad, error in (("(1, 'x', 1.0)", KeyExists), ("(2, NULL, 1.0)", ConstraintError), ("(2, 'long', 1.0)", ConstraintError), ("(2, 'x', -1.0)", ConstraintError), ("(2, 'x', 1.0), (2, 'y', 1.0)", KeyExists)):
        with pytest.raises(error):
            engine.execute(f"INSERT INTO t (id, n, b) VALUES {bad}")
    engine.execute("INSERT INTO t (id, n, b) VALUES (1, 'z', 1.0) ON CONFLICT DO NOTHING")
    assert rows(engine, "SELECT n FROM t") == [("a",)]


def test_transactions_savepoints_and_replication(engine, spark, tmp_path):
    engine.execute("CREATE TABLE t (id INTEGER, PRIMARY KEY id); BEGIN; INSERT INTO t (id) VALUES (1); SAVEPOINT a; INSERT INTO t (id) VALUES (2); ROLLBACK TO SAVEPOINT a; COMMIT; BEGIN; DELETE FROM t WHERE id = 1; ROLLBACK")
    assert rows(engine, "SELECT id FROM t") == [(1,)]
    replica = Database(spark, f"file://{tmp_path}/replica")
    assert replicate(engine.db, replica) == 2
    assert replicate(engine.db, replica) == 0
    assert replica.verify() == []


def test_parameters_and_sets(engine):
    assert rows(engine, "SELECT @a + 1 AS x, $1 || 'b' AS y", {"a": 2, 1: "a"}) == [(3, "ab")]
    assert sorted(rows(engine, "SELECT * FROM (VALUES (1), (2), (2)) AS a EXCEPT SELECT * FROM (VALUES (1)) AS b")) == [(2,), (2,)]
    assert rows(engine, "SELECT -7 / 2 AS a, -7 % 2 AS b, 7 / 2.0 AS c") == [(-3, -1, 3.5)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(engine, "SELECT 1 / 0 AS x")
