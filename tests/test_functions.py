import pytest

from kairolog.plans.engine import Engine

CASES = {
    "REVERSE('hello')": "olleh", "TRANSLATE('hello','el','ip')": "hippo", "SPLIT_PART('a-b-c','-',2)": "b", "REGEXP_REPLACE('foo123bar','[0-9]+','NUM')": "fooNUMbar", "SUBSTR('hello',2,3)": "ell",
    "ASCII('Z')": 90, "CHR(65)": "A", "INITCAP('hello world')": "Hello World", "LENGTH('é')": 2, "LPAD('ab',5,'xyz')": "xyzab", "LPAD('ab',4,'xyz')": "xyza", "CONCAT('a',NULL,'b')": "ab",
    "CONCAT_WS('-','a',NULL,'b')": "a-b", "REPLACE('abc','','-')": "-a-b-c-", "ROUND(-2.5)": -3.0, "TO_NUMBER('1,234.5')": 1234.5, "TO_NUMBER('x')": None, "NULLIF(1,1)": None, "GREATEST(1,NULL,3)": 3,
    "CAST(1.0 AS VARCHAR)": "1", "CAST(-3.9 AS INTEGER)": -3, "CAST('on' AS BOOLEAN)": True, "NULL LIKE 'a'": False, "NULL NOT LIKE 'a'": True, "NULL = NULL": True, "NULL < 1": True, "NULL IN (NULL, 1)": True,
    "CASE 3 WHEN 1 THEN 'a' WHEN 3 THEN 'c' END": "c", "JSON_TYPEOF('[1]'::JSON)": "ARRAY", "'{\"a\":{\"b\":[5,6]}}'::JSON->'a'->'b'->'1'": "6", "POSITION('lo','hello')": 4, "LEFT('hello',2)": "he", "RIGHT('hello',2)": "lo",
    "EXTRACT(YEAR FROM '2024-05-06')": 2024, "TO_CHAR('2024-05-06 07:08:09'::TIMESTAMP,'DD/MM/YYYY HH24:MI:SS')": "06/05/2024 07:08:09", "x'4142'": bytearray(b"AB"),
}


def test_values(spark):
    names = list(CASES)
    found = Engine(spark).query("SELECT " + ", ".join(f"{x} AS v{i}" for i, x in enumerate(names))).first()
    assert {n: found[f"v{i}"] for i, n in enumerate(names)} == CASES


@pytest.mark.parametrize("sql", ["SELECT NONE(1)", "SELECT CAST('x' AS UUID) AS u", "SELECT 'a' < TRUE AS x", "SELECT a FROM (VALUES (1)) AS t"])
def test_errors(spark, sql):
    with pytest.raises(Exception):  # noqa: B017
        Engine(spark).query(sql).collect()
