"""The queries of the library, by the names of the survey's operators, each with SQL for DuckDB to hold it against.

SQL entries run in the dialect through the engine over the Parquet tables of a folder; the others call operators. Change
statements run in a database of their own in the shared folder, over whole tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.operators import documents, kv, proofs, temporal
from kairolog.operators.documents import Comparison
from kairolog.plans.engine import Engine
from kairolog.sources.scratch import scratch
from kairolog.streaming import replication

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Lazy(dict):
    """Tables by name, read when a query names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __contains__(self, name) -> bool:
        return super().__contains__(name) or name in TABLES

    def __missing__(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)


def engine(spark: SparkSession, sf_dir: str, writes: bool = False) -> Engine:
    out = Engine(spark, scratch(spark, "db") if writes else None)
    out.resolved = _Lazy(spark, sf_dir)
    return out


# key -> (query in the dialect, the same for DuckDB)
SQL: dict[str, tuple[str, str]] = {
    # scans and sources
    "scan_table": ("SELECT * FROM customer", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"),
    "scan_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100"),
    "use_index": ("SELECT s_suppkey, s_name FROM supplier USE INDEX ON s_nationkey WHERE s_nationkey = 3", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3"),
    "values": ("SELECT v.col0 AS a, v.col1 AS b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, NULL), (3, 'z')) AS v(a, b)"),
    "select_no_from": ("SELECT 1 + 2 AS a, 'x' AS b, TRUE AS c", "SELECT 3::BIGINT AS a, 'x' AS b, TRUE AS c"),
    "subquery_from": ("SELECT q.k, q.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS q WHERE q.n > 5", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5"),
    "table_resolver": ("SELECT COUNT(*) AS n FROM benchmark", "SELECT count(*) AS n FROM benchmark"),
    # projection, filters, scalar operators
    "project": ("SELECT p_partkey AS k, p_retailprice * 2 AS twice, p_name FROM part", "SELECT p_partkey AS k, p_retailprice * 2 AS twice, p_name FROM part"),
    "project_star": ("SELECT * FROM nation INNER JOIN region ON n_regionkey = r_regionkey", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey, r_regionkey::BIGINT AS r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "filter": ("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05"),
    "cmp": ("SELECT x.a, x.b, x.a = x.b AS eq, x.a <> x.b AS ne, x.a < x.b AS lt, x.a <= x.b AS le, x.a > x.b AS gt, x.a >= x.b AS ge FROM (SELECT c.col0 AS a, d.col0 AS b FROM (VALUES (1), (2), (NULL)) AS c CROSS JOIN (VALUES (1), (2), (NULL)) AS d) AS x",
            "SELECT a, b, a IS NOT DISTINCT FROM b AS eq, a IS DISTINCT FROM b AS ne, coalesce(a, 0) < coalesce(b, 0) AS lt, coalesce(a, 0) <= coalesce(b, 0) AS le, coalesce(a, 0) > coalesce(b, 0) AS gt, coalesce(a, 0) >= coalesce(b, 0) AS ge FROM (VALUES (1::BIGINT), (2), (NULL)) c(a), (VALUES (1::BIGINT), (2), (NULL)) d(b)"),
    "between": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "is_null": ("SELECT COUNT(*) AS n FROM documents WHERE lang IS NOT NULL AND NOT text IS NULL", "SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL"),
    "like": ("SELECT p_partkey FROM part WHERE p_name LIKE '%1%'", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%'"),
    "not_like": ("SELECT p_partkey FROM part WHERE p_type NOT LIKE '%S%'", "SELECT p_partkey FROM part WHERE coalesce(p_type NOT LIKE '%S%', TRUE)"),
    "ilike": ("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'"),
    "not_ilike": ("SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE 'build%'", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT ILIKE 'build%'"),
    "not_matches": ("SELECT c_custkey FROM customer WHERE c_name !~ '%7'", "SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%7'"),
    "in_list": ("SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, NULL)", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3)"),
    "not_in_list": ("SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 3, NULL)", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (1, 3)"),
    "and": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 10", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 10"),
    "or": ("SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 1", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 1"),
    "not": ("SELECT s_suppkey FROM supplier WHERE NOT (s_nationkey = 1)", "SELECT s_suppkey FROM supplier WHERE NOT (s_nationkey = 1)"),
    "arith": ("SELECT l_orderkey, l_linenumber, l_orderkey / 7 AS d, l_orderkey % 7 AS m, 0 - l_linenumber AS neg, l_quantity * l_linenumber AS x FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_orderkey // 7 AS d, l_orderkey % 7 AS m, -l_linenumber::BIGINT AS neg, l_quantity * l_linenumber AS x FROM lineitem"),
    "case_when": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, CASE WHEN o_totalprice > 100000 THEN 1 END AS big FROM orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, CASE WHEN o_totalprice > 100000 THEN 1::BIGINT END AS big FROM orders"),
    "cast": ("SELECT p_partkey::VARCHAR AS t, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS FLOAT) AS f, '2024-02-29 10:11:12'::TIMESTAMP AS ts, CAST(86400 AS TIMESTAMP) AS e, CAST('yes' AS BOOLEAN) AS b FROM part",
             "SELECT p_partkey::VARCHAR AS t, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS f, TIMESTAMP '2024-02-29 10:11:12' AS ts, TIMESTAMP '1970-01-02' AS e, TRUE AS b FROM part"),
    "json_path": ("SELECT event_id, CAST(props->'k' AS INTEGER) AS k, props->'none' IS NULL AS none FROM events", "SELECT event_id, (props->>'k')::BIGINT AS k, (props->>'none') IS NULL AS none FROM events"),
    "json_cmp_arith": ("SELECT event_id, (props->'k') * 2 AS twice FROM events WHERE props->'k' > 50", "SELECT event_id, (props->>'k')::DOUBLE * 2 AS twice FROM events WHERE (props->>'k')::BIGINT > 50"),
    "extract": ("SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS mi, EXTRACT(SECOND FROM ts) AS s FROM events",
                "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events"),
    "scalar_subquery": ("SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders) AS most, (SELECT o_orderkey FROM orders WHERE FALSE) AS none FROM customer", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS most, NULL::BIGINT AS none FROM customer"),
    "exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)"),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)"),
    # joins
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0"),
    "join_hash": ("SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey"),
    "join_full": ("SELECT r.r_name, n.n_name FROM region r FULL OUTER JOIN nation n ON r.r_regionkey = n.n_regionkey AND n.n_nationkey < 4", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 4"),
    "join_cross": ("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "join_using": ("SELECT a.n_name AS a, b.n_name AS b, n_regionkey FROM nation a JOIN nation b USING (n_regionkey)", "SELECT a.n_name AS a, b.n_name AS b, n_regionkey::BIGINT AS n_regionkey FROM nation a JOIN nation b USING (n_regionkey)"),
    "join_natural": ("SELECT n_name, k FROM nation NATURAL JOIN (SELECT n_nationkey, n_name AS k FROM nation) AS x", "SELECT n_name, n_name AS k FROM nation"),
    "join_lateral": ("SELECT c.c_custkey, x.n FROM customer c, LATERAL (SELECT COUNT(*) AS n FROM orders o WHERE o.o_custkey = c.c_custkey) AS x", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "join_subquery": ("SELECT n.n_name, q.n FROM nation n JOIN (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) q ON q.k = n.n_nationkey", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"),
    "multi_join": ("SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "semi": ("SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n_name FROM nation SEMI JOIN supplier ON s_nationkey = n_nationkey"),
    "anti": ("SELECT n_name FROM nation n WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)", "SELECT n_name FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey"),
    # aggregation
    "agg_count_star": ("SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    "agg_count_col": ("SELECT COUNT(lang) AS n FROM documents", "SELECT count(lang) AS n FROM documents"),
    "agg_count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "agg_sum": ("SELECT l_returnflag, SUM(l_linenumber) AS s, ROUND(SUM(l_quantity)) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s, round(sum(l_quantity)) AS q FROM lineitem GROUP BY 1"),
    "agg_min": ("SELECT MIN(o_orderdate) AS d, MIN(o_totalprice) AS p, MIN(o_orderpriority) AS t FROM orders", "SELECT min(o_orderdate) AS d, min(o_totalprice) AS p, min(o_orderpriority) AS t FROM orders"),
    "agg_max": ("SELECT MAX(o_orderdate) AS d, MAX(o_totalprice) AS p FROM orders", "SELECT max(o_orderdate) AS d, max(o_totalprice) AS p FROM orders"),
    "agg_avg": ("SELECT l_returnflag, AVG(l_linenumber) AS a, ROUND(AVG(l_quantity) * 1000) AS q FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, (sum(l_linenumber) // count(l_linenumber))::BIGINT AS a, round(avg(l_quantity) * 1000) AS q FROM lineitem GROUP BY 1"),
    "agg_string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, ', ') AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS s FROM nation GROUP BY 1"),
    "agg_distinct_other": ("SELECT SUM(DISTINCT l_linenumber) AS s FROM lineitem", "SELECT sum(DISTINCT l_linenumber)::BIGINT AS s FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderpriority) AS m, MIN(o_totalprice) AS f FROM orders WHERE FALSE", "SELECT 0::BIGINT AS n, 0::BIGINT AS s, '' AS m, 0.0::DOUBLE AS f"),
    "group_stream": ("SELECT o_orderkey, COUNT(*) AS n FROM orders GROUP BY o_orderkey ORDER BY o_orderkey", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1"),
    "group_hash": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity)) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount))) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity)) AS q, round(sum(l_extendedprice * (1 - l_discount))) AS revenue FROM lineitem GROUP BY 1, 2"),
    "group_alias": ("SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, COUNT(*) AS n FROM orders GROUP BY size", "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, count(*) AS n FROM orders GROUP BY 1"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10"),
    "count_fast": ("SELECT COUNT(1) AS n FROM orders WHERE o_orderkey > 100", "SELECT count(*) AS n FROM orders WHERE o_orderkey > 100"),
    # windows
    "win_row_number": ("SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events"),
    "win_rank": ("SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders"),
    "win_dense_rank": ("SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS r FROM orders", "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS r FROM orders"),
    "win_count": ("SELECT event_id, COUNT(value) OVER (PARTITION BY event_type) AS n FROM events", "SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n FROM events"),
    "win_sum": ("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS s FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey)) AS s FROM orders"),
    "win_avg": ("SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey)) AS a FROM orders", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey)) AS a FROM orders"),
    "win_min": ("SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders"),
    "win_max": ("SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders"),
    "win_lag": ("SELECT event_id, LAG(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events", "SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events"),
    "win_lead": ("SELECT event_id, LEAD(value) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events", "SELECT event_id, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events"),
    "win_first_value": ("SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events", "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events"),
    "win_last_value": ("SELECT event_id, LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events", "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM events"),
    "win_ntile": ("SELECT event_id, NTILE(4) OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events", "SELECT event_id, ntile(4) OVER (PARTITION BY event_type ORDER BY event_id) AS t FROM events"),
    # sort, limit, distinct
    "order_by": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey"),
    "order_by_alias": ("SELECT p_partkey, p_retailprice * 2 AS twice FROM part ORDER BY twice DESC, p_partkey", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part ORDER BY 2 DESC, 1"),
    "order_by_ordinal": ("SELECT c_name, c_custkey FROM customer ORDER BY 2 DESC", "SELECT c_name, c_custkey FROM customer ORDER BY 2 DESC"),
    "order_by_index": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM orders ORDER BY 1 DESC"),
    "external_sort": ("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_partkey", "SELECT l_orderkey, l_extendedprice FROM lineitem"),
    "top_n": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit": ("SELECT r_name FROM region LIMIT 0", "SELECT r_name FROM region"),
    "offset": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 25", "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 15 OFFSET 25"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    # set operations, CTEs
    "union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", "SELECT n_nationkey::BIGINT AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "union": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region", "SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "except": ("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0", "SELECT o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT DISTINCT FROM o.o_custkey)"),
    "intersect": ("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", "SELECT o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND c_custkey IS NOT DISTINCT FROM o.o_custkey)"),
    "precedence": ("SELECT r_regionkey AS k FROM region EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM nation WHERE n_nationkey = 4", "SELECT r_regionkey::BIGINT AS k FROM region WHERE r_regionkey NOT IN (0, 1, 2, 4)"),
    "cte": ("WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000), per AS (SELECT k, COUNT(*) AS n FROM big GROUP BY k) SELECT k, n FROM per", "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1"),
    "cte_recursive": ("WITH RECURSIVE tree(k, depth) AS (SELECT c_custkey, 0 FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.depth + 1 FROM tree t JOIN customer c ON c.c_custkey / 2 = t.k AND c.c_custkey > 1) SELECT depth, COUNT(*) AS n FROM tree GROUP BY depth",
                      "WITH RECURSIVE tree(k, depth) AS (SELECT c_custkey, 0::BIGINT FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.depth + 1 FROM tree t JOIN customer c ON c.c_custkey // 2 = t.k AND c.c_custkey > 1) SELECT depth, count(*) AS n FROM tree GROUP BY 1"),
    # functions
    "fn_length": ("SELECT doc_id, LENGTH(text) AS a, OCTET_LENGTH(text) AS b FROM documents", "SELECT doc_id, strlen(text) AS a, strlen(text) AS b FROM documents"),
    "fn_substring": ("SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS a, SUBSTR(p_brand, 1, 3) AS b FROM part", "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_brand, 1, 3) AS b FROM part"),
    "fn_concat": ("SELECT p_partkey, CONCAT(p_brand, NULL, '-', p_type) AS a, p_brand || 'x' AS b FROM part", "SELECT p_partkey, concat(p_brand, '-', p_type) AS a, p_brand || 'x' AS b FROM part"),
    "fn_concat_ws": ("SELECT p_partkey, CONCAT_WS('/', p_brand, NULL, p_type) AS a FROM part", "SELECT p_partkey, concat_ws('/', p_brand, NULL, p_type) AS a FROM part"),
    "fn_lower": ("SELECT p_partkey, LOWER(p_name) AS a, UPPER(p_name) AS b FROM part", "SELECT p_partkey, lower(p_name) AS a, upper(p_name) AS b FROM part"),
    "fn_trim": ("SELECT p_partkey, TRIM(CONCAT('  ', p_name, ' ')) AS a FROM part", "SELECT p_partkey, trim(p_name) AS a FROM part"),
    "fn_replace": ("SELECT p_partkey, REPLACE(p_name, 'a', 'bb') AS a, REPLACE('abc', '', '-') AS b FROM part", "SELECT p_partkey, replace(p_name, 'a', 'bb') AS a, '-a-b-c-' AS b FROM part"),
    "fn_reverse": ("SELECT doc_id, REVERSE(text) AS a FROM documents", "SELECT doc_id, array_to_string(list_reverse(string_split(text, '')), '') AS a FROM documents"),
    "fn_left": ("SELECT p_partkey, LEFT(p_name, 3) AS a, RIGHT(p_name, 2) AS b, LEFT(p_name, -1) AS c FROM part", "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 2) AS b, '' AS c FROM part"),
    "fn_repeat": ("SELECT r_name, REPEAT(r_name, 2) AS a, REPEAT(r_name, -1) AS b FROM region", "SELECT r_name, repeat(r_name, 2) AS a, '' AS b FROM region"),
    "fn_position": ("SELECT p_partkey, POSITION('a', p_name) AS a, STRPOS('zz', p_name) AS b FROM part", "SELECT p_partkey, strpos(p_name, 'a') AS a, strpos(p_name, 'zz') AS b FROM part"),
    "fn_lpad": ("SELECT r_name, LPAD('ab', 5, 'xyz') AS a, LPAD('ab', 4, 'xyz') AS b, RPAD(r_name, 12, '*') AS c FROM region", "SELECT r_name, 'xyzab' AS a, 'xyza' AS b, rpad(r_name, 12, '*') AS c FROM region"),
    "fn_split_part": ("SELECT p_partkey, SPLIT_PART(p_type, ' ', 2) AS a, SPLIT_PART('a-b-c', '-', 2) AS b, SPLIT_PART('a', '-', 0) AS c FROM part", "SELECT p_partkey, split_part(p_type, ' ', 2) AS a, 'b' AS b, '' AS c FROM part"),
    "fn_initcap": ("SELECT INITCAP('hello world-foo bar9x') AS a, INITCAP('ABC') AS b", "SELECT 'Hello World-Foo Bar9x' AS a, 'Abc' AS b"),
    "fn_chr": ("SELECT n_nationkey, CHR(65 + n_nationkey) AS a, CHR(8364) AS e, ASCII(n_name) AS b, ASCII('') AS c FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, chr(65 + n_nationkey) AS a, chr(8364) AS e, ascii(n_name)::BIGINT AS b, 0::BIGINT AS c FROM nation"),
    "fn_md5": ("SELECT doc_id, MD5(text) AS a FROM documents", "SELECT doc_id, md5(text) AS a FROM documents"),
    "fn_translate": ("SELECT p_partkey, TRANSLATE(p_name, 'abc', 'xy') AS a, TRANSLATE('hello', 'el', 'ip') AS b FROM part", "SELECT p_partkey, translate(p_name, 'abc', 'xy') AS a, 'hippo' AS b FROM part"),
    "fn_regexp_replace": ("SELECT doc_id, REGEXP_REPLACE(text, '[0-9]+', 'N') AS a FROM documents", "SELECT doc_id, regexp_replace(text, '[0-9]+', 'N', 'g') AS a FROM documents"),
    "fn_quote_ident": ("SELECT QUOTE_IDENT('abc') AS a, QUOTE_IDENT('A b') AS b", "SELECT 'abc' AS a, '\"A b\"' AS b"),
    "fn_array_to_string": ("SELECT ARRAY_TO_STRING('{a,b,c}', '+') AS a, ARRAY_TO_STRING('{a,NULL,c}', '+', 'x') AS b", "SELECT 'a+b+c' AS a, 'a+x+c' AS b"),
    "fn_abs": ("SELECT s_suppkey, ABS(s_acctbal) AS a FROM supplier", "SELECT s_suppkey, abs(s_acctbal) AS a FROM supplier"),
    "fn_ceil": ("SELECT s_suppkey, CEIL(s_acctbal) AS a, FLOOR(s_acctbal) AS b FROM supplier", "SELECT s_suppkey, ceil(s_acctbal) AS a, floor(s_acctbal) AS b FROM supplier"),
    "fn_round": ("SELECT ROUND(2.5) AS a, ROUND(-2.5) AS b, ROUND(7) AS c", "SELECT 3.0::DOUBLE AS a, -3.0::DOUBLE AS b, 7.0::DOUBLE AS c"),
    "fn_sqrt": ("SELECT p_partkey, SQRT(p_size) AS a FROM part", "SELECT p_partkey, sqrt(p_size) AS a FROM part"),
    "fn_sign": ("SELECT s_suppkey, SIGN(s_acctbal) AS a FROM supplier", "SELECT s_suppkey, sign(s_acctbal)::DOUBLE AS a FROM supplier"),
    "fn_power": ("SELECT p_partkey, POWER(p_size, 2) AS a FROM part", "SELECT p_partkey, pow(p_size, 2) AS a FROM part"),
    "fn_mod": ("SELECT p_partkey, MOD(p_size, 7) AS a FROM part", "SELECT p_partkey, (p_size % 7)::DOUBLE AS a FROM part"),
    "fn_to_number": ("SELECT TO_NUMBER('1,234.5') AS a, TO_NUMBER('x') AS b", "SELECT 1234.5::DOUBLE AS a, NULL::DOUBLE AS b"),
    "fn_date_trunc": ("SELECT event_id, DATE_TRUNC('month', ts) AS m, DATE_TRUNC('hour', ts) AS h, DATE_TRUNC('week', ts) AS same FROM events", "SELECT event_id, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('hour', ts) AS h, ts AS same FROM events"),
    "fn_date_part": ("SELECT event_id, DATE_PART('year', ts) AS y, DATE_PART('dow', ts) AS d, DATE_PART('doy', ts) AS n, DATE_PART('epoch', ts) AS e, DATE_PART('x', ts) AS z FROM events", "SELECT event_id, year(ts)::DOUBLE AS y, date_part('dow', ts)::DOUBLE AS d, date_part('doy', ts)::DOUBLE AS n, floor(epoch(ts))::DOUBLE AS e, 0.0::DOUBLE AS z FROM events"),
    "fn_to_char": ("SELECT event_id, TO_CHAR(ts, 'YYYY-MM-DD HH24:MI:SS') AS a, TO_CHAR(ts, 'DD Month YY') AS b FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%d %B %y') AS b FROM events"),
    "fn_age": ("SELECT AGE('2024-03-05'::TIMESTAMP, '2022-01-01'::TIMESTAMP) AS a", "SELECT '2 years 2 mons 4 days' AS a"),
    "fn_coalesce": ("SELECT COALESCE(NULL, n_name) AS a FROM nation", "SELECT n_name AS a FROM nation"),
    "fn_nullif": ("SELECT n_nationkey, NULLIF(n_nationkey, 3) AS a FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, nullif(n_nationkey, 3)::BIGINT AS a FROM nation"),
    "fn_greatest": ("SELECT n_nationkey, GREATEST(n_nationkey, 5, NULL) AS a, LEAST(n_nationkey, 5) AS b FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, greatest(n_nationkey, 5)::BIGINT AS a, least(n_nationkey, 5)::BIGINT AS b FROM nation"),
    "fn_json_typeof": ("SELECT event_id, JSON_TYPEOF(props::JSON) AS a, JSON_TYPEOF(props->'k') AS b FROM events", "SELECT event_id, 'OBJECT' AS a, 'NUMBER' AS b FROM events"),
    "fn_pg_compat": ("SELECT CURRENT_DATABASE() AS a, CURRENT_SCHEMA() AS b, PG_TABLE_IS_VISIBLE(1) AS c, FORMAT_TYPE(20, 0) AS d, PG_RELATION_SIZE('x') AS e", "SELECT 'defaultdb' AS a, 'public' AS b, TRUE AS c, 'bigint' AS d, 0::BIGINT AS e"),
}

#: Without SQL to compare with.
UNCHECKED = {"fn_random": "SELECT RANDOM() AS r FROM nation", "fn_now": "SELECT NOW() AS t, CLOCK_TIMESTAMP() AS c", "fn_uuid": "SELECT RANDOM_UUID() AS u, GEN_RANDOM_UUID() AS v FROM nation", "explain": "EXPLAIN SELECT COUNT(*) FROM orders"}

# key -> (statements over a database of its own, of which the last is the query; the same state for DuckDB)
CUSTOMER = "CREATE TABLE t (k INTEGER, name VARCHAR[64] NOT NULL, nation INTEGER, bal FLOAT, PRIMARY KEY k); INSERT INTO t (k, name, nation, bal) SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer;"
SAME = "SELECT c_custkey AS k, c_name AS name, c_nationkey::BIGINT AS nation, c_acctbal AS bal FROM customer"
CHANGES: dict[str, tuple[str, str]] = {
    "dml_insert": (f"{CUSTOMER} SELECT * FROM t", SAME),
    "dml_upsert": (f"{CUSTOMER} UPSERT INTO t (k, name, nation, bal) SELECT c_custkey, c_name, c_nationkey, 0.0 FROM customer WHERE c_nationkey = 3; SELECT * FROM t", f"SELECT k, name, nation, CASE WHEN nation = 3 THEN 0.0 ELSE bal END AS bal FROM ({SAME})"),
    "dml_on_conflict": (f"{CUSTOMER} INSERT INTO t (k, name, nation, bal) SELECT c_custkey * 2, c_name, 99, 1.0 FROM customer ON CONFLICT DO UPDATE SET nation = nation + 100; SELECT k, nation FROM t",
                        f"WITH s AS ({SAME}), n AS (SELECT k * 2 AS k FROM s) SELECT k, CASE WHEN k IN (SELECT k FROM n) THEN nation + 100 ELSE nation END AS nation FROM s UNION ALL SELECT k, 99 FROM n WHERE k NOT IN (SELECT k FROM s)"),
    "dml_update": (f"{CUSTOMER} UPDATE t SET bal = bal + 1, name = UPPER(name) WHERE nation < 5; SELECT * FROM t", f"SELECT k, CASE WHEN nation < 5 THEN upper(name) ELSE name END AS name, nation, CASE WHEN nation < 5 THEN bal + 1 ELSE bal END AS bal FROM ({SAME})"),
    "dml_delete": (f"{CUSTOMER} DELETE FROM t WHERE bal < 0; SELECT * FROM t", f"SELECT * FROM ({SAME}) WHERE NOT bal < 0"),
    "dml_returning": (f"{CUSTOMER} UPDATE t SET nation = 7 WHERE nation = 3 RETURNING k, nation", f"SELECT k, 7::BIGINT AS nation FROM ({SAME}) WHERE nation = 3"),
    "ddl_table": (f"{CUSTOMER} ALTER TABLE t RENAME TO u; CREATE TABLE IF NOT EXISTS v (a INTEGER, PRIMARY KEY a); DROP TABLE v; SELECT COUNT(*) AS n FROM u", "SELECT count(*) AS n FROM customer"),
    "ddl_column": (f"{CUSTOMER} ALTER TABLE t ADD COLUMN extra VARCHAR; ALTER TABLE t RENAME COLUMN bal TO balance; ALTER TABLE t DROP COLUMN nation; UPDATE t SET extra = 'x' WHERE k < 10; SELECT * FROM t", f"SELECT k, name, bal AS balance, CASE WHEN k < 10 THEN 'x' END AS extra FROM ({SAME})"),
    "ddl_index": (f"CREATE TABLE i (a INTEGER, b INTEGER, PRIMARY KEY a); CREATE UNIQUE INDEX ON i (b); {CUSTOMER} CREATE INDEX ON t (nation); INSERT INTO i (a, b) SELECT k, k + 1 FROM t; SELECT name, unique FROM indexes('i')", "SELECT * FROM (VALUES ('i(a)', TRUE), ('i(b)', TRUE)) x(name, \"unique\")"),
    "ddl_constraint": ("CREATE TABLE c (a INTEGER, b FLOAT, CONSTRAINT pos CHECK b >= -1000000, PRIMARY KEY a); INSERT INTO c (a, b) SELECT c_custkey, c_acctbal FROM customer; ALTER TABLE c DROP CONSTRAINT pos; SELECT * FROM c", "SELECT c_custkey AS a, c_acctbal AS b FROM customer"),
    "ddl_sequence": ("CREATE SEQUENCE s START WITH 5 INCREMENT BY 3; SELECT NEXTVAL('s') AS a; SELECT NEXTVAL('s') AS b, CURRVAL('s') AS c", "SELECT 8::BIGINT AS b, 8::BIGINT AS c"),
    "view": (f"{CUSTOMER} CREATE VIEW w AS SELECT k, bal FROM t WHERE bal > 0; UPDATE t SET bal = 5.0 WHERE nation = 3; SELECT * FROM w", "SELECT k, bal FROM (SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 5.0 ELSE c_acctbal END AS bal FROM customer) WHERE bal > 0"),
    "fn_nextval": (f"{CUSTOMER} CREATE SEQUENCE s START WITH 10 INCREMENT BY 2; SELECT k, NEXTVAL('s') AS v FROM t WHERE nation < 3; SELECT CURRVAL('s') AS last, COUNT(*) AS n, COUNT(DISTINCT v) AS d, MIN(v) AS low, MAX(v) AS high FROM (SELECT NEXTVAL('s') AS v FROM t) x",
                   "SELECT 10 + 2 * (a.n + b.n - 1) AS last, b.n AS n, b.n AS d, 10 + 2 * a.n AS low, 10 + 2 * (a.n + b.n - 1) AS high FROM (SELECT count(*) AS n FROM customer WHERE c_nationkey < 3) a, (SELECT count(*) AS n FROM customer) b"),
    "txn": (f"{CUSTOMER} BEGIN; DELETE FROM t WHERE nation = 1; ROLLBACK; BEGIN; DELETE FROM t WHERE nation = 2; UPDATE t SET bal = 0.0 WHERE nation = 3; COMMIT; SELECT * FROM t", f"SELECT k, name, nation, CASE WHEN nation = 3 THEN 0.0 ELSE bal END AS bal FROM ({SAME}) WHERE nation <> 2"),
    "savepoint": (f"{CUSTOMER} BEGIN; DELETE FROM t WHERE nation = 1; SAVEPOINT a; DELETE FROM t WHERE nation = 2; ROLLBACK TO SAVEPOINT a; RELEASE SAVEPOINT a; COMMIT; SELECT k FROM t", f"SELECT k FROM ({SAME}) WHERE nation <> 1"),
    "catalog_fns": (f"{CUSTOMER} SELECT name, type, nullable FROM columns('t')", "SELECT * FROM (VALUES ('k', 'INTEGER', FALSE), ('name', 'VARCHAR', FALSE), ('nation', 'INTEGER', TRUE), ('bal', 'FLOAT', TRUE)) x(name, type, nullable)"),
    "system_tables": (f"{CUSTOMER} SELECT c.relname, a.attname FROM pg_class c JOIN pg_attribute a ON a.attrelid = c.oid", "SELECT 't' AS relname, unnest(['k', 'name', 'nation', 'bal']) AS attname"),
    "describe": (f"{CUSTOMER} SELECT table_name, column_name, data_type FROM information_schema.columns", "SELECT 't' AS table_name, * FROM (VALUES ('k', 'bigint'), ('name', 'character varying'), ('nation', 'bigint'), ('bal', 'double precision')) x(column_name, data_type)"),
    "grants": (f"{CUSTOMER} CREATE USER ann WITH PASSWORD 'x' READWRITE; GRANT SELECT, INSERT ON DATABASE defaultdb TO USER ann; REVOKE INSERT ON DATABASE defaultdb FROM USER ann; SELECT * FROM grants('ann')", "SELECT 'ann' AS \"user\", 'defaultdb' AS database, 'SELECT' AS privilege"),
    "db_admin": ("CREATE DATABASE other; USE DATABASE other; CREATE TABLE x (a INTEGER, PRIMARY KEY a); SELECT name FROM tables()", "SELECT 'x' AS name"),
    "user_admin": ("CREATE USER bob WITH PASSWORD 'p' ADMIN; CREATE USER cy WITH PASSWORD 'p'; ALTER USER cy WITH PASSWORD 'q' READWRITE; DROP USER bob; SELECT * FROM users()", "SELECT 'cy' AS name, 'READWRITE' AS permission"),
    "join_temporal": (f"{CUSTOMER} UPDATE t SET bal = bal + 1 WHERE nation = 3; SELECT n.k, o.bal AS old, n.bal AS now FROM t n JOIN t BEFORE TX 3 AS o ON o.k = n.k WHERE o.bal <> n.bal", f"SELECT k, bal AS old, bal + 1 AS now FROM ({SAME}) WHERE nation = 3"),
    "cdc_diff": (f"{CUSTOMER} UPDATE t SET nation = 1000 WHERE nation = 3; DELETE FROM t WHERE nation = 4; SELECT _diff_action, k FROM (DIFF OF t) SINCE TX 3 UNTIL TX 4", f"SELECT CASE nation WHEN 3 THEN 'UPDATE' ELSE 'DELETE' END AS _diff_action, k FROM ({SAME}) WHERE nation IN (3, 4)"),
}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions of users: event_id + 1 is the transaction, an error deletes."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "value", (F.col("event_id") + 1).alias("_tx"), F.lit(0).cast("long").alias("_seq"), F.col("ts").alias("_ts"), (F.col("event_type") == "error").alias("_deleted"))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.col("event_type").alias("value"), "_tx", "_seq", "_deleted")


LOG = "SELECT user_id, event_type, value, event_id + 1 AS tx, ts, event_type = 'error' AS deleted FROM events"
KV = f"SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, event_type AS value, tx, deleted FROM ({LOG})"
LAST = "row_number() OVER (PARTITION BY {} ORDER BY tx DESC) = 1"


def _state(low: int | None, high: int | None) -> str:
    where = " AND ".join(x for x in (f"tx >= {low}" if low is not None else "", f"tx <= {high}" if high is not None else "") if x) or "TRUE"
    return f"SELECT * FROM (SELECT * FROM ({LOG}) WHERE {where} QUALIFY {LAST.format('user_id')}) WHERE NOT deleted"


def scan_as_of(spark, sf_dir):
    return temporal.between(event_log(spark, sf_dir), ["user_id"], 200, 800)


def scan_history(spark, sf_dir):
    return temporal.history(event_log(spark, sf_dir), ["user_id"]).select("_rev", "user_id", "event_type", "value", "_deleted")


def scan_diff(spark, sf_dir):
    return temporal.diff(event_log(spark, sf_dir), ["user_id"], 300, 700)


def tx_metadata(spark, sf_dir):
    headers = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("_tx"), F.col("props").alias("_tx_metadata"))
    return event_log(spark, sf_dir).join(headers, "_tx").select("_tx", F.get_json_object("_tx_metadata", "$.k").cast("long").alias("k"))


def kv_get(spark, sf_dir):
    return kv.get(kv_log(spark, sf_dir), "u000003").select("key", "value")


def kv_get_all(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").select(F.concat(F.lit("u"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("key"))
    return kv.get_all(kv_log(spark, sf_dir), keys).select("key", "value")


def kv_scan(spark, sf_dir):
    return kv.scan(kv_log(spark, sf_dir), prefix="u0000", seek="u000002", inclusive_seek=True, limit=20).select("key", "value")


def kv_history(spark, sf_dir):
    return kv.key_history(kv_log(spark, sf_dir), "u000003", desc=True, offset=2, limit=10).select("_rev", "_tx", "value", "_deleted")


def kv_count(spark, sf_dir):
    return kv.count(kv_log(spark, sf_dir), "u")


def kv_reference(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    own = n.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"), F.lit(None).cast("string").alias("ref_key"))
    refs = n.select(F.concat(F.lit("ref-"), "n_name").alias("key"), F.lit(None).cast("string").alias("value"), F.col("n_name").alias("ref_key"))
    return kv.resolve(own.unionByName(refs))


def zset_scan(spark, sf_dir):
    z = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("set"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").cast("string").alias("key"), F.lit(0).cast("long").alias("at_tx"))
    return kv.zscan(z, "O", low=1000.0, high=400000.0, desc=True, offset=5, limit=25)


def tx_scan(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    log = c.select(F.col("conv_id").alias("_tx"), F.col("turn").alias("_seq"), F.col("role").alias("key"), F.lit(False).alias("_deleted"))
    return kv.transactions(log).select("_tx", "n_entries")


def doc_search(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.search(d, [[Comparison("lang", "EQ", "de"), Comparison("n_chars", "GT", 1000)], [Comparison("source", "LIKE", "src1%"), Comparison("lang", "NE", "en")]])


def doc_count(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return documents.count(d, [[Comparison("lang", "EQ", "en")]], limit=50)


def proof_entry(spark, sf_dir):
    """Every customer's inclusion in the Merkle tree of the table, checked."""
    tree = proofs.levels(proofs.leaves(read(spark, sf_dir, "customer"), ["c_custkey"]))
    return proofs.inclusions(tree).select("i", proofs.holds(F.col("hash"), F.col("path"), proofs.root(tree)).alias("ok"))


def verify_row(spark, sf_dir):
    """Each row against the root of its table's state; rows as they were before a change don't hold."""
    e = engine(spark, sf_dir, True)
    e.execute(f"{CUSTOMER} UPDATE t SET bal = bal + 1 WHERE nation = 3")
    top, paths = proofs.proven(e.query("SELECT * FROM t"), ["k"])
    old = e.query("SELECT * FROM t BEFORE TX 3")
    given = old.select(F.struct("k").alias("key"), proofs.leaf(*old.columns).alias("given"))
    return paths.join(given, "key").select("key.k", proofs.holds(F.col("hash"), F.col("path"), top).alias("ok"), proofs.holds(F.col("given"), F.col("path"), top).alias("old_ok"))


def verifiable_get(spark, sf_dir):
    """The state of every key, proven."""
    top, paths = proofs.proven(kv.live(kv_log(spark, sf_dir)), ["key"])
    return paths.select("key.key", proofs.holds(F.col("hash"), F.col("path"), top).alias("ok"))


def proof_dual(spark, sf_dir):
    """Between any two transactions: the later state continues the earlier one, and no other."""
    e = engine(spark, sf_dir, True)
    e.execute(f"{CUSTOMER} UPDATE t SET bal = 0.0 WHERE nation = 3; DELETE FROM t WHERE nation = 4; UPDATE t SET nation = 7 WHERE nation = 8")
    hashes = [bytes.fromhex(m["hash"]) for m in e.db.manifests]
    top = [proofs.tree_root(hashes[:n]) for n in range(len(hashes) + 1)]
    pairs = [(a, b, proofs.consistency(hashes, a, b)) for b in range(1, len(top)) for a in range(1, b + 1)]
    return spark.createDataFrame([(a, b, proofs.continues(top[a], a, top[b], b, p), proofs.continues(top[0], a, top[b], b, p)) for a, b, p in pairs], "tx_from long, tx_to long, ok boolean, forged_ok boolean")


def proof_linear(spark, sf_dir):
    e = engine(spark, sf_dir, True)
    e.execute("CREATE TABLE r (k INTEGER, n VARCHAR, PRIMARY KEY k); INSERT INTO r (k, n) SELECT r_regionkey, r_name FROM region; DELETE FROM r WHERE k = 1")
    hashes = [bytes.fromhex(m["hash"]) for m in e.db.manifests]
    running = proofs.chain(hashes)
    ok = proofs.follows(running[0], proofs.linear_proof(hashes, 0, 2), running[2])
    return spark.createDataFrame([(len(hashes), ok, len(e.db.verify()))], "transactions int, ok boolean, damaged int")


def stream_replication(spark, sf_dir):
    from kairolog.sources.versionlog import Database

    e = engine(spark, sf_dir, True)
    e.execute(f"{CUSTOMER} DELETE FROM t WHERE nation = 1")
    replica = Database(spark, scratch(spark, "replica"))
    replication.replicate(e.db, replica)
    follower = Engine(spark, None)
    follower.db = replica
    return follower.query("SELECT k, name FROM t")


def stream_index(spark, sf_dir):
    """The latest state kept by a stream over the log."""
    path = scratch(spark, "stream")
    log = event_log(spark, sf_dir)
    log.write.parquet(f"{path}/log")
    state = replication.latest_state(replication.read_stream(spark, f"{path}/log", log.schema), ["user_id"])
    query = state.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()  # each micro-batch gives the whole state, in place of the one before
    out = spark.read.parquet(f"{path}/out")
    return out.filter(~F.col("_deleted")).select("user_id", "event_type", "value")


def stream_ttl(spark, sf_dir):
    log = read(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"))
    return replication.expired(log, log.agg(F.max("expires_at")).first()[0] - datetime.timedelta(days=2)).select("event_id")


def stream_retention(spark, sf_dir):
    e = engine(spark, sf_dir, True)
    e.execute(f"{CUSTOMER} UPDATE t SET bal = 0.0 WHERE nation = 3")
    e.db.truncate_before(3)
    return e.query("SELECT * FROM t")


def nations(spark, sf_dir):
    """A key-value store of the nations."""
    from kairolog.sources.kvstore import KVStore, Set

    s = KVStore(engine(spark, sf_dir, True))
    s.exec_all([Set(r["n_name"], str(r["n_regionkey"])) for r in read(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()])  # 25 rows
    return s


def kv_set(spark, sf_dir):
    s = nations(spark, sf_dir)
    s.set("NATION_7", "changed")
    return kv.live(s.log).select("key", "value")


def kv_delete(spark, sf_dir):
    s = nations(spark, sf_dir)
    s.delete("NATION_7")
    return kv.live(s.log).select("key", "value")


def kv_preconditions(spark, sf_dir):
    """Each kind of precondition where it holds and where it doesn't; what is refused changes nothing."""
    from kairolog.sources.kvstore import PreconditionFailed

    s, out = nations(spark, sf_dir), []
    before = s.engine.db.last_tx
    for kind, bad, good in (("must_exist", ("NOWHERE",), ("NATION_3",)), ("must_not_exist", ("NATION_3",), ("NOWHERE",)), ("not_modified_after", {"NATION_3": before - 1}, {"NATION_3": before})):
        refused = []
        for at in (bad, good):
            try:
                s.set("NATION_9", kind, **{kind: at})
                refused.append(False)
            except PreconditionFailed:
                refused.append(True)
        out.append((kind, *refused, s.get("NATION_9").first()["value"], s.engine.db.last_tx - before))
    return spark.createDataFrame(out, "kind string, bad_refused boolean, good_refused boolean, value string, transactions long")


def zset_add(spark, sf_dir):
    from kairolog.sources.kvstore import KVStore, ZAdd

    s = KVStore(engine(spark, sf_dir, True))
    s.exec_all([ZAdd("n", float(r["n_regionkey"]), r["n_name"]) for r in read(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect()])
    s.exec_all([ZAdd("n", 9.5, "NATION_7")])  # an entry's score is replaced
    return s.zscan("n", low=2.0).select("score", "key")


def params(spark, sf_dir):
    return engine(spark, sf_dir).query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > @least AND o_orderstatus = @status", {"least": 1000.0, "status": "O"})


def exec_all(spark, sf_dir):
    from kairolog.sources.kvstore import Delete, KVStore, Set, ZAdd

    s = KVStore(engine(spark, sf_dir, True))
    s.exec_all([Set("a", "1"), Set("b", "2"), ZAdd("z", 3.5, "a")])
    s.exec_all([Set("a", "9"), Delete("b"), Set("r", None, None, "a")], must_exist=("b",))
    return kv.live(s.log).select("key", "value", "ref_key")


def collection(spark, sf_dir):
    """The documents' languages and sizes as a collection."""
    from kairolog.sources.collections import Collections

    c = Collections(engine(spark, sf_dir, True))
    c.create("d", {"lang": "STRING", "info.size": "INTEGER"})
    docs = read(spark, sf_dir, "documents")
    c.insert_frame("d", docs.select(F.col("doc_id").cast("string").alias("_id"), F.to_json(F.struct("lang", F.struct(F.col("n_chars").alias("size")).alias("info"))).alias("_doc")))
    return c


def in_collection(c, *expressions):
    return c.search("d", expressions).select(F.col("_id").alias("id"), "lang", F.col("`info.size`").alias("size"))


def doc_insert(spark, sf_dir):
    return in_collection(collection(spark, sf_dir))


def doc_replace(spark, sf_dir):
    c = collection(spark, sf_dir)
    c.replace("d", [[Comparison("lang", "EQ", "fr")]], {"lang": "xx", "info": {"size": 1}})
    return in_collection(c)


def doc_crud(spark, sf_dir):
    c = collection(spark, sf_dir)
    c.delete_documents("d", [[Comparison("lang", "EQ", "fr")]])
    return in_collection(c, [Comparison("info.size", "GT", 500)])


def doc_audit(spark, sf_dir):
    """The revisions of one document that was replaced with all others, then deleted."""
    c = collection(spark, sf_dir)
    c.replace("d", [], {"lang": "xx"})
    c.delete_documents("d", [])
    return c.audit("d", str(read(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0])).select("_rev", "_tx", "_deleted")


def doc_proof(spark, sf_dir):
    """Every document of a collection against the root of its state."""
    top, paths = proofs.proven(collection(spark, sf_dir).current("d").select("_id", "_doc"), ["_id"])
    return paths.select(F.col("key._id").alias("id"), proofs.holds(F.col("hash"), F.col("path"), top).alias("ok"))


def kv_expiry(spark, sf_dir):
    """Keys that are neither deleted nor expired at the middle of the events' time."""
    log = kv_log(spark, sf_dir).join(read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("_tx"), "ts"), "_tx").withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 12 HOURS")).drop("ts")
    at = log.agg(F.max("expires_at")).first()[0] - datetime.timedelta(hours=36)
    return kv.live(log, now=at).select("key", "value")


def storage_backends(spark, sf_dir):
    """The same rows from each of Parquet's codecs."""
    path, found = scratch(spark, "codecs"), []
    for codec in ("snappy", "gzip", "zstd", "uncompressed"):
        read(spark, sf_dir, "nation").write.option("compression", codec).parquet(f"{path}/{codec}")
        found.append(spark.read.parquet(f"{path}/{codec}").select(F.lit(codec).alias("codec"), "n_name"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("codec").agg(F.count(F.lit(1)).alias("n"))


def auditor(spark, sf_dir):
    """Each transaction's manifest follows from the one before."""
    e = engine(spark, sf_dir, True)
    e.execute(f"{CUSTOMER} DELETE FROM t WHERE nation = 1")
    return e.db.headers().select("_tx").withColumn("ok", ~F.col("_tx").isin(e.db.verify() or [-1]))


def windows_tumbling(spark, sf_dir):
    out = replication.windowed(read(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sink_copy(spark, sf_dir):
    path = scratch(spark, "copy")
    c = read(spark, sf_dir, "customer")
    c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_nationkey") == 3, F.lit("\\N")).otherwise(F.col("c_nationkey").cast("string"))).alias("value")).write.text(path)
    e = engine(spark, sf_dir, True)
    e.execute("CREATE TABLE t (k INTEGER, name VARCHAR, nation INTEGER, PRIMARY KEY k)")
    e.copy_text("t", path)
    return e.query("SELECT * FROM t")


CALLS: dict[str, tuple[Callable, str | None]] = {
    "scan_as_of": (scan_as_of, f"SELECT user_id, event_type, value FROM ({_state(200, 800)})"),
    "scan_history": (scan_history, f"SELECT row_number() OVER (PARTITION BY user_id ORDER BY tx) AS _rev, user_id, event_type, value, deleted AS _deleted FROM ({LOG})"),
    "scan_diff": (scan_diff, f"SELECT * FROM (SELECT CASE WHEN a.user_id IS NULL THEN 'INSERT' WHEN b.user_id IS NULL THEN 'DELETE' WHEN a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value THEN 'UPDATE' END AS _diff_action, coalesce(b.user_id, a.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN a.event_type ELSE b.event_type END AS event_type, CASE WHEN b.user_id IS NULL THEN a.value ELSE b.value END AS value FROM ({_state(None, 299)}) a FULL JOIN ({_state(None, 700)}) b ON a.user_id = b.user_id) WHERE _diff_action IS NOT NULL"),
    "tx_metadata": (tx_metadata, "SELECT event_id + 1 AS _tx, (props->>'k')::BIGINT AS k FROM events"),
    "kv_get": (kv_get, f"SELECT key, value FROM (SELECT * FROM ({KV}) WHERE key = 'u000003' QUALIFY {LAST.format('key')}) WHERE NOT deleted"),
    "kv_get_all": (kv_get_all, f"SELECT key, value FROM (SELECT * FROM ({KV}) QUALIFY {LAST.format('key')}) WHERE NOT deleted AND key IN (SELECT 'u' || lpad(n_nationkey::VARCHAR, 6, '0') FROM nation)"),
    "kv_scan": (kv_scan, f"SELECT key, value FROM (SELECT * FROM ({KV}) QUALIFY {LAST.format('key')}) WHERE NOT deleted AND key >= 'u000002' AND starts_with(key, 'u0000') ORDER BY key LIMIT 20"),
    "kv_history": (kv_history, f"SELECT * FROM (SELECT row_number() OVER (ORDER BY tx) AS _rev, tx AS _tx, value, deleted AS _deleted FROM ({KV}) WHERE key = 'u000003') ORDER BY _rev DESC LIMIT 10 OFFSET 2"),
    "kv_count": (kv_count, f"SELECT count(DISTINCT key) AS n FROM ({KV})"),
    "kv_reference": (kv_reference, "SELECT n_name AS key, n_regionkey::VARCHAR AS value, NULL::VARCHAR AS referenced_by FROM nation UNION ALL SELECT 'ref-' || n_name, n_regionkey::VARCHAR, n_name FROM nation"),
    "zset_scan": (zset_scan, "SELECT o_orderstatus AS set, o_totalprice AS score, o_orderkey::VARCHAR AS key, 0::BIGINT AS at_tx FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 400000 ORDER BY score DESC, key DESC LIMIT 25 OFFSET 5"),
    "tx_scan": (tx_scan, "SELECT conv_id AS _tx, count(*) AS n_entries FROM conversations GROUP BY 1"),
    "exec_all": (exec_all, "SELECT * FROM (VALUES ('a', '9', NULL), ('r', NULL, 'a')) x(key, value, ref_key)"),
    "doc_search": (doc_search, "SELECT doc_id, lang, source, n_chars FROM documents WHERE (lang = 'de' AND n_chars > 1000) OR (source LIKE 'src1%' AND lang IS DISTINCT FROM 'en')"),
    "doc_count": (doc_count, "SELECT least(50, count(*)) AS n FROM documents WHERE lang = 'en'"),
    "doc_crud": (doc_crud, "SELECT doc_id::VARCHAR AS id, lang, n_chars AS size FROM documents WHERE lang IS DISTINCT FROM 'fr' AND n_chars > 500"),
    "doc_insert": (doc_insert, "SELECT doc_id::VARCHAR AS id, lang, n_chars AS size FROM documents"),
    "doc_replace": (doc_replace, "SELECT doc_id::VARCHAR AS id, CASE WHEN lang = 'fr' THEN 'xx' ELSE lang END AS lang, CASE WHEN lang = 'fr' THEN 1::BIGINT ELSE n_chars END AS size FROM documents"),
    "doc_audit": (doc_audit, "SELECT * FROM (VALUES (1, 2::BIGINT, FALSE), (2, 3::BIGINT, FALSE), (3, 4::BIGINT, TRUE)) x(_rev, _tx, _deleted)"),
    "doc_proof": (doc_proof, "SELECT doc_id::VARCHAR AS id, TRUE AS ok FROM documents"),
    "kv_set": (kv_set, "SELECT n_name AS key, CASE WHEN n_name = 'NATION_7' THEN 'changed' ELSE n_regionkey::VARCHAR END AS value FROM nation"),
    "kv_delete": (kv_delete, "SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_name <> 'NATION_7'"),
    "kv_preconditions": (kv_preconditions, "SELECT kind, TRUE AS bad_refused, FALSE AS good_refused, kind AS value, n::BIGINT AS transactions FROM (VALUES ('must_exist', 1), ('must_not_exist', 2), ('not_modified_after', 3)) x(kind, n)"),
    "zset_add": (zset_add, "SELECT * FROM (SELECT CASE WHEN n_name = 'NATION_7' THEN 9.5 ELSE n_regionkey END::DOUBLE AS score, n_name AS key FROM nation) WHERE score >= 2"),
    "params": (params, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'"),
    "proof_entry": (proof_entry, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, TRUE AS ok FROM customer"),
    "verify_row": (verify_row, "SELECT c_custkey AS k, TRUE AS ok, c_nationkey <> 3 AS old_ok FROM customer"),
    "verifiable_get": (verifiable_get, f"SELECT key, TRUE AS ok FROM (SELECT * FROM ({KV}) QUALIFY {LAST.format('key')}) WHERE NOT deleted"),
    "proof_dual": (proof_dual, "SELECT a AS tx_from, b AS tx_to, TRUE AS ok, FALSE AS forged_ok FROM range(1, 6) x(a), range(1, 6) y(b) WHERE a <= b"),
    "proof_linear": (proof_linear, "SELECT 3 AS transactions, TRUE AS ok, 0 AS damaged"),
    "stream_replication": (stream_replication, "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_nationkey <> 1"),
    "stream_index": (stream_index, f"SELECT user_id, event_type, value FROM ({_state(None, None)})"),
    "stream_ttl": (stream_ttl, "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > (SELECT max(ts) - INTERVAL 1 DAY FROM events)"),
    "stream_retention": (stream_retention, f"SELECT k, name, nation, CASE WHEN nation = 3 THEN 0.0 ELSE bal END AS bal FROM ({SAME})"),
    "kv_expiry": (kv_expiry, f"SELECT key, value FROM (SELECT k.*, e.ts + INTERVAL 12 HOURS AS expires_at FROM ({KV}) k JOIN events e ON e.event_id + 1 = k.tx QUALIFY {LAST.format('key')}) WHERE NOT deleted AND expires_at > (SELECT max(ts) - INTERVAL 24 HOURS FROM events)"),
    "storage_backends": (storage_backends, "SELECT unnest(['snappy', 'gzip', 'zstd', 'uncompressed']) AS codec, (SELECT count(*) FROM nation) AS n"),
    "auditor": (auditor, "SELECT unnest([1, 2, 3])::BIGINT AS _tx, TRUE AS ok"),
    "windows_tumbling": (windows_tumbling, "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sink_copy": (sink_copy, "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_nationkey <> 3 THEN c_nationkey::BIGINT END AS nation FROM customer"),
}


def queries() -> dict:
    asked = {k: (lambda spark, d, q=q: engine(spark, d).query(q)) for k, (q, _) in SQL.items()}
    asked |= {k: (lambda spark, d, q=q: engine(spark, d).query(q)) for k, q in UNCHECKED.items()}
    changed = {k: (lambda spark, d, q=q: engine(spark, d, True).execute(q)[-1]) for k, (q, _) in CHANGES.items()}
    return asked | changed | {k: f for k, (f, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in (SQL | CHANGES).items()} | {k: sql for k, (_, sql) in CALLS.items() if sql}
