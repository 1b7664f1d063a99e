"""Proofs: over trees of every small size, and refused where anything differs."""

import hashlib

from pyspark.sql import functions as F

from kairolog.operators import proofs
from kairolog.plans.engine import Engine
from kairolog.sources.kvstore import KVStore, Set

HASHES = [hashlib.sha256(bytes([n])).digest() for n in range(20)]


def test_a_later_tree_continues_each_earlier_one():
    top = [proofs.tree_root(HASHES[:n]) for n in range(len(HASHES) + 1)]
    for last in range(1, len(HASHES) + 1):
        for first in range(1, last + 1):
            p = proofs.consistency(HASHES, first, last)
            assert len(p) <= 2 * last.bit_length()
            assert proofs.continues(top[first], first, top[last], last, p)
            assert not proofs.continues(HASHES[-1][::-1], first, top[last], last, p)
            assert not proofs.continues(top[first], first, HASHES[-1][::-1], last, p)
            assert not proofs.continues(top[first], first, top[last], last, [*p, HASHES[0]])
            for i in range(len(p)):
                assert not proofs.continues(top[first], first, top[last], last, [*p[:i], HASHES[0][::-1], *p[i + 1 :]])
                assert not proofs.continues(top[first], first, top[last], last, p[:i] + p[i + 1 :])


def test_paths_are_those_of_single_proofs(spark):
    for n in (0, 1, 2, 5, 8):
        rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")).repartition(3)
        top, paths = proofs.proven(rows, ["k"])
        found = sorted(paths.select("key.k", "hash", "path", proofs.holds(F.col("hash"), F.col("path"), top).alias("ok"), proofs.holds(F.col("hash"), F.col("path"), HASHES[0]).alias("other")).collect())
        assert [r["k"] for r in found] == list(range(n))
        assert top == proofs.tree_root([bytes(r["hash"]) for r in found])
        for r in found:
            assert r["ok"] and not r["other"]
            single = [("left" if x["left"] else "right", bytes(x["hash"])) for x in r["path"]]
            assert proofs.verified(bytes(r["hash"]), single, top)
            assert not any(proofs.verified(bytes(r["hash"]), single[:i], top) for i in range(len(single)))


def test_rows_with_nulls_and_of_one_key(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "a"), (2, "b")], "k int, v string")
    top, paths = proofs.proven(rows, ["k"])
    assert [r["ok"] for r in paths.select(proofs.holds(F.col("hash"), F.col("path"), top).alias("ok")).collect()] == [True] * 4
    assert top == proofs.proven(rows.repartition(4), ["k"])[0]


def test_values_of_keys_with_quotes(spark, tmp_path):
    s = KVStore(Engine(spark, f"file://{tmp_path}"))
    s.exec_all([Set("it's", "1"), Set("b", "2")])
    s.set_reference("r'", "it's")
    assert [s.get(k).first()["value"] for k in ("it's", "b", "r'")] == ["1", "2", "1"]
    assert s.get("c").isEmpty()


def test_scans_without_a_limit_give_every_key(spark):
    from kairolog.operators import kv

    log = spark.range(6000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("key"), F.lit("v").alias("value"), F.lit(1).cast("long").alias("_tx"), F.col("id").alias("_seq"), F.lit(False).alias("_deleted"))
    assert kv.scan(log).count() == 6000 and kv.scan(log, limit=7).count() == 7
