"""Integrity: Merkle trees over rows, in Spark, and proofs that a client checks alone.

A leaf's hash is SHA-256 of 0x00 and the leaf, an inner node's of 0x01 and its children. Levels are aggregations over
pairs; a node without a partner goes up as it is. The paths of all leaves are found by a join a level, and a proof is
checked as a column. Transactions' hashes lie on the driver already; their own append-only tree is computed there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairolog.sources.scratch import saved, scratch


def leaf(*columns: str) -> Column:
    """The hash of a row: its columns as JSON."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")), 256))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """leaves: i (0 and up, without gaps), hash. Each level up to the root, as tables."""
    folder = scratch(leaves.sparkSession, "merkle")
    out = [saved(leaves.select("i", "hash"), f"{folder}/0")]
    n = out[0].count()
    while n > 1:
        below = out[-1].groupBy(F.shiftright("i", 1).alias("i"))
        both = below.agg(F.max_by("hash", -F.col("i")).alias("l"), F.max_by("hash", F.col("i")).alias("r"), F.count(F.lit(1)).alias("n"))
        node = F.when(F.col("n") == 1, F.col("l")).otherwise(F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), "l", "r"), 256)))
        out.append(saved(both.select("i", node.alias("hash")), f"{folder}/{len(out)}"))
        n = (n + 1) // 2
    return out


def root(tree: Sequence[DataFrame]) -> bytes:
    row = tree[-1].first()
    return bytes(row["hash"]) if row else hashlib.sha256(b"").digest()


def leaves(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows as leaves in the order of their key: i, key (a struct), hash (of all columns). Places within sorted partitions
    are added to those of the partitions before. Rows of one key are leaves each, in any order."""
    sorted_rows = rows.select(F.struct(*key).alias("key"), leaf(*rows.columns).alias("hash")).orderBy("key", "hash").withColumn("mid", F.monotonically_increasing_id())
    tagged = saved(sorted_rows, scratch(rows.sparkSession, "leaves")).withColumn("part", F.shiftright("mid", 33))
    sizes = tagged.groupBy("part").count()  # a row for each task
    base = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    return tagged.join(base, "part").select((F.col("base") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), "key", "hash")


def inclusions(tree: Sequence[DataFrame]) -> DataFrame:
    """For each leaf i, hash and path: on each level its partner's hash and whether that is the left one."""
    out = tree[0].select("i", "hash", F.col("i").alias("at"), F.array().cast("array<struct<left:boolean,hash:binary>>").alias("path"))
    for level in tree[:-1]:
        beside = level.select(F.col("i").bitwiseXOR(F.lit(1)).alias("at"), F.col("hash").alias("other"))
        step = F.array(F.struct((F.col("at").bitwiseAND(F.lit(1)) == 1).alias("left"), F.col("other").alias("hash")))
        out = out.join(beside, "at", "left").select("i", "hash", F.shiftright("at", 1).alias("at"), F.when(F.col("other").isNull(), F.col("path")).otherwise(F.concat("path", step)).alias("path"))
    return out.drop("at")


def holds(leaf_hash: Column, path: Column, root_hash: bytes) -> Column:
    """Whether a path leads from a leaf's hash to the root."""
    both = lambda h, x: F.when(x["left"], F.concat(x["hash"], h)).otherwise(F.concat(h, x["hash"]))
    top = F.aggregate(path, leaf_hash, lambda h, x: F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), both(h, x)), 256)))
    return top == F.unhex(F.lit(root_hash.hex()))


def proven(rows: DataFrame, key: Sequence[str]) -> tuple[bytes, DataFrame]:
    """The root of a table's state, and for each of its rows key, hash and path. Who keeps the root can check a row alone.
    Of no rows: the hash of nothing, and no paths."""
    own = saved(leaves(rows, key), scratch(rows.sparkSession, "proven"))
    tree = levels(own)
    return root(tree), own.select("i", "key").join(inclusions(tree), "i").select("key", "hash", "path")


def inclusion(tree: Sequence[DataFrame], i: int) -> list[tuple[str, bytes]]:
    """The proof of leaf i: on each level its partner's hash and side; levels without a partner are left out."""
    out = []
    for level in tree[:-1]:
        row = level.filter(F.col("i") == (i ^ 1)).first()
        if row is not None:
            out.append(("left" if i & 1 else "right", bytes(row["hash"])))
        i >>= 1
    return out


def verified(leaf_hash: bytes, proof: Sequence[tuple[str, bytes]], expected: bytes) -> bool:
    h = leaf_hash
    for side, other in proof:
        h = hashlib.sha256(b"\x01" + (other + h if side == "left" else h + other)).digest()
    return h == expected


def chain(hashes: Sequence[bytes], before: bytes = b"\0" * 32) -> list[bytes]:
    """The running hash of transactions: each covers all before it."""
    out = []
    for h in hashes:
        before = hashlib.sha256(before + h).digest()
        out.append(before)
    return out


def linear_proof(hashes: Sequence[bytes], first: int, last: int) -> list[bytes]:
    """What a client that trusts the running hash of `first` needs to compute that of `last`."""
    return list(hashes[first + 1 : last + 1])


def follows(trusted: bytes, proof: Sequence[bytes], claimed: bytes) -> bool:
    return (chain(proof, trusted) or [trusted])[-1] == claimed


def consistency(hashes: Sequence[bytes], first: int, last: int) -> list[bytes]:
    """That the append-only tree of the first `last` hashes continues that of the first `first` (1 to last): nodes of the
    later tree, from the lowest, by which both roots are computed. They grow with the logarithm of `last`."""
    if not 0 < first <= last <= len(hashes):
        raise ValueError(f"no proof from {first} to {last} of {len(hashes)}")

    def nodes(m: int, own: Sequence[bytes], known: bool) -> list[bytes]:
        if m == len(own):
            return [] if known else [tree_root(own)]
        half = 1 << (len(own) - 1).bit_length() - 1
        if m <= half:
            return [*nodes(m, own[:half], known), tree_root(own[half:])]
        return [*nodes(m - half, own[half:], False), tree_root(own[:half])]

    return nodes(first, hashes[:last], True)


def continues(old_root: bytes, first: int, new_root: bytes, last: int, proof: Sequence[bytes]) -> bool:
    """Whether a consistency proof leads to both roots: the old tree's last node is followed up the new tree, and what
    stands left of it belongs to both."""
    if first == last:
        return old_root == new_root and not proof
    rest = list(proof)
    a, b = first - 1, last - 1
    while a & 1:
        a, b = a >> 1, b >> 1
    if a:  # else the old tree is a whole node of the new one, and its root is known
        if not rest:
            return False
        old = new = rest.pop(0)
    else:
        old = new = old_root
    for h in rest:
        if not b:
            return False
        if a & 1 or a == b:
            old, new = (hashlib.sha256(b"\x01" + h + x).digest() for x in (old, new))
            while a and not a & 1:
                a, b = a >> 1, b >> 1
        else:
            new = hashlib.sha256(b"\x01" + new + h).digest()
        a, b = a >> 1, b >> 1
    return (old, new, b) == (old_root, new_root, 0)


def consistent(old_root: bytes, old_size: int, leaves: Sequence[bytes], new_root: bytes) -> bool:
    """Whether a tree of these leaf hashes has both roots, the old one over its first leaves."""
    return tree_root(leaves[:old_size]) == old_root and tree_root(leaves) == new_root


def tree_root(leaves: Sequence[bytes]) -> bytes:
    level = list(leaves)
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]
