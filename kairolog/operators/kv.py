"""Key-value reads over a log of (key, value, ...) versions: DataFrame in, DataFrame out.

A log has key, _tx, _seq, _deleted and any payload; expires_at (timestamp) and at_tx are optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairolog.operators.temporal import as_of, history


class KeyResolutionLimit(ValueError):
    """A reference to a reference."""


def live(log: DataFrame, tx: int | None = None, now=None) -> DataFrame:
    """The latest version of each key, without deleted and expired ones."""
    out = as_of(log, ["key"], tx)
    if "expires_at" in out.columns:
        at = F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")
        out = out.filter(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    return out


def get(log: DataFrame, key: str, at_tx: int | None = None, revision: int | None = None) -> DataFrame:
    """One key: its state at a transaction, or its n-th revision (0 and less count back from the last)."""
    own = log.filter(F.col("key") == key)
    if revision is None:
        return live(own, at_tx)
    down = revision <= 0
    order = [F.col("_tx").desc(), F.col("_seq").desc()] if down else ["_tx", "_seq"]
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return ranked.filter(F.col("_n") == (1 - revision if down else revision)).drop("_n")


def get_all(log: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys that exist; others are left out."""
    return live(log).join(keys.select("key").distinct(), "key", "left_semi")


def scan(log: DataFrame, prefix: str = "", seek: str | None = None, end: str | None = None, inclusive_seek: bool = False, inclusive_end: bool = False, desc: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
    """Keys of a prefix in order, from seek to end; all of them without a limit."""
    out = log.filter(F.col("key").startswith(prefix)) if prefix else log
    low, high = (end, seek) if desc else (seek, end)
    low_in, high_in = (inclusive_end, inclusive_seek) if desc else (inclusive_seek, inclusive_end)
    if low is not None:
        out = out.filter(F.col("key") >= low if low_in else F.col("key") > low)
    if high is not None:
        out = out.filter(F.col("key") <= high if high_in else F.col("key") < high)
    out = live(out).orderBy(F.col("key").desc() if desc else F.col("key"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def key_history(log: DataFrame, key: str, desc: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
    out = history(log.filter(F.col("key") == key), ["key"])
    out = out.orderBy(F.col("_rev").desc() if desc else F.col("_rev"))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def count(log: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct keys of a prefix, deleted ones too."""
    return (log.filter(F.col("key").startswith(prefix)) if prefix else log).agg(F.count_distinct("key").alias("n"))


def resolve(entries: DataFrame) -> DataFrame:
    """entries: key, value, ref_key. A reference takes the value of the entry it names, one step; references to
    references stop the query."""
    targets = entries.select(F.col("key").alias("_k"), F.col("value").alias("_v"), F.col("ref_key").alias("_r"))
    joined = entries.join(targets, entries["ref_key"] == targets["_k"], "left")
    bad = F.col("_r").isNotNull()
    value = F.when(F.col("ref_key").isNull(), F.col("value")).when(bad, F.raise_error(F.lit("key resolution limit reached")).cast("string")).otherwise(F.col("_v"))
    return joined.select("key", value.alias("value"), F.col("ref_key").alias("referenced_by"))


def zscan(entries: DataFrame, name: str, low: float | None = None, high: float | None = None, desc: bool = False, offset: int = 0, limit: int = 0) -> DataFrame:
    """entries: set, score, key, at_tx. Members of a set by score, then key and transaction."""
    out = entries.filter(F.col("set") == name)
    if low is not None:
        out = out.filter(F.col("score") >= low)
    if high is not None:
        out = out.filter(F.col("score") <= high)
    keys = [F.col(c).desc() if desc else F.col(c) for c in ("score", "key", "at_tx")]
    out = out.orderBy(*keys)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def transactions(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """For each transaction its entries in order, and their number."""
    if low is not None:
        log = log.filter(F.col("_tx") >= low)
    if high is not None:
        log = log.filter(F.col("_tx") <= high)
    out = log.groupBy("_tx").agg(F.sort_array(F.collect_list(F.struct("_seq", "key", "_deleted"))).alias("entries"))
    return out.withColumn("n_entries", F.size("entries").cast("long"))
