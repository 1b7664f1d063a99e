"""Reading a log of row versions: state at a point, changes in a range, history, difference.

A log is a DataFrame with the table's columns and _tx, _seq (order in the transaction), _deleted. The latest version of
each key is an aggregation (partial on each task, then one shuffle by key), not a window, so a key with very many
versions isn't gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ("_tx", "_seq", "_ts", "_deleted", "_tx_metadata")


def columns_of(log: DataFrame, key: list[str]) -> list[str]:
    return [c for c in log.columns if c not in META]


def _latest(condition: Column | None, rest: list[str]) -> Column:
    row, order = F.struct("_deleted", *rest), F.struct("_tx", "_seq")
    return F.max_by(row, order) if condition is None else F.max_by(F.when(condition, row), F.when(condition, order))


def between(log: DataFrame, key: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows whose last version in the range isn't a deletion, as of that version. The version is chosen first."""
    if low is not None:
        log = log.filter(F.col("_tx") >= low)
    if high is not None:
        log = log.filter(F.col("_tx") <= high)
    columns = columns_of(log, key)
    rest = [c for c in columns if c not in key]
    last = log.groupBy(*key).agg(_latest(None, rest).alias("_v")).filter(~F.col("_v._deleted"))
    return last.select(*[F.col(c) if c in key else F.col(f"_v.`{c}`").alias(c) for c in columns])


def as_of(log: DataFrame, key: list[str], tx: int | None = None) -> DataFrame:
    return between(log, key, None, tx)


def history(log: DataFrame, key: list[str]) -> DataFrame:
    """All versions, deletions too, with _rev: 1 for a key's first."""
    order = Window.partitionBy(*key).orderBy("_tx", "_seq")
    return log.withColumn("_rev", F.row_number().over(order).cast("bigint"))


def diff(log: DataFrame, key: list[str], low: int | None, high: int | None, before: int | None = None) -> DataFrame:
    """What changed between the state before `low` (or at `before`) and the state at `high`: _diff_action INSERT, UPDATE
    (the new row) or DELETE (the old row). Rows that are the same again don't show. One aggregation gives both states."""
    columns = columns_of(log, key)
    rest = [c for c in columns if c not in key]
    old_end = before if before is not None else (low - 1 if low is not None else None)
    old = F.lit(False) if old_end is None else F.col("_tx") <= old_end
    new = F.lit(True) if high is None else F.col("_tx") <= high
    both = log.groupBy(*key).agg(_latest(old, rest).alias("_old"), _latest(new, rest).alias("_new"))
    there = lambda v: F.coalesce(~F.col(f"{v}._deleted"), F.lit(False))
    was, is_ = there("_old"), there("_new")
    action = F.when(~was & is_, "INSERT").when(was & ~is_, "DELETE").when(was & is_ & ~F.col("_old").eqNullSafe(F.col("_new")), "UPDATE")
    shown = F.when(action == "DELETE", F.col("_old")).otherwise(F.col("_new"))
    out = both.withColumn("_diff_action", action).filter(F.col("_diff_action").isNotNull()).withColumn("_v", shown)
    return out.select("_diff_action", *[F.col(c) if c in key else F.col(f"_v.`{c}`").alias(c) for c in columns])


def tx_since(headers: DataFrame, time, inclusive: bool) -> int | None:
    """headers: _tx, _ts. The first transaction at or after a time (not inclusive: from a second later); None if none."""
    return headers.filter(F.col("_ts") >= F.lit(time).cast("timestamp_ntz") + F.expr("INTERVAL 0 SECOND" if inclusive else "INTERVAL 1 SECOND")).agg(F.min("_tx")).first()[0]


def tx_until(headers: DataFrame, time, inclusive: bool) -> int | None:
    """The last transaction at or before a time (not inclusive: up to a second earlier); None if none."""
    return headers.filter(F.col("_ts") <= F.lit(time).cast("timestamp_ntz") - F.expr("INTERVAL 0 SECOND" if inclusive else "INTERVAL 1 SECOND")).agg(F.max("_tx")).first()[0]
