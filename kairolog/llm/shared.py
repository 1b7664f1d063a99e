"""The folder that driver and executors share, and small helpers used by the operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A small side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 100_000


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kairolog-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of this process where it is unset and Spark runs in one
    process, as in tests. On a cluster executors don't see such a folder, so it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or _own_dir()).rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for the tables and files of one run of an operator."""
    return f"{shared_dir(spark)}/kairolog/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that nothing reads again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


#: For jobs that an operator runs itself: rows that Python workers get at once, so that a batch of long texts stays small.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """These settings while jobs run, then those before."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def trim() -> None:
    """In a Python worker: gives freed memory back to the system. Workers live from stage to stage, and an executor's limit
    holds for all of its own together."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `rows` rows, else as it is (a shuffled join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() does it for pure ASCII, faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, compared without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """df's columns by their whole names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with columns of these names (compared without case) under free ones, and the columns that give df's own back."""
    clash = [c for c in df.columns if c.lower() in names]
    new = dict(zip(clash, free_name(df, *[f"_{c}" for c in clash]), strict=True))
    moved = df.select(*[x.alias(new.get(c, c)) for c, x in zip(df.columns, own(df), strict=True)])
    return moved, [x.alias(c) for c, x in zip(df.columns, own(moved), strict=True)]
