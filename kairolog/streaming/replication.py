"""Continuous reading of a log: replicas, the latest state, windows over event time."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairolog.sources.versionlog import Database

#: Batches copied at a time.
COPIES = 8


def replicate(source: Database, target: Database) -> int:
    """Follower: takes the source's transactions after its own last one, in order; the number taken. Files are copied
    byte by byte, some at a time, and manifests keep their hashes, so the replica proves the same history and contents;
    files that retention has dropped since aren't there to copy. Running it again goes on where it was."""
    taken = 0
    source.refresh()
    for m in source.manifests[target.last_tx :]:
        paths = [b["path"] for b in m["batches"] if b["path"] not in source.replaced]
        with ThreadPoolExecutor(COPIES) as pool:
            list(pool.map(lambda path: target.store.copy(source.store, path), paths))
        target.store.create(f"tx/{m['tx']:012d}.json", m)
        target.refresh()
        taken += 1
    return taken


def latest_state(stream: DataFrame, key: list[str]) -> DataFrame:
    """A streaming log (_tx, _seq, _deleted) as its latest version of each key, kept as state."""
    rest = [c for c in stream.columns if c not in key]
    last = stream.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_tx", "_seq")).alias("v"))
    return last.select(*key, "v.*")


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of log rows to Parquet once each; all that is there, then it ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expired(log: DataFrame, at, column: str = "expires_at") -> DataFrame:
    """TTL: rows that are still valid at a time."""
    return log.filter(F.col(column).isNull() | (F.col(column) > F.lit(at).cast("timestamp_ntz")))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling or sliding windows; on a stream rows later than `late` are dropped. Additional to the dialect."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", by: str = "user_id") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
