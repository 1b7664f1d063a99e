"""Exact deduplication as a stateful stream: keyed state on disk, without expiry.

A stream of digests feeds an aggregation whose state (RocksDB) keeps for each digest how many rows came, the largest
identifier and where that row's content lies. Rows that hit another's digest are then checked byte by byte against the
row that stays. DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm.shared import ascii_lower, configured, free_name, own, saved, small, workspace

#: State on the executors' disks, its memory bounded, its changes logged in the shared folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of a query that has ended are closed then
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store takes 4 MB ahead for its manifest
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Rows of one group that are compared in one place.
TOGETHER = 250


def normalised(text):
    """A-Z lower-cased; null is empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def from_files(docs: DataFrame) -> DataFrame:
    """docs, or a copy of it in the shared folder where its rows aren't read from files and so have no place."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018
        return docs
    except AnalysisException:
        return saved(docs, f"{workspace(docs.sparkSession, 'exact')}/rows")


def placed(docs: DataFrame, name: str) -> DataFrame:
    """docs with the file and row of each row's content. docs: from_files()."""
    at = docs.metadataColumn("_metadata")
    return docs.select(*own(docs), F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias(name))


def group_stream(stream: DataFrame) -> DataFrame:
    """For each digest of a stream of (key, digest, place): rows, and the largest key with its place."""
    return stream.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("key", "place")).alias("keeper"))


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def groups_of(digests: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over the digest tables in folder/digests until all that it hasn't read is read; its state and what
    it has read lie in folder/state. Each micro-batch writes the groups that it changed, under its number, so that a
    batch done again replaces its own. Returns every group as it is now."""
    spark = digests.sparkSession
    # a digest is a small part of its row: fewer stores than partitions, each with its own files and memory, are enough
    stores = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    with configured(spark, STATE | {"spark.sql.shuffle.partitions": str(stores)}):
        stream = spark.readStream.schema(digests.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/digests")
        groups = group_stream(stream)
        query = (
            groups.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={n}")).start()
        )
        query.awaitTermination()
    if not _there(spark, f"{folder}/groups"):
        return spark.createDataFrame([], groups.schema)
    found = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    return found.groupBy("digest").agg(F.max("rows").alias("rows"), F.max("keeper").alias("keeper"))


def judged(docs: DataFrame, key: str, text: str, state: str | None = None) -> DataFrame:
    """For each row: key, place, digest, rows of its group, keeper, kept. Only rows that hit are read again, for their
    bytes; a keeper that came with an earlier call, by its place. state: a folder of the shared ones that keeps digests,
    state and groups from call to call; else each call has its own."""
    spark = docs.sparkSession
    work = workspace(spark, "exact")
    folder = (state or work).rstrip("/")
    last = f"{folder}/last-{uuid.uuid4().hex}"
    (place,) = free_name(docs, "_place")
    rows = placed(docs, place).select(F.col(key).alias("key"), F.col(place).alias("place"), normalised(F.col(text)).alias("body"))
    digests = saved(rows.select("key", "place", F.unhex(F.sha2("body", 256)).alias("digest")), f"{folder}/digests/{uuid.uuid4().hex}")
    groups = saved(groups_of(digests, folder), last)
    is_keeper = F.struct("key", "place").eqNullSafe(F.col("keeper"))
    found = saved(digests.join(groups, "digest").withColumn("kept", is_keeper), f"{work}/found")
    hit = found.filter("rows > 1")
    names = hit.select(F.col("key").alias("k"), F.col("place").alias("p"), "digest", "rows", "kept").distinct()
    bodies = rows.join(small(names), F.col("key").eqNullSafe(F.col("k")) & (F.col("place") == F.col("p"))).select("key", "place", "digest", "rows", "kept", "body")
    if state:
        bodies = bodies.unionByName(_earlier(hit, digests, key, text, docs))
    bodies = saved(bodies, f"{work}/bodies")
    # each row that hit goes, with its text, to one of several copies of the keeper's text
    parts = F.ceil(F.col("rows") / TOGETHER).cast("int")
    hits = bodies.filter("not kept").withColumn("part", F.pmod(F.xxhash64("key", "place"), parts).cast("int"))
    keepers = bodies.filter("kept").select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    same = F.when(F.col("body") == F.col("kept_body"), F.lit(True)).otherwise(F.raise_error(F.lit("two texts with one digest")).cast("boolean"))
    checked = hits.join(keepers, ["digest", "part"]).filter(same).select("key", "place").distinct()
    checked = checked.select(F.col("key").alias("k"), F.col("place").alias("p"))
    gone = found.filter("not kept").join(checked, F.col("key").eqNullSafe(F.col("k")) & (F.col("place") == F.col("p")), "left_semi")
    return found.filter("kept").unionByName(gone)


def _earlier(hit: DataFrame, digests: DataFrame, key: str, text: str, docs: DataFrame) -> DataFrame:
    """Keepers of hit groups that came with an earlier call, read from where they lie."""
    spark = docs.sparkSession
    came = digests.select(F.struct("key", "place").alias("keeper"))
    old = hit.select("digest", "rows", "keeper").distinct().join(came, "keeper", "left_anti").select("digest", "rows", F.col("keeper.place").alias("p"))
    files = [r["file"] for r in old.select("p.file").distinct().collect()]  # names of input files
    if not files:
        return spark.createDataFrame([], hit.select("key", "place", "digest", "rows", "kept").schema.add("body", "string"))
    kind = docs.schema
    there = spark.read.schema(type(kind)([kind[key], kind[text]])).parquet(*files)
    there = placed(there, "place_").select(F.col(key).alias("key"), F.col("place_").alias("place"), normalised(F.col(text)).alias("body"))
    return there.join(small(old), F.col("place") == F.col("p")).select("key", "place", "digest", "rows", F.lit(True).alias("kept"), "body")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", state: str | None = None) -> DataFrame:
    """For each row: key, keep_id (key of the row that stays), group_size, kept, text_sha256 (of the normalised text).
    Texts are equal if identical after lower-casing A-Z; null is the empty text. The row with the largest key stays; of
    rows with that key (null if all are), the last in file order (docs that aren't read from files are written first).
    A pair of texts with one digest but other bytes stops the query. An empty table gives no rows. Other columns, whatever
    their names, aren't looked at.

    With a state folder the rows are an arrival: they are held against those of earlier calls too, in this session or one
    before, whose files must still be there; group_size counts all so far. A row of an earlier call doesn't come again,
    though a larger key may have taken its place: superseded() has those."""
    out = judged(from_files(docs), key, text, state)
    return out.select(F.col("key").alias(key), F.col("keeper.key").alias("keep_id"), F.col("rows").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def superseded(docs: DataFrame, state: str, key: str = "doc_id") -> DataFrame:
    """Keys of earlier keepers (key, keep_id) that a later arrival's larger key has replaced. docs: any arrival, for the
    session and the type of its key."""
    spark = docs.sparkSession
    folder = state.rstrip("/")
    groups = spark.read.parquet(f"{folder}/groups").select("digest", "rows", "keeper")
    now = groups.groupBy("digest").agg(F.max("keeper").alias("now"))
    old = groups.join(now, "digest").filter("keeper <> now")
    return old.select(F.col("keeper.key").alias(key), F.col("now.key").alias("keep_id")).distinct()


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns whatever their names; exact_dedup() says which. Of rows that are equal in
    key and text one stays. Null texts are equal to empty ones; an empty table stays so."""
    docs = from_files(docs)
    k, p, place = free_name(docs, "_k", "_p", "_place")
    gone = judged(docs, key, text).filter("not kept").select(F.col("key").alias(k), F.col("place").alias(p))
    gone = saved(gone, f"{workspace(docs.sparkSession, 'exact')}/gone")
    return placed(docs, place).join(small(gone), F.col(key).eqNullSafe(F.col(k)) & (F.col(place) == F.col(p)), "left_anti").select(*own(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
