"""A database as a log of transactions: each commits Parquet files and one manifest.

A manifest names the transaction's time, files and, if it changed, the catalog. Readers see the files of the manifests
up to a transaction, so a commit is visible at once or not at all; creating the manifest is the commit, and the first
of two writers of one number wins. Each transaction's hash covers the one before.
"""

from __future__ import annotations

import copy
import datetime
import hashlib
import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairolog.functions import types as K
from kairolog.sources.store import Store

META = T.StructType([T.StructField("_tx", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_ts", T.TimestampNTZType()), T.StructField("_deleted", T.BooleanType())])


@dataclass
class Column:
    name: str
    kind: str
    max: int | None = None
    auto: bool = False
    not_null: bool = False
    default: Any = None
    #: its name in the files, which a rename leaves
    stored: str = ""


@dataclass
class Table:
    name: str
    id: str
    columns: list[Column]
    key: list[str]
    checks: list[tuple[str, str]] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    next_key: int = 1

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"no column {name} in {self.name}")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.stored or c.name, K.SPARK[c.kind], True, {"kind": c.kind} if c.kind in (K.UUID, K.JSON) else {}) for c in self.columns])

    @property
    def kinds(self) -> dict[str, str]:
        return {c.name: c.kind for c in self.columns}


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, dict] = field(default_factory=dict)
    users: dict[str, dict] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"users": self.users, "tables": {k: {**t.__dict__, "columns": [c.__dict__ for c in t.columns]} for k, t in self.tables.items()}, "views": self.views, "sequences": self.sequences}

    @classmethod
    def from_json(cls, raw: dict) -> Catalog:
        tables = {k: Table(**{**t, "columns": [Column(**c) for c in t["columns"]], "checks": [tuple(c) for c in t["checks"]]}) for k, t in raw["tables"].items()}
        return cls(tables, dict(raw["views"]), dict(raw["sequences"]), dict(raw.get("users", {})))


def linked_hash(before: str, manifest: dict) -> str:
    body = {k: v for k, v in manifest.items() if k != "hash"}
    return hashlib.sha256((before + json.dumps(body, sort_keys=True)).encode()).hexdigest()


class Database:
    """One database of a warehouse folder."""

    def __init__(self, spark: SparkSession, root: str, name: str = "defaultdb"):
        self.spark, self.name = spark, name
        self.path = f"{root.rstrip('/')}/{name}"
        self.store = Store(spark, self.path)
        self.manifests: list[dict] = []
        self.catalog = Catalog()
        self.replaced: set[str] = set()
        self.refresh()

    def refresh(self) -> None:
        """Reads the manifests that were committed since."""
        for name in self.store.names("tx"):
            if name.endswith(".json") and int(name[:-5]) > len(self.manifests):
                m = self.store.read(f"tx/{name}")
                self.manifests.append(m)
                self._drop(m.get("dropped", ()))
                if m.get("catalog"):
                    self.catalog = Catalog.from_json(m["catalog"])

    def _drop(self, paths) -> None:
        """Marks batches whose files a later transaction replaced."""
        if paths:
            gone = set(paths)
            self.replaced |= gone

    @property
    def last_tx(self) -> int:
        return len(self.manifests)

    def headers(self) -> DataFrame:
        rows = [(m["tx"], datetime.datetime.fromisoformat(m["ts"]), m["hash"], m.get("metadata") and json.dumps(m["metadata"])) for m in self.manifests]
        return self.spark.createDataFrame(rows, "_tx long, _ts timestamp_ntz, hash string, _tx_metadata string")

    def stage(self, table: Table, rows: DataFrame) -> dict:
        """Writes rows (the table's columns, _seq, _deleted) as files that no manifest names yet."""
        path = f"data/{table.id}/{uuid.uuid4().hex}"
        columns = [F.col(f"`{c.name}`").cast(K.SPARK[c.kind]).alias(c.stored or c.name) for c in table.columns]
        rows.select(*columns, F.col("_seq").cast("long").alias("_seq"), "_deleted").write.parquet(f"{self.path}/{path}")
        return {"table": table.id, "path": path, "sha256": self._digest(path)}

    def _digest(self, path: str) -> str:
        """Of all the batch's files: the hash of their names and their contents' hashes, which Spark computes."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{path}")
        found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
        return hashlib.sha256(json.dumps(sorted((r["name"], r["sha"]) for r in found)).encode()).hexdigest()

    def commit(self, batches: list[dict], catalog: Catalog | None = None, metadata: dict | None = None, ts: datetime.datetime | None = None, dropped: list[str] | None = None) -> int:
        tx = self.last_tx + 1
        at = ts or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        if self.manifests:  # time doesn't go back
            at = max(at, datetime.datetime.fromisoformat(self.manifests[-1]["ts"]))
        manifest = {"tx": tx, "ts": at.isoformat(), "batches": batches, "catalog": catalog.to_json() if catalog else None, "metadata": metadata}
        if dropped:
            manifest["dropped"] = dropped
        manifest["hash"] = linked_hash(self.manifests[-1]["hash"] if self.manifests else "", manifest)
        self.store.create(f"tx/{tx:012d}.json", manifest)
        self.manifests.append(manifest)
        if catalog:
            self.catalog = copy.deepcopy(catalog)
        return tx

    def log(self, table: Table, staged: list[dict] = (), upto: int | None = None) -> DataFrame:
        """All versions of the table's rows up to a transaction, with those staged as the next one's."""
        paths = [(b["path"], b.get("tx", m["tx"]), b.get("ts", m["ts"])) for m, b in self._batches(table) if upto is None or b.get("tx", m["tx"]) <= upto]
        paths.sort(key=lambda p: p[1])  # what retention kept stands for the transactions that it replaced
        stored = T.StructType([*table.schema.fields, META["_seq"], META["_deleted"]])
        now = datetime.datetime.now().isoformat()
        paths += [(b["path"], self.last_tx + 1, now) for b in staged if b["table"] == table.id]
        if not paths:
            empty = self.spark.createDataFrame([], T.StructType([*table.schema.fields, *META.fields]))
            return self._named(empty, table)
        df = self.spark.read.schema(stored).parquet(*[f"{self.path}/{p}" for p, _, _ in paths])
        known = self.spark.createDataFrame([(p.rsplit("/", 1)[1], i + 1, tx, datetime.datetime.fromisoformat(ts)) for i, (p, tx, ts) in enumerate(paths)], "_batch string, _part long, _tx long, _ts timestamp_ntz")
        batch = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        # as many rows as batches, so Catalyst can broadcast them while they are few
        joined = df.withColumn("_batch", batch).join(known, "_batch").withColumn("_seq", F.col("_part") * F.lit(1 << 40) + F.col("_seq"))
        return self._named(joined.select(*[f.name for f in table.schema.fields], "_tx", "_seq", "_ts", "_deleted"), table)

    @staticmethod
    def _named(df: DataFrame, table: Table) -> DataFrame:
        return df.select(*[F.col(c.stored or c.name).alias(c.name) for c in table.columns], "_tx", "_seq", "_ts", "_deleted")

    def _batches(self, table: Table) -> list[tuple[dict, dict]]:
        """Manifest and batch of each batch of the table whose files are there."""
        return [(m, b) for m in self.manifests for b in m["batches"] if b["table"] == table.id and b["path"] not in self.replaced]

    def truncate_before(self, tx: int) -> int:
        """Retention: deletes the files of earlier transactions whose rows have later versions or are deleted; a state at
        tx - 1 or later stays. The rows that stay are a batch of a new transaction, in the place of those that it drops;
        manifests and hashes stay. Files are deleted when that transaction is committed. Returns the batches dropped."""
        from kairolog.operators.temporal import between

        kept, dropped = [], []
        at = min(tx - 1, self.last_tx)
        for table in self.catalog.tables.values():
            old = [(m, b) for m, b in self._batches(table) if b.get("tx", m["tx"]) < tx]
            if not old or len(old) == 1 and "tx" in old[0][1]:
                continue  # nothing there, or dropped before
            live = between(self.log(table, upto=tx - 1), table.key).withColumn("_seq", F.lit(0)).withColumn("_deleted", F.lit(False))
            kept.append(self.stage(table, live) | {"tx": at, "ts": self.manifests[at - 1]["ts"]})
            dropped += [b["path"] for _, b in old]
        if dropped:
            self.commit(kept, metadata={"truncated_before": tx}, dropped=dropped)
            self._drop(dropped)
            for path in dropped:
                self.store.remove(path)
        return len(dropped)

    def verify(self) -> list[int]:
        """Transactions whose hash doesn't follow from the one before, or whose files aren't those that were committed."""
        bad, before = [], ""
        for name in self.store.names("tx"):
            m = self.store.read(f"tx/{name}")
            batches = [b for b in m["batches"] if b["path"] not in self.replaced]
            if linked_hash(before, m) != m["hash"] or any(b.get("sha256") and self._same(b) is False for b in batches):
                bad.append(m["tx"])
            before = m["hash"]
        return bad

    def _same(self, batch: dict) -> bool:
        try:
            return self._digest(batch["path"]) == batch["sha256"]
        except (PySparkException, Py4JJavaError):  # it is gone, or can't be read to the end
            return False
