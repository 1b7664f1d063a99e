"""Token-ID files: independent zstandard frames, an index frame and a seek table, so that a reader decompresses only
the frames of the documents it is asked for.

A file is [frame]* [index frame] [seek table]. Frames hold ids as little-endian unsigned integers of `width` bytes,
documents one after the other, and end at a document where they can. The index frame is an Arrow stream of (key, n): a
document's key and number of ids. The seek table is the public seekable format's: a skippable frame with, for each
frame, its compressed size, its size and the low half of XXH64 of its content, then a footer.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.llm.shared import saved, workspace
from kairolog.llm.tokens import WordTokenizer, vocabulary_path

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids after which a frame ends at the next document, and at which it ends within one.
FRAME, LONGEST = 1 << 17, 1 << 20
LEVEL = 3


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file; it appears under its name only when it is whole, and a second attempt replaces the first."""

    def __init__(self, path: str, key_type: pa.DataType, width: int, attempt: int = 0):
        self.files, self.path = _store(path)
        self.part = f"{self.path}.{attempt}.part"
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.files.open_output_stream(self.part)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.width, self.key_type = width, key_type
        self.buffer, self.table, self.keys, self.counts = bytearray(), [], [], []

    def _frame(self, content: bytes) -> None:
        packed = self.zip.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.buffer += ids.astype(f"<u{self.width}").tobytes()
        while len(self.buffer) > LONGEST:
            self._frame(bytes(self.buffer[:LONGEST]))
            del self.buffer[:LONGEST]
        if len(self.buffer) >= FRAME:
            self._frame(bytes(self.buffer))
            self.buffer.clear()

    def close(self) -> None:
        if self.buffer:
            self._frame(bytes(self.buffer))
        sink = pa.BufferOutputStream()
        index = pa.table({"key": pa.array(self.keys, self.key_type), "n": pa.array(self.counts, pa.int64())}).replace_schema_metadata({"width": str(self.width)})
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        self._frame(sink.getvalue().to_pybytes())
        entries = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        self.files.move(self.part, self.path)


class TokenReader:
    """Reads documents of one file by place or key; checks each frame that it decompresses."""

    def __init__(self, path: str):
        files, inner = _store(path)
        self.file = files.open_input_file(inner)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", table))
        self.offsets = [0, *accumulate(x[0] for x in self.frames)]
        self.starts = [0, *accumulate(x[1] for x in self.frames[:-1])]
        self.unzip = zstandard.ZstdDecompressor()
        self.decompressed = 0
        index = pa.ipc.open_stream(self._frame(n - 1)).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.keys, self.counts = index["key"].to_pylist(), index["n"].to_pylist()
        self.begins = [0, *accumulate(self.counts)]
        self.last: tuple[int, bytes] = (-1, b"")

    def _frame(self, i: int) -> bytes:
        packed, size, check = self.frames[i]
        content = self.unzip.decompress(self.file.read_at(packed, self.offsets[i]), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        self.decompressed += 1
        return content

    def ids(self, place: int) -> np.ndarray:
        """Of the document at this place in the file."""
        low, high = self.begins[place] * self.width, self.begins[place + 1] * self.width
        parts, i = [], max(0, bisect.bisect_right(self.starts, low) - 1)
        while low < high:
            if self.last[0] != i:
                self.last = (i, self._frame(i))
            parts.append(self.last[1][low - self.starts[i] : high - self.starts[i]])
            low, i = self.starts[i] + self.frames[i][1], i + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}")

    def find(self, key) -> list[np.ndarray]:
        """Of the documents with this key, one after the other."""
        return [self.ids(i) for i, k in enumerate(self.keys) if k == key]


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int | None = 1, width: int = 4, ordinary: bool = False) -> DataFrame:
    """Tokenizes docs into files under folder (in a store that driver and executors share), in ascending key order
    from file to file; null keys come first, rows of one key in the order of their texts, null texts are empty. Every
    document gets the end id. Returns the manifest, a table beside the files: shard, path, documents, ids. An empty table has no files."""
    path, key_type = tokenizer or vocabulary_path(), pa.int64() if docs.schema[key].dataType.typeName() == "long" else None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, words, writer, n = TaskContext.get(), WordTokenizer.of(path, ordinary), None, 0
        tail = b"" if end is None else struct.pack("<I", end)
        name = f"{folder}/shard-{task.partitionId():07d}.tok"
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = TokenWriter(name, key_type or batch.schema.field(0).type, width, task.taskAttemptId())
            for k, raw in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + tail, "<u4")
                writer.add(k, ids)
                n += len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": name, "documents": len(writer.keys), "ids": n}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text)).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    return saved(rows.mapInArrow(write, "shard long, path string, documents long, ids long"), f"{folder}/manifest")


def read_tokens(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """key, start (ids of all documents before it, over all files) and ids, a binary of little-endian unsigned 32-bit
    integers, of every document, read from the files."""
    starts = manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, out, size = TokenReader(row["path"]), [], 0
                for i, k in enumerate(reader.keys):
                    ids = reader.ids(i).astype("<u4").tobytes()
                    out.append((k, row["base"] + reader.begins[i], ids))
                    size += len(ids)
                    if size > 4 * LONGEST or i + 1 == len(reader.keys):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["key", "start", "ids"])
                        out, size = [], 0

    shards = max(1, manifest.count())
    return starts.repartition(shards, "shard").mapInArrow(read, f"key {key_type}, start long, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = read_tokens(write_tokens(docs, workspace(spark, "tokens"), width=2))
    return rows.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
