"""Repeats across documents by suffix arrays with two-stage sorting.

Every 50-byte string of a document belongs to the 16-gram of least hash in it; the strings in a row that share that
occurrence make a segment. Segments go to buckets by that 16-gram's hash, so equal 50-byte strings meet in one bucket.
There one suffix array is built over the distinct segments: suffixes smaller than their successors are sorted
directly, the others are induced by scanning the buckets of first bytes; adjacent common prefixes of 50 bytes then give
the groups of equal strings, and each group's least key tells which copies go.

A first pass exchanges only the 16-grams of each block, a few bytes each, and learns which of them two documents have;
the second pass sends the segments of those. A segment that occurs again within a block of documents goes to its bucket
once, with its least key; for the others the block already knows an earlier copy. So a passage in very many documents
costs one segment a block. A 16-gram of very many blocks, in changing surroundings, is hot: its segments are cut by
where in a string the 16-gram lies, and go by the 45 bytes that the strings of such a piece share. A task takes the
segments of its bucket in parts of about PART bytes, which end between 16-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm.shared import released, removed, saved, trim, workspace
from kairolog.llm.shingles import mix

#: Bytes of a string that must not repeat, and of the grams whose least hash places it.
LENGTH, GRAM = 50, 16
#: Bytes of a block, a bucket and a part of a long text, about.
BLOCK, BUCKET = 2 << 20, 8 << 20
#: Bytes of a bucket's segments that are sorted at a time, about.
PART = 1 << 20
#: A 16-gram of so many blocks is hot, where a block that has it MANY times or more counts as so many; so many of the
#: hottest are known to all tasks. They steer where segments go, not what is found. PLACES of the 16-gram in a string make
#: a piece.
HOT_BLOCKS, MANY, HOTTEST, PLACES = 512, 8, 100_000, 6
#: Suffixes are sorted to this depth in 8-byte words; no segment has a longer string in question.
WORDS = 7
EXPANSION = 3.4
BASE = 0x9E3779B97F4A7C15


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), f"{order}u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes of text (unsigned bytes) in order, to a depth of 8 * WORDS bytes at least."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    step = np.append(np.sign(np.diff(text.astype(np.int16))), -1).astype(np.int8)
    unlike = np.flatnonzero(step).astype(np.int32)
    smaller = np.repeat(step[unlike] > 0, np.diff(unlike, prepend=-1))  # than the successor
    words = np.append(_words(text, ">"), np.zeros(8 * WORDS, np.uint64))
    direct = np.flatnonzero(smaller).astype(np.int32)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.append(False, words[direct[1:]] != words[direct[:-1]]), dtype=np.int32) if len(direct) else direct
    for j in range(1, WORDS):
        alike = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(alike, False) | np.append(False, alike)) if len(direct) else direct
        if not len(tied):
            break
        own, key = direct[tied], words[direct[tied] + 8 * j]
        order = np.lexsort((key, group[tied]))
        direct[tied] = own[order]
        key, g = key[order], group[tied]
        news = np.zeros(len(group), np.int32)
        news[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(news, dtype=np.int32)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    head = ends - sizes
    out = np.empty(n, np.int32)
    n_direct = np.bincount(text[direct], minlength=256)
    stop = ends - n_direct  # of the part of each first byte that is induced
    at = np.repeat(stop - (np.cumsum(n_direct) - n_direct), n_direct) + np.arange(len(direct))
    out[at] = direct

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            counts = np.bincount(first, minlength=256)
            rank = np.arange(len(before)) - np.repeat(np.cumsum(counts) - counts, counts)
            out[head[first] + rank] = before
            head[:] += counts

    last = text[n - 1]
    out[head[last]] = n - 1  # it is followed by the end, which is smaller than any byte
    head[last] += 1
    for c in np.flatnonzero(sizes).tolist():
        low = ends[c] - sizes[c]
        while low < head[c]:  # what is induced within the bucket follows
            low, now = head[c], out[low : head[c]].copy()
            induce(now)
        induce(out[stop[c] : ends[c]])
    return out


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Of each suffix with the one before it (the first: 0): bytes in common, at most limit."""
    out = np.zeros(len(suffixes), np.int32)
    words = np.append(_words(text, ">"), np.zeros(limit + 8, np.uint64))
    live = np.arange(1, len(suffixes), dtype=np.int32)
    for j in range(0, limit, 8):
        unlike = words[suffixes[live] + j] ^ words[suffixes[live - 1] + j]
        same = unlike == 0
        bits = np.frexp(unlike[~same].astype(np.float64))[1]  # may round up to a power of two: corrected
        bits -= (unlike[~same] >> np.minimum(np.maximum(bits - 1, 0), 63).astype(np.uint64)) == 0
        out[live[~same]] = np.minimum(j + (64 - bits) // 8, limit)
        live = live[same]
    out[live] = limit
    room = len(text) - np.maximum(suffixes, np.append(np.int32(-1), suffixes[:-1]))
    return np.minimum(out, room)


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts at starts in data: each segment's text, first and last string (places in data), the hash of its
    16-gram and where that lies."""
    nothing = np.zeros(0, np.int32)
    own = np.maximum(sizes - LENGTH + 1, 0)
    if not own.sum():
        return nothing, nothing, nothing, np.zeros(0, np.uint64), nothing
    words = _words(data, "<")
    grams = words[: len(data) - GRAM + 1] * np.uint64(BASE)
    grams ^= mix(words[8 : len(data) - GRAM + 9])
    del words
    grams = mix(grams)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, wide = LENGTH - GRAM + 1, 1
    while wide * 2 <= width:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    place = (least & low).astype(np.int32)
    del least
    texts = np.repeat(np.arange(len(starts), dtype=np.int32), own)
    strings = np.arange(len(texts), dtype=np.int32) + np.repeat((starts - np.cumsum(own) + own).astype(np.int32), own)
    p = place[strings]
    first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (texts[1:] != texts[:-1]))))
    last = np.append(first[1:], len(strings)) - 1
    return texts[first], strings[first], strings[last], grams[p[first]], p[first]


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each piece's bytes."""
    words = np.append(_words(data, "<"), np.zeros(256, np.uint64))
    h = mix(size.astype(np.uint64))
    for j in range(0, int(size.max(initial=0)), 8):
        rest = np.clip(size - j, 0, 8)
        w = words[begin + j]
        w = np.where(rest == 8, w, w & ((np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1)))
        h = np.where(rest > 0, mix(h ^ w) + np.uint64(0x9E3779B97F4A7C15), h)
    return h


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> None:
    """Raises if the pieces at a and b, which have one hash, differ in a byte."""
    words = np.append(_words(data, "<"), np.zeros(256, np.uint64))
    for j in range(0, int(size.max(initial=0)), 8):
        rest = np.clip(size - j, 0, 8).astype(np.uint64)
        unlike = (words[a + j] ^ words[b + j]) << (np.uint64(8) * (np.uint64(8) - np.maximum(rest, np.uint64(1))))
        if (unlike[rest > 0] != 0).any():
            raise RuntimeError("two segments with one hash")


def _cuts(*by: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    n = len(by[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), n)


def _runs(segment: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive strings in one segment: indices of each run's first and last."""
    first = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (string[1:] != string[:-1] + 1))))
    return first, np.append(first[1:], len(segment)) - 1


ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("content", pa.binary())])
SPANS = pa.schema([("node", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Texts (node, tag, text) in blocks: of each part its node and tag, what turns a place in the block into one in its
    text, the block's bytes, and the parts' sizes. Long texts lie in several parts, which share all but one byte of a
    string."""
    names: list[tuple[int, int, int]] = []
    parts: list[bytes] = []
    size = 0

    def block():
        table, sizes = np.array(names, np.int64).reshape(-1, 3), np.array([len(p) for p in parts])
        return table[:, 0], table[:, 1], table[:, 2] - (np.cumsum(sizes) - sizes), b"".join(parts), sizes

    for batch in batches:
        for node, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK):
                names.append((node, tag, at))
                parts.append(raw[at : at + BLOCK + LENGTH - 1])
                size += len(parts[-1])
                if size >= BLOCK:
                    yield block()
                    names, parts, size = [], [], 0
    if parts:
        yield block()


def _segments_of(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    return segments(np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes, sizes)


def _placed(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a 16-gram, and the number that tells it apart there (others with it only cost time)."""
    h = mix(gram)
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), h & np.uint64(0xFFFFFFFF)


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of their places, which compresses well."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.uint64))


ASKED = "bucket long, part long, block long, content binary"
ANSWERS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("bucket", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("hot", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64()))])
ANSWERED = "part long, block long, bucket long, check long, bits binary, hot array<long>, blocks array<long>"


def asked(texts: DataFrame, buckets: int) -> DataFrame:
    """First pass: the distinct 16-grams of each block, by bucket, and which of them two nodes of the block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        for number, (node, _, _, raw, sizes) in enumerate(_blocks(batches)):
            text, _, _, gram, _ = _segments_of(raw, sizes)
            bucket, value = _placed(gram, buckets)
            order = np.lexsort((node[text], value, bucket))
            b, v, n = bucket[order], value[order], node[text][order]
            if not len(b):
                continue
            cut = _cuts(b, v)
            first, last = cut[:-1], cut[1:] - 1
            several, many = n[first] != n[last], last - first >= MANY - 1
            b, v = b[first], v[first]
            cut = _cuts(b)
            rows = [(int(b[x]), part, number, zip_.compress(np.array([y - x], "<i8").tobytes() + np.packbits(several[x:y]).tobytes() + np.packbits(many[x:y]).tobytes() + _planes(v[x:y]))) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["bucket", "part", "block", "content"])

    return texts.mapInArrow(run, ASKED)


def answered(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block a bit for each of its 16-grams, whether two nodes have it; check tells the list. With
    the first block, the bucket's hot 16-grams and how many blocks have each."""
    unzip, values, flags, many = zstandard.ZstdDecompressor(), [], [], []
    for packed in table["content"].to_pylist():
        raw = unzip.decompress(packed)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        bits = -(-n // 8)
        flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8))[:n].astype(bool))
        many.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8 + bits))[:n].astype(bool))
        values.append(_from_planes(raw[8 + 2 * bits :]))
    every, place, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[place[np.concatenate(flags)]] = True
    out, at = [], 0
    for v in values:
        out.append((zlib.crc32(v.tobytes()), np.packbits(shared[place[at : at + len(v)]]).tobytes()))
        at += len(v)
    count = count + (MANY - 1) * np.bincount(place[np.concatenate(many)], minlength=len(every))
    hot = count >= HOT_BLOCKS
    lists = [every[hot].astype(np.int64).tolist(), count[hot].tolist()]
    none: list = [[]] * (len(out) - 1)
    return pa.table({"part": table["part"], "block": table["block"], "bucket": table["bucket"], "check": pa.array([c for c, _ in out], pa.int64()), "bits": pa.array([b for _, b in out], pa.binary()), "hot": pa.array([lists[0], *none], pa.list_(pa.int64())), "blocks": pa.array([lists[1], *none], pa.list_(pa.int64()))}, ANSWERS)


def _named(bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
    return bucket << np.uint64(32) | value


def _pieces(data: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of hot 16-grams, cut so that in all strings of a piece the 16-gram lies at one of PLACES places: which
    segment, first and last string, and the hash of what all strings with the 16-gram there share."""
    low, high = (place - last) // PLACES, (place - first) // PLACES
    n = high - low + 1
    of = np.repeat(np.arange(len(n)), n)
    w = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
    begin = np.maximum(first[of], place[of] - w * PLACES - (PLACES - 1))
    end = np.minimum(last[of], place[of] - w * PLACES)
    shared = _hashes(data, place[of] - w * PLACES, np.full(len(of), LENGTH - PLACES + 1))
    return of, begin, end, mix(shared ^ mix(w.astype(np.uint64)))


def dealt(texts: DataFrame, buckets: int, answers: str, hot: np.ndarray) -> DataFrame:
    """Second pass. Rows (bucket, kind, content): segments of a block (kind 0) whose 16-gram two nodes have, by the table
    of answers (where it has none for a block, as if its rows came in another order, all go); and spans that the block
    itself knows to repeat (kind 1). hot: names of hot 16-grams, ascending."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, part, hot = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), shared.value
        files, inner = pafs.FileSystem.from_uri(answers)
        folder = f"{inner}/p={part}"
        known_bits = {}
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            for batch in pads.dataset(folder, filesystem=files, format="parquet").to_batches(columns=["block", "bucket", "check", "bits"]):
                known_bits.update({(r["block"], r["bucket"]): (r["check"], r["bits"]) for r in batch.to_pylist()})
        for number, (node, tag, base, raw, sizes) in enumerate(_blocks(batches)):
            text, first, last, gram, place = _segments_of(raw, sizes)
            if not len(text):
                continue
            data = np.frombuffer(raw, np.uint8)
            bucket, value = _placed(gram, buckets)
            order = np.lexsort((value, bucket))
            b, v = bucket[order], value[order]
            cut = _cuts(b, v)
            lead = np.zeros(len(b), bool)
            lead[cut[:-1]] = True
            b, v = b[lead], v[lead]
            asked_for = np.ones(len(b), bool)
            cut = _cuts(b)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                check, bits = known_bits.get((number, int(b[x])), (None, None))
                if check == zlib.crc32(v[x:y].tobytes()):
                    asked_for[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8))[: y - x]
            keep = np.sort(order[asked_for[np.cumsum(lead) - 1]])
            if not len(keep):
                continue
            text, first, last, place, bucket, value = text[keep], first[keep], last[keep], place[keep], bucket[keep], value[keep]
            is_hot = np.isin(_named(bucket, value), hot) if len(hot) else np.zeros(len(keep), bool)
            if is_hot.any():
                h = np.flatnonzero(is_hot)
                of, begin, end, name = _pieces(data, first[h], last[h], place[h])
                hot_bucket, hot_value = _placed(name, buckets)
                rest = ~is_hot
                text, first, last = np.append(text[rest], text[h][of]), np.append(first[rest], begin), np.append(last[rest], end)
                bucket, value = np.append(bucket[rest], hot_bucket), np.append(value[rest], hot_value)
            key, size = node[text], last - first + LENGTH
            content = _hashes(data, first, size)
            order = np.lexsort((key, content))
            cut = _cuts(content[order])
            n = np.diff(cut)
            one = np.repeat(order[cut[:-1]], n)
            _alike(data, first[order], first[one], size[order])
            least = key[one]
            # of equal segments those with the least key go to find out; for the others the block knows an earlier copy
            known, sent = order[key[order] > least], order[key[order] == least]
            rows = []
            if len(known):
                known = known[np.lexsort((last[known], first[known]))]
                t, start, end = text[known], first[known], last[known] + LENGTH
                new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (start[1:] > end[:-1]))))
                stop = np.append(new[1:], len(t)) - 1
                spans = np.stack((node[t[new]], tag[t[new]], start[new] + base[t[new]], end[stop] - start[new]), 1)
                rows.append((number % buckets, 1, zip_.compress(spans.astype("<i8").tobytes())))
            sent = sent[np.lexsort((first[sent], value[sent], bucket[sent]))]
            cut = _cuts(bucket[sent])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                mine = sent[x:y]
                used, t = np.unique(text[mine], return_inverse=True)
                head = np.array([len(used), len(mine)], "<i8").tobytes() + np.stack((node[used], tag[used]), 1).astype("<i8").tobytes()
                starts = (first[mine] + base[text[mine]]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
                own = b"".join([raw[i:j] for i, j in zip(first[mine].tolist(), (last[mine] + LENGTH).tolist(), strict=True)])
                rows.append((int(bucket[mine[0]]), 0, zip_.compress(head + t.astype("<u4").tobytes() + starts + size[mine].astype("<u1").tobytes() + (value[mine] >> np.uint64(24)).astype("<u1").tobytes() + own)))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r, strict=True)) for r in rows[i : i + 64]], ROWS)

    return texts.mapInArrow(run, "bucket long, kind int, content binary")


def repeats_of(table: pa.Table) -> pa.Table:
    """Of one bucket: the spans of each text (node, tag) whose 50-byte strings lie in a text of a smaller node."""
    unzip = zstandard.ZstdDecompressor()
    out, blocks = [], []
    held = np.zeros(256, np.int64)  # bytes by the top byte of the 16-gram's number
    for kind, packed in zip(table["kind"].to_pylist(), table["content"], strict=True):
        raw = unzip.decompress(packed.as_buffer())
        if kind:
            out.append(np.frombuffer(raw, "<i8").reshape(-1, 4))
            continue
        k, m = np.frombuffer(raw, "<i8", 2).tolist()
        names = np.frombuffer(raw, "<i8", 2 * k, 16).reshape(-1, 2)
        at = 16 + 16 * k
        size, top = np.frombuffer(raw, "<u1", m, at + 12 * m).astype(np.int32), np.frombuffer(raw, "<u1", m, at + 13 * m)
        blocks.append((names, np.frombuffer(raw, "<u4", m, at), np.frombuffer(raw, np.uint8, 8 * m, at + 4 * m).reshape(8, m), size, top, np.frombuffer(raw, np.uint8, -1, at + 14 * m), np.append(0, np.cumsum(size))))
        held += np.bincount(top, size, 256).astype(np.int64)
    edges, room = [0], PART
    for b in range(256):
        if held[b] > room and b > edges[-1]:
            edges.append(b)
            room = PART
        room -= held[b]
    for low, high in zip(edges, [*edges[1:], 256], strict=True):
        taken = []
        for names, of, starts, size, top, content, ends in blocks:
            i, j = np.searchsorted(top, [low, high]).tolist()
            if i < j:
                taken.append((names[of[i:j], 0], names[of[i:j], 1], starts[:, i:j].T.copy().view("<i8").ravel(), size[i:j], content[ends[i] : ends[j]]))
        if taken:
            node, tag, start, size, content = map(np.concatenate, zip(*taken, strict=True))
            out.append(_found(node, tag, start, size, (np.cumsum(size) - size).astype(np.int32), content))
    del blocks
    trim()
    spans = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    return pa.table({name: spans[:, i] for i, name in enumerate(SPANS.names)}, SPANS)


def _found(node, tag, start, size, begin, data) -> np.ndarray:
    content = _hashes(data, begin, size)
    order = np.lexsort((node, content))
    cut = _cuts(content[order])
    one = order[cut[:-1]]  # of each distinct segment the copy of the least node
    copies = np.diff(cut)
    _alike(data, begin[order], begin[np.repeat(one, copies)], size[order])
    of = np.empty(len(node), np.int32)  # each copy's distinct segment
    of[order] = np.repeat(np.arange(len(one), dtype=np.int32), copies)
    del content, order
    n = size[one]
    base = (np.cumsum(n + 1) - n - 1).astype(np.int32)  # a zero ends each; bytes are raised by one, as UTF-8 has no 0xFF
    text = np.zeros(int((n + 1).sum()), np.uint8)
    shift = np.repeat(begin[one] - (np.cumsum(n) - n).astype(np.int32), n)
    inside = np.ones(len(text), bool)
    inside[base + n] = False
    text[inside] = data[shift + np.arange(len(shift), dtype=np.int32)] + np.uint8(1)
    segment = np.repeat(np.arange(len(one), dtype=np.int32), n + 1)
    whole = np.arange(len(text), dtype=np.int32) - base[segment] <= n[segment] - LENGTH  # strings that lie in their segment
    suffixes = suffix_array(text)
    common = common_prefixes(text, suffixes, LENGTH)
    valid = whole[suffixes]
    new = ~((common >= LENGTH) & valid & np.append(False, valid[:-1]))
    del common, valid, whole
    least = np.minimum.reduceat(node[one][segment[suffixes]], np.flatnonzero(new))
    earliest = np.empty(len(text), np.int64)
    earliest[suffixes] = least[np.cumsum(new) - 1]
    del suffixes, segment, new
    # each copy's strings against the earliest node that has them
    strings = size - LENGTH + 1
    copy = np.repeat(np.arange(len(node), dtype=np.int32), strings)
    inner = np.arange(len(copy), dtype=np.int32) - np.repeat((np.cumsum(strings) - strings).astype(np.int32), strings)
    gone = earliest[base[of[copy]] + inner] < node[copy]
    copy, inner = copy[gone], inner[gone]
    if not len(copy):
        return np.zeros((0, 4), np.int64)
    first, last = _runs(copy, inner)
    c = copy[first]
    return np.stack((node[c], tag[c], start[c] + inner[first], inner[last] - inner[first] + LENGTH), 1).astype(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) spans as maximal disjoint (start, end) runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], start + length))
        else:
            out.append((start, start + length))
    return out


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, bytes (of the text in UTF-8; null: none), spans (start and end of each maximal removed run)
    and kept, the remaining bytes. Removed is each byte of a 50-byte string that also starts in a row with a smaller
    key; columns besides these two aren't looked at. Rows of one key don't count against each other; a row without a key is kept whole and counts against none.
    Keys are whole numbers. An empty table stays so."""
    spark = docs.sparkSession
    d = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("tag", F.xxhash64("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * EXPANSION / BUCKET))
    folder = workspace(spark, "repeats")
    texts = d.filter("node is not null").select("node", "tag", F.col("text").cast("binary").alias("text"))
    replies = asked(texts, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answered, ANSWERED)
    replies.withColumn("p", F.col("part")).repartition("p").write.partitionBy("p").parquet(f"{folder}/answers")
    hot = spark.read.schema("bucket long, hot array<long>, blocks array<long>").parquet(f"{folder}/answers").filter(F.size("hot") > 0).select("bucket", F.explode(F.arrays_zip("hot", "blocks")).alias("x"))
    top = hot.select("bucket", "x.hot", "x.blocks").orderBy(F.desc("blocks"), "bucket", "hot").limit(HOTTEST).toPandas()
    names = _named(top["bucket"].to_numpy(np.int64).view(np.uint64), top["hot"].to_numpy(np.int64).view(np.uint64))
    released(spark)
    rows = dealt(texts, buckets, f"{folder}/answers", np.sort(names))
    spans = rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(repeats_of, "node long, tag long, start long, length long")
    spans = saved(spans, f"{folder}/spans")
    removed(spark, f"{folder}/answers")
    released(spark)
    per_text = spans.groupBy("node", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for raw, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = raw.as_buffer().to_pybytes()
                own = merged([(x["start"], x["length"]) for x in found or ()])
                at, rest = 0, []
                for start, end in own:
                    rest.append(raw[at:start])
                    at = end
                rest.append(raw[at:])
                sizes.append(len(raw))
                runs.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["node", "bytes", "spans", "kept"])

    joined = d.join(per_text, ["node", "tag"], "left").select("node", F.col("text").cast("binary").alias("text"), "spans")
    out = joined.mapInArrow(cut, "node long, bytes long, spans array<struct<start:long, end:long>>, kept binary")
    return out.select(F.col("node").cast(docs.schema[key].dataType).alias(key), "bytes", "spans", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", F.col("bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
