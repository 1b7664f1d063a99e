"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles are grouped in size bands. Within a band, every token is hashed to one of M segments, so that a
set is cut into M subsets. Sets of Jaccard >= 3/4 differ in at most d = (|r| + |s|) / 7 tokens, so in at most d
segments. Of each set the segments are ordered from the hottest (empty ones first) to the rarest, by one order for
all sets; if a pair agrees in at least M - d segments, its rarest agreeing segment is among the |r| / 3 + 1 rarest of
both. Only those, and SPARE more, are indexed, so a pair shares a known number of entries, and pairs with fewer need no
look. A band may take fewer segments instead, each with its one-deletion neighbourhood, which
tolerate one difference each: so d / 2 + 1 segments, rounded down, are enough. Each band takes what costs less.

Sets that share an index entry are candidates and are verified exactly, from their shingles. A first round verifies for
each document its best candidate; later only what lies in different components is left to verify, as only components
are asked for. Entries of few sets give pairs; entries of many give lists, whose members are looked at in blocks of
bounded size, each block against each other as arrays in one task, so no pair of a list is ever a row. An entry that
many documents of one block of input have goes to its bucket once for the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.llm.components import components
from kairolog.llm.shared import SMALL_BATCHES, ascii_lower, configured, released, removed, saved, small, trim, workspace
from kairolog.llm.shingles import mix, shingle_sets

#: Links need 100 * intersection >= 75 * union. The bounds above follow from this value.
PERCENT = 75
#: A shingle that so many of a task's documents have is reported as hot; so many of the hottest order the segments. They
#: steer what is indexed, not what is found.
HOT, HOTTEST = 4, 100_000
#: Documents whose entries are written together, and bytes of text whose entries fall in one bucket, about.
BLOCK, BUCKET = 4096, 6 << 20
#: Up to this size a group of sets with one entry gives all its pairs; beyond, its members with the first at once, and
#: the rest in blocks when components are known.
PAIRED = 8
#: Of a set's tokens, the part by which more segments are indexed than a pair needs to meet.
SPARE = 6
#: Documents, and their shingles, of a block that is verified against another.
BESIDE, SHINGLES = 256, 1 << 19
#: What an expected candidate costs against an index entry, in the choice of a band's way.
CANDIDATE = 8
#: Sets below 2 ** BANDS tokens have bands of their own.
BANDS = 40


@dataclass(frozen=True)
class Heat:
    """hashes ascending, with their counts; share: part of all shingle occurrences that is hot; warm: part that was
    reported too but has no place among the hottest, so that the order of segments doesn't know it."""

    hashes: np.ndarray
    counts: np.ndarray
    share: float
    warm: float = 0.0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[i] == hashes, self.counts[i], 0)


def bands(n: int) -> list[int]:
    """Of a set of n tokens: its own, and the one below if a partner can lie there."""
    own = n.bit_length() - 1
    return [own - 1, own] if own and -(-PERCENT * n // 100) < 1 << own else [own]


def allocation(band: int, heat: Heat) -> int:
    """Segments of a band, negative if each has its one-deletion neighbourhood. The cost is that of the entries of a
    set of middle size and of the candidates that they bring. Exact segments of a token each leave out the hottest, but
    meet by any warm token; with deletions no segment can be left out, but its other tokens must all be repeated ones."""
    n, most = 3 << band >> 1 if band else 1, (2 << band) - 1
    differ = (most + 100 * most // PERCENT) // 7
    whole, part = differ // 2 + 1, min(1, kept(n) / n)
    hot_left = max(0.0, heat.share - (1 - part)) / part
    exact = kept(n) * (1 + CANDIDATE * (hot_left + heat.warm))
    deletions = (n + whole) * (1 + CANDIDATE * (heat.share + heat.warm) ** max(1, n / whole - 1))
    return -whole if differ and deletions < exact else max(2, 2 << band)


def kept(n: int) -> int:
    """Segments of a set of n tokens that are indexed."""
    return n // 3 + 1 + n // SPARE


def entries(tokens: np.ndarray, heat: Heat, ways: dict[int, int]) -> np.ndarray:
    """The index entries of one set, as hashes."""
    n, out = len(tokens), []
    hot = heat.of(tokens)
    for band in bands(n) if n else ():
        if band not in ways:
            ways[band] = allocation(band, heat)
        way = ways[band]
        m, salt = abs(way), np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        segment = mix(tokens ^ salt) % np.uint64(m)
        order = np.argsort(segment, kind="stable")
        own = segment[order]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        worth = mix(tokens[order] + salt)
        sums = np.add.reduceat(worth, first)
        names = own[first]
        if way < 0:
            sizes = np.diff(np.append(first, n))
            out.append(mix(sums + mix(names ^ salt)))
            out.append(mix(np.repeat(sums, sizes) - worth + mix(own ^ salt)))
            if len(names) < m:  # empty segments: partners may hold one token more there
                out.append(mix(mix(np.setdiff1d(np.arange(m, dtype=np.uint64), names) ^ salt)))
            continue
        most = min(kept(n), m)
        marks = mix(sums + mix(names ^ salt))
        if most < len(marks):
            rare = np.lexsort((marks, np.minimum.reduceat(hot[order], first)))[:most]
            marks = marks[rare]
        elif most > len(marks):  # as few segments have a token, empty ones count too, from the first
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), names)[: most - len(marks)]
            marks = np.concatenate((marks, mix(mix(empty ^ salt))))
        out.append(marks)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def spare_of(least: str, most: str, ways: dict[int, int]) -> Column:
    """Entries that a set shares with any partner, at least: as the smaller of two, it has kept() and differs from one of
    4/3 its size in a third of its tokens; as the larger, the partner has the fewest entries. One less, for what rounding
    takes from sizes in between. One where deletions are indexed."""
    own = F.expr(f"{least} div 3 + 1 + {least} div {SPARE} - ({most} + {most} * 100 div {PERCENT}) div 7")
    low = f"(({PERCENT} * {least} + 99) div 100)"
    partner = F.expr(f"{low} div 3 + 1 + {low} div {SPARE} - ({low} + {most}) div 7")
    one = F.lit(1).cast("long")
    return F.when(F.expr(by_deletions(least, most, ways)), one).otherwise(F.greatest(one, F.least(own, partner) - 1))


def by_deletions(least: str, most: str, ways: dict[int, int]) -> str:
    """Whether a set of these sizes, or a partner of it, may lie in a band that indexes deletions."""
    return " or ".join(f"({most} >= {1 << b} and {least} < {4 << b})" for b, way in sorted(ways.items()) if way < 0) or "false"


def find_heat(texts: DataFrame) -> Heat:
    """The hottest shingles: each task counts its documents and reports those that HOT of them or more have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge() -> None:
            nonlocal hashes, counts, parts
            new, number = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            again = number >= 2  # of a part of the task
            both = np.concatenate((hashes, new[again]))
            order = np.argsort(both, kind="stable")
            both, number = both[order], np.concatenate((counts, number[again]))[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
            hashes, counts, parts = both[first], np.add.reduceat(number, first) if len(first) else number, []

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                parts += shingle_sets(batch.column(0).slice(at, 512).to_pylist())
                if sum(map(len, parts)) > 1 << 20:
                    total += sum(map(len, parts))
                    merge()
        total += sum(map(len, parts))
        merge()
        hot = counts >= HOT
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes[hot].view(np.int64), 0)), pa.array(np.append(counts[hot], 0)), pa.array([0] * int(hot.sum()) + [total])], names=["hash", "n", "total"])

    found = texts.mapInArrow(count, "hash long, n long, total long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    folder = workspace(texts.sparkSession, "heat")
    found = saved(found, f"{folder}/hot")
    total, reported = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = found.filter(F.col("n") > 2 * PAIRED).orderBy(F.desc("n"), "hash").limit(HOTTEST).toPandas()
    removed(texts.sparkSession, folder)
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hot = int(top["n"].sum())
    return Heat(hashes[order], top["n"].to_numpy(np.int64)[order], hot / max(total, 1), (reported - hot) / max(total, 1))


#: Set in a document's number within its block: the entry is that of others in the block too, and stands for them.
MANY = 1 << 15
LOW = np.uint64((1 << 48) - 1)


def _list_names(marks: np.ndarray, bucket: int) -> np.ndarray:
    """Of entries that are lists of their own, from what a bucket knows of an entry."""
    return mix((marks & LOW) ^ mix(np.array([bucket], np.uint64))).view(np.int64)


def _groups(*by: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    if not len(by[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(by[0]), bool)
    new[0] = True
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def indexed(texts: DataFrame, heat: Heat, ways: dict[int, int], buckets: int) -> DataFrame:
    """texts: node, digest, text. Rows (bucket, kind, content): entries of a block of documents that fall in a bucket
    (kind 0), the sizes of the block's sets (kind 1), and lists of the block's documents that have one entry, of which
    the bucket gets the first document's only (kind 2)."""
    shared = texts.sparkSession.sparkContext.broadcast((heat, ways))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heat, ways = shared.value

        def blocks() -> Iterator[tuple[np.ndarray, list[bytes], list[int], list[np.ndarray]]]:
            nodes: list[int] = []
            digests, sizes, marks = [], [], []
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    nodes += part.column(0).to_pylist()
                    digests += part.column(1).to_pylist()
                    for s in shingle_sets(part.column(2).to_pylist()):
                        sizes.append(len(s))
                        marks.append(entries(s, heat, ways))
                    if len(nodes) >= BLOCK:
                        yield np.array(nodes, "<i8"), digests, sizes, marks
                        nodes, digests, sizes, marks = [], [], [], []
            if nodes:
                yield np.array(nodes, "<i8"), digests, sizes, marks

        for nodes, digests, sizes, marks in blocks():
            of = np.repeat(np.arange(len(marks), dtype=np.uint16), [len(m) for m in marks])
            mark = np.concatenate(marks)
            marks.clear()
            bucket = ((mark >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((nodes[of], mark))  # so by bucket too
            mark, of, bucket = mark[order], of[order], bucket[order]
            first = _groups(mark)
            n = np.diff(np.append(first, len(mark)))
            several = np.repeat(n > PAIRED, n)
            several[first] = False
            rows = []
            for f, k in zip(first[n > PAIRED].tolist(), n[n > PAIRED].tolist(), strict=True):
                b = int(bucket[f])
                rows.append((b, 2, _list_names(mark[f : f + 1], b).tobytes() + nodes[of[f : f + k]].tobytes()))
            of[first[n > PAIRED]] |= MANY
            mark, of, bucket = mark[~several], of[~several], bucket[~several]
            cut = np.append(_groups(bucket), len(bucket))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                m = mark[x:y]  # 48 bits besides the bucket's tell entries apart; what they confuse is verified
                used, place = np.unique(of[x:y] & np.uint16(MANY - 1), return_inverse=True)
                place = place.astype("<u2") | (of[x:y] & np.uint16(MANY))
                head = np.array([len(used), len(m)], "<i8").tobytes()
                rows.append((int(bucket[x]), 0, head + nodes[used].tobytes() + place.astype("<u2").tobytes() + (m & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((m >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()))
            sized = b"".join(digests)
            rows.append((int(nodes[0]) % buckets, 1, np.array([len(sizes), 0], "<i8").tobytes() + nodes.tobytes() + np.array(sizes, "<i8").tobytes() + sized))
            del mark, of, bucket, order, several
            trim()
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "kind", "content"), r, strict=True)) for r in rows[i : i + 64]], pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("content", pa.binary())]))

    return texts.mapInArrow(run, "bucket long, kind int, content binary")


FOUND = "kind int, a long, b long, n long, star long, digest binary, list long, members array<long>"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("star", pa.int64()), ("digest", pa.binary()), ("list", pa.int64()), ("members", pa.list_(pa.int64()))])


def _found(kind: int, rows: int, **columns) -> pa.Table:
    arrays = [pa.array(np.full(rows, kind, np.int32))] + [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in list(FOUND_ARROW)[1:]]
    return pa.table(arrays, FOUND_ARROW)


def candidates_of(table: pa.Table) -> pa.Table:
    """Of one bucket. Kind 1: node a, digest, size n. Kind 2: a pair (a, b), a < b, that shares n entries of small groups
    and, a being their first, `star` of large ones. Kind 3: members of a list, that of n equal large groups, or (star 1)
    a part of that of one entry."""
    docs, marks, many, parts, own_lists, stars = [], [], [], [], [], []
    bucket = table["bucket"][0].as_py()
    for kind, raw in zip(table["kind"].to_pylist(), table["content"], strict=True):
        raw = raw.as_buffer()
        if kind == 2:
            name, *_ = np.frombuffer(raw, "<i8", 1).tolist()
            own = np.unique(np.frombuffer(raw, "<i8", -1, 8))
            own_lists.append((name, 1, 1, own))
            stars.append((own[0], own[1:]))
            continue
        k, m = np.frombuffer(raw, "<i8", 2).tolist()
        nodes = np.frombuffer(raw, "<i8", k, 16)
        at = 16 + 8 * k
        if kind:
            digests = raw.to_pybytes()[at + 8 * k :]
            w = len(digests) // max(k, 1)
            parts.append(_found(1, k, a=nodes, n=np.frombuffer(raw, "<i8", k, at), digest=[digests[i * w : (i + 1) * w] for i in range(k)]))
            continue
        place = np.frombuffer(raw, "<u2", m, at)
        docs.append(nodes[place & np.uint16(MANY - 1)])
        many.append(place >= MANY)
        marks.append(np.frombuffer(raw, "<u4", m, at + 2 * m).astype(np.uint64) | np.frombuffer(raw, "<u2", m, at + 6 * m).astype(np.uint64) << np.uint64(32))
    names, at_a, at_b = np.zeros(0, np.int64), [], []
    plain = 0
    if docs:
        names, doc = np.unique(np.concatenate(docs), return_inverse=True)
        mark, flag = np.concatenate(marks), np.concatenate(many)
        del docs, marks, many
        order = np.lexsort((doc, mark))
        doc, mark, flag = doc[order].astype(np.int32), mark[order], flag[order]
        first = _groups(mark)
        sizes = np.diff(np.append(first, len(mark)))
        listed = np.logical_or.reduceat(flag, first) if len(first) else np.zeros(0, bool)
        for g in range(2, PAIRED + 1):
            at = first[(sizes == g) & ~listed]
            for i, j in combinations(range(g), 2) if len(at) else ():
                at_a.append(doc[at + i])
                at_b.append(doc[at + j])
        plain = sum(map(len, at_a))
        equal: dict[bytes, list] = {}
        for i in np.flatnonzero((sizes > PAIRED) | listed & (sizes > 1)).tolist():
            own = np.unique(doc[first[i] : first[i] + sizes[i]])
            if listed[i]:
                own_lists.append((int(_list_names(mark[first[i] : first[i] + 1], bucket)[0]), 1, 1, names[own]))
            else:
                equal.setdefault(own.tobytes(), [own, 0])[1] += 1
            at_a.append(np.full(len(own) - 1, own[0], np.int32))
            at_b.append(own[1:])
        for own, n in equal.values():
            hashed = mix(names[own].view(np.uint64))
            own_lists.append((int((mix(hashed.sum(dtype=np.uint64)[None]) ^ np.bitwise_xor.reduce(hashed)).view(np.int64)[0]), n, 0, names[own]))
    pair_a = np.concatenate([names[np.concatenate(at_a)] if at_a else names[:0], *[np.full(len(b), a) for a, b in stars]])
    pair_b = np.concatenate([names[np.concatenate(at_b)] if at_b else names[:0], *[b for _, b in stars]])
    if len(pair_a):
        order = np.lexsort((pair_b, pair_a))
        a, b = pair_a[order], pair_b[order]
        start = _groups(a, b)
        n_plain = np.add.reduceat((order < plain).astype(np.int64), start)
        n_all = np.diff(np.append(start, len(a)))
        a, b = a[start], b[start]
        apart = a != b
        parts.append(_found(2, int(apart.sum()), a=a[apart], b=b[apart], n=n_plain[apart], star=(n_all - n_plain)[apart]))
    if own_lists:
        parts.append(_found(3, len(own_lists), list=[x[0] for x in own_lists], n=[x[1] for x in own_lists], star=[x[2] for x in own_lists], members=[x[3] for x in own_lists]))
    trim()
    return pa.concat_tables(parts) if parts else FOUND_ARROW.empty_table()


def _linked(met: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes with so many tokens in common are linked."""
    return (a > 0) & (b > 0) & (100 * met >= PERCENT * (a + b - met))


def shingles_of(texts: DataFrame) -> DataFrame:
    """texts: node, text. node, n (its shingles) and shingles (8 bytes each, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "n", "shingles"])
        trim()

    return texts.mapInArrow(run, "node long, n long, shingles binary")


def _blocks(nodes: DataFrame, by: str) -> DataFrame:
    """nodes: node, n, `by`. Adds block: nodes alike in `by`, BESIDE of them and SHINGLES of theirs at most, about; which,
    by the node's hash."""
    sizes = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("held"))
    slices = F.greatest(F.ceil(F.col("members") / BESIDE), F.ceil(F.col("held") / SHINGLES), F.lit(1))
    return nodes.join(sizes, by).withColumn("block", F.xxhash64(by, F.pmod(F.xxhash64("node"), slices))).drop("members", "held")


def verified(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Of the pairs (a, b) those whose sets have the Jaccard. sets: node, n, shingles. Nodes that stand in pairs with one
    another lie in blocks of the least node that each meets; a task gets the pairs of two blocks and each of their sets
    once, not once for each pair."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("with")).union(pairs.select("b", "a"))
    near = both.groupBy("node").agg(F.least(F.min("with"), F.col("node")).alias("least"))
    near = saved(near.join(sets.groupBy("node").agg(F.sum("n").alias("n")), "node"), f"{folder}/nodes")
    block = saved(_blocks(near, "least").select("node", "block"), f"{folder}/blocks")
    side = small(block)
    placed = pairs.select("a", "b").join(side.select(F.col("node").alias("a"), F.col("block").alias("x")), "a").join(side.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    placed = saved(placed.select("a", "b", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("unit")), f"{folder}/units")
    sent = placed.select(F.col("a").alias("node"), "unit").union(placed.select("b", "unit")).distinct()
    listed = placed.groupBy("unit").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))  # of two blocks at most
    rows = sets.join(small(saved(sent, f"{folder}/sent")), "node").select("unit", "node", "shingles", F.lit(None).cast(listed.schema["pairs"].dataType).alias("pairs"))
    rows = rows.unionByName(listed, allowMissingColumns=True)

    def check(table: pa.Table) -> pa.Table:
        known: dict[int, list] = {}
        for k, s in zip(table["node"].to_pylist(), table["shingles"], strict=True):
            if k is not None:
                known.setdefault(k, []).append(np.frombuffer(s.as_buffer(), "<u8"))
        a, b = [], []
        for listed in table["pairs"].to_pylist():
            for p in listed or ():
                for x in known.get(p["a"], ()):
                    for y in known.get(p["b"], ()):
                        if 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) and _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                            a.append(p["a"])
                            b.append(p["b"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("unit").applyInArrow(check, "a long, b long").distinct()


def met_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """For each set of xs and each of ys the tokens in common, as products of 0-1 matrices over the tokens of both."""
    x, y = np.concatenate(xs), np.concatenate(ys)
    of_x, of_y = np.repeat(np.arange(len(xs)), [len(s) for s in xs]), np.repeat(np.arange(len(ys)), [len(s) for s in ys])
    common = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), np.float32)  # whole numbers below 2 ** 24 in each part

    def sides(tokens: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        inside = common[at] == tokens if len(common) else np.zeros(len(tokens), bool)
        at, of = at[inside], of[inside]
        order = np.argsort(at, kind="stable")
        return at[order], of[order], np.searchsorted(at[order], np.arange(0, len(common) + width, width))

    (at_x, of_x, cut_x), (at_y, of_y, cut_y) = sides(x, of_x), sides(y, of_y)
    total = np.zeros(out.shape, np.int64)
    for i, low in enumerate(range(0, len(common), width)):
        a, b = np.zeros((len(xs), width), np.float32), np.zeros((len(ys), width), np.float32)
        a[of_x[cut_x[i] : cut_x[i + 1]], at_x[cut_x[i] : cut_x[i + 1]] - low] = 1
        b[of_y[cut_y[i] : cut_y[i + 1]], at_y[cut_y[i] : cut_y[i + 1]] - low] = 1
        total += (a @ b.T).astype(np.int64)
    return total


def beside(table: pa.Table) -> pa.Table:
    """Rows (unit, second, node, component, shingles) of some units: of each unit links between nodes of the first block
    and of the second (or within the one), enough to connect what their links connect."""
    a, b = [], []
    unit = table["unit"].to_numpy()
    order = np.argsort(unit, kind="stable")
    start = _groups(unit[order])
    second, node, component = (table[c].to_numpy() for c in ("second", "node", "component"))
    for rows in np.split(order, start[1:]):
        if len(np.unique(component[rows])) < 2:
            continue
        sides = [rows[second[rows] == k] for k in (0, 1)]
        sides[1] = sides[1] if len(sides[1]) else sides[0]
        sets = [[np.frombuffer(table["shingles"][int(i)].as_buffer(), "<u8") for i in side] for side in sides]
        sizes = [np.array([len(s) for s in x]) for x in sets]
        linked = _linked(met_counts(*sets), sizes[0][:, None], sizes[1][None, :])
        linked &= component[sides[0]][:, None] != component[sides[1]][None, :]
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = int(component[sides[0][i]]), int(component[sides[1][j]])
            if root(x) != root(y):  # components that are connected already need no other link
                up[root(y)] = root(x)
                a.append(int(node[sides[0][i]]))
                b.append(int(node[sides[1][j]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_in(lists: DataFrame, sets: DataFrame, folder: str, parts: int) -> DataFrame:
    """Links (a, b) between members of different components of one list. lists: list, node, component. Members lie in
    blocks of the least node that stands in a list with each; two blocks that a list has are a unit of work."""
    spark = lists.sparkSession
    low = lists.groupBy("list").agg(F.min("node").alias("low"))
    hubs = lists.join(low, "list").groupBy("node", "component").agg(F.min("low").alias("hub"))
    hubs = saved(hubs.join(sets.groupBy("node").agg(F.sum("n").alias("n")), "node"), f"{folder}/hubs")
    block = saved(_blocks(hubs, "hub").select("node", "component", "block"), f"{folder}/blocks")
    # the blocks of each list; of lists with the same blocks one is enough
    has = saved(lists.select("list", "node").join(block.select("node", "block"), "node").select("list", "block").distinct(), f"{folder}/has")
    same = has.groupBy("list").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("block")).alias("x"), F.bit_xor(F.xxhash64("block", F.lit(1))).alias("y"))
    one = has.join(same.groupBy("k", "x", "y").agg(F.min("list").alias("list")).select("list"), "list", "left_semi")
    other = one.select("list", F.col("block").alias("beside"))
    units = one.join(other, "list").filter("block <= beside").select("block", "beside").distinct()
    units = saved(units.withColumn("unit", F.xxhash64("block", "beside")), f"{folder}/units")
    sent = units.select("unit", "block", F.lit(0).alias("second")).union(units.filter("block <> beside").select("unit", "beside", F.lit(1)))
    sent = saved(block.join(sent, "block").select("unit", "second", "node", "component"), f"{folder}/sent")
    volume = sent.join(hubs.select("node", "n"), "node").agg(F.sum(F.col("n") * 8)).first()[0] or 0
    parts = max(parts, volume // BUCKET)
    rows = sets.join(small(sent), "node").select(F.pmod(F.xxhash64("unit"), F.lit(parts)).alias("part"), "unit", "second", "node", "component", "shingles")
    found = saved(rows.groupBy("part").applyInArrow(beside, "a long, b long").distinct(), f"{folder}/links")
    released(spark)
    return found


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_shingles, component_id (the least key reachable by links, its own included). A-Z are
    lower-cased; words are runs of other bytes than space and 0x09 to 0x0D. Null and empty texts have no shingles and no
    link; a row without a key is linked with nothing. Rows of one key are one node, linked if any of their texts is.
    Keys are whole numbers; other columns, whatever their names, aren't looked at. Equal texts are looked at once. An
    empty table gives no rows."""
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "jaccard")
    d = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.unhex(F.md5(ascii_lower(F.col("text")))))
    narrow = saved(d.select("node", "digest", F.octet_length("text").alias("size")), f"{folder}/digests")
    volume = narrow.agg(F.sum("size")).first()[0] or 0
    narrow = narrow.select("node", "digest")
    reps = narrow.filter("node is not null").groupBy("digest").agg(F.min("node").alias("first"))
    copies = saved(narrow.join(reps, "digest", "left").filter("node is null or node <> first").select("node", "digest").distinct(), f"{folder}/copies")
    gone = copies.filter("node is not null")
    texts = d.filter("node is not null").join(small(gone), ["digest", "node"], "left_anti").select("node", "digest", "text")
    with configured(spark, SMALL_BATCHES):
        heat = find_heat(d.select("text"))
    ways = {b: allocation(b, heat) for b in range(BANDS)}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, volume // BUCKET)
    found = indexed(texts, heat, ways, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(candidates_of, FOUND)
    with configured(spark, SMALL_BATCHES):
        found = saved(found, f"{folder}/found")
    released(spark)
    sizes = saved(found.filter("kind = 1").select("digest", F.col("n").alias("n_shingles"), F.col("a").alias("rep")).distinct(), f"{folder}/by-text")
    node_sizes = saved(sizes.groupBy(F.col("rep").alias("node")).agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")).withColumn("spare", spare_of("least", "most", ways)), f"{folder}/sizes")

    def possible(pairs: DataFrame, shared: str, left_out: str = "0") -> DataFrame:
        """Pairs whose sizes and shared entries (but those left out) allow a link: each has kept() of its segments, and all
        but one for each token by which they differ agree. Where deletions are indexed, one entry is enough."""
        a, b = (node_sizes.select(F.col("node").alias(x), F.col("least").alias(f"l{x}"), F.col("most").alias(f"m{x}"), F.col("spare").alias(f"s{x}")) for x in "ab")
        segments = lambda x: f"(l{x} div 3 + 1 + l{x} div {SPARE})"
        one = f"({by_deletions('la', 'ma', ways)}) or ({by_deletions('lb', 'mb', ways)})"
        need = f"CASE WHEN {one} THEN 1 ELSE greatest(1, least({segments('a')}, {segments('b')}) - (ma + mb) div 7 - {left_out}) END"
        return pairs.join(a, "a").join(b, "b").filter(f"100 * ma >= {PERCENT} * lb and 100 * mb >= {PERCENT} * la and {shared} >= {need}").select(*pairs.columns)

    pairs = saved(found.filter("kind = 2").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("star").alias("star")), f"{folder}/pairs")
    likely = possible(pairs.withColumn("all", F.col("n") + F.col("star")), "all")
    best = likely.groupBy("b").agg(F.max(F.struct("all", (-F.col("a")).alias("a")))["a"].alias("a")).select((-F.col("a")).alias("a"), "b")
    best = saved(best, f"{folder}/best")
    few = saved(possible(pairs.filter("n > 0"), "n", "(greatest(sa, sb) - 1)").select("a", "b"), f"{folder}/few")
    # Members of lists. A set shares at least `spare` entries with any partner, so it may leave all but one of these, the
    # largest lists first.
    listed = found.filter("kind = 3").select("list", "n", "star", "members")
    about = listed.groupBy("list").agg(F.max("star").alias("own"), F.sum("n").alias("n"), F.sum(F.size("members")).alias("all"), F.max(F.size("members")).alias("most_members"))
    about = about.select("list", F.when(F.col("own") == 1, 1).otherwise(F.col("n")).alias("n"), F.when(F.col("own") == 1, F.col("all")).otherwise(F.col("most_members")).alias("size"))
    in_list = listed.select("list", F.explode("members").alias("node")).distinct().join(about, "list").join(node_sizes.select("node", "spare"), "node")
    run = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("size"), "list"))
    in_list = saved(in_list.withColumn("run", run).filter("run >= spare").select("list", "node"), f"{folder}/lists")
    live = best.select(F.col("a").alias("node")).union(best.select("b")).union(few.select("a")).union(few.select("b")).union(in_list.select("node")).distinct()
    live = saved(live, f"{folder}/live")
    removed(spark, f"{folder}/found")
    with configured(spark, SMALL_BATCHES):
        sets = saved(shingles_of(texts.select("node", "text").join(small(live), "node", "left_semi").select("node", "text")), f"{folder}/sets")
    first = saved(verified(best, sets, f"{folder}/v1"), f"{folder}/first")
    labels = components(first, f"{folder}/first-components")
    released(spark)

    def labelled(x: DataFrame, of: str, name: str) -> DataFrame:
        return x.join(small(labels.select(F.col("node").alias(of), F.col("component").alias(name))), of, "left").withColumn(name, F.coalesce(name, of))

    left = labelled(labelled(few, "a", "x"), "b", "y").filter("x <> y").select("a", "b").join(best, ["a", "b"], "left_anti")
    links = saved(verified(saved(left, f"{folder}/left"), sets, f"{folder}/v2"), f"{folder}/second")
    labels = components(first.union(links), f"{folder}/second-components")
    in_list = labelled(in_list, "node", "component")
    mixed = in_list.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("list")
    mixed = saved(in_list.join(mixed, "list", "left_semi").select("list", "node", "component"), f"{folder}/mixed")
    links = first.union(links).union(links_in(mixed, sets, f"{folder}/v3", parts))
    labels = components(links, f"{folder}/components")
    by_text = sizes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = narrow.join(by_text, "digest", "left")
    released(spark)
    empty = F.coalesce(F.col("n_shingles"), F.lit(0)) == 0
    return out.select(F.col("node").cast(docs.schema[key].dataType).alias(key), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.when(empty | F.col("node").isNull(), F.col("node")).otherwise(F.col("component")).cast(docs.schema[key].dataType).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
