"""Packing token sequences into windows by non-negative least squares over length combinations.

Documents give whole windows of their own and a rest shorter than the window. Rests are counted by length class (GRAIN
tokens) and by coarse class (COARSE to a window). All combinations of coarse classes that fill a window are enumerated,
and their repeat counts solve min |A x - h|, x >= 0, for the coarse histogram h (Lawson and Hanson's active sets: exact,
with no more combinations in use than classes). Counts are rounded down and then up by largest remainders, as far as
there are rests; each combination takes classes of GRAIN within its coarse ones whose sum fills the window. What is left
is solved again, residuals are packed greedily, class by class, and
what then would leave a window part empty is chained: laid end to end and cut at windows. The tail of the chain is cut
into powers of two, which need no padding.

The plan is made from a histogram of bounded size; a document finds its place in it by its rank within its class, from
prefix sums over slices of the input. No group of documents is ever gathered.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kairolog.llm.shared import SMALL_BATCHES, configured, saved, small, trim, workspace
from kairolog.llm.tokens import WordTokenizer, vocabulary_path

WINDOW, GRAIN, COARSE = 4096, 4, 16
#: Share of a window that a combination must fill; others are chained.
FILLED = 0.995
#: Times that what is left is solved again.
ROUNDS = 6
#: Documents tokenized at a time.
TOGETHER = 512
PLACES = pa.list_(pa.struct([(c, pa.int64()) for c in ("sequence", "place", "offset", "length")]))


def combinations(units: int, most: int | None = None) -> list[tuple[int, ...]]:
    """Classes of 1 to units that fill the window, the largest first."""
    most = most or units
    return [(a, *rest) for a in range(min(most, units), 0, -1) for rest in (combinations(units - a, a) if a < units else [()])]


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by active sets."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * a.shape[0]
    for _ in range(10 * a.shape[0]):
        gain = np.where(used, -np.inf, a.T @ (b - a @ x))
        if gain.max(initial=-np.inf) <= small:
            break
        used[gain.argmax()] = True
        while used.any():
            at = np.flatnonzero(used)
            free = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if free.min() > 0:
                x[:] = 0
                x[at] = free
                break
            down = at[free <= 0]
            step = min(1.0, (x[down] / np.maximum(x[down] - free[free <= 0], 1e-300)).min())
            x[at] += step * (free - x[at])
            used[at[(free <= 0) & (x[at] <= small)]] = False
            x[~used] = 0
    return x


@dataclass(frozen=True)
class Plan:
    """For each class: ends of rank ranges, and for each range its first sequence and place there; counts[c] rests of
    class c have a place, later ones are chained, in the order of classes. sequences: in use by combinations; solved:
    units that solved combinations place, of all; residual: of the first solution, as part of the histogram's length."""

    starts: list[np.ndarray]
    sequence: list[np.ndarray]
    place: list[np.ndarray]
    counts: np.ndarray
    sequences: int
    solved: int
    units: int
    residual: float


def plan(histogram: np.ndarray, filled: float = FILLED) -> Plan:
    """histogram[c - 1]: rests of class c."""
    units, left = len(histogram), np.append(0, histogram).astype(np.int64)  # by class from 1
    step = max(1, units // COARSE)
    coarse = units // step
    classes = np.arange(units + 1)
    coarse_of = np.minimum((classes + step // 2) // step, coarse)  # the nearest; 0: short ones, which fill what is left
    of_coarse = [classes[(coarse_of == p) & (classes > 0)] for p in range(coarse + 1)]
    least_of = [int(x[0]) if len(x) else 1 for x in of_coarse]
    chosen: list[tuple[list[int], int]] = []

    def take(combo: list[int], most: int) -> int:
        need = np.bincount(combo, minlength=units + 1)
        n = int(min(most, (left[need > 0] // need[need > 0]).min()))
        if n > 0:
            left[:] -= n * need
            chosen.append((combo, n))
        return n

    def fitting(parts: tuple[int, ...]) -> list[int] | None:
        """A class for each coarse one, so that they fill a window, short rests added; of those in best supply."""
        free, room, combo = left.copy(), units, []

        def add(c: int) -> None:
            nonlocal room
            free[c] -= 1
            room -= c
            combo.append(int(c))

        ahead = sum(p * step for p in parts)
        least = sum(least_of[p] for p in parts)
        for p in parts[:-2]:
            ahead, least = ahead - p * step, least - least_of[p]
            own = of_coarse[p]
            own = own[(free[own] > 0) & (own <= room - least)]
            if not len(own):
                return None
            off = np.abs(room - own - ahead)  # from where the later ones, at their middle, would end
            near = own[off <= max(step // 2, off.min())]
            add(near[free[near].argmax()])
        a, b = (of_coarse[p] for p in (parts[-2:] if len(parts) > 1 else (parts[0], 0)))
        a = a[(free[a] > 0) & (a <= room)]
        if len(parts) == 1:
            if not len(a):
                return None
            add(a[-1])
        else:
            b = b[(free[b] > 0) & (b <= room)]
            if not len(a) or not len(b):
                return None
            gap = room - a[:, None] - b[None, :]
            supply = np.minimum(free[a][:, None], free[b][None, :]) // np.where(a[:, None] == b[None, :], 2, 1)
            gap = np.where((gap < 0) | (supply < 1), units + 1, gap)
            good = gap <= max(gap.min(), (1 - filled) * units / 4)
            i, j = np.unravel_index(np.where(good & (gap <= units), supply, -1).argmax(), gap.shape)
            if gap[i, j] > units:
                return None
            add(a[i])
            add(b[j])
        short = of_coarse[0]
        while room:
            c = short[(short <= room) & (free[short] > 0)]
            if not len(c):
                break
            add(c[-1])
        return combo if units - room >= filled * units else None

    solved, residual = 0, 0.0
    columns = combinations(coarse)
    matrix = np.array([np.bincount(c, minlength=coarse + 1)[1:] for c in columns], float).T
    for turn in range(ROUNDS):
        wanted = np.bincount(coarse_of, left, coarse + 1)[1:]
        if not wanted.any():
            break
        x = least_squares(matrix, wanted)
        if turn == 0:
            residual = float(np.linalg.norm(matrix @ x - wanted) / np.linalg.norm(wanted))
        before = int(left @ classes)
        whole = np.floor(x + 1e-9).astype(np.int64)
        for counts, order in ((whole, np.argsort(-whole, kind="stable")), ((x > whole + 1e-9).astype(np.int64), np.argsort(whole - x, kind="stable"))):
            for i in order:
                n = int(counts[i])
                while n > 0 and (combo := fitting(columns[i])):
                    n -= take(combo, n)
        if int(left @ classes) == before:
            break
    solved = int(np.append(0, histogram) @ classes - left @ classes)
    for c in range(units, 0, -1):  # greedily: the largest rest, then each time the largest that fits
        while left[c]:
            free, room, combo = left.copy(), units, []
            while len(k := np.flatnonzero(free[: min(c, room) + 1])):
                combo.append(int(k[-1]))
                free[k[-1]] -= 1
                room -= int(k[-1])
            if units - room < filled * units or not take(combo, int(left[c])):
                break
    starts: list[list[int]] = [[] for _ in range(units)]
    sequence: list[list[int]] = [[] for _ in range(units)]
    place: list[list[int]] = [[] for _ in range(units)]
    counts, used = np.zeros(units, np.int64), 0
    for combo, n in chosen:
        for j, c in enumerate(combo):
            starts[c - 1].append(counts[c - 1])
            sequence[c - 1].append(used)
            place[c - 1].append(j)
            counts[c - 1] += n
        used += n
    arrays = lambda lists: [np.array(x, np.int64) for x in lists]
    return Plan(arrays(starts), arrays(sequence), arrays(place), counts, used, solved, int(np.append(0, histogram) @ classes), residual)


def cuts(start: int, length: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, length) of what lies at start in a chain of total tokens: windows, then powers of two."""
    out, end, full = [], start + length, total // window * window
    while start < end:
        if start < full:
            sequence, offset = divmod(start, window)
            stop = (sequence + 1) * window
        else:
            at, sequence, rest = full, full // window, total - full
            while at + (size := 1 << (rest.bit_length() - 1)) <= start:
                at, rest, sequence = at + size, rest - size, sequence + 1
            offset, stop = start - at, at + size
        n = min(end, stop) - start
        out.append((sequence, offset, n))
        start += n
    return out


def tokenized(docs: DataFrame, key: str, text: str, tokenizer: str, end: int, window: int, grain: int, ordinary: bool) -> DataFrame:
    """For each document its ids (16 bits each, where the vocabulary allows) and its place in its slice, a task's input:
    whole windows before it, and of its rest the class, rank and tokens before it in the class."""
    width = 2 if max(WordTokenizer.of(tokenizer).size - 1, end) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail, units = WordTokenizer.of(tokenizer, ordinary), struct.pack("<I", end), window // grain
        number, fulls, ranks, before = 0, 0, [0] * (units + 1), [0] * (units + 1)
        name = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                keys, texts, out = batch.column(0).slice(at, TOGETHER), batch.column(1).slice(at, TOGETHER).to_pylist(), []
                for raw in words.encode(texts):
                    ids = np.frombuffer(raw + tail, "<u4")
                    full, rest = divmod(len(ids), window)
                    c = -(-rest // grain)
                    out.append((name, number, len(ids), fulls, full, c, ranks[c], before[c], rest, ids.astype(f"<u{width}").tobytes()))
                    number += 1
                    fulls += full
                    ranks[c] += 1
                    before[c] += rest
                part = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.int64()) for x in part[:9]], pa.array(part[9], pa.binary())], names=["key", "slice", "number", "tokens", "fulls_before", "fulls", "class", "rank", "before", "rest", "ids"])
        words.forget()
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, slice long, number long, tokens long, fulls_before long, fulls long, class long, rank long, before long, rest long, ids binary")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 2, window: int = WINDOW, grain: int = GRAIN, ordinary: bool = False) -> DataFrame:
    """Pieces of all documents: key, start, length, doc_tokens, sequence_id, offset, ids (a binary of `width` bytes an
    id), width. Each id lies in one piece, a sequence's pieces leave no gap, and no sequence is longer than the window.
    A null text is empty and gives its end id; each of repeated rows is packed; an empty table gives no pieces."""
    spark, folder, path = docs.sparkSession, workspace(docs.sparkSession, "packing"), tokenizer or vocabulary_path()
    width = 2 if max(WordTokenizer.of(path).size - 1, end) < 1 << 16 else 4
    with configured(spark, SMALL_BATCHES):
        tokenized(docs, key, text, path, end, window, grain, ordinary).write.parquet(f"{folder}/tokens")
    tokens = spark.read.parquet(f"{folder}/tokens")
    narrow = tokens.drop("ids")
    # what lies before each slice, for each class (of whole windows: class -1)
    rests = narrow.filter("class > 0").groupBy("slice", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("t"))
    fulls = narrow.groupBy("slice").agg(F.sum("fulls").alias("n")).select("slice", F.lit(-1).cast("long").alias("class"), "n", F.lit(0).cast("long").alias("t"))
    to_here = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rests.unionByName(fulls)
    sums = saved(sums.select("slice", "class", "n", "t", *[F.coalesce(F.sum(c).over(to_here), F.lit(0)).alias(f"{c}_base") for c in "nt"]), f"{folder}/sums")
    totals = {r["class"]: (r["n"], r["t"]) for r in sums.groupBy("class").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()}  # a row for each class
    units = window // grain
    made = plan(np.array([totals.get(c, (0, 0))[0] for c in range(1, units + 1)]))
    own = totals.get(-1, (0, 0))[0]
    bases = sums.filter("class > 0").select("slice", "class", "n_base", "t_base")
    ranked = narrow.filter("class > 0").join(small(bases), ["slice", "class"]).select("slice", "number", "tokens", "rest", "class", (F.col("rank") + F.col("n_base")).alias("rank"), (F.col("before") + F.col("t_base")).alias("before"))
    # tokens before the first chained rest of each class, and where each class begins in the chain
    limit = F.get(F.lit(made.counts.tolist()), (F.col("class") - 1).cast("int"))
    firsts = {r["class"]: r["before"] for r in ranked.filter(F.col("rank") == limit).select("class", "before").collect()}
    chained = {c: totals[c][1] - first for c, first in sorted(firsts.items())}
    begins, total = {}, 0
    for c, n in chained.items():
        begins[c], total = total - firsts[c], total + n
    shared = spark.sparkContext.broadcast((made, begins))

    @F.arrow_udf("array<struct<sequence:long, place:long, offset:long, length:long>>")
    def placed(cls: pa.Array, rank: pa.Array, before: pa.Array, rest: pa.Array) -> pa.Array:
        made, begins = shared.value
        out: list = [None] * len(cls)
        k, r, at, lengths = cls.to_numpy() - 1, rank.to_numpy(), before.to_pylist(), rest.to_pylist()
        fits = r < made.counts[k]
        for c in np.unique(k):
            rows = np.flatnonzero((k == c) & fits)
            if len(rows):
                i = np.searchsorted(made.starts[c], r[rows], side="right") - 1
                for row, s, p in zip(rows.tolist(), (made.sequence[c][i] + r[rows] - made.starts[c][i]).tolist(), made.place[c][i].tolist(), strict=True):
                    out[row] = [{"sequence": s, "place": p, "offset": -1, "length": lengths[row]}]
        for row in np.flatnonzero(~fits).tolist():
            parts = cuts(at[row] + begins[int(k[row]) + 1], lengths[row], total, window)
            out[row] = [{"sequence": made.sequences + s, "place": 0, "offset": o, "length": n} for s, o, n in parts]
        return pa.array(out, PLACES)

    rest_start = F.col("tokens") - F.col("rest")
    # a table, else the plan asks Python for the places again in each branch and once more for the filter
    pieces = saved(ranked.withColumn("p", placed("class", "rank", "before", "rest")), f"{folder}/pieces")
    in_chain = F.get("p", 0)["offset"] >= 0
    one = pieces.filter(~in_chain).select("slice", "number", rest_start.alias("start"), F.col("rest").alias("length"), F.get("p", 0)["sequence"].alias("sequence"), F.get("p", 0)["place"].alias("place"))
    ahead = Window.partitionBy("sequence").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    piece = lambda start, length, sequence, offset: F.struct(start.alias("start"), length.alias("length"), sequence.alias("sequence_id"), offset.alias("offset"))
    one = one.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    one = one.select("slice", "number", F.array(piece(F.col("start"), F.col("length"), F.col("sequence") + own, F.col("offset"))).alias("pieces"))
    starts = lambda x, i: rest_start + F.aggregate(F.slice("p", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"])
    many = pieces.filter(in_chain).select("slice", "number", F.transform("p", lambda x, i: piece(starts(x, i), x["length"], x["sequence"] + own, x["offset"])).alias("pieces"))
    of_rest = one.unionByName(many)
    of_fulls = small(sums.filter("class = -1").select("slice", "n_base"))
    with_fulls = narrow.join(of_fulls, "slice").select("slice", "number", F.when(F.col("fulls") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("fulls") - 1, F.lit(0))), lambda i: piece(i * window, F.lit(window).cast("long"), F.col("n_base") + F.col("fulls_before") + i, F.lit(0).cast("long")))).alias("whole"))
    where = with_fulls.join(of_rest, ["slice", "number"], "left")
    where = where.select("slice", "number", F.concat(F.coalesce("whole", F.array().cast(of_rest.schema["pieces"].dataType)), F.coalesce("pieces", F.array().cast(of_rest.schema["pieces"].dataType))).alias("pieces"))
    joined = tokens.select("slice", "number", "key", "tokens", "ids").join(where, ["slice", "number"]).select("key", "tokens", "ids", F.explode("pieces").alias("x"))
    ids = F.substring(F.col("ids"), (F.col("x.start") * width + 1).cast("int"), (F.col("x.length") * width).cast("int"))
    return joined.select(F.col("key").alias(key), "x.start", "x.length", F.col("tokens").alias("doc_tokens"), "x.sequence_id", "x.offset", ids.alias("ids"), F.lit(width).alias("width"))


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array, width: pa.Array) -> pa.Array:
    """Of ids as little-endian unsigned 32-bit integers."""
    return pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").tobytes()) for x, w in zip(ids, width.to_pylist(), strict=True)], pa.int64())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digests(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(key, "start", "length", ids_crc32("ids", "width").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
