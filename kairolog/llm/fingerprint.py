"""Document fingerprints from closed syncmers, with DataFrame functions only.

Words are hashed; an s-mer is S adjacent words, a k-mer K. A k-mer is an anchor if the smallest hash of its inner
s-mers is that of its first or last one: that depends on its own words alone, so an edit moves or changes only the
anchors that it touches. The fingerprint keeps each distinct anchor with its first word position; two fingerprints are
alike by the share of anchors that lie in both, at an offset that a neighbouring one has too.

Characters of scripts that don't put spaces between words are words each. A text of fewer than SHORT words also gives
the anchors of its characters, and only those if it has fewer than K words: so short texts, and texts without white
space, keep what an edit leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.llm.shared import free_name, saved, small, workspace

K, S = 5, 2
#: All anchors are kept: a bound would leave a long text with few of its own.
KEPT = None
#: Offsets that differ by so many words are one; an edit moves what follows it.
NEAR = 16
SCRIPTS = "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]"
#: Words below which a text also gives the anchors of its characters.
SHORT = 24
#: An anchor is one long: 32 bits of its hash over 31 bits of its position, which no text exceeds.
BITS = 31
HASH, PLACE = 0x7FFFFFFF80000000, 0x7FFFFFFF
#: Rows of a range of keys, about, and most ranges.
ROWS, RANGES = 2048, 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(HASH)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(PLACE)))


def _hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, BITS)


def anchors(text: Column) -> Column:
    """array<long>, ascending: the closed syncmers of the whole text, packed. Null and empty texts have none; a text of
    fewer than K characters besides white space has one, of the text itself."""
    words = F.filter(F.split(F.regexp_replace(text, f"({SCRIPTS})", " $1 "), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    single = F.filter(F.split(text, ""), lambda c: ~c.isin(*" \t\n\r\f\x0b", ""))

    def syncmers(h: Column) -> Column:
        n = F.size(h)
        return _let(F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)])), lambda s: chosen(h, s, n))

    def chosen(h: Column, s: Column, n: Column) -> Column:
        inner = K - S
        at = lambda i, j: F.get(s, i + j)
        edge = lambda i: (at(i, 0) <= F.least(*[at(i, j) for j in range(1, inner + 1)])) | (at(i, inner) < F.least(*[at(i, j) for j in range(inner)]))
        places = F.filter(F.sequence(F.lit(0), n - K), edge)
        return F.transform(places, lambda i: _packed(F.xxhash64(*[at(i, j) for j in range(0, inner + 1, S)], F.get(h, i + (K - 1))), i))

    none = F.array().cast("array<long>")
    found = lambda h: F.when(F.size(h) >= K, syncmers(h)).otherwise(none)
    of_words = lambda w: _let(F.transform(w, lambda x: F.xxhash64(x)), found)
    of_characters = _let(F.transform(single, lambda x: F.xxhash64(x, F.lit(1))), found)
    every = _let(words, lambda w: F.when(F.size(w) >= SHORT, of_words(w)).otherwise(F.concat(of_words(w), of_characters)))
    whole = F.array(_packed(F.xxhash64(text), F.lit(0)))
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(_let(F.sort_array(every), lambda x: F.when(F.size(x) == 0, whole).otherwise(x)))


def fingerprint(text: Column) -> Column:
    """array<long>, ascending: the distinct anchor hashes, each at its first place."""
    return _let(anchors(text), lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get(a, i - 1)))))


def as_text(fp: Column) -> Column:
    """`hash:place` in hexadecimal digits, joined by spaces; empty for no anchors."""
    return F.lower(F.array_join(F.transform(fp, lambda a: F.concat(F.hex(_hash_of(a)), F.lit(":"), F.hex(a.bitwiseAND(F.lit(PLACE))))), " "))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the hashes of both, the share that lies in both and follows or precedes another such one at an offset
    of places not more than NEAR from its own (a single one counts); 1 if neither has any."""
    sided = lambda x, side: F.transform(x, lambda v: F.shiftleft(v, 1).bitwiseOR(F.lit(side)))
    place = lambda v: F.shiftright(v, 1).bitwiseAND(F.lit(PLACE))
    second = lambda v: v.bitwiseAND(F.lit(1)) == 1
    shift = lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF))

    def pair(v: Column, w: Column) -> Column:
        """The place in a over the offset; null if these aren't the same anchor in a and in b."""
        packed = lambda x, y: F.shiftleft(place(x), 32).bitwiseOR(place(x) - place(y) + (PLACE + 1))
        return F.when(F.shiftright(v, BITS + 1) == F.shiftright(w, BITS + 1), F.when(second(v), packed(w, v)).otherwise(packed(v, w)))

    def scored(n: Column, p: Column) -> Column:
        close = lambda x, i: F.abs(shift(x) - shift(F.get(p, i))) <= NEAR
        chained = F.when(F.size(p) == 1, 1).otherwise(F.size(F.filter(p, lambda x, i: close(x, i - 1) | close(x, i + 1))))
        return F.when(n == 0, F.lit(1.0)).otherwise(chained / (n - F.size(p)))

    both = F.sort_array(F.concat(sided(a, 0), sided(b, 1)))
    pairs = lambda m: F.sort_array(F.filter(F.transform(m, lambda v, i: pair(v, F.get(m, i + 1))), lambda x: x.isNotNull()))
    return _let(both, lambda m: _let(pairs(m), lambda p: scored(F.size(m), p)))


def with_next(df: DataFrame, key: str, carried: list[str], rows: int = ROWS) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the row next in descending key (after the last: the first).
    Keys are of any type that has an order. Null keys come last; rows of one key follow in the order of a hash of the
    carried columns, then the columns. Keys and hashes are cut at every `rows`-th (RANGES ranges at most, whatever the
    keys' distribution); the first row of each range also goes, as a copy, to the end of the range before it."""
    spark = df.sparkSession
    at, part, copy, top, to, bounds = free_name(df, "_at", "_part", "_copy", "_top", "_to", "_bounds")
    df = df.withColumn(at, F.struct(F.col(key).alias("key"), F.xxhash64(*carried).alias("hash")))
    folder = workspace(spark, "ranges")
    keys = saved(df.select(at), f"{folder}/keys")
    every = max(rows, keys.count() // RANGES + 1)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within a partition, in its order
    cut = keys.repartitionByRange(parts, F.col(at).desc()).sortWithinPartitions(F.col(at).desc()).withColumn(part, number).filter(F.col(part) % every == every - 1).select(at)
    cut = saved(cut.distinct().agg(F.sort_array(F.collect_list(at), asc=False).alias(bounds)), f"{folder}/bounds")  # one row
    n = cut.select(F.size(bounds)).first()[0]
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]).cast("array<int>")
    later = lambda i, k: (i + k <= n) & (F.get(F.col(bounds), i + k - 1) > F.col(at))
    place = F.aggregate(steps, F.lit(0), lambda i, k: F.when(later(i, k), i + k).otherwise(i))  # bounds that come before
    placed = lambda x: x.join(F.broadcast(cut)).withColumn(part, place).drop(bounds)
    tops = placed(keys).groupBy(part).agg(F.max(at).alias(top))
    order = Window.orderBy(part)
    tops = saved(tops.select(top, F.coalesce(F.lag(part).over(order), F.max(part).over(Window.partitionBy())).alias(to)), f"{folder}/tops")
    copies = df.join(small(tops), df[at] == F.col(top)).drop(top).withColumnRenamed(to, part).withColumn(copy, F.lit(True))
    w = Window.partitionBy(part).orderBy(copy, F.col(at).desc(), *carried)
    all_rows = placed(df).withColumn(copy, F.lit(False)).unionByName(copies)
    return all_rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).filter(~F.col(copy)).drop(at, part, copy)


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key (of any ordered type), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Columns besides key and text aren't looked at. The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next text in
    descending key. Null texts are empty; repeated rows follow each other; an empty table gives no rows."""
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = with_next(d, key, ["text"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    d = d.select(key, "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - third), F.left("next_text", third)).alias("edited"))
    d = d.select(key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[fingerprint(F.col(c)).alias(f"fp_{c}") for c in ("text", "edited", "next_text")])
    return d.select(
        key, "n_chars", "edited_sha256", as_text(F.col("fp_text")).alias("fingerprint"), as_text(F.col("fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_text"), F.col("fp_next_text")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
