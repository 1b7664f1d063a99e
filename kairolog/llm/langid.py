"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient
descent in numpy, with calibrated rejection.

A text's letters are lower-cased, everything else becomes one space; its character 2-, 3- and 4-grams are hashed to
embeddings, whose mean goes through a linear layer. As both are linear, a trained model is one table of class scores
for each hash, and a whole text's scores are their mean over all its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm.shared import aside, free_name, own, trim

GRAMS = (2, 3, 4)
BITS, WIDTH = 15, 16
UNKNOWN = "und"
#: The fit's sample: rows that are drawn by hash, at most so many of each language, and of each of these windows of so
#: many characters. Nothing else is bounded.
DRAWN, OF_EACH, WINDOWS = 12_000, 500, (400, 200, 80, 30)
EPOCHS, BATCH, RATE = 4, 32, 1.0
#: Share of the calibration windows, right ones, that the rejection may cost.
REJECTED = 0.001
MADE = ("lang_pred", "score", "rejected")
#: Texts handled at a time.
TOGETHER = 256
#: Characters handled at a time; longer texts in parts that overlap by the longest n-gram.
PART = 1 << 17

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    if not _tables:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(low) if len(low := c.lower()) == 1 else i
        _tables.append(table)
    return _tables[0]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, each with a space at both ends; where each text begins, and the end."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    raw = _letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    keep = raw != 32
    keep[1:] |= raw[:-1] != 32
    keep[starts[:-1]] = True
    places = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return raw[keep], places[starts]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of each text, one after the other, and where each text's begin, and the end."""
    codes, starts = _codes(texts)
    n = len(codes)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    grams, of = [], []
    h = codes * np.uint32(0x9E3779B1)
    for k in range(1, max(GRAMS)):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[k:]
        if k + 1 in GRAMS:
            inside = owner[: n - k] == owner[k:]
            g = (h * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
            grams.append(g[inside])
            of.append(owner[: n - k][inside])
    counts = sum(np.bincount(o, minlength=len(texts)) for o in of)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    out, at = np.empty(ends[-1], np.int64), ends[:-1].copy()
    for g, o in zip(grams, of, strict=True):
        own = np.bincount(o, minlength=len(texts))
        first = np.cumsum(own) - own
        out[at[o] + np.arange(len(o)) - first[o]] = g
        at += own
    return out, ends


@dataclass(frozen=True)
class Model:
    """scores: for each hash and language; temperature and least score come from the calibration."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, starts = hashed(texts)
        counts = np.diff(starts)
        sums = np.zeros((len(texts), len(self.languages)))
        if len(grams):
            full = counts > 0
            sums[full] = np.add.reduceat(self.scores[grams], starts[:-1][full], axis=0, dtype=np.float64)
        return sums, counts

    def logits(self, texts: list[str]) -> np.ndarray:
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        some, size = [], 0

        def flush() -> None:
            s, c = self._sums([x for _, x in some])
            np.add.at(sums, [i for i, _ in some], s)
            np.add.at(counts, [i for i, _ in some], c)

        for i, text in enumerate(texts):
            for at in range(0, len(text), PART):
                some.append((i, text[at : at + PART + max(GRAMS) - 1]))
                size += len(some[-1][1])
                if size >= PART:
                    flush()
                    some, size = [], 0
        if some:
            flush()
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(texts) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (`und` without a letter), score, and whether the text is rejected."""
        known = [t is not None and any(map(str.isalpha, t)) for t in texts]
        p = self.probabilities([t if k else "" for t, k in zip(texts, known, strict=True)])
        score = np.where(known, p.max(1, initial=0), 0.0)
        lang = [self.languages[j] if k else UNKNOWN for j, k in zip(p.argmax(1), known, strict=True)]
        return lang, score, score < self.least


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """Fits embeddings and softmax on four fifths of the texts, in random order, languages weighted alike; on the last
    fifth the temperature (least log loss) and the least score of an accepted text."""
    languages = tuple(sorted(set(labels)))
    if len(languages) < 1:
        raise ValueError("no labelled texts to learn from")
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(texts) // 5]
    fit = order[len(texts) // 5 :]
    grams, starts = hashed(texts)
    sizes = np.diff(starts)
    fit = fit[sizes[fit] > 0]
    share = 1 / np.maximum(np.bincount(y[fit], minlength=len(languages)), 1)
    weight = share[y] / share[y[fit]].mean() if len(fit) else np.ones(len(y))
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    out, bias = rng.normal(0, 0.3, (WIDTH, len(languages))), np.zeros(len(languages))
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            rows = fit[at : at + BATCH]
            n = sizes[rows]
            own = np.concatenate([grams[starts[r] : starts[r + 1]] for r in rows])
            first = np.cumsum(n) - n
            mean = np.add.reduceat(table[own], first, axis=0) / n[:, None]
            error = _softmax(mean @ out + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= weight[rows, None] / len(rows)
            rate = RATE * (1 - step / steps)
            back = (error @ out.T) / n[:, None]
            out -= rate * mean.T @ error
            bias -= rate * error.sum(0)
            np.add.at(table, own, -rate * len(rows) * np.repeat(back, n, axis=0))
            step += 1
    model = Model(languages, (table @ out).astype(np.float32), bias, 1.0, 0.0)
    held = held[sizes[held] > 0]
    if not len(held):
        return model
    z, truth = model.logits([texts[i] for i in held]), y[held]
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), truth], 1e-12)).mean()
    t = min(np.geomspace(0.02, 5, 60), key=loss)
    p = _softmax(z / t)
    right = p.max(1)[p.argmax(1) == truth]
    least = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return Model(languages, model.scores, bias, float(t), min(least, 1.0))


def held_out(key: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from a bounded sample (DRAWN, OF_EACH, WINDOWS) of rows with text and language that aren't held out. The
    key only draws the sample; of rows with one key and language one is taken, and none without a key. Where no row is
    left, as in an empty table, the model knows no language and calls each text with a letter `und`."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    drawn = rows.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    n = rows.count()
    if n > 2 * DRAWN:  # by a bound on the hash first, so that no task sends more than its part; twice what is needed
        drawn = drawn.filter(F.col("h") <= F.lit((1 << 64) * 2 * DRAWN // n - (1 << 63)))
    drawn = drawn.orderBy("h", "key").limit(DRAWN).toPandas()
    if not len(drawn):
        return Model((UNKNOWN,), np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    keys = drawn.groupby("lang").head(OF_EACH)[["key"]].dropna().drop_duplicates()
    chosen = docs.sparkSession.createDataFrame(keys, f"key {docs.schema[key].dataType.simpleString()}")
    n = F.char_length(text)
    cuts = [F.substring(F.col(text), (F.lit(1) + F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)), F.greatest(n - w, F.lit(1)))).cast("int"), F.lit(w)) for i, w in enumerate(WINDOWS)]
    found = rows.join(F.broadcast(chosen), rows[key] == chosen["key"]).select(F.col(lang).alias("lang"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.array(*cuts).alias("cuts"))
    found = found.groupBy("h", "lang").agg(F.min("cuts").alias("cuts")).toPandas().sort_values(["h", "lang"])  # of a key's rows one a language
    pieces = [(cut, label) for label, cuts in zip(found["lang"], found["cuts"], strict=True) for cut in dict.fromkeys(cuts)]
    return train([p for p, _ in pieces], [x for _, x in pieces])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, calibrated) and rejected (columns of these names are replaced). A null text
    or one without a letter is `und`, with score 0, and rejected. Repeated rows get the same; an empty table stays so."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(texts.slice(at, TOGETHER).to_pylist()) for at in range(0, len(texts), TOGETHER)]
            lang = [x for part, _, _ in found for x in part]
            score = np.concatenate([x for _, x, _ in found]) if found else np.zeros(0)
            bad = np.concatenate([x for _, _, x in found]) if found else np.zeros(0, bool)
            bad = bad | (np.array(lang, dtype=object) == UNKNOWN)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad.astype(bool), pa.bool_())], names=["lang_pred", "score", "rejected"])
        trim()

    kept = [x for c, x in zip(docs.columns, own(docs), strict=True) if c.lower() not in MADE]
    (found,) = free_name(docs, "_judged")
    return docs.select(*kept, judged(docs[text]).alias(found)).select(*kept, f"{found}.*")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, all columns whatever their names."""
    moved, back = aside(docs, *MADE)
    return identify(moved, model, text).filter("not rejected").select(*back)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
