"""Operators without SQL against plain versions, and their parts on random input."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from kairolog.llm import fingerprint, langid, ngramjoin, packing, shingles, suffix, tokenfile, urlfilter
from kairolog.llm.shared import workspace
from kairolog.llm.tokens import WordTokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in range(150):
        n, a = int(rng.integers(1, 300)), int(rng.integers(1, 6))
        t = rng.integers(1, a + 1, n).astype(np.uint8)
        if k % 3 == 0:
            t = np.tile(t[: max(1, n // 5)], 10)[:n]
        b, sa = t.tobytes(), suffix.suffix_array(t).tolist()
        assert [b[i : i + 56] for i in sa] == sorted(b[i : i + 56] for i in range(len(b)))
        common = suffix.common_prefixes(t, np.array(sa), 50).tolist()
        for x in range(1, len(sa)):
            p, q, m = b[sa[x - 1] :], b[sa[x] :], 0
            while m < min(len(p), len(q), 50) and p[m] == q[m]:
                m += 1
            assert m == common[x]


def test_repeats(spark, documents):
    df, texts = documents
    seen: set[bytes] = set()
    want = {}
    for d in sorted(texts):
        b = texts[d].encode()
        gone = np.zeros(len(b) + 1, bool)
        own = {b[i : i + 50] for i in range(len(b) - 49)}
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        want[d] = bytes(c for c, g in zip(b, gone, strict=False) if not g)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix.drop_repeats(df).collect()} == want


def shingles_of(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts):
    """The least key that links reach, from all pairs."""
    sets = {d: shingles_of(t) for d, t in texts.items()}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


def test_a_phrase_in_many_contexts_is_split(spark, monkeypatch):
    """A hot 16-gram around which every text differs, and repeats of which it is a part."""
    monkeypatch.setattr(suffix, "HOT_BLOCKS", 2)
    monkeypatch.setattr(suffix, "BLOCK", 20_000)
    monkeypatch.setattr(suffix, "PART", 4096)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    texts, seen, want = {}, set(), {}
    for d in range(1500):
        parts = [word() for _ in range(8)] + ["the common phrase here"] + [word() for _ in range(8)]
        if d % 3 == 0 and d:
            old = texts[rng.randrange(d)]
            parts.append(old[rng.randrange(len(old) // 2) :])
        texts[d] = " ".join(parts)
    for d, t in texts.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        own = {b[i : i + 50] for i in range(len(b) - 49)}
        for i in range(len(b) - 49):
            if b[i : i + 50] in seen:
                gone[i : i + 50] = True
        seen |= own
        want[d] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix.drop_repeats(df).collect()} == want


def test_components(spark, documents):
    df, texts = documents
    roots = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(df).collect()}
    assert got == {d: (len(shingles_of(texts[d])), roots[d]) for d in texts}


def pair_at_the_bound(rng, n, hot):
    """Two sets of about n tokens, some of them hot, with a Jaccard of 3/4 or hardly more; None where n has no such pair."""
    base = rng.choice(hot, min(n // 2, len(hot)), replace=False)
    a = np.unique(np.concatenate((base, rng.integers(0, 1 << 62, n - len(base)).astype(np.uint64))))
    drop = (len(a) - -(-3 * len(a) // 4)) if rng.random() < 0.5 else 0
    b = a[rng.permutation(len(a))[drop:]]
    add = 0
    while len(b) and 4 * len(b) >= 3 * (len(a) + add + 1) and add < n:
        add += 1
    b = np.unique(np.concatenate((b, rng.integers(0, 1 << 62, add).astype(np.uint64))))
    both = len(np.intersect1d(a, b))
    return (a, b) if 100 * both >= 75 * (len(a) + len(b) - both) else None


@pytest.mark.parametrize("warm", [0.0, 0.5])
def test_pairs_at_the_bound_share_what_the_pruning_relies_on(warm):
    """In every band, with exact segments and with deletions."""
    rng = np.random.default_rng(2)
    hot = np.unique(rng.integers(0, 1 << 62, 2000).astype(np.uint64))
    heat = ngramjoin.Heat(hot, np.arange(len(hot)), 0.05, warm)
    ways = {b: ngramjoin.allocation(b, heat) for b in range(ngramjoin.BANDS)}
    assert any(way < 0 for way in ways.values()) == (warm > 0)
    deleted = lambda n: any(way < 0 and (1 << b) <= n < (4 << b) for b, way in ways.items())
    segments = lambda n: n // 3 + 1 + n // ngramjoin.SPARE

    def spare(n):
        low = (75 * n + 99) // 100
        return max(1, min(segments(n) - (n + n * 100 // 75) // 7, segments(low) - (low + n) // 7) - 1)

    for n in [*range(1, 70), *rng.integers(64, 2000, 60).tolist()] * 2:
        if pair := pair_at_the_bound(rng, n, hot):
            a, b = pair
            shared = len(np.intersect1d(ngramjoin.entries(a, heat, ways), ngramjoin.entries(b, heat, ways)))
            need = 1 if deleted(len(a)) or deleted(len(b)) else max(min(segments(len(a)), segments(len(b))) - (len(a) + len(b)) // 7, spare(len(a)), spare(len(b)), 1)
            assert shared >= need, (n, len(a), len(b), shared, need)


def test_blocks_beside_each_other_count_what_they_have_in_common():
    rng = np.random.default_rng(5)
    xs, ys = ([np.unique(rng.integers(0, 3000, int(k)).astype(np.uint64)) for k in rng.integers(1, 900, 40)] for _ in "xy")
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert (ngramjoin.met_counts(xs, ys, width=256) == np.array(want)).all()


def test_a_dense_group_around_the_bound(spark):
    """More near copies than make pairs, some linked with some only: lists, stars and blocks against brute force."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words if d % 5 else [f"y{d}_{i % 50}" for i in range(100)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(df).collect()}
    assert got == brute_components(texts)


def test_shingles():
    texts = ["A b c d E f", "a B c d e F", "", None, "one two", "x " * 5000 + "é ñ", "\x0bq\x0c w e r t\x1fy u"]
    got = [len(s) for s in shingles.shingle_sets(texts)]
    assert got[:5] == [2, 2, 0, 0, 1] and got[6] == 2  # q w e r t\x1fy u
    assert (shingles.shingle_sets(texts)[0] == shingles.shingle_sets(texts)[1]).all()


def test_packing_leaves_little_padding():
    rng = np.random.default_rng(3)
    lengths = np.minimum((rng.lognormal(5.5, 1.2, 20000)).astype(int) % 4096 + 1, 4095)
    classes = -(-lengths // packing.GRAIN)
    units = packing.WINDOW // packing.GRAIN
    made = packing.plan(np.bincount(classes, minlength=units + 1)[1:])
    assert (made.counts <= np.bincount(classes, minlength=units + 1)[1:]).all()
    placed = sum(int(c) * (k + 1) for k, c in enumerate(made.counts))
    assert placed >= 0.98 * made.sequences * units
    total = 3 * 4096 + 1234
    pieces = [c for i in range(0, total, 100) for c in packing.cuts(i, min(100, total - i), total, 4096)]
    ends: dict[int, int] = {}
    for s, o, n in pieces:
        assert ends.get(s, 0) == o
        ends[s] = o + n
    assert sum(ends.values()) == total and all(n == 4096 or n & (n - 1) == 0 for n in ends.values())


@pytest.mark.parametrize(("sf", "rows"), [("0.01", 1000), ("0.1", 10_000)])
def test_solved_combinations_carry_the_packing(sf, rows):
    """At small sizes too; and what combinations place leaves little of their windows empty."""
    tokens = WordTokenizer.of(vocabulary_path())
    texts = duckdb.sql(f"SELECT text FROM '/root/testdata/sf{sf}/documents.parquet'").fetchall()
    assert len(texts) == rows
    rest = np.array([len(x) // 4 + 1 for x in tokens.encode([t for (t,) in texts])]) % packing.WINDOW
    units = packing.WINDOW // packing.GRAIN
    made = packing.plan(np.bincount(-(-rest[rest > 0] // packing.GRAIN), minlength=units + 1)[1:])
    assert made.solved > 0.7 * made.units and made.residual < 0.01
    placed = sum(int(c) * (k + 1) for k, c in enumerate(made.counts))
    assert placed >= 0.998 * made.sequences * units


def test_least_squares_against_brute_force():
    """No step along any column makes it better, and nothing is negative."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 4, (6, 14)).astype(float), rng.integers(0, 30, 6).astype(float)
        x = packing.least_squares(a, b)
        gain = a.T @ (b - a @ x)
        assert x.min() >= 0 and gain.max() < 1e-6 and abs(gain[x > 1e-9]).max(initial=0) < 1e-6
    assert sorted(packing.combinations(5)) == sorted([(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1), (2, 1, 1, 1), (1, 1, 1, 1, 1)])


@pytest.mark.parametrize(("window", "grain"), [(64, 4), (100, 1), (48, 8), (16, 16)])
def test_plans_of_odd_windows(window, grain):
    """Each rest has one place, and no sequence is too long."""
    rng = np.random.default_rng(7)
    units = window // grain
    h = rng.integers(0, 9, units)
    made = packing.plan(h)
    filled: dict[int, int] = {}
    assert (made.counts <= h).all()
    for c in range(units):
        for r in range(int(made.counts[c])):
            i = int(np.searchsorted(made.starts[c], r, side="right")) - 1
            s = int(made.sequence[c][i] + r - made.starts[c][i])
            filled[s] = filled.get(s, 0) + c + 1
    assert all(x <= units for x in filled.values()) and set(filled) == set(range(made.sequences))


def test_random_access_decompresses_few_frames(spark, tmp_path):
    import pyarrow as pa

    writer = tokenfile.TokenWriter(f"file://{tmp_path}/a.tok", pa.int64(), 2)
    data = [np.random.default_rng(i).integers(0, 49000, 5000) for i in range(200)] + [np.arange(700_000) % 40_000]
    for i, ids in enumerate(data):
        writer.add(i * 3, ids)
    writer.close()
    reader = tokenfile.TokenReader(f"file://{tmp_path}/a.tok")
    before = reader.decompressed
    assert (reader.find(150)[0] == data[50]).all() and reader.decompressed - before <= 1
    assert (reader.ids(200) == data[200]).all() and reader.find(1) == []
    raw = bytearray((tmp_path / "a.tok").read_bytes())
    raw[100] ^= 255
    (tmp_path / "a.tok").write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        tokenfile.TokenReader(f"file://{tmp_path}/a.tok").ids(0)


def test_globs_against_fnmatch():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    found = urlfilter.match(urlfilter.compile_globs(g.encode() for g in globs), [t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == bool(re.fullmatch(g.replace("*", ".*").replace("?", "."), t)), (t, g)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text: str) -> list[int]:
    """In Python, with Spark's xxhash64 (seed 42, each value's hash seeds the next; whole numbers here have 8 bytes)."""
    chained = lambda values: __import__("functools").reduce(lambda h, v: xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h), values, 42)
    pack = lambda x, i: x & fingerprint.HASH | i

    def syncmers(h):
        s = [signed(chained([h[i], h[i + 1]])) for i in range(len(h) - 1)]
        return [pack(chained([s[i], s[i + 2], h[i + 4]]), i) for i in range(len(h) - 4) if s[i] <= min(s[i + 1 : i + 4]) or s[i + 3] < min(s[i : i + 3])]

    words = [w for w in re.split("[ \t\n\r\f\x0b]+", text) if w]
    found = syncmers([signed(chained([w.encode()])) for w in words])
    if len(words) < fingerprint.SHORT:
        found += syncmers([signed(chained([c.encode(), (1).to_bytes(4, "little")])) for c in text if c not in " \t\n\r\f\x0b"])
    if text and not found:
        found = [pack(chained([text.encode()]), 0)]
    out: list[int] = []
    for a in sorted(found):
        if not out or out[-1] >> fingerprint.BITS != a >> fingerprint.BITS:
            out.append(a)
    return out


@pytest.mark.parametrize("kind", ["long", "string", "decimal(20,0)"])
def test_next_rows_of_any_key(spark, kind):
    """Dense keys and one far away, a key of many rows and null ones: small ranges, and the order of one window."""
    from pyspark.sql import functions as F

    keys = [*range(3000), 10**15, *[77] * 40, None, None]
    df = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "k long, text string").select(F.col("k").cast(kind).alias("k"), "text").repartition(5)
    got = {(r["text"], r["next_text"]) for r in fingerprint.with_next(df, "k", ["text"], rows=100).collect()}
    rows = df.withColumn("h", F.xxhash64("text")).collect()
    order = sorted((r for r in rows if r["k"] is not None), key=lambda r: (r["k"], r["h"]), reverse=True) + sorted((r for r in rows if r["k"] is None), key=lambda r: -r["h"])
    assert got == {(a["text"], b["text"]) for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_short_and_unspaced_texts_are_like_their_edits(spark):
    rows = [(i, t) for i, t in enumerate(["the quick fox jumps", "supercalifragilistic", "".join(chr(0x4E00 + 37 * j % 5000) for j in range(4000)), "a few words more than five of them", "x" * 12 + "abcdefgh" * 6])]
    got = {r["i"]: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "i long, text string"), key="i").collect()}
    assert all(got[i]["near_edited"] > 0.2 and got[i]["near_edited"] > got[i]["near_next"] for i in range(5)), got
    assert got[2]["near_edited"] > 0.4


def test_fingerprints(spark, documents):
    df, texts = documents
    show = lambda fp: " ".join(f"{a >> fingerprint.BITS:x}:{a & fingerprint.PLACE:x}" for a in fp)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(df).collect()}
    order = sorted(texts, reverse=True)
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        third = len(texts[d]) // 3
        edited = texts[d][: len(texts[d]) - third] + texts[after][:third]
        assert got[d]["fingerprint"] == show(plain_fingerprint(texts[d]))
        assert got[d]["edited_fingerprint"] == show(plain_fingerprint(edited))
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    far = [r for r in got.values() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > r["near_next"] for r in far) >= 0.97 * len(far)


def test_language_on_held_out_rows(spark, documents):
    df, _ = documents
    found = langid.identify(df, langid.fit(df)).filter(langid.held_out("doc_id")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        path = workspace(spark, name)
        stage(spark, kept, SF).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        if name != "mix_sources":
            assert kept.count() <= before.count()
    assert kept.count() > 0
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
