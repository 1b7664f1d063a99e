"""The pipeline's stages on odd rows and clashing columns, and exact deduplication from arrival to arrival."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kairolog.llm import exactdedup, langid, mixing
from kairolog.llm.shared import workspace

CLASHING = "_place _k _p _judged _before _epoch _leaf _spot _slice _edge _base _whole _rest _bits node digest text_ key rejected component_id copies _METADATA `odd`".replace("`odd`", "a.b").split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = {"en": "the of and to in that is was for it".split(), "fr": "le la les des est dans une pour que qui".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "r"]) for _ in range(n))
    out = [(i, say("en" if i % 2 else "fr", 60), "en" if i % 2 else "fr", f"src{i % 4}", 1) for i in range(120)]
    out += [(200 + i, out[i][1].upper() if i % 2 else out[i][1], out[i][2], out[i][3], 1) for i in range(20)]
    out += [(300 + i, out[i][1] + " end", out[i][2], None, 1) for i in range(20)]
    return out + [(400, None, None, None, None), (401, "", "en", "src0", 0), (402, "!!! 12", None, "src0", 6), (5, out[5][1], out[5][2], out[5][3], 1), (None, "the of and " * 9, "en", "src1", 3)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kept(rows):
    """Exact copies and near copies by hand: of equal texts the largest key's row, of linked ones the least."""
    from test_brute_force import shingles_of

    by = {}
    for r in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        if t not in by or (r[0] is not None and (by[t][0] is None or r[0] >= by[t][0])):
            by[t] = r
    kept = list(by.values())
    sets = [shingles_of(r[1] or "") for r in kept]
    up = list(range(len(kept)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (kept[i][0], kept[j][0]) and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(kept):
        x = root(i)
        if x not in least or (r[0] is not None and r[0] < least[x][0]):
            least[x] = r
    return kept, list(least.values())


def test_pipeline_rows_against_plain_versions(spark, rows, tmp_path):
    """Each stage on all that the one before it kept, with rows and texts, not only keys."""
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/sf/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept, found = docs, {}
    for name in list(stages)[:4]:
        path = workspace(spark, name)
        stages[name](spark, kept, f"file://{tmp_path}/sf").write.parquet(path)
        kept = spark.read.parquet(path)
        found[name] = sorted((tuple(r) for r in kept.collect()), key=str)
        assert kept.columns == docs.columns
    model = langid.fit(docs)
    _, _, rejected = model.predict([r[1] for r in rows])
    accepted = [r for r, bad in zip(rows, rejected, strict=True) if not bad and any(map(str.isalpha, r[1] or ""))]
    assert found["language_id"] == sorted(accepted, key=str) and len(accepted) >= len(rows) - 8
    exact, near = plain_kept(accepted)
    assert found["exact_dedup"] == sorted(exact, key=str)
    assert found["ngram_join"] == sorted(near, key=str)
    copies = mixing.mix_sources(spark.createDataFrame(near, SCHEMA)).collect()
    assert found["mix_sources"] == sorted([tuple(r)[:5] for r in copies for _ in range(r["copies"])], key=str)
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}/sf").collect()
    held = {}
    for p in pieces:
        held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["length"]
    want = {}
    from kairolog.llm.tokens import WordTokenizer, vocabulary_path

    for r in found["mix_sources"]:
        want[r[0]] = want.get(r[0], 0) + len(WordTokenizer.of(vocabulary_path()).library.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert held == want


@pytest.mark.parametrize("case", ["clash", "empty", "nulls"])
def test_stages_take_any_columns_and_rows(spark, rows, case):
    docs = spark.createDataFrame(rows if case == "clash" else [] if case == "empty" else [(None,) * 5, (1, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    names = [c for c in CLASHING if case == "clash"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        path = workspace(spark, f"{case}-{name}")
        stage(spark, docs, "").write.parquet(path)
        out = spark.read.parquet(path)
        if name != "pack_sequences":
            assert out.columns == docs.columns, name
            docs = out
        assert out.count() > 0 or case != "clash"


def test_frames_without_files_keep_the_right_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "A"), (2, "A"), (None, "c"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(exactdedup.deduplicated(df).collect(), key=str) == sorted([(1, "b"), (2, "A"), (None, "c"), (4, "")], key=str)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exactdedup.exact_dedup(df).collect())
    assert got == sorted([("1", "2", 3, False), ("1", "1", 1, True), ("2", "2", 3, False), ("2", "2", 3, True), ("None", "None", 1, True), ("3", "4", 2, False), ("4", "4", 2, True)])


def test_arrivals_meet_the_state_that_was_kept(spark, tmp_path):
    """Three arrivals, each a query of its own started from what the one before left in the folder."""
    state = f"file://{tmp_path}/state"
    came = []
    for i, rows in enumerate(([(1, "One"), (2, "two"), (9, "nine")], [(5, "one"), (3, "three"), (4, "NINE")], [(6, "ONE"), (7, "three"), (8, "new")])):
        path = f"file://{tmp_path}/arrival{i}"
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
        got = exactdedup.exact_dedup(spark.read.parquet(path), state=state).collect()
        came.append({r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got})
    assert came[0] == {1: (1, 1, True), 2: (2, 1, True), 9: (9, 1, True)}
    assert came[1] == {5: (5, 2, True), 3: (3, 1, True), 4: (9, 2, False)}
    assert came[2] == {6: (6, 3, True), 7: (7, 2, True), 8: (8, 1, True)}
    assert hashlib.sha256(b"nine").hexdigest() in {r["text_sha256"] for r in exactdedup.exact_dedup(spark.read.parquet(f"file://{tmp_path}/arrival0"), state=f"{state}-2").collect()}
    gone = {(r["doc_id"], r["keep_id"]) for r in exactdedup.superseded(spark.read.parquet(f"file://{tmp_path}/arrival0"), state).collect()}
    assert gone == {(1, 6), (5, 6), (3, 7)}
