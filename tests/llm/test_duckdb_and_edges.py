"""Operators with SQL against DuckDB, and all operators on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import struct
import zlib
from collections import Counter

import duckdb
import pytest

from kairolog.llm import exactdedup, fingerprint, htmltext, langid, mixing, ngramjoin, packing, registry, suffix, tokenfile, urlfilter
from kairolog.llm.tokens import WordTokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra rara " * 30_000


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty, very long and repeated rows, read from files as tables are."""
    rows = [(1, None, None, None, None), (2, "", "en", "src0", 0), (3, "!!! 123 ...", "en", "src0", 11), (4, LONG, "es", "src1", len(LONG)), (5, "one two three", "en", "src0", 13), (5, "one two three", "en", "src0", 13), (6, "ONE two three", "en", None, 13), (7, "Äpfel ÄPFEL 'tis don't İstanbul ǅ ß", "de", "src2", 35), (8, "a\x1cb <|endoftext|> x́ \ud7ff", "en", "src3", 20), (9, " \n\t ", "en", "src3", 4)]
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(rel.fetchall())


def test_empty_tables(spark, none):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = langid.fit(none)
    for df in (langid.identify(none, model), htmltext.extract_text(pages), mixing.mix_sources(none), packing.pack(none), suffix.drop_repeats(none), exactdedup.exact_dedup(none), ngramjoin.jaccard_components(none), fingerprint.fingerprint_edits(none), urlfilter.judge_urls(pages)):
        assert df.count() == 0
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, f"{spark.conf.get('spark.checkpoint.dir')}/none")).count() == 0


def test_language_of_odd_texts(spark, odd):
    model = langid.train(["the cat and the dog", "le chat et le chien", "der hund und die katze"] * 20, ["en", "fr", "de"] * 20)
    df = odd.selectExpr("*", "lang AS lang_pred", "1 AS score")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == got[9]["lang_pred"] == "und"
    assert got[1]["score"] == 0.0 and got[1]["rejected"]
    assert all(r["lang_pred"] in ("en", "fr", "de") and 0 <= r["score"] <= 1 for i, r in got.items() if i in (4, 5, 6, 7, 8))


def test_tokens_of_odd_texts(spark, odd):
    t = WordTokenizer.of(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    manifest = tokenfile.write_tokens(odd, f"{spark.conf.get('spark.checkpoint.dir')}/odd", width=2)
    rows = tokenfile.read_tokens(manifest).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        ids = [*t.library.encode(texts[r["key"]] or "", add_special_tokens=False).ids, 1]
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["start"] == at
        at += len(ids)
    assert [r["key"] for r in sorted(rows, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in odd.collect())


def test_packing_of_odd_texts(spark, odd):
    t = WordTokenizer.of(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    pieces = packing.digests(packing.pack(odd)).collect()
    for i in texts:
        ids = [*t.library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) * (2 if i == 5 else 1)
        for p in own:
            cut = ids[p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
    for s in {p["sequence_id"] for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p["sequence_id"] == s), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW


def test_exact_dedup_of_odd_texts(spark, odd):
    got = exactdedup.exact_dedup(odd).collect()
    assert len(got) == 10
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert (by[1][0]["keep_id"], by[1][0]["group_size"], by[2][0]["kept"]) == (2, 2, True)
    assert all(r["keep_id"] == 6 and r["group_size"] == 3 and not r["kept"] for r in by[5]) and by[6][0]["kept"]
    assert by[6][0]["text_sha256"] == hashlib.sha256(b"one two three").hexdigest()
    twice = odd.filter("doc_id = 5")
    assert sorted(r["kept"] for r in exactdedup.exact_dedup(twice).collect()) == [False, True]
    assert exactdedup.deduplicated(odd).columns == odd.columns and exactdedup.deduplicated(odd).count() == 7


def test_components_of_odd_texts(spark, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[9] == (0, 9)
    assert got[5] == got[6] == (1, 5)
    assert got[4] == (2, 4)


def test_spans_of_odd_texts(spark, odd):
    rows = spark.createDataFrame([(1, "x" * 60), (2, "y" + "x" * 55), (3, None), (4, ""), (2, "y" + "x" * 55), (None, "x" * 60)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix.drop_repeats(rows).collect())
    assert got == [("1", 60, [], b"x" * 60), ("2", 56, [(1, 56)], b"y"), ("2", 56, [(1, 56)], b"y"), ("3", 0, [], b""), ("4", 0, [], b""), ("None", 60, [], b"x" * 60)]


def test_fingerprints_of_odd_texts(spark, odd):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(odd).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == "" and got[2]["near_next"] == 1.0
    assert got[5]["fingerprint"] != got[6]["fingerprint"]
    assert got[4]["n_chars"] == len(LONG)


def test_mixing_of_odd_rows(spark, odd):
    mixed = mixing.mix_sources(odd.withColumnRenamed("n_chars", "copies"))
    assert mixed.count() == 10 and all(r["copies"] >= 0 for r in mixed.collect())


def test_pages(spark):
    rows = [(1, None, None, 0), (2, "http://h.org/a", "", 0), (3, "x", "<p>a &amp; b\n c<br>d</p><p>e", 0), (4, "http://h.org/b", '<html><body><nav><a href="/">menu</a></nav><div class="post"><h1>T</h1><p>one</p><script>var x="</p>"</script><p>two &lt;3</p><div class="comments"><p>nice</p></div></div><aside>side</aside><footer>f</footer></body></html>', 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(pages).collect()}
    assert got == {1: "", 2: "", 3: "a & b c d\ne", 4: "T\none\ntwo <3"}


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.NET/en/x?q#f"), (4, "http://a.net"), (5, "http://a.net/x.com/de/"), (6, "http://example.com/de/"), (7, "x://org/fr/"), (8, "http://b.test/ads/x"), (9, "http://notexample.com/de/")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("a.net", "", None, "allow") and got[5][2:] == ("net/", "block")
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == ("org/fr/", "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
