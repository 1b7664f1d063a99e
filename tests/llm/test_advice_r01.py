"""Cases of the first review."""

import random
import struct

from pyspark.sql import functions as F

from kairolog.llm import fingerprint, htmltext, packing, tokens
from kairolog.llm.tokens import WordTokenizer, vocabulary_path


def same_as_library(t: WordTokenizer, texts: list[str]) -> None:
    for text, raw in zip(texts, t.encode(texts), strict=True):
        ids = t.library.encode(text, add_special_tokens=False).ids
        assert raw == struct.pack(f"<{len(ids)}I", *ids), text[:100]


def test_tokens_of_each_latin_letter():
    """Those too whose lower case lies beyond the letters that the split pattern lists."""
    same_as_library(WordTokenizer(vocabulary_path()), [x for c in map(chr, range(1, 0x2100)) for x in (f"{c}a", f"al{c}", f"a{c}b{c} {c}")])


def test_tokens_of_more_words_than_are_kept(monkeypatch):
    """Some known before, in one text and in texts encoded together; then few again."""
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokens, "LEARNT", 7, raising=False)
    t = WordTokenizer(vocabulary_path())
    many = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    for texts in (["waa wab wac"], [" ".join(many)], many, ["waa wab wzz"], [" ".join(many[:15])], [" ".join(many[10:25])]):
        same_as_library(t, texts)
    assert len(t.known) <= 20


def test_articles_of_sections_lists_and_tables(spark):
    """The whole article is kept, on each of a host's pages; what is around it isn't."""
    p = lambda c, n: "<p>" + c * n + "</p>"
    page = lambda x: f'<html><body><nav><a href="/">menu</a></nav><div class="ad">{"z" * 80}</div>{x}<footer>f</footer></body></html>'
    items = "".join(f"<li>{'i' * 150}</li>" for _ in range(10))
    cases = {
        "sections": (f"<article><h1>{'t' * 60}</h1>{p('l', 200)}{''.join(f'<section>{p(c, 1000)}</section>' for c in 'abc')}</article>", ["t" * 60, "l" * 200, *[c * 1000 for c in "abc"]]),
        "list": (f"<article><h1>{'t' * 60}</h1>{p('l', 300)}<ul>{items}</ul></article>", ["t" * 60, "l" * 300, *["i" * 150] * 10]),
        "table": (f"<article><h1>{'t' * 60}</h1><table><tbody><tr><td>{p('a', 900)}</td></tr><tr><td>{'b' * 700}</td></tr></tbody></table></article>", ["t" * 60, "a" * 900, "b" * 700]),
        "divs": (f"<div class='post'><h1>{'t' * 60}</h1>{p('l', 200)}<div class='text'>{p('a', 900)}{p('b', 900)}</div></div>", ["t" * 60, "l" * 200, "a" * 900, "b" * 900]),
        "body": (f"<h1>{'t' * 60}</h1><section>{p('a', 900)}</section><section>{p('b', 900)}</section>", ["t" * 60, "a" * 900, "b" * 900]),
        "outside": (f"<div class='box'>{p('o', 50)}</div><article>{p('a', 900)}{p('b', 900)}</article>", ["a" * 900, "b" * 900]),
    }
    rows = [(100 * i + k, f"http://{name}.org/{k}", page(x)) for i, (name, (x, _)) in enumerate(cases.items()) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (name, (_, lines)) in enumerate(cases.items()):
        assert [got[100 * i + k] for k in range(3)] == ["\n".join(lines)] * 3, name


def test_near_copies_are_alike(spark):
    """With words inserted and deleted all over a long text, and without white space."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    edited = [x for i, w in enumerate(words) for x in (["new", w] if i % 400 == 200 else [] if i % 400 == 390 else [w])]
    middle = [*words[:2000], "new", *words[2000:]]
    far = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(300)]
    code = "".join(rng.choice("abcdefghijklmnop") for _ in range(400))
    rows = [(0, " ".join(words), " ".join(middle)), (1, " ".join(words), " ".join(edited)), (2, " ".join(words), " ".join(far)), (3, "".join(han), "".join([*han[:150], "新", *han[150:]])), (4, code, code[:200] + "x" + code[200:]), (5, "short", "short"), (6, "short", "other"), (7, "", None)]
    fp = lambda c: fingerprint.fingerprint(F.coalesce(F.col(c), F.lit("")))
    found = spark.createDataFrame(rows, "i int, a string, b string").select("i", fp("a").alias("a"), fp("b").alias("b")).select("i", F.size("a").alias("n"), fingerprint.likeness(F.col("a"), F.col("b")).alias("near"))
    got = {r["i"]: (r["n"], r["near"]) for r in found.collect()}
    assert got[0][0] > 1000 and got[0][1] > 0.95 and got[1][1] > 0.85 and got[2][1] < 0.05
    assert got[3][1] > 0.9 and got[4][1] > 0.9
    assert (got[5][1], got[6][1], got[7][1]) == (1.0, 0.0, 1.0)


def test_special_tokens_are_the_librarys(spark):
    texts = ["a <|endoftext|> b", "x<|startoftext|>", "a <|ENDOFTEXT|> b"]
    ids = lambda t: [struct.unpack(f"<{len(x) // 4}I", x) for x in t.encode(texts)]
    assert ids(WordTokenizer.of(vocabulary_path()))[:2] == [(320, 49407, 321), (343, 49406)]
    ordinary = ids(WordTokenizer.of(vocabulary_path(), True))
    assert ordinary[0] == ordinary[2] == ids(WordTokenizer.of(vocabulary_path()))[2] and len(ordinary[1]) == 8
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    assert [packing.pack(docs, ordinary=x).first()["doc_tokens"] for x in (False, True)] == [4, 9]
