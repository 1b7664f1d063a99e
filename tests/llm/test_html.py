"""Extraction: what an article holds, whatever its authors call it, and pages of any depth."""

import html
import re
import time
import tracemalloc

import pytest

from kairolog.llm import htmltext

SF = "/root/testdata/sf0.001"
LONG = "".join(f"<p>{c * 300}</p>" for c in "abcd")
LINES = [c * 300 for c in "abcd"]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f'<article><div title="a hidden gem"><p>{"g" * 80}</p></div>{LONG}</article>', ["g" * 80, *LINES]),
        (f'<article><div class="entry-header"><h1>Headline</h1></div>{LONG}</article>', ["Headline", *LINES]),
        (f'<article>{LONG}<p class="search-result">{"r" * 90}</p></article>', [*LINES, "r" * 90]),
        (f'<div class="top"><h1>Headline</h1></div><article>{LONG}</article>', ["Headline", *LINES]),
        (f"<article>{LONG}<div class='comments'><p>{'c' * 90}</p></div><div class='ad-slot'>{'z' * 50}</div><p class='cookie-notice'>{'n' * 40}</p></article>", LINES),
        (f"<div class='comment'>{LONG}</div>", LINES),
        (f'<article data-x=\'a>b\' class=post hidden-by="no"><p title="x > y" aria-hidden="false">{"q" * 90}</p>{LONG}</article>', ["q" * 90, *LINES]),
        (f"<article>{LONG}<div hidden>{'h' * 60}</div><form>{'f' * 60}</form><aside>{'s' * 60}</aside></article><header>{'k' * 60}</header>", LINES),
        ("", []),
        ("no markup &amp; all", ["no markup & all"]),
    ],
)
def test_what_belongs_to_the_article(page, lines):
    assert htmltext.text_of(f"<html><body><nav>menu</nav>{page}<footer>foot</footer></body></html>") == "\n".join(lines)


def test_nested_text_is_kept():
    assert htmltext.text_of("<div>x" * 2000) == "\n".join("x" * 2000)


@pytest.mark.parametrize("make", [lambda n: "<div>x" * n, lambda n: "<p>" + "<b>" * n + "x</i>" * n, lambda n: "<a>" + "<div>" * n + "</a>x" * n, lambda n: "<li><ul>" * n, lambda n: "<b><p>y" * n])
def test_depth_costs_no_more_than_length(make):
    took = []
    for n in (5_000, 50_000):
        page = make(n)
        tracemalloc.start()
        began = time.process_time()
        htmltext.text_of(page)
        took.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert took[1][0] < 40 * took[0][0] + 2 and took[1][1] < 20 * took[0][1] + (1 << 20)


def test_the_host_decides_what_a_name_means(spark):
    """Comments are little on most pages of a host, so they go on one where they are most; a host whose articles lie in a
    container of such a name keeps them, on a short page too."""
    say = "<div class='replies'>" + "".join(f"<p>{'r' * 200}</p>" for _ in range(8)) + "</div>"
    few = "<div class='replies'><p>thanks</p></div>"
    rows = [(i, f"http://a.org/{i}", f"<article>{LONG}{few if i else say}</article>") for i in range(8)]
    box = lambda body: f"<div class='page'><div class='widget'>{body}</div><p>{'o' * 60}</p></div>"
    rows += [(100 + i, f"http://b.org/{i}", box(LONG if i else f"<p>{'w' * 20}</p>")) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n".join(LINES) for i in range(8))
    assert got[100].startswith("w" * 20) and all(got[100 + i].startswith("\n".join(LINES)) for i in range(1, 8))


def plain(page: str) -> str:
    """The generated pages hold one article of h1 and p elements each: cut out and split by hand."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", inside))
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_generated_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in df.collect()}
    assert {r["page_id"]: r["text"] for r in htmltext.extract_text(df).collect()} == want
