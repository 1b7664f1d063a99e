"""Main text of HTML pages by consensus host paths.

Each page's containers are scored by the prose that they hold, and from the best the page climbs to the one that holds
the whole article. The pages of a host vote, in Spark, on the generalised tag-class paths of these containers, and on
those of containers whose names sound like boilerplate: which hold little of their pages' prose, and so are it. Then
every page is extracted again by its host's paths. A page is read once from left to right into a tree of blocks;
everything after that is a pass over the tree's nodes, so work and memory follow the page's length, not its depth.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm.shared import LOWER, UPPER, free_name, saved, small, workspace

# Element names of HTML and words that page authors use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Not the article wherever they stand.
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg canvas object head title dialog menu datalist audio video map math noembed noframes xmp".split())
#: Elements that a start tag ends, if no container lies between.
ENDS = {**{t: {"p"} for t in BLOCKS}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("html body article aside div section main table ul ol dl nav header footer form td th blockquote".split())
#: Names that make a container a candidate only; what its pages hold there decides.
NAMED = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond social share sharing "
    "sharebar related recommended recommendations widget widgets pagination pager login signup register search searchbox toolbar copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SAFE = frozenset("html body main article".split())
#: Parts of an article, never the whole: the container around them is taken.
PARTS = frozenset("section ul ol dl li dt dd table tbody thead tfoot tr blockquote figure figcaption details center pre p h1 h2 h3 h4 h5 h6".split())
#: Share of the page's prose from which an article or main element is the article; what else there is lies outside.
DECLARED = 0.9
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li td dd".split())
#: A container of a boilerplate name is boilerplate if it holds less than this part of the pages' prose, in thousandths.
LITTLE = 300
#: A host's paths with this part of its votes win; and of its pages, are known to all (in thousandths).
WINS, KNOWN = 100, 10

TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?|["'/=]""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Tree:
    """Nodes in the order in which they begin, a parent before its children (-1: none). why: 2 not the article's by its
    tag, role or being hidden, 1 perhaps, by its name, 0 no. Blocks in order: text, node (-1: none), linked characters."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    why: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def down(self, own: list, join) -> list:
        """From the top: join(of the parent, own) for each node."""
        out: list = []
        for p, x in zip(self.parent, own, strict=True):
            out.append(x if p < 0 else join(out[p], x))
        return out

    def up(self, own: list) -> list:
        """Sums over each node and all below it."""
        out = list(own)
        for i in range(len(out) - 1, -1, -1):
            if self.parent[i] >= 0:
                out[self.parent[i]] += out[i]
        return out


def attributes(raw: str) -> dict[str, str]:
    """Of a start tag, the first of each name; names in lower case, references decoded."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        if m[1]:
            value = m[2] or ""
            out.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _reason(tag: str, own: dict[str, str], in_article: bool) -> int:
    if tag in DROPPED or tag == "header" and not in_article or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) or own.get("role", "").lower() in ROLES:
        return 2
    if tag in SAFE or not own:
        return 0
    names = [{w.lower() for w in WORD.findall(c)} for c in [*own.get("class", "").split(), own.get("id", "")] if c]
    # what carries text itself only by a name all of whose words are such
    return int(any(n and n <= NAMED if tag in PROSE else n & NAMED for n in names))


def read(page: str) -> Tree:
    """All blocks of text of the page: character references decoded, white space one space, trimmed."""
    tree = Tree()
    stack: list[tuple[str, int, bool]] = []  # tag, its node or that around it, whether in an article or main
    opened: Counter = Counter()
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                tree.text.append(own)
                tree.node.append(stack[-1][1] if stack else -1)
                tree.linked.append(min(len(own), len(" ".join(html.unescape("".join(linked)).split()))))
            text.clear()
            linked.clear()

    def pop(to: int) -> None:
        for tag, _, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    def last(tags: frozenset | set, within: bool) -> int:
        """The place of the innermost open element of these, not beyond a container that is none of them if within."""
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if within and stack[i][0] in SCOPES:
                    break
        return -1

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            text.append(piece)
            if opened["a"]:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            i = last({tag}, tag not in SCOPES)  # an inline end tag doesn't close containers
            if tag in BLOCKS or i >= 0 and any(t in BLOCKS for t, _, _ in stack[i:]):
                flush()
            if i >= 0:
                pop(i)
            continue
        if tag in BLOCKS:
            flush()
        elif tag == "br":
            text.append(" ")
        if ends := ENDS.get(tag):
            while (i := last(ends, True)) >= 0:
                pop(i)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        raw = m[3] if m[2] else m[6]
        own = attributes(raw) if raw and not raw.isspace() else {}
        _, over, inside = stack[-1] if stack else ("", -1, False)
        why = _reason(tag, own, inside)
        if tag in BLOCKS or why:
            name = tag
            if tag in BLOCKS and own.get("class"):
                name += "." + ".".join(sorted({DIGITS.sub("#", c) for c in own["class"].split()}))
            above = tree.path[over] if over >= 0 else 0
            tree.path.append(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above & 0xFFFFFFFFFFFFFFFF) - (1 << 63) if tag in BLOCKS else above)
            tree.parent.append(over)
            tree.tag.append(tag)
            tree.why.append(why)
            over = len(tree.path) - 1
        stack.append((tag, over, inside or tag in ("article", "main")))
        opened[tag] += 1
    flush()
    return tree


def _own_sums(tree: Tree, values: list) -> list:
    out = [0] * len(tree.parent)
    for n, v in zip(tree.node, values, strict=True):
        if n >= 0:
            out[n] += v
    return out


def _shares(tree: Tree) -> list[int]:
    """For each node the part of the page's prose in it, in thousandths: 1000 where it holds a headline, 0 where it lies
    beside the article or main element of the page that holds text."""
    chars = _own_sums(tree, [len(t) for t in tree.text])
    away = tree.down([w == 2 for w in tree.why], lambda a, b: a or b)
    prose = [0 if x else c for x, c in zip(away, chars, strict=True)]
    held, whole = tree.up(prose), max(1, sum(prose))
    headed = tree.up([int(t == "h1") for t in tree.tag])
    declared = [int(t in ("article", "main") and x > 0) for t, x in zip(tree.tag, held, strict=True)]
    around, inside = tree.up(declared), tree.down(declared, max)
    beside = [any(declared) and not a and not i for a, i in zip(around, inside, strict=True)]
    return [1000 if h else 0 if b else 1000 * x // whole for h, b, x in zip(headed, beside, held, strict=True)]


def _dropped(tree: Tree, boilerplate: dict[int, bool]) -> list[int]:
    """For each node why its blocks don't count; boilerplate: what is known of named paths, where it isn't by share."""
    shares = _shares(tree) if 1 in tree.why else tree.why
    return tree.down([int(boilerplate.get(p, x < LITTLE)) if w == 1 else w for w, p, x in zip(tree.why, tree.path, shares, strict=True)], max)


def named_paths(tree: Tree) -> list[tuple[int, int]]:
    """For each path of nodes with a boilerplate name their shares."""
    out: dict[int, int] = defaultdict(int)
    if 1 in tree.why:
        for w, p, x in zip(tree.why, tree.path, _shares(tree), strict=True):
            if w == 1:
                out[p] += x
    return list(out.items())


def _worth(tree: Tree, dropped: list[int]) -> list[float]:
    """Of each block its length, less what is linked around it; 0 if it is dropped."""
    chars, linked = tree.up(_own_sums(tree, [len(t) for t in tree.text])), tree.up(_own_sums(tree, tree.linked))
    out = []
    for t, n in zip(tree.text, tree.node, strict=True):
        free = 1 - linked[n] / max(chars[n], 1) if n >= 0 else 1
        out.append(0.0 if n >= 0 and dropped[n] else (len(t) + 25) * free * free)
    return out


def article(tree: Tree, dropped: list[int]) -> tuple[int, int] | None:
    """The node that holds the page's article, and its part of the page's prose in thousandths.

    A block counts for the container around it, half for the next, a quarter for the third. Up from the best container:
    the outermost article or main around it, if that holds DECLARED of the prose; else the smallest container with all
    blocks of prose that aren't mostly links."""
    worth = _worth(tree, dropped)
    own: dict[int, float] = defaultdict(float)
    holder = tree.down([-1 if t in PROSE else i for i, t in enumerate(tree.tag)], lambda a, b: b if b >= 0 else a)
    for n, w in zip(tree.node, worth, strict=True):
        h = holder[n] if n >= 0 and w else -1
        for share in (1.0, 0.5, 0.25):
            if h < 0:
                break
            own[h] += w * share * (1.3 if tree.tag[h] in ("article", "main") else 1.0)
            h = holder[tree.parent[h]] if tree.parent[h] >= 0 else -1
    by_path: dict[int, float] = defaultdict(float)
    for h, w in own.items():
        by_path[tree.path[h]] += w
    if not by_path:
        return None
    best = max(by_path, key=lambda p: (by_path[p], p))
    chain = [next(h for h in sorted(own) if tree.path[h] == best)]
    while tree.parent[chain[-1]] >= 0:
        chain.append(tree.parent[chain[-1]])
    # a path's nodes on the page count together
    held: dict[int, float] = defaultdict(float)
    prose: dict[int, int] = defaultdict(int)
    chars, linked = tree.up(_own_sums(tree, [len(t) for t in tree.text])), tree.up(_own_sums(tree, tree.linked))
    unlinked = [int(w > 0 and (n < 0 or 2 * linked[n] <= chars[n])) for n, w in zip(tree.node, worth, strict=True)]
    for p, w, k in zip(tree.path, tree.up(_own_sums(tree, worth)), tree.up(_own_sums(tree, unlinked)), strict=True):
        held[p] += w
        prose[p] += k
    whole, n_prose = sum(worth), sum(unlinked)
    at = next((n for n in reversed(chain) if tree.tag[n] in ("article", "main") and held[tree.path[n]] >= DECLARED * whole), None)
    if at is None:
        at = next((n for n in chain if tree.tag[n] not in PARTS and prose[tree.path[n]] >= n_prose), chain[-1])
    return at, round(1000 * min(1.0, held[tree.path[at]] / max(whole, 1e-9)))


def text_of(page: str, winners: list[int] = (), boilerplate: dict[int, bool] | None = None) -> str:
    """The blocks in the containers on that one of the winning paths which holds most of the page; if the page has none,
    in its own article. A headline before them on a page that has none there belongs to them."""
    tree = read(page)
    known = boilerplate or {}
    for why in (_dropped(tree, known), [2 if w == 2 else 0 for w in _dropped(tree, {p: False for p in tree.path})]):
        kept = [n < 0 or not why[n] for n in tree.node]
        if not any(kept):
            continue
        held: dict[int, int] = defaultdict(int)
        for p, c in zip(tree.path, tree.up(_own_sums(tree, [len(t) * k for t, k in zip(tree.text, kept, strict=True)])), strict=True):
            held[p] += c
        best = max((p for p in winners if held.get(p)), key=lambda p: held[p], default=None)
        if best is None and (own := article(tree, why)):
            best = tree.path[own[0]]
        if best is None:
            lines = [i for i, k in enumerate(kept) if k]
        else:
            inside = tree.down([p == best for p in tree.path], lambda a, b: a or b)
            lines = [i for i, (n, k) in enumerate(zip(tree.node, kept, strict=True)) if k and n >= 0 and inside[n]]
            if lines:
                in_h1 = tree.down([t == "h1" for t in tree.tag], lambda a, b: a or b)
                titles = [i for i, n in enumerate(tree.node) if n >= 0 and kept[i] and in_h1[n]]
                if titles and not set(titles) & set(lines):
                    lines = [i for i in titles if i < lines[0]] + lines
        if lines:
            return "\n".join(tree.text[i] for i in lines)
    return ""


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def host_paths(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """For each host: winners, the paths with WINS of its votes or more, the most first (10 at most, as each page has one
    vote of 1000 at most); keep and drop, named paths on KNOWN of its pages or more that hold much or little prose."""

    @F.pandas_udf("array<struct<named:boolean, path:long, vote:long>>")
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for page in batch:
                tree = read(page) if isinstance(page, str) else Tree()
                found = article(tree, _dropped(tree, {}))
                out.append([{"named": True, "path": p, "vote": x} for p, x in named_paths(tree)] + ([{"named": False, "path": tree.path[found[0]], "vote": found[1]}] if found else []))
            yield pd.Series(out)

    cast = pages.select(host, F.explode(votes(html_col)).alias("v")).groupBy(host, "v.named", "v.path").agg(F.sum("v.vote").alias("vote"), F.count(F.lit(1)).alias("n"))
    cast = saved(cast, f"{workspace(pages.sparkSession, 'votes')}/cast")
    whole = cast.filter(~F.col("named")).groupBy(host).agg(F.sum("vote").alias("all"), F.sum("n").alias("pages"))
    known = cast.join(whole, host).filter(F.when(F.col("named"), F.col("n") * 1000 >= F.col("pages") * KNOWN).otherwise((F.col("vote") > 0) & (F.col("vote") * 1000 >= F.col("all") * WINS)))
    little = F.col("named") & (F.col("vote") < F.col("n") * LITTLE)
    ranked = F.sort_array(F.collect_list(F.when(~F.col("named"), F.struct("vote", "path"))), asc=False)
    listed = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("path"))))
    return known.groupBy(host).agg(F.transform(ranked, lambda x: x["path"]).alias("winners"), listed(F.col("named") & ~little).alias("keep"), listed(little).alias("drop"))


def extract_text(pages: DataFrame, url: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text, the main text (a column of that name is replaced). Null html is empty; a null url or one
    without `://` belongs to the host ''. Repeated rows vote each and get the same text; an empty table stays so."""
    host, paths = free_name(pages, "_host", "_paths")
    hosted = pages.withColumn(host, host_of(F.col(url)))
    won = host_paths(hosted, host, html_col).select(host, F.struct("winners", "keep", "drop").alias(paths))
    won = saved(won, f"{workspace(pages.sparkSession, 'paths')}/won")

    @F.pandas_udf("string")
    def extracted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        none: tuple = ()
        listed = lambda x: x.tolist() if isinstance(x, np.ndarray) else none
        for pages, winners, keep, drop in batches:
            yield pd.Series([text_of(x, listed(w), dict.fromkeys(listed(k), False) | dict.fromkeys(listed(d), True)) if isinstance(x, str) else "" for x, w, k, d in zip(pages, winners, keep, drop, strict=True)], dtype=object)

    joined = hosted.join(small(won), host, "left")
    kept = [F.col(c) for c in pages.columns if c.lower() != "text"]
    own = F.col(paths)
    return joined.select(*kept, extracted(html_col, own["winners"], own["keep"], own["drop"]).alias("text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
