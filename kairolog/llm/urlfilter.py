"""URL filters: a bit-parallel automaton that runs every wildcard rule over each canonical URL at once.

Rules are globs over the bytes of the canonical form `.` host 0xFF path (0xFF is in no UTF-8 text, so a rule's
host can't match inside a path). All rules are packed side by side into 64-bit words: one bit for a rule's start,
one for each symbol. A byte advances all rules of all URLs of a batch by a shift, a mask and the self-loops of `*`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairolog.llm.shared import LOWER, UPPER

SPLIT = 0xFF
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: Host and path of the contract's rules with their verdicts.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Globs on host and path for a url without a rule; `|` stands between host and path. Others are allowed.
GLOBS = (("*|*/ads/*", "block"), ("*|*/adserver/*", "block"), ("*.doubleclick.*|*", "block"), ("*|*/wp-login.php", "block"))


@dataclass(frozen=True)
class Automaton:
    """start: the words before the first byte; masks[byte]: symbols that the byte matches; loops: states before a `*`;
    ends: for each pattern the word and bit of its last state."""

    start: np.ndarray
    masks: np.ndarray
    loops: np.ndarray
    ends: tuple[tuple[int, int], ...]


def rule_glob(host: str, path: str) -> bytes:
    """The glob of a rule: the host and its subdomains, paths that start with the rule's; both literal."""
    quoted = lambda s: b"".join(b"\\" + bytes([c]) if c in b"*?\\" else bytes([c]) for c in s.encode())
    return b"*." + quoted(host.lower()) + bytes([SPLIT]) + quoted(path) + b"*"


def compile_globs(globs: Iterable[bytes]) -> Automaton:
    """`*` matches any bytes, `?` one byte, a backslash makes the next byte literal."""
    symbols: list[int | None] = []  # of each bit: a byte, -1 for any byte, None for a start
    loops, ends = set(), []
    for glob in globs:
        symbols.append(None)
        chars = iter(glob)
        for c in chars:
            if c == ord("*"):
                loops.add(len(symbols) - 1)
            else:
                symbols.append(next(chars, c) if c == ord("\\") else -1 if c == ord("?") else c)
        ends.append(divmod(len(symbols) - 1, 64))
    n = max(1, -(-len(symbols) // 64))
    start, loop, masks = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((256, n), np.uint64)
    for i, s in enumerate(symbols):
        word, bit = i // 64, np.uint64(1 << i % 64)
        if s is None:
            start[word] |= bit
        else:
            masks[slice(None) if s < 0 else s, word] |= bit
        if i in loops:
            loop[word] |= bit
    return Automaton(start, masks, loop, tuple(ends))


def match(automaton: Automaton, texts: list[bytes]) -> np.ndarray:
    """Row by row and pattern by pattern: whether the whole text matches."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = (np.cumsum(sizes) - sizes)[order]
    live = len(texts) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")  # texts longer than i
    state = np.tile(automaton.start, (len(texts), 1))
    for i, k in enumerate(live.tolist()):
        d = state[:k]
        moved = d << np.uint64(1)
        moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
        state[:k] = (moved & automaton.masks[data[at[:k] + i]]) | (d & automaton.loops)
    out = np.empty((len(texts), len(automaton.ends)), bool)
    for p, (word, bit) in enumerate(automaton.ends):
        out[order, p] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
    return out


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """Adds host, path, rule and verdict to df (and replaces columns of these names). Host: after the first `://` up
    to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end; both empty for a null url
    or one without `://`. Of the rules that fit, the longest (host and path together, then the first given) decides; without one, the globs: block if a
    blocking glob fits and no allowing one, else allow. Repeated rows are judged alike; an empty table gives none."""
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][0] + x[1][1]), x[0]))
    names = [host + path for _, (host, path, _) in ranked]
    verdicts = [verdict for _, (_, _, verdict) in ranked]
    patterns = [rule_glob(host, path) for _, (host, path, _) in ranked]
    more = [b"".join(bytes([SPLIT]) if c == "|" else c.encode() for c in "." * (not g.startswith("*")) + g) for g, _ in globs]
    blocking = np.array([v == "block" for _, v in globs], bool)
    automaton = compile_globs([*patterns, *more])

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = match(automaton, [b"." + h.encode() + bytes([SPLIT]) + p.encode() for h, p in zip(host, path, strict=True)])
        own, other = found[:, : len(names)], found[:, len(names) :]
        first = own.argmax(1) if len(names) else np.zeros(len(found), int)
        hit = own.any(1)
        plain = np.where(other[:, blocking].any(1) & ~other[:, ~blocking].any(1), "block", "allow")
        rule = [names[k] if x else None for k, x in zip(first, hit, strict=True)]
        verdict = [verdicts[k] if x else v for k, x, v in zip(first, hit, plain, strict=True)]
        return pd.DataFrame({"rule": pd.Series(rule, dtype=object), "verdict": pd.Series(verdict, dtype=object)})

    host = F.translate(F.coalesce(F.regexp_extract(df[url], URL, 1), F.lit("")), UPPER, LOWER)
    path = F.coalesce(F.regexp_extract(df[url], URL, 2), F.lit(""))
    kept = [df[c] for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    both = df.select(*kept, host.alias("host"), path.alias("path"))
    return both.withColumn("verdict", judged("host", "path")).select(*[c for c in both.columns], "verdict.rule", F.col("verdict.verdict").alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN contains(path, '/ads/') OR contains(path, '/adserver/') OR ends_with(path, '/wp-login.php') OR contains('.' || host, '.doubleclick.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled"""
