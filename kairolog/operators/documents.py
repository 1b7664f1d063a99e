"""Document filters: OR over expressions, each an AND over comparisons of declared fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairolog.functions import nullsem


@dataclass(frozen=True)
class Comparison:
    field: str
    #: EQ NE LT LE GT GE LIKE NOT_LIKE
    op: str
    value: object


OPS = {"EQ": nullsem.eq, "NE": nullsem.ne, "LT": nullsem.lt, "LE": nullsem.le, "GT": nullsem.gt, "GE": nullsem.ge, "LIKE": nullsem.like, "NOT_LIKE": lambda a, b: nullsem.like(a, b, True)}


def matches(expressions: Sequence[Sequence[Comparison]]) -> Column:
    """No expression: every document."""
    one = lambda c: OPS[c.op](F.col(f"`{c.field}`"), F.lit(c.value))
    return nullsem.any_of(nullsem.all_of(one(c) for c in e) for e in expressions) if expressions else F.lit(True)


def search(docs: DataFrame, expressions: Sequence[Sequence[Comparison]] = (), order: Sequence[tuple[str, bool]] = (), limit: int = 0, offset: int = 0) -> DataFrame:
    """order: (field, descending). A limit of 0 is none."""
    out = docs.filter(matches(expressions))
    if order:
        out = out.orderBy(*[F.col(f"`{f}`").desc() if down else F.col(f"`{f}`") for f, down in order])
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def count(docs: DataFrame, expressions: Sequence[Sequence[Comparison]] = (), limit: int = 0) -> DataFrame:
    """The limit holds before the count."""
    return search(docs, expressions, limit=limit).agg(F.count(F.lit(1)).alias("n"))


def extracted(raw: DataFrame, fields: dict[str, str], doc: str = "_doc") -> DataFrame:
    """Adds typed columns for dotted paths of a JSON column."""
    def value(path: str, kind: str) -> Column:
        at = f"$.{path}"
        return F.try_variant_get(F.try_parse_json(F.col(doc)), at, kind)

    return raw.withColumns({path: value(path, kind) for path, kind in fields.items()})
