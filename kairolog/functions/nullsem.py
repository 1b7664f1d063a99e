"""Two-valued comparisons: NULL equals NULL and is less than any value.

Every builder returns a Column that is never NULL, so AND, OR and NOT need no third value. Equality is `<=>`, which
Catalyst takes as a hash-join key and pushes to Parquet.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def lt(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


def le(a: Column, b: Column) -> Column:
    return a.isNull() | F.coalesce(a <= b, F.lit(False))


def gt(a: Column, b: Column) -> Column:
    return lt(b, a)


def ge(a: Column, b: Column) -> Column:
    return le(b, a)


COMPARE = {"=": eq, "<>": ne, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}


#: The comparison with its sides exchanged.
SWAPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def kept(a: Column, op: str, value: Column) -> Column:
    """For filters: a against a value that isn't NULL, as true where the comparison is and else false or NULL."""
    match op:
        case "<":
            return a.isNull() | (a < value)
        case "<=":
            return a.isNull() | (a <= value)
        case ">":
            return a > value
    return a >= value


def between(a: Column, low: Column, high: Column) -> Column:
    return ge(a, low) & le(a, high)


def any_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x | y, columns, F.lit(False))


def all_of(columns: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, columns, F.lit(True))


def in_list(a: Column, values: Iterable[Column], negated: bool = False) -> Column:
    """Any value equal; so NULL is in (NULL), and NOT IN with a NULL in the list is still true or false."""
    found = any_of(eq(a, v) for v in values)
    return ~found if negated else found


def like(a: Column, pattern: Column, negated: bool = False, any_case: bool = False) -> Column:
    """A NULL is like nothing, and NOT LIKE everything."""
    found = F.ilike(a, pattern) if any_case else F.like(a, pattern)
    return F.coalesce(~found, F.lit(True)) if negated else F.coalesce(found, F.lit(False))
