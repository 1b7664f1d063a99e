"""Syntax tree of the SQL dialect."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any
    kind: str


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Param:
    name: str | int


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    value: Any


@dataclass(frozen=True)
class Like:
    value: Any
    pattern: Any
    negated: bool
    any_case: bool


@dataclass(frozen=True)
class InList:
    value: Any
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    value: Any
    query: Any
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Scalar:
    query: Any


@dataclass(frozen=True)
class Case:
    operand: Any
    arms: tuple
    other: Any


@dataclass(frozen=True)
class Cast:
    value: Any
    kind: str


@dataclass(frozen=True)
class JsonPath:
    value: Any
    path: tuple[str, ...]


@dataclass(frozen=True)
class Extract:
    part: str
    value: Any


@dataclass(frozen=True)
class Call:
    """A function; aggregates too, with star for COUNT(*)."""

    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Over:
    call: Call
    partition: tuple
    order: tuple


@dataclass(frozen=True)
class Order:
    value: Any
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Bound:
    """An end of a period: a transaction or a time."""

    value: Any
    by_tx: bool
    inclusive: bool


@dataclass(frozen=True)
class Source:
    """A table, sub-query, list of values or table function in FROM."""

    table: str | None = None
    query: Any = None
    rows: tuple = ()
    function: tuple | None = None
    alias: str | None = None
    history: bool = False
    diff: bool = False
    since: Bound | None = None
    until: Bound | None = None
    lateral: bool = False


@dataclass(frozen=True)
class Join:
    kind: str
    source: Source
    on: Any = None
    using: tuple[str, ...] = ()
    natural: bool = False


@dataclass(frozen=True)
class Target:
    value: Any
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    targets: tuple = ()
    star: bool = False
    distinct: bool = False
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    order: tuple[Order, ...] = ()
    limit: Any = None
    offset: Any = None


@dataclass(frozen=True)
class SetOp:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class With:
    tables: tuple
    recursive: bool
    query: Any


@dataclass(frozen=True)
class Statement:
    """Everything that isn't a query: its kind and parts."""

    kind: str
    parts: dict = field(default_factory=dict)
