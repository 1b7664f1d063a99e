"""Syntax trees to DataFrames.

Every column of every source gets a name of its own, so that joins, self-joins and correlated sub-queries need no
qualifiers; a Scope maps the dialect's names to them, with types. The plan is declared only; Catalyst orders joins,
pushes filters, prunes columns and decorrelates sub-queries.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.functions import nullsem, scalar
from kairolog.functions import types as K
from kairolog.plans import nodes as N
from kairolog.plans.parser import AGGREGATES
from kairolog.sources.scratch import saved, scratch

Typed = tuple[Column, str]
#: Rounds after which a recursive WITH ends.
ROUNDS = 1000
ZERO = {K.INTEGER: 0, K.FLOAT: 0.0, K.VARCHAR: "", K.BOOLEAN: False}
WINDOW_ONLY = frozenset("ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD FIRST_VALUE LAST_VALUE".split())
_numbers = itertools.count()


def _own(name: str) -> str:
    """A column name that no other column has."""
    return f"c{next(_numbers)}_{re.sub(r'[^A-Za-z0-9_]', '_', name)}"


class QueryError(ValueError):
    pass


@dataclass
class Field:
    """A column: its name in the dialect, its own name in the DataFrame, its type, the table it belongs to."""

    name: str
    own: str
    kind: str
    table: str | None = None
    #: merged by USING: found only with its table's name
    hidden: bool = False


@dataclass
class Relation:
    df: DataFrame
    fields: list[Field]


@dataclass
class Scope:
    fields: list[Field]
    outer: Scope | None = None
    #: what stands for expressions that are computed already (aggregates, grouped expressions)
    done: dict = field(default_factory=dict)

    def find(self, name: N.Name) -> Field | None:
        hits = [f for f in self.fields if f.name == name.column and (f.table == name.table if name.table else not f.hidden)]
        if len(hits) > 1:
            raise QueryError(f"ambiguous column {name.column}")
        return hits[0] if hits else None


def relation(df: DataFrame, kinds: dict[str, str] | None = None, table: str | None = None) -> Relation:
    """df with own names for its columns."""
    kinds = kinds or {}
    fields = [Field(f.name.lower(), _own(f.name), kinds.get(f.name, K.of_spark(f.dataType, f.metadata)), table) for f in df.schema.fields]
    columns = [F.col(f"`{f.name}`").cast(K.SPARK[x.kind]) if x.kind in (K.INTEGER, K.FLOAT) else F.col(f"`{f.name}`") for f, x in zip(df.schema.fields, fields, strict=True)]
    return Relation(df.select(*[c.alias(x.own) for c, x in zip(columns, fields, strict=True)]), fields)


def walk(node, found: Callable) -> None:
    """Calls found on every node of an expression, not into sub-queries; found returns True to stop there."""
    if isinstance(node, tuple):
        for x in node:
            walk(x, found)
    elif hasattr(node, "__dataclass_fields__") and not isinstance(node, (N.Select, N.SetOp, N.With)):
        if not found(node):
            for name in node.__dataclass_fields__:
                walk(getattr(node, name), found)


class Compiler:
    """tables(source) gives the DataFrame and types of a named table, with its period; functions(name, args) that of a
    table function."""

    def __init__(self, spark: SparkSession, tables: Callable, functions: Callable, params: dict | None = None, sequences: Callable | None = None, numbered: Callable | None = None):
        self.spark, self.tables, self.functions, self.sequences, self.numbered = spark, tables, functions, sequences, numbered
        self.params = params or {}
        self.bound: dict[str, Relation] = {}

    # queries

    def run(self, node) -> DataFrame:
        rel = self.query(node)
        names: list[str] = []
        for i, f in enumerate(rel.fields):
            names.append(f.name if f.name not in names else f"{f.name}_{i}")
        return rel.df.select(*[F.col(f.own).alias(n, metadata={"kind": f.kind} if f.kind in (K.UUID, K.JSON) else {}) for f, n in zip(rel.fields, names, strict=True)])

    def query(self, node, outer: Scope | None = None) -> Relation:
        if isinstance(node, N.With):
            return self._with(node, outer)
        if isinstance(node, N.SetOp):
            return self._set_op(node, outer)
        return self._select(node, outer)

    def _with(self, node: N.With, outer: Scope | None) -> Relation:
        before = dict(self.bound)
        try:
            for name, columns, query in node.tables:
                rel = self._recursive(name, columns, query, outer) if node.recursive and isinstance(query, N.SetOp) and query.op.startswith("UNION") else self.query(query, outer)
                self.bound[name] = self._renamed(rel, columns)
            return self.query(node.query, outer)
        finally:
            self.bound = before

    @staticmethod
    def _renamed(rel: Relation, columns: tuple) -> Relation:
        return Relation(rel.df, [Field(n, f.own, f.kind) for n, f in zip(columns or [f.name for f in rel.fields], rel.fields, strict=True)])

    def _recursive(self, name: str, columns: tuple, query: N.SetOp, outer: Scope | None) -> Relation:
        """The step sees the rows that the round before added; rows that come again are kept, and a query that adds rows for
        more than ROUNDS rounds is an error. Each round is a table in the shared folder."""
        folder = scratch(self.spark, "recursive")
        rel = self._renamed(self.query(query.left, outer), columns)
        new, parts = saved(rel.df, f"{folder}/0"), []
        for i in range(1, ROUNDS + 1):
            parts.append(new)
            self.bound[name] = Relation(new, rel.fields)
            step = self._aligned(self.query(query.right, outer), rel)
            new = saved(step, f"{folder}/{i}")
            if new.isEmpty():
                break
        else:
            raise QueryError(f"the recursive query doesn't end within {ROUNDS} rounds")
        return Relation(reduce(DataFrame.unionByName, parts), rel.fields)

    @staticmethod
    def _aligned(rel: Relation, to: Relation) -> DataFrame:
        if len(rel.fields) != len(to.fields):
            raise QueryError("queries with different numbers of columns")
        for a, b in zip(rel.fields, to.fields, strict=True):
            if a.kind != b.kind and K.ANY not in (a.kind, b.kind) and {a.kind, b.kind} != {K.INTEGER, K.FLOAT}:
                raise QueryError(f"column {b.name} is {b.kind} here and {a.kind} there")
        return rel.df.select(*[K.cast(F.col(a.own), a.kind, b.kind).alias(b.own) for a, b in zip(rel.fields, to.fields, strict=True)])

    def _set_op(self, node: N.SetOp, outer: Scope | None) -> Relation:
        left = self.query(node.left, outer)
        right = self._aligned(self.query(node.right, outer), left)
        names = [f.own for f in left.fields]
        if node.op.startswith("UNION"):
            both = left.df.select(names).unionByName(right)
            return Relation(both if node.op.endswith("ALL") else both.distinct(), left.fields)
        # rows on the left keep their duplicates
        other = right.select(*[F.col(n).alias(f"r_{n}") for n in names])
        same = nullsem.all_of(F.col(n).eqNullSafe(F.col(f"r_{n}")) for n in names)
        return Relation(left.df.select(names).join(other, same, "left_anti" if node.op.startswith("EXCEPT") else "left_semi"), left.fields)

    def _source(self, source: N.Source, outer: Scope | None) -> Relation:
        if source.rows:
            rel = self._values(source.rows)
        elif source.query is not None:
            inner = self.query(source.query, outer)
            rel = Relation(inner.df, [Field(f.name, f.own, f.kind) for f in inner.fields])
        elif source.function:
            name, args = source.function
            rel = relation(self.functions(name, [a.value for a in args]))
        elif source.table in self.bound and not (source.since or source.until):
            known = self.bound[source.table]
            own = {f.own: _own(f.name) for f in known.fields}
            rel = Relation(known.df.select(*[F.col(a).alias(b) for a, b in own.items()]), [Field(f.name, own[f.own], f.kind) for f in known.fields])
        else:
            rel = relation(*self.tables(source, self))
        table = source.alias or source.table or (source.function[0] if source.function else None)
        return Relation(rel.df, [Field(f.name, f.own, f.kind, table) for f in rel.fields])

    def _values(self, rows: tuple) -> Relation:
        none = Scope([])
        typed = [[self.expr(x, none) for x in row] for row in rows]
        if len({len(r) for r in typed}) > 1:
            raise QueryError("rows of different lengths")
        kinds = []
        for i, column in enumerate(zip(*typed, strict=True)):
            found = {k for _, k in column if k != K.ANY}
            if len(found) > 1:
                raise QueryError(f"col{i} has values of {', '.join(sorted(found))}")
            kinds.append(found.pop() if found else K.ANY)
        names = [f"col{i}" for i in range(len(kinds))]
        one = F.array(*[F.struct(*[K.cast(c, k, kind).alias(n) for (c, k), kind, n in zip(row, kinds, names, strict=True)]) for row in typed])
        df = self.spark.range(1).select(F.explode(one).alias("v")).select("v.*")
        return relation(df, dict(zip(names, kinds, strict=True)))

    def _join(self, left: Relation, join: N.Join, outer: Scope | None) -> Relation:
        if join.kind == "RIGHT" and join.source.lateral:
            raise QueryError("RIGHT JOIN LATERAL")
        right = self._source(join.source, Scope(left.fields, outer) if join.source.lateral else outer)
        names = join.using or (tuple(f.name for f in left.fields if not f.hidden and f.name in {g.name for g in right.fields}) if join.natural else ())
        scope = Scope(left.fields + right.fields, outer)
        how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full_outer", "CROSS": "cross"}[join.kind]
        if names:
            pairs = [(Scope(left.fields).find(N.Name(n)), Scope(right.fields).find(N.Name(n))) for n in names]
            if any(a is None or b is None for a, b in pairs):
                raise QueryError(f"USING needs columns of both sides: {', '.join(names)}")
            on = nullsem.all_of(nullsem.eq(*self._level((F.col(a.own), a.kind), (F.col(b.own), b.kind))[:2]) for a, b in pairs)
            df = left.df.join(right.df, on, "inner" if how == "cross" else how)
            merged = {b.own for _, b in pairs}
            fields = list(left.fields)
            if how in ("right", "full_outer"):
                for a, b in pairs:
                    own = _own(a.name)
                    df = df.withColumn(own, F.coalesce(F.col(a.own), F.col(b.own)))
                    fields = [Field(f.name, f.own, f.kind, f.table, f.hidden or f.own == a.own) for f in fields] + [Field(a.name, own, a.kind)]
            return Relation(df, fields + [Field(f.name, f.own, f.kind, f.table, f.own in merged) for f in right.fields])
        on = self.condition(join.on, scope) if join.on is not None else None
        if join.source.lateral:
            df = left.df.lateralJoin(right.df, on, "left" if how == "left" else "inner" if on is not None else "cross")
        elif on is None:
            df = left.df.crossJoin(right.df)
        else:
            df = left.df.join(right.df, on, "inner" if how == "cross" else how)
        return Relation(df, scope.fields)

    def _select(self, q: N.Select, outer: Scope | None) -> Relation:
        rel = self._source(q.source, outer) if q.source else Relation(self.spark.range(1).select(), [])
        for join in q.joins:
            rel = self._join(rel, join, outer)
        df, scope = rel.df, Scope(rel.fields, outer)
        aliases = {t.alias: t.value for t in q.targets if t.alias}
        if q.where is not None:
            df = df.filter(self.where(q.where, scope))
        targets = [N.Target(N.Name(f.name, f.table) if f.table else N.Name(f.name)) for f in rel.fields if not f.hidden] if q.star else list(q.targets)
        by_alias = lambda e: aliases[e.column] if isinstance(e, N.Name) and not e.table and e.column in aliases and scope.find(e) is None else e
        order = [self._order_value(o, targets, aliases, scope) for o in q.order]
        group = [by_alias(g) for g in q.group]
        if q.having is not None and not group:
            raise QueryError("HAVING needs GROUP BY")
        aggregates: list[N.Call] = []

        def aggregate(node) -> bool:
            if isinstance(node, N.Over):
                walk((node.call.args, node.partition, node.order), aggregate)
                return True
            if isinstance(node, N.Call) and node.name in AGGREGATES:
                if node not in aggregates:
                    aggregates.append(node)
                return True
            return False

        walk((tuple(t.value for t in targets), q.having, tuple(o.value for o in order)), aggregate)
        if group or aggregates:
            df, scope = self._grouped(df, scope, group, aggregates)
            if q.having is not None:
                df = df.filter(self.condition(q.having, scope))
        if q.source is not None and (calls := self._drawn(targets)):
            df, scope = self._with_sequences(df, scope, calls)
        values = [self.expr(t.value, scope) for t in targets]
        fields = [Field(self._shown(t, i), f"c{next(_numbers)}_{i}", k) for i, (t, (_, k)) in enumerate(zip(targets, values, strict=True))]
        keys = [f"k{next(_numbers)}" for _ in order]
        shown = {t.value: f.own for t, f in zip(targets, fields, strict=True)}
        columns = [c.alias(f.own) for (c, _), f in zip(values, fields, strict=True)]
        if q.distinct:
            df = df.select(*columns).distinct()
            if any(o.value not in shown for o in order):
                raise QueryError("ORDER BY of DISTINCT rows needs selected columns")
            keys = [shown[o.value] for o in order]
        else:
            df = df.select(*columns, *[self.expr(o.value, scope)[0].alias(k) for o, k in zip(order, keys, strict=True)])
        if order:
            df = df.orderBy(*[self._sorted(F.col(k), o) for o, k in zip(order, keys, strict=True)])
        if (n := self._whole(q.offset)) > 0:
            df = df.offset(n)
        if (n := self._whole(q.limit)) > 0:  # 0 is no limit
            df = df.limit(n)
        return Relation(df.select(*[f.own for f in fields]), fields)

    @staticmethod
    def _drawn(targets: list) -> list[N.Call]:
        calls: list[N.Call] = []

        def found(node) -> bool:
            if isinstance(node, N.Call) and node.name == "NEXTVAL" and node not in calls:
                calls.append(node)
            return False

        walk(tuple(t.value for t in targets), found)
        return calls

    def _with_sequences(self, df: DataFrame, scope: Scope, calls: list[N.Call]) -> tuple[DataFrame, Scope]:
        """A value of its own for each row: the rows are numbered, and as many values drawn at once."""
        if self.sequences is None or self.numbered is None:
            raise QueryError("sequences need an engine")
        df = self.numbered(df)
        n, done = df.count(), dict(scope.done or {})
        for call in calls:
            own = f"q{next(_numbers)}"
            first, step = self.sequences("NEXTVAL", call.args[0].value, n)
            df = df.withColumn(own, F.lit(first).cast("bigint") + F.col("_seq") * F.lit(step))
            done[call] = (own, K.INTEGER)
        return df.drop("_seq"), Scope(scope.fields, scope.outer, done)

    def _order_value(self, o: N.Order, targets: list, aliases: dict, scope: Scope) -> N.Order:
        value = o.value
        if isinstance(value, N.Literal) and value.kind == K.INTEGER:
            if not 1 <= value.value <= len(targets):
                raise QueryError(f"ORDER BY {value.value} of {len(targets)} columns")
            value = targets[value.value - 1].value
        elif isinstance(value, N.Name) and not value.table and value.column in aliases:
            value = aliases[value.column]
        return N.Order(value, o.descending, o.nulls_first)

    @staticmethod
    def _sorted(column: Column, o: N.Order) -> Column:
        first = o.nulls_first if o.nulls_first is not None else not o.descending
        if o.descending:
            return column.desc_nulls_first() if first else column.desc_nulls_last()
        return column.asc_nulls_first() if first else column.asc_nulls_last()

    def _whole(self, node) -> int:
        if node is None:
            return 0
        value = self.params.get(node.name) if isinstance(node, N.Param) else node.value if isinstance(node, N.Literal) else None
        if not isinstance(value, int) or value < 0:
            raise QueryError("LIMIT and OFFSET need whole numbers of 0 or more")
        return value

    @staticmethod
    def _shown(target: N.Target, i: int) -> str:
        return target.alias or (target.value.column if isinstance(target.value, N.Name) else f"col{i}")

    def _grouped(self, df: DataFrame, scope: Scope, group: list, aggregates: list[N.Call]) -> tuple[DataFrame, Scope]:
        keys = [(g, *self.expr(g, scope), f"g{next(_numbers)}") for g in group]
        made, after, done = [], {}, {}
        for call in aggregates:
            own = f"a{next(_numbers)}"
            column, kind, finish = self._aggregate(call, scope, own)
            made += column
            after[own] = finish
            done[call] = (own, kind)
        values = made or [F.count(F.lit(1)).alias("n_rows")]
        # without keys by select(), which also takes columns of an outer query that are not resolved yet
        grouped = df.groupBy(*[c.alias(own) for _, c, _, own in keys]).agg(*values) if keys else df.select(*values)
        columns = [F.col(own) for *_, own in keys]
        for call, (own, kind) in done.items():
            value = after[own]
            if not group and kind in ZERO:  # of no rows: a row of zeros
                value = F.coalesce(value, F.lit(ZERO[kind]))
            columns.append(value.alias(own))
        fields = []
        for g, _, kind, own in keys:
            if isinstance(g, N.Name):
                f = scope.find(g)
                fields.append(Field(g.column, own, kind, f.table if f else None))
        known = {g: (own, kind) for g, _, kind, own in keys} | done
        return grouped.select(*columns), Scope(fields, scope.outer, known)

    def _aggregate(self, call: N.Call, scope: Scope, own: str) -> tuple[list[Column], str, Column]:
        """Columns to aggregate, the type, and the value from them."""
        if call.star or not call.args:
            return [F.count(F.lit(1)).alias(own)], K.INTEGER, F.col(own)
        column, kind = self.expr(call.args[0], scope)
        match call.name:
            case "COUNT":
                return [(F.count_distinct(column) if call.distinct else F.count(column)).alias(own)], K.INTEGER, F.col(own)
            case "MIN" | "MAX":
                return [(F.min if call.name == "MIN" else F.max)(column).alias(own)], kind, F.col(own)
            case "STRING_AGG":
                separator = call.args[1].value if len(call.args) > 1 else ""
                return [F.sort_array(F.collect_list(K.cast(column, kind, K.VARCHAR))).alias(own)], K.VARCHAR, F.when(F.size(own) > 0, F.array_join(own, separator))
        if kind == K.JSON:
            column, kind = scalar.as_scalar(column, K.FLOAT), K.FLOAT
        if kind not in (K.INTEGER, K.FLOAT):
            raise QueryError(f"{call.name} of {kind}")
        total = (F.sum_distinct if call.distinct else F.sum)(column)
        if call.name == "SUM":
            return [total.alias(own)], kind, F.col(own)
        n = (F.count_distinct if call.distinct else F.count)(column)
        both = [total.alias(f"{own}_s"), n.alias(f"{own}_n")]
        n_or_null = F.nullif(F.col(f"{own}_n"), F.lit(0))
        return both, kind, F.call_function("div", F.col(f"{own}_s"), n_or_null) if kind == K.INTEGER else F.col(f"{own}_s") / n_or_null

    # expressions

    def condition(self, node, scope: Scope) -> Column:
        column, kind = self.expr(node, scope)
        if kind == K.JSON:
            column = scalar.as_scalar(column, K.BOOLEAN)
        elif kind not in (K.BOOLEAN, K.ANY):
            raise QueryError(f"a condition of type {kind}")
        return F.coalesce(column.cast("boolean"), F.lit(False))

    def where(self, node, scope: Scope) -> Column:
        """condition() for a filter, where false and NULL are alike: comparisons with a constant stay as they are, so that
        they reach the scan."""
        if isinstance(node, N.Binary) and node.op in ("AND", "OR"):
            a, b = self.where(node.left, scope), self.where(node.right, scope)
            return a & b if node.op == "AND" else a | b
        if isinstance(node, N.Binary) and node.op in nullsem.SWAPPED:
            for left, right, op in ((node.left, node.right, node.op), (node.right, node.left, nullsem.SWAPPED[node.op])):
                value = self._constant(right)
                if value is not None and not isinstance(left, N.Literal):
                    a, b = self.expr(left, scope), self.expr(right, scope)
                    if a[1] == b[1] or {a[1], b[1]} == {K.INTEGER, K.FLOAT}:  # no cast that could give NULL
                        x, y, _ = self._level(a, b)
                        return nullsem.kept(x, op, y)
        return self.condition(node, scope)

    def _constant(self, node):
        """The value of a literal or a parameter; None if it is neither, or NULL."""
        return node.value if isinstance(node, N.Literal) else self.params.get(node.name) if isinstance(node, N.Param) else None

    def _level(self, a: Typed, b: Typed) -> tuple[Column, Column, str]:
        """Both in a type in which they compare."""
        try:
            kind = K.common(a[1], b[1])
        except TypeError as e:
            raise QueryError(str(e)) from None
        to = lambda x: scalar.as_scalar(x[0], kind) if x[1] == K.JSON and kind != K.JSON else K.cast(*x, kind)
        return to(a), to(b), kind

    def literal(self, value) -> Typed:
        import datetime
        import uuid

        if isinstance(value, uuid.UUID):
            return F.lit(str(value)), K.UUID
        if isinstance(value, bool):
            return F.lit(value), K.BOOLEAN
        if isinstance(value, int):
            return F.lit(value).cast("bigint"), K.INTEGER
        if isinstance(value, float):
            return F.lit(value), K.FLOAT
        if isinstance(value, datetime.datetime):
            return F.lit(value).cast("timestamp_ntz"), K.TIMESTAMP
        if isinstance(value, (bytes, bytearray)):
            return F.lit(bytes(value)), K.BLOB
        return (F.lit(None), K.ANY) if value is None else (F.lit(value), K.VARCHAR)

    def expr(self, node, scope: Scope) -> Typed:
        if scope.done and node in scope.done:
            own, kind = scope.done[node]
            return F.col(own), kind
        return getattr(self, f"_{type(node).__name__.lower()}")(node, scope)

    def _literal(self, node: N.Literal, scope: Scope) -> Typed:
        return self.literal(node.value)[0], node.kind

    def _param(self, node: N.Param, scope: Scope) -> Typed:
        if node.name not in self.params:
            raise QueryError(f"parameter {node.name} is missing")
        return self.literal(self.params[node.name])

    def _name(self, node: N.Name, scope: Scope) -> Typed:
        depth, at = 0, scope
        while at is not None:
            f = at.find(node)
            if f is not None:
                return (F.col(f.own).outer() if depth else F.col(f.own)), f.kind
            at, depth = at.outer, depth + 1
        raise QueryError(f"no column {node.table + '.' if node.table else ''}{node.column}" + (" outside of an aggregate or GROUP BY" if scope.done else ""))

    def _binary(self, node: N.Binary, scope: Scope) -> Typed:
        a, b = self.expr(node.left, scope), self.expr(node.right, scope)
        if node.op in ("AND", "OR"):
            for x in (a, b):
                if x[1] not in (K.BOOLEAN, K.ANY):
                    raise QueryError(f"{node.op} of {x[1]}")
            return (a[0] & b[0] if node.op == "AND" else a[0] | b[0]), K.BOOLEAN
        if node.op in nullsem.COMPARE:
            x, y, _ = self._level(a, b)
            if isinstance(node.right, N.Literal) and node.right.value is None and node.op in ("=", "<>"):
                return (a[0].isNull() if node.op == "=" else a[0].isNotNull()), K.BOOLEAN
            return nullsem.COMPARE[node.op](x, y), K.BOOLEAN
        number = lambda x: (scalar.as_scalar(x[0], K.FLOAT), K.FLOAT) if x[1] == K.JSON else (K.cast(*x, K.FLOAT), K.FLOAT) if x[1] in (K.VARCHAR, K.ANY) else x
        a, b = number(a), number(b)
        for x in (a, b):
            if x[1] not in (K.INTEGER, K.FLOAT):
                raise QueryError(f"{node.op} of {x[1]}")
        x, y, kind = self._level(a, b)
        match node.op:
            case "+":
                return x + y, kind
            case "-":
                return x - y, kind
            case "*":
                return x * y, kind
            case "/":
                return (F.call_function("div", x, y) if kind == K.INTEGER else x / y), kind
        return x % y, kind

    def _not(self, node: N.Not, scope: Scope) -> Typed:
        column, kind = self.expr(node.value, scope)
        if kind not in (K.BOOLEAN, K.ANY):
            raise QueryError(f"NOT of {kind}")
        return ~column, K.BOOLEAN

    def _like(self, node: N.Like, scope: Scope) -> Typed:
        a, p = self.expr(node.value, scope), self.expr(node.pattern, scope)
        return nullsem.like(K.cast(*a, K.VARCHAR), K.cast(*p, K.VARCHAR), node.negated, node.any_case), K.BOOLEAN

    def _inlist(self, node: N.InList, scope: Scope) -> Typed:
        a = self.expr(node.value, scope)
        found = nullsem.any_of(nullsem.eq(*self._level(a, self.expr(x, scope))[:2]) for x in node.items)
        return (~found if node.negated else found), K.BOOLEAN

    def _inquery(self, node: N.InQuery, scope: Scope) -> Typed:
        inner = self.query(node.query, scope)
        value = self.expr(node.value, Scope([], scope))
        x, y, _ = self._level((F.col(inner.fields[0].own), inner.fields[0].kind), value)
        found = inner.df.filter(nullsem.eq(x, y)).exists()
        return (~found if node.negated else found), K.BOOLEAN

    def _exists(self, node: N.Exists, scope: Scope) -> Typed:
        return self.query(node.query, scope).df.exists(), K.BOOLEAN

    def _scalar(self, node: N.Scalar, scope: Scope) -> Typed:
        inner = self.query(node.query, scope)
        single = isinstance(node.query, N.Select) and not node.query.group and any(isinstance(t.value, N.Call) and t.value.name in AGGREGATES for t in node.query.targets)
        df = inner.df.select(inner.fields[0].own)
        return (df if single else df.limit(1)).scalar(), inner.fields[0].kind

    def _case(self, node: N.Case, scope: Scope) -> Typed:
        arms = [self.expr(then, scope) for _, then in node.arms] + ([self.expr(node.other, scope)] if node.other is not None else [])
        kind = reduce(K.common, [k for _, k in arms])
        out = None
        operand = self.expr(node.operand, scope) if node.operand is not None else None
        for (when, _), (then, own) in zip(node.arms, arms, strict=False):
            if operand is None:
                test = self.condition(when, scope)
            else:
                test = nullsem.eq(*self._level(operand, self.expr(when, scope))[:2])
            then = K.cast(then, own, kind)
            out = F.when(test, then) if out is None else out.when(test, then)
        if node.other is not None:
            out = out.otherwise(K.cast(*arms[-1], kind))
        return out, kind

    def _cast(self, node: N.Cast, scope: Scope) -> Typed:
        column, kind = self.expr(node.value, scope)
        if kind == K.JSON and node.kind != K.JSON:
            return scalar.as_scalar(column, node.kind), node.kind
        return K.cast(column, kind, node.kind), node.kind

    def _jsonpath(self, node: N.JsonPath, scope: Scope) -> Typed:
        column, kind = self.expr(node.value, scope)
        if kind not in (K.JSON, K.VARCHAR):
            raise QueryError(f"-> of {kind}")
        return scalar.json_path(column, list(node.path)), K.JSON

    def _extract(self, node: N.Extract, scope: Scope) -> Typed:
        if node.part not in ("year", "month", "day", "hour", "minute", "second"):
            raise QueryError(f"EXTRACT of {node.part}")
        return scalar.part(node.part, K.cast(*self.expr(node.value, scope), K.TIMESTAMP)).cast("bigint"), K.INTEGER

    def _call(self, node: N.Call, scope: Scope) -> Typed:
        if node.name in AGGREGATES:
            raise QueryError(f"{node.name} can't stand here")
        if node.name in ("NEXTVAL", "CURRVAL"):
            if self.sequences is None:
                raise QueryError("sequences need an engine")
            return self.literal(self.sequences(node.name, node.args[0].value)[0])
        try:
            return scalar.call(node.name, [self.expr(a, scope) for a in node.args])
        except (ValueError, TypeError) as e:
            raise QueryError(str(e)) from None

    def _over(self, node: N.Over, scope: Scope) -> Typed:
        call = node.call
        args = [self.expr(a, scope) for a in call.args]
        window = Window.partitionBy(*[self.expr(p, scope)[0] for p in node.partition])
        ordered = window.orderBy(*[self._sorted(self.expr(o.value, scope)[0], o) for o in node.order] or [F.lit(1)])
        whole = (ordered if node.order else window).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if call.name in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
            return {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[call.name]().over(ordered).cast("bigint"), K.INTEGER
        if call.name == "NTILE":
            return F.ntile(call.args[0].value).over(ordered).cast("bigint"), K.INTEGER
        if call.name in ("LAG", "LEAD"):
            step = call.args[1].value if len(call.args) > 1 else 1
            return (F.lag if call.name == "LAG" else F.lead)(args[0][0], step).over(ordered), args[0][1]
        if call.name in ("FIRST_VALUE", "LAST_VALUE"):
            return (F.first if call.name == "FIRST_VALUE" else F.last)(args[0][0]).over(whole), args[0][1]
        if call.name == "COUNT":  # rows of the partition
            return F.count(F.lit(1)).over(window), K.INTEGER
        if call.name == "SUM":
            return F.coalesce(F.sum(K.cast(*args[0], K.FLOAT)).over(window), F.lit(0.0)), K.FLOAT
        if call.name == "AVG":
            return F.avg(K.cast(*args[0], K.FLOAT)).over(window), K.FLOAT
        if call.name in ("MIN", "MAX"):
            return (F.min if call.name == "MIN" else F.max)(args[0][0]).over(window), args[0][1]
        raise QueryError(f"unknown window function {call.name}")
