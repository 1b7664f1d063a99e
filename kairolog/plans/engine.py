"""The engine: SQL text against a versioned database, in transactions.

Queries are DataFrames. A statement that changes data computes its batch as a DataFrame, writes it as files and, at the
commit, adds one manifest; within a transaction later statements read the batches before them.
"""

from __future__ import annotations

import copy
import datetime
import hashlib
import re
import secrets
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.functions import types as K
from kairolog.operators import temporal
from kairolog.plans import nodes as N
from kairolog.plans.compiler import Compiler, QueryError, Relation, Scope, relation
from kairolog.plans.parser import expression, parse
from kairolog.sources.versionlog import Catalog, Column, Database, Table

PSEUDO = {"_rev": K.INTEGER, "_diff_action": K.VARCHAR, "_tx_metadata": K.JSON}
#: Longest index: columns.
INDEX_COLUMNS = 8


class KeyExists(QueryError):
    """INSERT of a key that is there."""


class ConstraintError(QueryError):
    """A row breaks NOT NULL, a length, a CHECK or a unique index."""


class Engine:
    """One session. tables: DataFrames that are known by name besides the database's own (a table resolver)."""

    def __init__(self, spark: SparkSession, root: str | None = None, database: str = "defaultdb", tables: dict[str, DataFrame] | None = None):
        self.spark, self.root = spark, root
        self.db = Database(spark, root, database) if root else None
        self.resolved = dict(tables or {})
        self.own_users: dict[str, dict] = {}  # of a session without a database
        self.staged: list[dict] = []
        self.catalog: Catalog | None = None  # a changed one, not yet committed
        self.open = False
        self.savepoints: list[tuple[str, int, Catalog | None]] = []
        self.metadata: dict | None = None
        self.currval: dict[str, int] = {}
        self.asts: dict[str, N.Select] = {}

    # reading

    @property
    def now(self) -> Catalog:
        return self.catalog or (self.db.catalog if self.db else Catalog())

    @property
    def users(self) -> dict[str, dict]:
        return self.now.users if self.db else self.own_users

    def query(self, sql: str, params: dict | None = None) -> DataFrame:
        """The rows of the one query in the text."""
        found = parse(sql)
        if len(found) != 1 or isinstance(found[0], N.Statement) and found[0].kind not in ("explain", "show") and not found[0].parts.get("returning"):
            raise QueryError("expected one query")
        return self.run(found[0], params)

    def execute(self, sql: str, params: dict | None = None) -> list:
        """Runs all statements; of each the rows (queries), the rows returned, or the number of rows changed."""
        return [self.run(node, params) for node in parse(sql)]

    def run(self, node, params: dict | None = None):
        if isinstance(node, N.Statement):
            try:
                return getattr(self, f"_{node.kind}")(**node.parts, **({"params": params} if node.kind in ("insert", "update", "delete", "explain") else {}))
            except Exception:
                if not self.open or node.kind in ("insert", "update", "delete"):
                    self._rollback()  # a failed statement leaves nothing that a later one would commit
                raise
        return self.compiler(params).run(node)

    def compiler(self, params: dict | None = None) -> Compiler:
        return Compiler(self.spark, self._table, self._function, params, self._sequence, self._numbered)

    def _table(self, source: N.Source, compiler: Compiler):
        name = source.table
        if name in self.now.views:
            rel = compiler.query(parse(self.now.views[name])[0])
            return rel.df.select(*[F.col(f.own).alias(f.name) for f in rel.fields]), {f.name: f.kind for f in rel.fields}
        if name not in self.now.tables:
            if name in self.resolved:
                return (self.resolved[name],)
            if (system := self._system(name)) is not None:
                return (system,)
            raise QueryError(f"no table {name}")
        table = self.now.tables[name]
        log = self.db.log(table, self.staged)
        kinds = table.kinds | PSEUDO
        low, high = self._period(source, compiler)
        if source.diff:
            if source.since is None or source.until is None:
                raise QueryError("DIFF OF needs both ends of a period")
            before = None
            if not source.since.by_tx:
                time = self._value(source.since.value, compiler)
                before = temporal.tx_until(self.db.headers(), time, not source.since.inclusive) or 0
            elif low == 1:
                raise QueryError("DIFF OF can't begin at the first transaction")
            return temporal.diff(log, table.key, low, high, before), kinds
        if source.history:
            return temporal.history(log, table.key).select("_rev", *[c.name for c in table.columns]), kinds
        if (source.since is not None or source.until is not None) and (low, high) == (None, None):
            return self.spark.createDataFrame([], table.schema), kinds
        return temporal.between(log, table.key, low, high), kinds

    def _value(self, node, compiler: Compiler):
        column, kind = compiler.expr(node, Scope([]))
        if kind == K.VARCHAR:
            column = K.cast(column, kind, K.TIMESTAMP)
        return self.spark.range(1).select(column.alias("v")).first()[0]

    def _period(self, source: N.Source, compiler: Compiler) -> tuple[int | None, int | None]:
        """(0, 0) if no transaction lies in it."""
        low = high = None
        if source.since is not None:
            value = self._value(source.since.value, compiler)
            low = value + (not source.since.inclusive) if source.since.by_tx else temporal.tx_since(self.db.headers(), value, source.since.inclusive)
            if low is None:
                return 0, 0
        if source.until is not None:
            value = self._value(source.until.value, compiler)
            high = value - (not source.until.inclusive) if source.until.by_tx else temporal.tx_until(self.db.headers(), value, source.until.inclusive)
            if high is None:
                return 0, 0
        return low, high

    # catalog as tables

    def _function(self, name: str, args: list) -> DataFrame:
        rows = lambda data, schema: self.spark.createDataFrame(data, schema)
        tables = self.now.tables
        if name == "databases":
            return rows([(d,) for d in self.databases()], "name string")
        if name == "tables":
            return rows([(t,) for t in sorted(tables)], "name string")
        if name == "table":
            t = tables[args[0]]
            return rows([(c.name, c.kind, not c.not_null and c.name not in t.key, c.name in t.key, c.auto) for c in t.columns], "name string, type string, nullable boolean, primary_key boolean, auto_increment boolean")
        if name == "users":
            return rows([(u, x["permission"]) for u, x in sorted(self.users.items())], "name string, permission string")
        if name == "columns":
            t = tables[args[0]]
            return rows([(args[0], c.name, c.kind, c.max or 0, not c.not_null and c.name not in t.key, c.auto, c.name in {k for i in t.indexes for k in i["columns"]} | set(t.key), c.name in t.key, False) for c in t.columns], "table string, name string, type string, max_length int, nullable boolean, auto_increment boolean, indexed boolean, primary boolean, unique boolean")
        if name == "indexes":
            t = tables[args[0]]
            found = [{"columns": t.key, "unique": True, "primary": True}, *t.indexes]
            return rows([(args[0], f"{args[0]}({','.join(i['columns'])})", i["unique"], i.get("primary", False)) for i in found], "table string, name string, unique boolean, primary boolean")
        if name == "grants":
            return rows([(u, d, p) for u, x in sorted(self.users.items()) if not args or u == args[0] for d, ps in x["grants"].items() for p in sorted(ps)], "user string, database string, privilege string")
        raise QueryError(f"unknown table function {name}")

    def databases(self) -> list[str]:
        from kairolog.sources.store import Store

        return Store(self.spark, self.root).names("") if self.root else []

    def _system(self, name: str) -> DataFrame | None:
        """What clients look up in pg_catalog and information_schema."""
        rows = lambda data, schema: self.spark.createDataFrame(data, schema)
        tables = sorted(self.now.tables.items())
        number = {t: 16384 + i for i, (t, _) in enumerate(tables)}
        # Type numbers of the PostgreSQL protocol.
        types = {K.BOOLEAN: 16, K.BLOB: 17, K.INTEGER: 20, K.VARCHAR: 25, K.JSON: 114, K.FLOAT: 701, K.TIMESTAMP: 1114, K.UUID: 2950}
        names = {K.BOOLEAN: "boolean", K.BLOB: "bytea", K.INTEGER: "bigint", K.VARCHAR: "character varying", K.JSON: "jsonb", K.FLOAT: "double precision", K.TIMESTAMP: "timestamp without time zone", K.UUID: "uuid"}
        made = {
            "pg_class": lambda: rows([(number[t], t, 2200, "r", len(x.columns)) for t, x in tables], "oid long, relname string, relnamespace long, relkind string, relnatts int"),
            "pg_attribute": lambda: rows([(number[t], c.name, types[c.kind], i + 1, c.not_null or c.name in x.key) for t, x in tables for i, c in enumerate(x.columns)], "attrelid long, attname string, atttypid long, attnum int, attnotnull boolean"),
            "pg_index": lambda: rows([(number[t], True, True, ",".join(x.key)) for t, x in tables] + [(number[t], i["unique"], False, ",".join(i["columns"])) for t, x in tables for i in x.indexes], "indrelid long, indisunique boolean, indisprimary boolean, indkey string"),
            "pg_namespace": lambda: rows([(11, "pg_catalog"), (2200, "public")], "oid long, nspname string"),
            "pg_am": lambda: rows([(403, "btree")], "oid long, amname string"),
            "pg_type": lambda: rows([(n, names[k], 11) for k, n in types.items()], "oid long, typname string, typnamespace long"),
            "pg_database": lambda: rows([(i + 1, d) for i, d in enumerate(self.databases())], "oid long, datname string"),
            "pg_roles": lambda: rows([(i + 10, u) for i, u in enumerate(sorted(self.users) or ["kairolog"])], "oid long, rolname string"),
            "pg_settings": lambda: rows([("server_encoding", "UTF8"), ("TimeZone", "UTC")], "name string, setting string"),
            "pg_constraint": lambda: rows([(number[t], f"{t}_pkey", "p") for t, x in tables] + [(number[t], n, "c") for t, x in tables for n, _ in x.checks], "conrelid long, conname string, contype string"),
            "pg_tables": lambda: rows([("public", t) for t, _ in tables], "schemaname string, tablename string"),
            "pg_indexes": lambda: rows([("public", t, f"{t}_{'_'.join(i['columns'])}") for t, x in tables for i in x.indexes], "schemaname string, tablename string, indexname string"),
            "pg_views": lambda: rows([("public", v) for v in sorted(self.now.views)], "schemaname string, viewname string"),
            "pg_sequences": lambda: rows([("public", n, s["start"], s["increment"]) for n, s in sorted(self.now.sequences.items())], "schemaname string, sequencename string, start_value long, increment_by long"),
            "tables": lambda: rows([(self.db.name, "public", t, "BASE TABLE") for t, _ in tables], "table_catalog string, table_schema string, table_name string, table_type string"),
            "columns": lambda: rows([("public", t, c.name, i + 1, names[c.kind], "NO" if c.not_null or c.name in x.key else "YES") for t, x in tables for i, c in enumerate(x.columns)], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"),
            "schemata": lambda: rows([(self.db.name, "public")], "catalog_name string, schema_name string"),
            "key_column_usage": lambda: rows([(f"{t}_pkey", t, k, i + 1) for t, x in tables for i, k in enumerate(x.key)], "constraint_name string, table_name string, column_name string, ordinal_position int"),
            "table_constraints": lambda: rows([(f"{t}_pkey", t, "PRIMARY KEY") for t, _ in tables] + [(n, t, "CHECK") for t, x in tables for n, _ in x.checks], "constraint_name string, table_name string, constraint_type string"),
        }
        if name in made:
            return made[name]()
        if name in ("pg_description", "pg_proc", "pg_attrdef", "pg_collation", "pg_inherits", "pg_policy", "pg_publication", "pg_statistic_ext"):
            return rows([], "oid long")
        return None

    def _show(self, what: str, arg: str | None) -> DataFrame:
        return self._function({"table": "columns"}.get(what, what), [arg] if arg else [])

    def _explain(self, query, params: dict | None = None) -> DataFrame:
        df = self.compiler(params).run(query)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(line,) for line in plan.splitlines()], "plan string")

    # transactions

    def _begin(self):
        if self.open:
            raise QueryError("a transaction is open")
        self.open = True

    def _commit(self):
        if not self.open:
            raise QueryError("no transaction is open")
        self.open = False
        return self._finish()

    def _finish(self) -> int | None:
        tx = self.db.commit(self.staged, self.catalog, self.metadata) if self.staged or self.catalog else None
        self.staged, self.catalog, self.savepoints = [], None, []
        return tx

    def _rollback(self):
        for b in self.staged:
            self.db.store.remove(b["path"])
        self.staged, self.catalog, self.savepoints, self.open = [], None, [], False

    def _savepoint(self, name: str):
        self.savepoints.append((name, len(self.staged), copy.deepcopy(self.catalog)))

    def _at(self, name: str) -> int:
        for i in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[i][0] == name:
                return i
        raise QueryError(f"no savepoint {name}")

    def _release(self, name: str):
        del self.savepoints[self._at(name) :]

    def _rollback_to(self, name: str):
        i = self._at(name)
        _, n, catalog = self.savepoints[i]
        for b in self.staged[n:]:
            self.db.store.remove(b["path"])
        self.staged, self.catalog = self.staged[:n], catalog
        del self.savepoints[i + 1 :]

    def _done(self, value=None):
        if not self.open:
            self._finish()
        return value

    def _changed(self) -> Catalog:
        if self.catalog is None:
            self.catalog = copy.deepcopy(self.db.catalog)
        return self.catalog

    # definition

    def table(self, name: str) -> Table:
        if name not in self.now.tables:
            raise QueryError(f"no table {name}")
        return self.now.tables[name]

    def _create_table(self, if_not_exists: bool, name: str, columns: list, primary_key: list, checks: list):
        if name in self.now.tables:
            if if_not_exists:
                return None
            raise QueryError(f"table {name} exists")
        if not primary_key:
            raise QueryError("a table needs a primary key")
        if len(primary_key) > INDEX_COLUMNS:
            raise QueryError("too many key columns")
        import uuid

        own = [Column(**c, stored=c["name"]) for c in columns]
        if len({c.name for c in own}) < len(own):
            raise QueryError("two columns of one name")
        for c in own:
            if c.auto and ([c.name] != primary_key or c.kind != K.INTEGER):
                raise QueryError("AUTO_INCREMENT is for a single whole-number key")
        table = Table(name, f"{name}-{uuid.uuid4().hex[:8]}", own, list(primary_key))
        for k in primary_key:
            if table.column(k).kind == K.JSON:
                raise QueryError("JSON can't be indexed")
        for i, (label, check) in enumerate(checks):
            table.checks.append((label or f"{name}_check{i + 1}", check))
        self._changed().tables[name] = table
        return self._done()

    def _drop_table(self, if_exists: bool, name: str):
        if name not in self.now.tables:
            if if_exists:
                return None
            raise QueryError(f"no table {name}")
        del self._changed().tables[name]
        return self._done()

    def _truncate(self, name: str):
        import uuid

        table = self._changed().tables[self.table(name).name]
        table.id, table.next_key = f"{name}-{uuid.uuid4().hex[:8]}", 1
        return self._done()

    def _rename_table(self, table: str, to: str):
        if to in self.now.tables:
            raise QueryError(f"table {to} exists")
        tables = self._changed().tables
        tables[to] = tables.pop(self.table(table).name)
        tables[to].name = to
        return self._done()

    def _add_column(self, table: str, column: dict):
        own = Column(**column)
        if own.not_null:
            raise QueryError("a new column must take NULL")
        t = self.table(table)
        if own.name in {c.name for c in t.columns}:
            raise QueryError(f"column {own.name} exists")
        used = {c.stored or c.name for c in t.columns}
        own.stored = own.name
        while own.stored in used or own.stored in self._gone(t):
            own.stored += "_"
        self._changed().tables[table].columns.append(own)
        return self._done()

    def _gone(self, t: Table) -> set:
        return {n for c in ([Catalog.from_json(m["catalog"]) for m in self.db.manifests if m.get("catalog")]) for x in c.tables.values() if x.id == t.id for n in [k.stored or k.name for k in x.columns]}

    def _rename_column(self, table: str, name: str, to: str):
        t = self._changed().tables[self.table(table).name]
        if to in {c.name for c in t.columns}:
            raise QueryError(f"column {to} exists")
        c = t.column(name)
        c.stored, c.name = c.stored or c.name, to
        t.key = [to if k == name else k for k in t.key]
        return self._done()

    def _drop_column(self, table: str, name: str):
        t = self.table(table)
        if name in t.key or any(name in i["columns"] for i in t.indexes):
            raise QueryError(f"column {name} is indexed")
        t.column(name)
        own = self._changed().tables[table]
        own.columns = [c for c in own.columns if c.name != name]
        return self._done()

    def _alter_column(self, table: str, name: str, **change):
        self.table(table).column(name)
        c = self._changed().tables[table].column(name)
        for k, v in change.items():
            setattr(c, k, v)
        return self._done()

    def _create_index(self, unique: bool, if_not_exists: bool, table: str, columns: tuple, where):
        t = self.table(table)
        if any(i["columns"] == list(columns) for i in t.indexes):
            if if_not_exists:
                return None
            raise QueryError("the index exists")
        if len(columns) > INDEX_COLUMNS or any(t.column(c).kind == K.JSON for c in columns):
            raise QueryError("too many columns, or JSON, in an index")
        if unique and not self.db.log(t, self.staged).isEmpty():
            raise QueryError("a unique index needs an empty table")
        self._changed().tables[table].indexes.append({"columns": list(columns), "unique": unique})
        return self._done()

    def _drop_index(self, if_exists: bool, table: str, columns: tuple):
        t = self._changed().tables[self.table(table).name]
        left = [i for i in t.indexes if i["columns"] != list(columns)]
        if len(left) == len(t.indexes) and not if_exists:
            raise QueryError("no such index")
        t.indexes = left
        return self._done()

    def _drop_constraint(self, table: str, name: str):
        t = self._changed().tables[self.table(table).name]
        left = [c for c in t.checks if c[0] != name]
        if len(left) == len(t.checks):
            raise QueryError(f"no constraint {name}")
        t.checks = left
        return self._done()

    def create_view(self, name: str, sql: str):
        self._changed().views[name] = sql
        return self._done()

    def _create_view(self, if_not_exists: bool, name: str, sql: str):
        """Keeps the text, so that each query of the view, in any session, reads the tables as they then are."""
        if name in self.now.views or name in self.now.tables:
            if if_not_exists and name in self.now.views:
                return None
            raise QueryError(f"{name} exists")
        self.compiler().query(parse(sql)[0])  # fails now if it can't be read
        return self.create_view(name, sql)

    def _drop_view(self, if_exists: bool, name: str):
        if name not in self.now.views:
            if if_exists:
                return None
            raise QueryError(f"no view {name}")
        del self._changed().views[name]
        return self._done()

    def _create_sequence(self, if_not_exists: bool, name: str, start: int, increment: int):
        if name in self.now.sequences:
            if if_not_exists:
                return None
            raise QueryError(f"sequence {name} exists")
        self._changed().sequences[name] = {"start": start, "increment": increment, "next": start}
        return self._done()

    def _drop_sequence(self, if_exists: bool, name: str):
        if self._changed().sequences.pop(name, None) is None and not if_exists:
            raise QueryError(f"no sequence {name}")
        return self._done()

    def _sequence(self, function: str, name: str, n: int = 1) -> tuple[int, int]:
        """The first of n values drawn at once (CURRVAL: the last drawn), and the step between them."""
        if name not in self.now.sequences:
            raise QueryError(f"no sequence {name}")
        if function == "CURRVAL":
            if name not in self.currval:
                raise QueryError(f"sequence {name} has no value yet")
            return self.currval[name], 0
        step = self.now.sequences[name]["increment"]
        if not n:
            return self.now.sequences[name]["next"], step
        s = self._changed().sequences[name]
        value, s["next"] = s["next"], s["next"] + n * step
        self.currval[name] = value + (n - 1) * step
        self._done()
        return value, step

    def _create_database(self, if_not_exists: bool, name: str):
        if name in self.databases() and not if_not_exists:
            raise QueryError(f"database {name} exists")
        other = Database(self.spark, self.root, name)
        if not other.manifests:
            other.commit([], Catalog())

    def _use_database(self, name: str):
        if name not in self.databases():
            raise QueryError(f"no database {name}")
        self.db = Database(self.spark, self.root, name)

    def _changed_users(self) -> dict[str, dict]:
        return self._changed().users if self.db else self.own_users

    def _user(self, name: str) -> dict:
        if name not in self.users:
            raise QueryError(f"no user {name}")
        return self._changed_users()[name]

    @staticmethod
    def _hashed(password: str, salt: str | None = None) -> str:
        salt = salt or secrets.token_hex(16)
        return f"{salt}:{hashlib.scrypt(password.encode(), salt=bytes.fromhex(salt), n=1 << 14, r=8, p=1).hex()}"

    def authenticated(self, name: str, password: str) -> bool:
        """Whether this is the user's password."""
        known = self.users.get(name, {}).get("password")
        return bool(known) and secrets.compare_digest(known, self._hashed(password, known.partition(":")[0]))

    def _create_user(self, name: str, password: str, permission: str):
        if name in self.users:
            raise QueryError(f"user {name} exists")
        self._changed_users()[name] = {"permission": permission, "grants": {}, "password": self._hashed(password)}
        return self._kept()

    def _alter_user(self, name: str, password: str, permission: str | None = None):
        user = self._user(name)
        user["password"] = self._hashed(password)
        if permission:
            user["permission"] = permission
        return self._kept()

    def _drop_user(self, if_exists: bool, name: str):
        if name not in self.users:
            if if_exists:
                return None
            raise QueryError(f"no user {name}")
        del self._changed_users()[name]
        return self._kept()

    def _kept(self):
        return self._done() if self.db else None

    # The privileges of the dialect.
    PRIVILEGES = ("SELECT", "CREATE", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER")

    def _grant(self, privileges: Iterable[str], database: str, user: str):
        grants = self._user(user)["grants"]
        grants[database] = sorted({*grants.get(database, ()), *(self.PRIVILEGES if "ALL" in privileges else privileges)})
        return self._kept()

    def _revoke(self, privileges: Iterable[str], database: str, user: str):
        grants = self._user(user)["grants"]
        grants[database] = sorted({*grants.get(database, ())} - {*(self.PRIVILEGES if "ALL" in privileges else privileges)})
        return self._kept()

    # changes

    def _append(self, table: Table, rows: DataFrame, returning, params, deleted: bool = False):
        """Stages rows (all columns of the table, _seq); the rows or their number."""
        batch = self.db.stage(table, rows.withColumn("_deleted", F.lit(deleted)))
        written = self.spark.read.schema(table.schema).parquet(f"{self.db.path}/{batch['path']}")
        self.staged.append(batch)
        out = None
        if returning:
            compiler = self.compiler(params)
            rel = relation(Database._named(written.withColumns({c: F.lit(None) for c in ("_tx", "_seq", "_ts", "_deleted")}), table).drop("_tx", "_seq", "_ts", "_deleted"), table.kinds, table.name)
            compiler.bound["returned"] = Relation(rel.df, rel.fields)
            out = compiler.run(N.Select(source=N.Source(table="returned", alias=table.name), star=returning == "*", targets=() if returning == "*" else returning))
        else:
            out = written.count()
        return out

    def _checked(self, table: Table, rows: DataFrame) -> None:
        """One pass over the rows for NOT NULL, lengths, CHECKs and keys that come twice."""
        tests = {}
        for c in table.columns:
            if c.not_null or c.name in table.key:
                tests[f"{c.name} can't be NULL"] = F.col(c.name).isNull()
            if c.max and c.kind in (K.VARCHAR, K.BLOB):
                tests[f"{c.name} is longer than {c.max}"] = F.octet_length(c.name) > c.max
        rel = relation(rows.select(*[c.name for c in table.columns]), table.kinds, table.name)
        if table.checks:
            scope = Scope(rel.fields)
            for label, text in table.checks:
                tests[f"CHECK {label}"] = ~self.compiler().condition(expression(text), scope)
        own = {f.name: f.own for f in rel.fields}
        named = rel.df.withColumns({n: F.col(o) for n, o in own.items()})
        if tests:
            found = named.agg(*[F.max(F.coalesce(t, F.lit(False))).alias(f"t{i}") for i, t in enumerate(tests.values())]).first()
            for label, bad in zip(tests, found, strict=True):
                if bad:
                    raise ConstraintError(label)
        if not rows.groupBy(*table.key).count().filter("count > 1").limit(1).isEmpty():
            raise KeyExists("a key comes twice")

    def _unique(self, table: Table) -> None:
        for index in table.indexes:
            if index["unique"]:
                current = temporal.as_of(self.db.log(table, self.staged), table.key)
                if not current.groupBy(*index["columns"]).count().filter("count > 1").limit(1).isEmpty():
                    raise ConstraintError(f"unique index on {', '.join(index['columns'])}")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """Adds _seq, 0 and up in the rows' order: ranks within partitions over a table of the partitions' sizes."""
        from kairolog.sources.scratch import saved, scratch

        tagged = saved(rows.withColumn("_mid", F.monotonically_increasing_id()), f"{scratch(self.spark, 'rows')}")
        part = F.shiftright("_mid", 33)
        sizes = tagged.groupBy(part.alias("_p")).count()
        base = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_b"))
        return tagged.withColumn("_p", part).join(base, "_p").withColumn("_seq", F.col("_b") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_b", "_mid")

    def _insert(self, table: str, columns, upsert: bool, conflict, returning, rows=None, query=None, params: dict | None = None):
        t = self.table(table)
        names = list(columns) if columns else [c.name for c in t.columns if not (rows and len(rows[0]) < len(t.columns) and c.auto)]
        compiler = self.compiler(params)
        if rows is not None:
            if any(len(r) != len(names) for r in rows):
                raise QueryError("as many values as columns are needed")
            defaults = {c.name: expression(c.default) if c.default else N.Literal(None, K.ANY) for c in t.columns}
            rel = compiler._values(tuple(tuple(defaults[n] if v is None else v for n, v in zip(names, r, strict=True)) for r in rows))
        else:
            rel = compiler.query(query)
            if len(rel.fields) != len(names):
                raise QueryError("as many columns in the query as in the list are needed")
        given = dict(zip(names, rel.fields, strict=True))
        values = []
        for c in t.columns:
            if c.name in given:
                f = given[c.name]
                values.append(K.cast(F.col(f.own), f.kind, c.kind).cast(K.SPARK[c.kind]).alias(c.name))
            else:
                value = compiler.expr(expression(c.default), Scope([])) if c.default else (F.lit(None), K.ANY)
                values.append(K.cast(*value, c.kind).cast(K.SPARK[c.kind]).alias(c.name))
        for n in names:
            t.column(n)
        batch = self._numbered(rel.df.select(*values))
        auto = next((c.name for c in t.columns if c.auto), None)
        if auto and auto not in given:
            batch = batch.withColumn(auto, F.lit(t.next_key) + F.col("_seq"))
        self._checked(t, batch)
        current = temporal.as_of(self.db.log(t, self.staged), t.key)
        if conflict is not None:
            old = current.select(*[F.col(k).alias(f"k_{k}") for k in t.key], *[F.col(c.name).alias(f"o_{c.name}") for c in t.columns])
            same = [F.col(k) == F.col(f"k_{k}") for k in t.key]
            new = batch.join(old, same, "left_anti")
            if conflict:
                hits = old.join(batch, same).select(*[F.col(f"o_{c.name}").alias(c.name) for c in t.columns], "_seq")
                new = new.unionByName(self._assigned(t, hits, conflict, params))
            batch = new
        elif not upsert:
            if not batch.join(current, t.key, "left_semi").limit(1).isEmpty():
                raise KeyExists(f"a key of {table} exists")
        if auto:
            most = batch.agg(F.max(auto)).first()[0]
            if most is not None and most >= t.next_key:
                self._changed().tables[table].next_key = most + 1
        out = self._append(self.now.tables[table], batch, returning, params)
        self._unique(t)
        return self._done(out)

    def _assigned(self, t: Table, rows: DataFrame, changes, params) -> DataFrame:
        """rows with SET applied; the right sides see the rows as they were."""
        rel = relation(rows.select(*[c.name for c in t.columns], "_seq"), t.kinds, t.name)
        scope, compiler = Scope(rel.fields[:-1]), self.compiler(params)
        new = {}
        for name, node in changes:
            if name in t.key:
                raise QueryError("key columns can't be changed")
            new[name] = K.cast(*compiler.expr(node, scope), t.column(name).kind).cast(K.SPARK[t.column(name).kind])
        return rel.df.select(*[new.get(f.name, F.col(f.own)).alias(f.name) for f in rel.fields[:-1]], F.col(rel.fields[-1].own).alias("_seq"))

    def _chosen(self, t: Table, where, limit, offset, params) -> DataFrame:
        current = temporal.as_of(self.db.log(t, self.staged), t.key)
        rel = relation(current, t.kinds, t.name)
        compiler = self.compiler(params)
        df = rel.df if where is None else rel.df.filter(compiler.where(where, Scope(rel.fields)))
        df = df.select(*[F.col(f.own).alias(f.name) for f in rel.fields])
        n, skip = compiler._whole(limit), compiler._whole(offset)
        if n or skip:
            df = df.orderBy(*t.key)
            df = df.offset(skip) if skip else df
            df = df.limit(n) if n else df
        return self._numbered(df)

    def _update(self, table: str, set, where, limit, offset, returning, params: dict | None = None):
        t = self.table(table)
        new = self._assigned(t, self._chosen(t, where, limit, offset, params), set, params)
        self._checked(t, new)
        out = self._append(t, new, returning, params)
        self._unique(t)
        return self._done(out)

    def _delete(self, table: str, where, limit, offset, returning, params: dict | None = None):
        t = self.table(table)
        return self._done(self._append(t, self._chosen(t, where, limit, offset, params), returning, params, deleted=True))

    def copy_text(self, table: str, path: str, columns: list[str] | None = None) -> int:
        r"""COPY: rows of tab-separated text with \N for NULL and backslash escapes."""
        t = self.table(table)
        names = columns or [c.name for c in t.columns]
        lines = self.spark.read.text(path).filter((F.col("value") != "\\.") & (F.col("value") != ""))
        parts = F.split("value", "\t")
        plain = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\\\\"), F.lit("\\"))
        values = [F.when(F.get(parts, i) == "\\N", None).otherwise(plain(F.get(parts, i))).alias(n) for i, n in enumerate(names)]
        self.resolved["copied"] = lines.select(*[K.cast(v, K.VARCHAR, t.column(n).kind).alias(n) for v, n in zip(values, names, strict=True)])
        try:
            return self.run(N.Statement("insert", {"table": table, "columns": tuple(names), "upsert": False, "conflict": None, "returning": None, "query": N.Select(star=True, source=N.Source(table="copied"))}))
        finally:
            del self.resolved["copied"]


def bind_time(value: str) -> datetime.datetime:
    """A parameter for a period, from its text."""
    return datetime.datetime.fromisoformat(re.sub("Z$", "", value))
