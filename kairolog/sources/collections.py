"""Document collections: JSON documents as rows of a versioned table with extracted, typed fields."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairolog.functions import types as K
from kairolog.operators import documents, temporal
from kairolog.operators.documents import Comparison
from kairolog.plans.engine import Engine

# Field types of collections, and the form of names.
KINDS = {"STRING": "VARCHAR[512]", "BOOLEAN": "BOOLEAN", "INTEGER": "INTEGER", "DOUBLE": "FLOAT", "UUID": "UUID"}
NAME = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_\-]*$")
PATH = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_\-.]*$")


def _column(path: str) -> str:
    """A field's column: a dot would name a part of a struct."""
    return path.replace(".", "/")


class Collections:
    def __init__(self, engine: Engine):
        self.engine = engine

    @staticmethod
    def _table(name: str) -> str:
        if not NAME.match(name):
            raise ValueError(f"bad collection name {name}")
        return f'"doc_{name}"'

    def create(self, name: str, fields: dict[str, str], indexes: Sequence[Sequence[str]] = (), id_field: str = "_id") -> None:
        """fields: dotted path -> STRING, BOOLEAN, INTEGER, DOUBLE or UUID."""
        if any(not PATH.match(f) for f in fields):
            raise ValueError("bad field name")
        columns = "".join(f', "{_column(f)}" {KINDS[k]}' for f, k in fields.items())
        self.engine.execute(f'CREATE TABLE {self._table(name)} ("{id_field}" VARCHAR, "_doc" JSON{columns}, PRIMARY KEY "{id_field}")')
        for index in indexes:
            self.create_index(name, index)

    def delete(self, name: str) -> None:
        self.engine.execute(f"DROP TABLE {self._table(name)}")

    def fields(self, name: str) -> dict[str, str]:
        t = self.engine.table(f"doc_{name}")
        return {c.name.replace("/", "."): c.kind for c in t.columns if c.name not in (t.key[0], "_doc")}

    def names(self) -> list[str]:
        return sorted(t[4:] for t in self.engine.now.tables if t.startswith("doc_"))

    def add_field(self, name: str, field: str, kind: str) -> None:
        """Documents that are there keep NULL."""
        self.engine.execute(f'ALTER TABLE {self._table(name)} ADD COLUMN "{_column(field)}" {KINDS[kind]}')

    def remove_field(self, name: str, field: str) -> None:
        self.engine.execute(f'ALTER TABLE {self._table(name)} DROP COLUMN "{_column(field)}"')

    def create_index(self, name: str, fields: Sequence[str], unique: bool = False) -> None:
        self.engine.execute(f"CREATE {'UNIQUE ' if unique else ''}INDEX ON {self._table(name)} ({', '.join(chr(34) + _column(f) + chr(34) for f in fields)})")

    def delete_index(self, name: str, fields: Sequence[str]) -> None:
        self.engine.execute(f"DROP INDEX ON {self._table(name)} ({', '.join(chr(34) + _column(f) + chr(34) for f in fields)})")

    def _rows(self, name: str, raw: DataFrame) -> str:
        """raw: the id and _doc. Registers the rows with their fields; the name to select from."""
        sparks = {K.VARCHAR: "string", K.BOOLEAN: "boolean", K.INTEGER: "bigint", K.FLOAT: "double", K.UUID: "string"}
        found = documents.extracted(raw, {f: sparks[k] for f, k in self.fields(name).items()})
        self.engine.resolved["incoming"] = found.toDF(*[_column(c) for c in found.columns])
        return "incoming"

    def insert(self, name: str, docs: Sequence[dict]) -> list[str]:
        """The new ids; a document may not bring its own."""
        key = self.engine.table(f"doc_{name}").key[0]
        if any(key in d for d in docs):
            raise ValueError(f"{key} is generated")
        ids = [uuid.uuid4().hex for _ in docs]
        raw = self.engine.spark.createDataFrame([(i, json.dumps({**d, key: i})) for i, d in zip(ids, docs, strict=True)], f"`{key}` string, `_doc` string")
        self.insert_frame(name, raw)
        return ids

    def insert_frame(self, name: str, raw: DataFrame, upsert: bool = False) -> int:
        """Documents of a DataFrame with the id and _doc, JSON text."""
        try:
            return self.engine.execute(f"{'UPSERT' if upsert else 'INSERT'} INTO {self._table(name)} SELECT * FROM {self._rows(name, raw)}")[0]
        finally:
            self.engine.resolved.pop("incoming", None)

    def current(self, name: str) -> DataFrame:
        t = self.engine.table(f"doc_{name}")
        return temporal.as_of(self.engine.db.log(t), t.key)

    def search(self, name: str, expressions: Sequence[Sequence[Comparison]] = (), **more) -> DataFrame:
        known = {*self.fields(name), *self.engine.table(f"doc_{name}").key}
        if unknown := {c.field for e in expressions for c in e} - known:
            raise ValueError(f"not a field: {', '.join(sorted(unknown))}")
        own = [[Comparison(_column(c.field), c.op, c.value) for c in e] for e in expressions]
        if "order" in more:
            more["order"] = [(_column(f), down) for f, down in more["order"]]
        found = documents.search(self.current(name), own, **more)
        return found.toDF(*[c.replace("/", ".") for c in found.columns])

    def count(self, name: str, expressions: Sequence[Sequence[Comparison]] = (), limit: int = 0) -> int:
        return self.search(name, expressions, limit=limit).count()

    def replace(self, name: str, expressions: Sequence[Sequence[Comparison]], doc: dict, **more) -> int:
        """Documents that match become doc, under their ids, as a new revision."""
        key = self.engine.table(f"doc_{name}").key[0]
        found = self.search(name, expressions, **more)
        body = F.lit(json.dumps(doc))
        raw = found.select(key, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(", " if doc else ""), F.lit(f'"{key}": "'), F.col(key), F.lit('"}')).alias("_doc"))
        return self.insert_frame(name, raw, upsert=True)

    def delete_documents(self, name: str, expressions: Sequence[Sequence[Comparison]], **more) -> int:
        key = self.engine.table(f"doc_{name}").key[0]
        self.engine.resolved["leaving"] = self.search(name, expressions, **more).select(key)
        try:
            return self.engine.execute(f'DELETE FROM {self._table(name)} WHERE "{key}" IN (SELECT "{key}" FROM leaving)')[0]
        finally:
            del self.engine.resolved["leaving"]

    def audit(self, name: str, id: str) -> DataFrame:
        """All revisions of a document with transaction, time and whether it was deleted."""
        t = self.engine.table(f"doc_{name}")
        own = self.engine.db.log(t).filter(F.col(t.key[0]) == id)
        return temporal.history(own, t.key).select("_rev", "_tx", "_ts", "_deleted", "_doc").orderBy("_rev")
