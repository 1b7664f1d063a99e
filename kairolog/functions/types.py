"""Types of the dialect, their aliases and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN, VARCHAR, BLOB, UUID, TIMESTAMP, JSON, ANY = "INTEGER FLOAT BOOLEAN VARCHAR BLOB UUID TIMESTAMP JSON ANY".split()

# Names of types in the dialect.
ALIASES = {
    **dict.fromkeys("INTEGER INT INT4 INT8 BIGINT SMALLINT SERIAL BIGSERIAL".split(), INTEGER),
    **dict.fromkeys("FLOAT FLOAT4 FLOAT8 DOUBLE REAL NUMERIC DECIMAL".split(), FLOAT),
    **dict.fromkeys("BOOLEAN BOOL".split(), BOOLEAN),
    **dict.fromkeys("VARCHAR TEXT CHAR STRING".split(), VARCHAR),
    **dict.fromkeys("BLOB BYTEA".split(), BLOB),
    **dict.fromkeys("TIMESTAMP TIMESTAMPTZ DATE".split(), TIMESTAMP),
    **dict.fromkeys("JSON JSONB".split(), JSON),
    "UUID": UUID,
}

SPARK = {INTEGER: T.LongType(), FLOAT: T.DoubleType(), BOOLEAN: T.BooleanType(), VARCHAR: T.StringType(), BLOB: T.BinaryType(), UUID: T.StringType(), TIMESTAMP: T.TimestampNTZType(), JSON: T.StringType(), ANY: T.NullType()}

#: Texts of a timestamp, the most exact first.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss VV", "yyyy-MM-dd")
TRUE, FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")
UUID_TEXT = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def of_spark(kind: T.DataType, metadata: dict | None = None) -> str:
    """The dialect's type of a Spark column; metadata["kind"] tells UUID and JSON from text."""
    if metadata and metadata.get("kind"):
        return metadata["kind"]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return TIMESTAMP
    return {T.BooleanType: BOOLEAN, T.BinaryType: BLOB, T.NullType: ANY}.get(type(kind), VARCHAR)


def _failed(value: Column, to: str, kind: T.DataType) -> Column:
    return F.raise_error(F.concat(F.lit(f"can't cast to {to}: "), F.coalesce(value.cast("string"), F.lit("NULL")))).cast(kind)


def float_text(x: Column) -> Column:
    """The shortest decimal text: no fraction for whole numbers below 1e21."""
    plain = F.when(F.abs(x) < 1e18, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), plain).otherwise(x.cast("string"))


def cast(value: Column, source: str, to: str) -> Column:
    """value of type source as type to; what can't be converted stops the query."""
    kind = SPARK[to]
    if source in (to, ANY):
        return value.cast(kind) if source == ANY else value
    text = F.trim(value) if source == VARCHAR else value
    if source == JSON and to not in (VARCHAR, BLOB):
        return cast(F.get_json_object(value, "$"), VARCHAR, to)
    match to:
        case "TIMESTAMP":
            if source == INTEGER:
                return F.timestamp_seconds(value).cast(kind)
            if source == VARCHAR:
                found = F.coalesce(*[F.try_to_timestamp(text, F.lit(x)).cast(kind) for x in LAYOUTS])
                return F.when(value.isNull(), F.lit(None).cast(kind)).otherwise(F.coalesce(found, _failed(value, to, kind)))
        case "BOOLEAN" if source == VARCHAR:
            low = F.lower(text)
            return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(value.isNull(), None).otherwise(_failed(value, to, kind))
        case "INTEGER" | "FLOAT" if source in (INTEGER, FLOAT, VARCHAR):
            return text.cast(kind)
        case "UUID" if source == VARCHAR:
            low = F.lower(text)
            return F.when(value.isNull(), F.lit(None).cast("string")).when(low.rlike(UUID_TEXT), low).otherwise(_failed(value, to, kind))
        case "UUID" if source == BLOB:
            return F.regexp_replace(F.lower(F.hex(value)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        case "BLOB" if source == UUID:
            return F.unhex(F.replace(value, F.lit("-")))
        case "BLOB" if source in (VARCHAR, JSON):
            return value.cast("binary")
        case "VARCHAR":
            return float_text(value) if source == FLOAT else value.cast("string")
        case "JSON":
            return {VARCHAR: F.to_json(F.try_parse_json(value)), FLOAT: float_text(value)}.get(source, value.cast("string"))
    raise TypeError(f"can't cast {source} to {to}")


def common(a: str, b: str) -> str:
    """The type in which two values compare or join a CASE."""
    if a == b or b == ANY:
        return a
    if a == ANY:
        return b
    pair = {a, b}
    if pair == {INTEGER, FLOAT}:
        return FLOAT
    if JSON in pair:
        return (pair - {JSON}).pop()
    if VARCHAR in pair:
        return (pair - {VARCHAR}).pop()
    raise TypeError(f"{a} and {b} can't be compared")
