"""Scalar functions of the dialect: name -> builder of a Column from (Column, type) arguments, with its type.

LENGTH and the functions with places count bytes; most return NULL only for a NULL first argument, other NULLs read as
an empty text or 0. Mathematical functions return FLOAT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairolog.functions.types import ANY, BOOLEAN, FLOAT, INTEGER, JSON, TIMESTAMP, UUID, VARCHAR, cast, common, float_text

Arg = tuple[Column, str]
REGISTRY: dict[str, tuple[int, int, Callable[..., Arg]]] = {}
MANY = 99
SPACE = " \t\n\r\x0b\x0c"


def function(names: str, least: int, most: int | None = None):
    def add(f):
        for name in names.split():
            REGISTRY[name] = (least, least if most is None else most, f)
        return f

    return add


def call(name: str, args: list[Arg]) -> Arg:
    if name not in REGISTRY:
        raise ValueError(f"unknown function {name}")
    least, most, f = REGISTRY[name]
    if not least <= len(args) <= most:
        raise ValueError(f"{name} takes {least} to {most} arguments")
    return f(*args)


def s(a: Arg) -> Column:
    return cast(*a, VARCHAR)


def s0(a: Arg) -> Column:
    return F.coalesce(s(a), F.lit(""))


def n(a: Arg) -> Column:
    return cast(*a, INTEGER)


def n0(a: Arg) -> Column:
    return F.coalesce(n(a), F.lit(0)).cast("int")


def x(a: Arg) -> Column:
    return cast(*a, FLOAT)


def _null_if(a: Column, value: Column) -> Column:
    return F.when(a.isNotNull(), value)


def _bytes(text: Column, start: Column | int, size: Column) -> Column:
    """size bytes of the text from a place on."""
    raw = F.substring(text.cast("binary"), start if isinstance(start, Column) else F.lit(start), size)
    return F.decode(raw, "UTF-8")


@function("LENGTH CHAR_LENGTH CHARACTER_LENGTH OCTET_LENGTH", 1)
def _length(a):
    return F.octet_length(s(a)).cast("long"), INTEGER


@function("SUBSTRING SUBSTR", 3)
def _substring(a, b, c):
    ok = (n(b) >= 1) & (n(c) >= 0)
    return _null_if(s(a), F.when(ok, F.substring(s(a), n0(b), n0(c))).otherwise(F.raise_error(F.lit("substring needs a place of 1 or more and no negative length")).cast("string"))), VARCHAR


@function("CONCAT", 1, MANY)
def _concat(*args):
    return F.concat(*[s0(a) for a in args]), VARCHAR


@function("CONCAT_WS", 1, MANY)
def _concat_ws(sep, *args):
    return _joined(sep, args), VARCHAR


def _joined(sep: Arg, args: tuple[Arg, ...]) -> Column:
    parts = F.array_compact(F.array(*[s(a) for a in args])) if args else F.array().cast("array<string>")
    return _null_if(s(sep), F.aggregate(parts, F.lit(None).cast("string"), lambda t, y: F.when(t.isNull(), y).otherwise(F.concat(t, s(sep), y)), lambda t: F.coalesce(t, F.lit(""))))


@function("LOWER", 1)
def _lower(a):
    return F.lower(s(a)), VARCHAR


@function("UPPER", 1)
def _upper(a):
    return F.upper(s(a)), VARCHAR


@function("TRIM BTRIM", 1)
def _trim(a):
    return F.trim(s(a), F.lit(SPACE)), VARCHAR


@function("LTRIM", 1)
def _ltrim(a):
    return F.ltrim(s(a), F.lit(SPACE)), VARCHAR


@function("RTRIM", 1)
def _rtrim(a):
    return F.rtrim(s(a), F.lit(SPACE)), VARCHAR


@function("REPLACE", 3)
def _replace(a, b, c):
    between = F.concat(s0(c), F.array_join(F.split(s(a), ""), "\x00"), s0(c))
    inserted = F.replace(between, F.lit("\x00"), s0(c))
    return _null_if(s(a), F.when(s0(b) == "", inserted).otherwise(F.replace(s(a), s0(b), s0(c)))), VARCHAR


@function("REVERSE", 1)
def _reverse(a):
    return F.reverse(s(a)), VARCHAR


@function("LEFT", 2)
def _left(a, b):
    return _null_if(s(a), _bytes(s(a), 1, F.greatest(n0(b), F.lit(0)))), VARCHAR


@function("RIGHT", 2)
def _right(a, b):
    size = F.least(F.greatest(n0(b), F.lit(0)), F.octet_length(s(a)))
    return _null_if(s(a), _bytes(s(a), F.octet_length(s(a)) - size + 1, size)), VARCHAR


@function("REPEAT", 2)
def _repeat(a, b):
    return _null_if(s(a), F.repeat(s(a), F.greatest(n0(b), F.lit(0)))), VARCHAR


@function("POSITION STRPOS", 2)
def _position(part, text):
    at = F.position(s0(part), s0(text))
    ahead = F.octet_length(F.substring(s0(text), F.lit(1), F.greatest(at - 1, F.lit(0))))
    return _null_if(s(part), F.when(at > 0, ahead + 1).otherwise(F.lit(0)).cast("long")), INTEGER


@function("LPAD", 2, 3)
def _lpad(a, b, fill=None):
    f, size = s0(fill) if fill else F.lit(" "), F.greatest(n0(b), F.lit(0))
    times = F.ceil((size - F.length(s(a))) / F.greatest(F.length(f), F.lit(1))).cast("int")
    return _null_if(s(a), F.substring(F.concat(F.when(F.length(f) > 0, F.repeat(f, F.greatest(times, F.lit(0)))).otherwise(""), s(a)), F.lit(1), size)), VARCHAR


@function("RPAD", 2, 3)
def _rpad(a, b, fill=None):
    f, size = s0(fill) if fill else F.lit(" "), F.greatest(n0(b), F.lit(0))
    return _null_if(s(a), F.rpad(s(a), size, f)), VARCHAR


@function("SPLIT_PART", 3)
def _split_part(a, b, c):
    whole = F.when(n0(c) == 1, s(a)).otherwise("")
    return _null_if(s(a), F.when(n0(c) < 1, "").when(s0(b) == "", whole).otherwise(F.split_part(s(a), s0(b), F.greatest(n0(c), F.lit(1))))), VARCHAR


@function("INITCAP", 1)
def _initcap(a):
    """A word is a run of letters and digits."""
    marked = F.regexp_replace(F.lower(s(a)), r"(?<![\p{L}\p{N}])([\p{L}\p{N}])", "\x00$1")
    parts = F.split(marked, "\x00")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))), ""), VARCHAR


@function("CHR", 1)
def _chr(a):
    code = n(a)
    one = lambda v: F.lpad(F.hex(v), 2, "0")
    b = lambda shift: (F.shiftright(code, shift).bitwiseAND(F.lit(63)) + 128)
    two, three = F.concat(one(F.shiftright(code, 6) + 192), one(b(0))), F.concat(one(F.shiftright(code, 12) + 224), one(b(6)), one(b(0)))
    four = F.concat(one(F.shiftright(code, 18) + 240), one(b(12)), one(b(6)), one(b(0)))
    raw = F.when(code < 128, one(code)).when(code < 2048, two).when(code < 65536, three).otherwise(four)
    return F.decode(F.unhex(raw), "UTF-8"), VARCHAR


@function("ASCII", 1)
def _ascii(a):
    first = F.conv(F.hex(F.substring(s(a).cast("binary"), 1, 1)), 16, 10).cast("long")
    return _null_if(s(a), F.when(s(a) == "", F.lit(0)).otherwise(first).cast("long")), INTEGER


@function("MD5", 1)
def _md5(a):
    return F.md5(s(a)), VARCHAR


@function("TRANSLATE", 3)
def _translate(a, b, c):
    """Of a character that is mapped twice, the last mapping holds."""
    chars = F.split(s(a), "")
    source, to = s0(b), s0(c)
    place = lambda ch: F.length(source) - F.position(ch, F.reverse(source)) + 1
    return _null_if(s(a), F.array_join(F.transform(chars, lambda ch: F.when((ch == "") | (F.position(ch, source) == 0), ch).when(place(ch) <= F.length(to), F.substring(to, place(ch), F.lit(1))).otherwise("")), "")), VARCHAR


@function("REGEXP_REPLACE", 3, 4)
def _regexp_replace(a, b, c, flags=None):
    return _null_if(s(a), F.regexp_replace(s(a), s0(b), s0(c))), VARCHAR


@function("QUOTE_IDENT", 1)
def _quote_ident(a):
    return F.when(s(a).rlike("^[a-z_][a-z0-9_]*$"), s(a)).otherwise(F.concat(F.lit('"'), F.replace(s(a), F.lit('"'), F.lit('""')), F.lit('"'))), VARCHAR


@function("ARRAY_TO_STRING", 2, 3)
def _array_to_string(a, b, null=None):
    inner = F.regexp_extract(s(a), r"^\{(.*)\}$", 1)
    items = F.split(inner, ",")
    shown = F.transform(items, lambda v: F.when(F.upper(v) == "NULL", s(null) if null else F.lit(None).cast("string")).otherwise(v))
    joined = F.aggregate(F.array_compact(shown), F.lit(None).cast("string"), lambda t, y: F.when(t.isNull(), y).otherwise(F.concat(t, s0(b), y)), lambda t: F.coalesce(t, F.lit("")))
    return _null_if(s(a), F.when(inner == "", F.lit("")).otherwise(joined)), VARCHAR


for _name, _build in {"ABS": F.abs, "CEIL": F.ceil, "CEILING": F.ceil, "FLOOR": F.floor, "ROUND": F.round, "SQRT": F.sqrt, "SIGN": F.signum}.items():
    REGISTRY[_name] = (1, 1, lambda a, f=_build: (f(x(a)).cast("double"), FLOAT))


@function("POWER POW", 2)
def _power(a, b):
    return F.pow(x(a), x(b)), FLOAT


@function("MOD", 2)
def _mod(a, b):
    return F.when(x(b) == 0, F.when(x(a).isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(x(a), x(b))), FLOAT


@function("RANDOM", 0)
def _random():
    return F.rand(), FLOAT


@function("TO_NUMBER", 1, 2)
def _to_number(a, fmt=None):
    return F.replace(s(a), F.lit(","), F.lit("")).try_cast("double"), FLOAT


@function("NOW CLOCK_TIMESTAMP CURRENT_TIMESTAMP", 0)
def _now():
    return F.current_timestamp().cast("timestamp_ntz"), TIMESTAMP


@function("DATE_TRUNC", 2)
def _date_trunc(unit, a):
    """Other units than these six leave the time as it is."""
    t, u = cast(*a, TIMESTAMP), F.lower(s(unit))
    known = ("year", "month", "day", "hour", "minute", "second")
    out = t
    for k in known:
        out = F.when(u == k, F.date_trunc(k, t).cast("timestamp_ntz")).otherwise(out)
    return out, TIMESTAMP


def part(field: str, t: Column) -> Column:
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": lambda v: F.floor(F.second(v)), "dow": lambda v: F.dayofweek(v) - 1, "doy": F.dayofyear, "epoch": lambda v: F.unix_timestamp(v.cast("timestamp"))}[field](t)


@function("DATE_PART", 2)
def _date_part(unit, a):
    t, u, out = cast(*a, TIMESTAMP), F.lower(s(unit)), F.lit(0.0)
    for k in ("year", "month", "day", "hour", "minute", "second", "dow", "doy", "epoch"):
        out = F.when(u == k, part(k, t).cast("double")).otherwise(out)
    return _null_if(t, out), FLOAT


#: Fields of TO_CHAR and Spark's names for them, longer ones first.
CHAR_FIELDS = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("Month", "MMMM"), ("Day", "EEEE"), ("YY", "yy"), ("MM", "MM"), ("DD", "dd"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"))


@function("TO_CHAR", 2)
def _to_char(a, fmt):
    if a[1] != TIMESTAMP:
        return s(a), VARCHAR
    out = s0(fmt)
    for i, (field, _) in enumerate(CHAR_FIELDS):
        out = F.replace(out, F.lit(field), F.lit(chr(0xE000 + i)))
    for i, (_, name) in enumerate(CHAR_FIELDS):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.date_format(a[0], name))
    return _null_if(a[0], out), VARCHAR


@function("AGE", 1, 2)
def _age(a, b=None):
    """In years of 365 and months of 30 days."""
    late, early = (cast(*a, TIMESTAMP), cast(*b, TIMESTAMP)) if b else (F.current_timestamp().cast("timestamp_ntz"), cast(*a, TIMESTAMP))
    seconds = F.unix_timestamp(late.cast("timestamp")) - F.unix_timestamp(early.cast("timestamp"))
    days = F.when(seconds < 0, -F.floor(-seconds / 86400)).otherwise(F.floor(seconds / 86400)).cast("long")
    years, rest = _div(days, 365), days % 365
    return F.concat(years.cast("string"), F.lit(" years "), _div(rest, 30).cast("string"), F.lit(" mons "), (rest % 30).cast("string"), F.lit(" days")), VARCHAR


def _div(a: Column, b: int) -> Column:
    """Whole-number division towards zero."""
    return ((a - a % b) / b).cast("long")


def _alike(args: tuple[Arg, ...]) -> tuple[list[Column], str]:
    kind = args[0][1]
    for _, other in args[1:]:
        kind = common(kind, other)
    return [cast(c, t, kind) for c, t in args], kind


@function("COALESCE", 1, MANY)
def _coalesce(*args):
    columns, kind = _alike(args)
    return F.coalesce(*columns), kind


@function("NULLIF", 2)
def _nullif(a, b):
    (p, q), _ = _alike((a, b))
    return F.when(~p.eqNullSafe(q), a[0]), a[1]


@function("GREATEST", 1, MANY)
def _greatest(*args):
    columns, kind = _alike(args)
    return (F.greatest(*columns) if len(columns) > 1 else columns[0]), kind


@function("LEAST", 1, MANY)
def _least(*args):
    columns, kind = _alike(args)
    return (F.least(*columns) if len(columns) > 1 else columns[0]), kind


@function("JSON_TYPEOF", 1)
def _json_typeof(a):
    t = F.trim(a[0])
    first = F.substring(t, 1, 1)
    return F.when(a[0].isNull(), None).when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING").when(t.isin("true", "false"), "BOOL").when(t == "null", "NULL").otherwise("NUMBER"), VARCHAR


@function("RANDOM_UUID GEN_RANDOM_UUID", 0)
def _uuid():
    return F.uuid(), UUID


# What clients of the PostgreSQL protocol ask for; fixed answers.
CONSTANTS = {
    "CURRENT_DATABASE": (0, 0, "defaultdb"), "CURRENT_SCHEMA": (0, 0, "public"), "CURRENT_USER": (0, 0, "kairolog"), "PG_GET_USERBYID": (1, 1, "kairolog"), "SHOBJ_DESCRIPTION": (2, 2, ""), "PG_ENCODING_TO_CHAR": (1, 1, "UTF8"),
    "PG_GET_EXPR": (1, 3, ""), "PG_GET_CONSTRAINTDEF": (1, 2, ""), "PG_GET_INDEXDEF": (1, 3, ""), "OBJ_DESCRIPTION": (1, 2, ""), "COL_DESCRIPTION": (2, 2, ""), "PG_GET_SERIAL_SEQUENCE": (2, 2, ""), "CURRENT_SCHEMAS": (0, 1, "{public}"),
    "PG_TABLE_IS_VISIBLE": (1, 1, True), "HAS_TABLE_PRIVILEGE": (2, 3, True), "HAS_SCHEMA_PRIVILEGE": (2, 3, True), "HAS_DATABASE_PRIVILEGE": (2, 3, True), "HAS_FUNCTION_PRIVILEGE": (2, 3, True),
    "PG_TOTAL_RELATION_SIZE": (1, 1, 0), "PG_RELATION_SIZE": (1, 2, 0),
}
for _name, (_least_args, _most_args, _value) in CONSTANTS.items():
    _kind = BOOLEAN if isinstance(_value, bool) else INTEGER if isinstance(_value, int) else VARCHAR
    REGISTRY[_name] = (_least_args, _most_args, lambda *args, v=_value, k=_kind: (F.lit(v).cast("bigint") if k == INTEGER else F.lit(v), k))
REGISTRY["ARRAY_UPPER"] = (2, 2, lambda a, b: (F.lit(None).cast("bigint"), INTEGER))
#: Type numbers of the PostgreSQL protocol.
TYPE_NAMES = {16: "boolean", 17: "bytea", 20: "bigint", 25: "text", 114: "json", 701: "double precision", 1043: "character varying", 1114: "timestamp without time zone", 2950: "uuid"}


@function("FORMAT_TYPE", 1, 2)
def _format_type(a, b=None):
    out = F.lit("text")
    for k, v in TYPE_NAMES.items():
        out = F.when(n(a) == k, v).otherwise(out)
    return out, VARCHAR


def json_path(value: Column, path: list[str]) -> Column:
    """The JSON at a path of keys and places as JSON text, NULL if there is none."""
    at = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path)
    found = F.try_variant_get(F.try_parse_json(value), at, "variant")
    return F.to_json(found)


def as_scalar(value: Column, to: str) -> Column:
    """A JSON scalar as a value of another type; texts lose their quotes."""
    if to == VARCHAR:
        return F.try_variant_get(F.try_parse_json(value), "$", "string")
    return F.try_variant_get(F.try_parse_json(value), "$", {INTEGER: "long", FLOAT: "double", BOOLEAN: "boolean"}.get(to, "string"))


__all__ = ["ANY", "JSON", "REGISTRY", "as_scalar", "call", "float_text", "json_path", "part"]
