"""The built-in scalar functions by name.

A function gets its arguments as typed fragments, and the compiler, which it asks for type errors
(``mismatch``: NULL in permissive mode, an error in strict mode).  Absent arguments give NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

from nestq.ast import QueryError
from nestq.plans import dynamic
from nestq.plans.values import FRACTIONAL, INTEGRAL, MISSING, NULL, Val, common, family, numeric, quote, text

LONG, STRING, DOUBLE, BOOLEAN = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
FUNCTIONS: dict = {}


def function(*names: str, least: int, most: int | None = None):
    def register(f):
        for name in names:
            FUNCTIONS[name] = (f, least, least if most is None else most)
        return f

    return register


def typed(c, v: Val, kind: str) -> Val | None:
    """The argument as a value of this family; None if it can't be one."""
    if v.type is None:
        return v
    if v.variant:
        return dynamic.typed(v.sql, kind, {"string": STRING, "number": DOUBLE, "boolean": BOOLEAN}[kind])
    return v if family(v.type) == kind else None


def on_strings(sql: str, result: T.DataType):
    def build(c, *args: Val) -> Val:
        found = [typed(c, a, "string") for a in args]
        if any(f is None for f in found):
            return c.mismatch("expected a string")
        if any(f.type is None for f in found):
            return NULL
        return Val(sql.format(*(f.sql for f in found)), result)

    return build


for _name, _sql, _type in (
    ("LOWER", "lower({0})", STRING), ("UPPER", "upper({0})", STRING), ("CHAR_LENGTH", "cast(char_length({0}) as bigint)", LONG), ("CHARACTER_LENGTH", "cast(char_length({0}) as bigint)", LONG),
    ("OCTET_LENGTH", "cast(octet_length({0}) as bigint)", LONG), ("BIT_LENGTH", "cast(bit_length({0}) as bigint)", LONG),
):
    FUNCTIONS[_name] = (on_strings(_sql, _type), 1, 1)


@function("POSITION", least=2)
def position(c, x: Val, s: Val) -> Val:
    if c.reference:  # byte offsets
        return on_strings("(case when position({0} in {1}) = 0 then 0L else cast(octet_length(substring({1}, 1, position({0} in {1}) - 1)) + 1 as bigint) end)", LONG)(c, x, s)
    return on_strings("cast(position({0} in {1}) as bigint)", LONG)(c, x, s)


@function("SUBSTRING", least=2, most=3)
def substring(c, s: Val, offset: Val | None, length: Val | None = None) -> Val:
    """1-based; an offset below 1 shortens the length."""
    s = typed(c, s, "string")
    if offset is None:
        offset = Val("0L" if c.reference else "1L", LONG)
    numbers = [typed(c, x, "number") for x in (offset, length) if x is not None]
    if s is None or any(x is None for x in numbers):
        return c.mismatch("SUBSTRING expects a string and numbers")
    if s.type is None or any(x.type is None for x in numbers):
        return NULL
    o = f"cast({numbers[0].sql} as int)"
    if length is None:
        return Val(f"substring({s.sql}, greatest({o}, 1))", STRING)
    n = f"cast({numbers[1].sql} as int)"
    return Val(f"substring({s.sql}, greatest({o}, 1), greatest({n} + least({o}, 1) - 1, 0))", STRING)


@function("OVERLAY", least=3, most=4)
def overlay(c, s: Val, r: Val, at: Val, length: Val | None = None) -> Val:
    strings, numbers = [typed(c, x, "string") for x in (s, r)], [typed(c, x, "number") for x in (at, length) if x is not None]
    if any(x is None for x in strings + numbers):
        return c.mismatch("OVERLAY expects strings and numbers")
    if any(x.type is None for x in strings + numbers):
        return NULL
    n = f" FOR cast({numbers[1].sql} as int)" if length is not None else ""
    return Val(f"overlay({strings[0].sql} PLACING {strings[1].sql} FROM greatest(cast({numbers[0].sql} as int), 1){n})", STRING)


@function("ABS", least=1)
def absolute(c, x: Val) -> Val:
    x = typed(c, x, "number")
    if x is None:
        return c.mismatch("ABS expects a number")
    return x if x.type is None else Val(f"abs({x.sql})", x.type)


@function("MOD", least=2)
def modulo(c, a: Val, b: Val) -> Val:
    return c.arithmetic("%", a, b)


@function("CARDINALITY", least=1)
def cardinality(c, x: Val) -> Val:
    if x.type is None:
        return NULL
    if family(x.type) in ("array", "map"):
        return Val(f"(case when {x.sql} is not null then cast(size({x.sql}) as bigint) end)", LONG)
    if x.struct:
        return Val(f"(case when {x.sql} is not null then {len(x.type.fields)}L end)", LONG)
    if x.variant:
        return Val(f"cast(size(try_variant_get({x.sql}, '$', 'array<variant>')) as bigint)", LONG)
    return c.mismatch("CARDINALITY expects a collection")


@function("COALESCE", least=0, most=99)
def coalesce(c, *args: Val) -> Val:
    args = [a for a in args if a.type is not None]
    if not args:
        return NULL
    args = c.alike(args)
    return Val(f"coalesce({', '.join(a.sql for a in args)})", args[0].type, bag=args[0].bag)


@function("NULLIF", least=2)
def nullif(c, a: Val, b: Val) -> Val:
    if a.type is None:
        return NULL
    return Val(f"(case when {c.compare('=', a, b).sql} then null else {a.sql} end)", a.type)


@function("EXTRACT", least=2)
def extract(c, part: Val, x: Val) -> Val:
    field = part.const
    if field not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TIMEZONE_HOUR", "TIMEZONE_MINUTE"):
        raise QueryError(f"EXTRACT has no part {field}")
    if x.type is None:
        return NULL
    if x.struct:  # TIME and zoned values are structs
        names = x.type.names
        if field.startswith("TIMEZONE_"):
            name = "tz_hour" if field.endswith("HOUR") else "tz_minute"
            return Val(f"cast({x.sql}.{name} as bigint)", LONG) if name in names else c.mismatch("no time zone")
        if field.lower() in names:
            kind = LONG if field != "SECOND" else T.DecimalType(11, 9)
            return Val(f"cast({x.sql}.{field.lower()} as {kind.simpleString()})", kind)
        if "ts" in names:
            # the wall clock where the value was written
            shifted = f"dateadd(minute, {x.sql}.tz_hour * 60 + {x.sql}.tz_minute, {x.sql}.ts)"
            return extract(c, part, Val(shifted, T.TimestampNTZType()))
        return c.mismatch("EXTRACT expects a date or time")
    if family(x.type) != "temporal" or field.startswith("TIMEZONE_") or (isinstance(x.type, T.DateType) and field in ("HOUR", "MINUTE", "SECOND")):
        return c.mismatch("EXTRACT can't take that part")
    if field == "SECOND":
        return Val(f"cast(extract(second from {x.sql}) as decimal(11,9))", T.DecimalType(11, 9))
    return Val(f"cast(extract({field.lower()} from {x.sql}) as bigint)", LONG)


def _fields(c, args: tuple[Val, ...]) -> list[tuple[str, Val]] | None:
    out = []
    for a in args:
        if not a.struct:
            return None
        out += [(f.name, Val(f"{a.sql}.{quote(f.name)}", f.dataType)) for f in a.type.fields]
    return out


@function("TUPLEUNION", least=1, most=10)
def tupleunion(c, *args: Val) -> Val:
    """All attributes of all tuples, repeated names kept."""
    found = _fields(c, args)
    return c.mismatch("TUPLEUNION expects tuples") if found is None else c.tuple_of(found)


@function("TUPLECONCAT", least=1, most=10)
def tupleconcat(c, *args: Val) -> Val:
    """All attributes; of equal names the last one's value."""
    found = _fields(c, args)
    return c.mismatch("TUPLECONCAT expects tuples") if found is None else c.tuple_of(list(dict(found).items()))


def collection(c, name: str, array: Val, distinct: bool) -> Val:
    """COLL_<name> of an array: absent elements are skipped, empty gives NULL (COUNT: 0)."""
    if array.type is None:
        return NULL
    if array.variant:
        array = Val(f"(case when {dynamic.is_a(array.sql, 'list')} then {dynamic.get(array.sql, 'array<variant>')} end)", T.ArrayType(dynamic.VARIANT))
    if not array.array:
        return c.mismatch(f"COLL_{name} expects a collection")
    element = array.element
    items = f"filter({array.sql}, x -> x is not null)"
    if isinstance(element, T.VariantType):
        items = f"filter({array.sql}, x -> x is not null and not is_variant_null(x))"
        if distinct:
            items = f"transform(array_distinct(transform({items}, x -> to_json(x))), x -> parse_json(x))"
        if name != "COUNT":
            return Val(*dynamic.collection(name, items))
    elif distinct:
        items = f"array_distinct({items})"
    if name == "COUNT":
        return Val(f"(case when {array.sql} is not null then cast(size({items}) as bigint) end)", LONG)
    if element is None:
        return NULL
    if name in ("MIN", "MAX"):
        return Val(f"array_{name.lower()}({items})", element)
    if name in ("ANY", "SOME", "EVERY"):
        if family(element) != "boolean":
            return c.mismatch(f"COLL_{name} expects booleans")
        test = "forall" if name == "EVERY" else "exists"
        return Val(f"(case when size({items}) > 0 then {test}({items}, x -> x) end)", BOOLEAN)
    if not numeric(element):
        return c.mismatch(f"COLL_{name} expects numbers")
    kind: T.DataType = LONG if isinstance(element, INTEGRAL) else DOUBLE if isinstance(element, FRACTIONAL) else T.DecimalType(38, element.scale)
    if name == "AVG":
        kind = DOUBLE
    zero = f"cast(0 as {kind.simpleString()})"
    total = f"aggregate({items}, {zero}, (s, x) -> cast(s + x as {kind.simpleString()}))"
    if name == "AVG":
        total = f"{total} / size({items})"
    return Val(f"(case when size({items}) > 0 then {total} end)", kind)


__all__ = ["FUNCTIONS", "MISSING", "collection", "common", "text"]
