"""Typed SQL fragments: what expressions compile to."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class Val:
    """A SQL expression with its type (None: the type of NULL), and what is known of it statically."""

    sql: str
    type: T.DataType | None
    bag: bool = False  # an unordered collection
    missing: bool = False  # certainly absent
    const: Any = None  # a literal's value

    @property
    def variant(self) -> bool:
        return isinstance(self.type, T.VariantType)

    @property
    def array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def struct(self) -> bool:
        return isinstance(self.type, T.StructType)

    @property
    def element(self) -> T.DataType | None:
        return None if isinstance(self.type.elementType, T.NullType) else self.type.elementType


NULL = Val("NULL", None)
MISSING = Val("NULL", None, missing=True)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A SQL string literal that is safe under any escape setting."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value: Any) -> Val:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return Val("true" if value else "false", T.BooleanType(), const=value)
    if isinstance(value, int):
        if -(2**63) <= value < 2**63:
            return Val(f"{value}L" if value >= 0 else f"({value}L)", T.LongType(), const=value)
        value = Decimal(value)
    if isinstance(value, Decimal):
        _, digits, exponent = value.as_tuple()
        scale = max(0, -exponent)
        kind = T.DecimalType(max(len(digits) + max(exponent, 0), scale, 1), scale)
        return Val(f"cast('{value:f}' as {kind.simpleString()})", kind, const=value)
    if isinstance(value, float):
        return Val(f"double('{value!r}')", T.DoubleType(), const=value)
    if isinstance(value, bytes):
        return Val(f"X'{value.hex()}'", T.BinaryType(), const=value)
    return Val(text(value), T.StringType(), const=value)


def numeric(t: T.DataType | None) -> bool:
    return isinstance(t, T.NumericType)


def family(t: T.DataType | None) -> str:
    """Types of one family can be compared with each other."""
    if t is None or isinstance(t, T.NullType):
        return "null"
    for name, kinds in (("number", T.NumericType), ("string", (T.StringType, T.CharType, T.VarcharType)), ("boolean", T.BooleanType), ("binary", T.BinaryType), ("temporal", TEMPORAL), ("array", T.ArrayType), ("struct", T.StructType), ("map", T.MapType), ("variant", T.VariantType)):
        if isinstance(t, kinds):
            return name
    return t.simpleString()


def common_number(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, FRACTIONAL) or isinstance(b, FRACTIONAL):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        def digits(t):
            return (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0)

        whole, scale = max(digits(a)[0], digits(b)[0]), max(digits(a)[1], digits(b)[1])
        return T.DecimalType(min(38, whole + scale), scale)
    return T.LongType()


def common(types: list[T.DataType | None]) -> T.DataType | None:
    """The type of a column that holds all of these: VARIANT where they have nothing in common."""
    found: T.DataType | None = None
    for t in types:
        if t is None or isinstance(t, T.NullType):
            continue
        if found is None or found == t:
            found = t
        elif numeric(found) and numeric(t):
            found = common_number(found, t)
        elif family(found) == family(t) == "string":
            found = T.StringType()
        elif family(found) == family(t) == "temporal":
            found = T.TimestampNTZType()
        elif isinstance(found, T.ArrayType) and isinstance(t, T.ArrayType):
            found = T.ArrayType(common([found.elementType, t.elementType]) or T.NullType())
        else:
            return T.VariantType()
    return found


def cast(v: Val, to: T.DataType | None) -> Val:
    if to is None or v.type == to:
        return v
    if isinstance(to, T.VariantType):
        return Val(f"to_variant_object({v.sql})" if family(v.type) in ("array", "struct", "map") else f"cast({v.sql} as variant)", to)
    return Val(f"cast({v.sql} as {to.simpleString()})", to, bag=v.bag)
