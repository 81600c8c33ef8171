"""Typed access to VARIANT values.

A cast alone would take ``'10'`` and ``true`` for numbers.  Here the value's own type decides, as the
language asks: mismatches are absent (SQL NULL), a JSON null stays null, integers stay integers.

The total order: booleans, numbers (NaN first), dates and times, strings, binary, lists, tuples; absent
and null values have no place in it (they go where NULLS FIRST or LAST says).
"""

from __future__ import annotations

from pyspark.sql import types as T

from nestq.plans.values import FRACTIONAL, INTEGRAL, Val, text

VARIANT = T.VariantType()
EXACT = "decimal(38,9)"
#: What schema_of_variant says of the members of each family.
NAMES = {"number": "BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL", "integer": "BIGINT|INT|SMALLINT|TINYINT", "real": "DOUBLE|FLOAT", "string": "STRING", "boolean": "BOOLEAN", "temporal": "DATE|TIMESTAMP", "binary": "BINARY", "list": "ARRAY", "tuple": "OBJECT"}
RANKED = ("boolean", "number", "temporal", "string", "binary", "list", "tuple")


def is_a(sql: str, kind: str) -> str:
    return f"schema_of_variant({sql}) rlike '^({NAMES[kind]})'"


def get(sql: str, to: str) -> str:
    return f"try_variant_get({sql}, '$', '{to}')"


def typed(sql: str, kind: str, to: T.DataType) -> Val:
    """The value as ``to`` if it is of this family, else NULL."""
    return Val(f"(case when {is_a(sql, kind)} then {get(sql, to.simpleString())} end)", to)


def _scalar_key(sql: str) -> str:
    rank = " ".join(f"when {is_a(sql, k)} then {i}" for i, k in enumerate(RANKED, 1))
    number = f"case when {is_a(sql, 'boolean')} then cast({get(sql, 'boolean')} as double) when {is_a(sql, 'number')} then {get(sql, 'double')} end"
    exact = f"case when {is_a(sql, 'number')} and not {is_a(sql, 'real')} then {get(sql, EXACT)} end"
    words = f"case when {is_a(sql, 'string')} then {get(sql, 'string')} when not {is_a(sql, 'number')} then to_json({sql}) end"
    return f"named_struct('r', case {rank} end, 'o', not coalesce(isnan({number}), false), 'n', {number}, 'd', coalesce({exact}, try_cast({number} as {EXACT})), 's', {words})"


def key(sql: str) -> str:
    """What stands for a value in the total order and in equality; NULL if it is absent or null."""
    members = f"transform(case when {is_a(sql, 'list')} then {get(sql, 'array<variant>')} end, m -> {_scalar_key('m')})"
    scalar = _scalar_key(sql)
    return f"(case when {sql} is not null and not is_variant_null({sql}) then named_struct('k', named_struct('r', {scalar}.r, 'o', {scalar}.o, 'n', {scalar}.n, 'd', {scalar}.d), 'l', {members}, 's', case when not {is_a(sql, 'list')} then {scalar}.s end) end)"


def compare(op: str, a: str, b: str) -> str:
    """Equality across all families; an order only inside one."""
    if op in ("=", "<>"):
        return f"({key(a)} {op} {key(b)})"
    ranks = " or ".join(f"({is_a(a, k)} and {is_a(b, k)})" for k in RANKED[:5])
    return f"(case when {ranks} then {key(a)} {op} {key(b)} end)"


def arithmetic(op: str, a: Val, b: Val, strict: bool) -> Val:
    """A number as VARIANT: integers give integers, reals give reals, all else decimals."""

    def test(v: Val, kind: str) -> str:
        if v.variant:
            return is_a(v.sql, kind)
        known = {"integer": isinstance(v.type, INTEGRAL), "real": isinstance(v.type, FRACTIONAL), "number": isinstance(v.type, T.NumericType)}[kind]
        return "true" if known else "false"

    def as_(v: Val, to: str) -> str:
        return get(v.sql, to) if v.variant else f"cast({v.sql} as {to})"

    def apply(to: str) -> str:
        x, y = as_(a, to), as_(b, to)
        if op == "^":
            return f"pow({x}, {y})"
        if op == "/" and to == "bigint":
            return f"({x} div nullif({y}, 0L))"
        if op == "/":
            return f"try_divide({x}, {y})"
        return f"try_{ {'+': 'add', '-': 'subtract', '*': 'multiply', '%': 'mod'}[op]}({x}, {y})"

    sides = (a, b)
    absent = " or ".join(f"{v.sql} is null" for v in sides)
    null = " or ".join(f"is_variant_null({v.sql})" for v in sides if v.variant)
    numbers = " and ".join(test(v, "number") for v in sides)
    integers = " and ".join(test(v, "integer") for v in sides)
    reals = " or ".join(test(v, "real") for v in sides)
    whole = f"when {integers} then cast({apply('bigint')} as variant) " if op != "^" else ""
    exact = f"when {numbers} then cast({apply(EXACT)} as variant)" if op != "^" else ""
    error = f" else raise_error({text(op + ' expects numbers')})" if strict else ""
    return Val(f"(case when {absent} then null when {null} then parse_json('null') {whole}when ({numbers}) and ({reals if op != '^' else 'true'}) then cast({apply('double')} as variant) {exact}{error} end)", VARIANT)


def aggregate(name: str, distinct: bool, sql: str) -> tuple[str, T.DataType]:
    """An aggregate over VARIANT.  SUM and AVG of a group with a value that is no number are absent."""
    present = f"{sql} is not null and not is_variant_null({sql})"
    d = "DISTINCT " if distinct else ""
    if name == "COUNT":
        return f"count({d}{key(sql)})", T.LongType()
    if name in ("MIN", "MAX"):
        return f"{name.lower()}_by({sql}, {key(sql)})", VARIANT
    if name in ("ANY", "SOME", "EVERY"):
        return f"{'bool_and' if name == 'EVERY' else 'bool_or'}({typed(sql, 'boolean', T.BooleanType()).sql})", T.BooleanType()

    def of(to: str) -> str:
        return f"(case when {is_a(sql, 'number')} then {get(sql, to)} end)"

    wrong = f"count_if({present} and not {is_a(sql, 'number')}) > 0"
    if name == "AVG":
        return f"(case when {wrong} then null else avg({d}{of('double')}) end)", T.DoubleType()
    none = f"count_if({present}) = 0"
    return f"(case when {wrong} or {none} then null when count_if({is_a(sql, 'real')}) > 0 then cast(sum({d}{of('double')}) as variant) when count_if(not {is_a(sql, 'integer')} and {present}) > 0 then cast(try_sum({d}{of(EXACT)}) as variant) else cast(try_sum({d}{of('bigint')}) as variant) end)", VARIANT


def collection(name: str, items: str) -> tuple[str, T.DataType]:
    """The same over an array of VARIANT without absent and null values."""
    if name in ("MIN", "MAX"):
        return f"aggregate({items}, cast(null as variant), (s, x) -> case when s is null or {key('x')} {'<' if name == 'MIN' else '>'} {key('s')} then x else s end)", VARIANT
    if name in ("ANY", "SOME", "EVERY"):
        test = "forall" if name == "EVERY" else "exists"
        return f"(case when size({items}) > 0 and forall({items}, x -> {is_a('x', 'boolean')}) then {test}({items}, x -> {get('x', 'boolean')}) end)", T.BooleanType()

    def total(to: str) -> str:
        return f"aggregate({items}, cast(0 as {to}), (s, x) -> cast(s + {get('x', to)} as {to}))"

    numbers = f"size({items}) > 0 and forall({items}, x -> {is_a('x', 'number')})"
    if name == "AVG":
        return f"(case when {numbers} then {total('double')} / size({items}) end)", T.DoubleType()
    return f"(case when not ({numbers}) then null when forall({items}, x -> {is_a('x', 'integer')}) then cast({total('bigint')} as variant) when exists({items}, x -> {is_a('x', 'real')}) then cast({total('double')} as variant) else cast({total(EXACT)} as variant) end)", VARIANT
