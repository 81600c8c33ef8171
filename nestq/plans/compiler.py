"""From syntax trees to Spark SQL.

Every FROM item gets a SQL alias of its own; a variable is either a row (a relation's columns) or a
value (one column).  Names are resolved here, against schemas, so the SQL that leaves has exact,
back-quoted names only.  Static type errors become NULL in permissive mode and errors in strict mode.
What runs, and how, is left to Catalyst: the result is one SQL statement over temporary views.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from nestq.ast import Node, QueryError
from nestq.functions.scalar import FUNCTIONS, collection
from nestq.operators.graph import match_sql
from nestq.plans import dynamic
from nestq.plans.values import FRACTIONAL, INTEGRAL, MISSING, NULL, Val, cast, common, common_number, family, literal, numeric, quote, text
from nestq.parser import TYPES

LONG, STRING, DOUBLE, BOOLEAN = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
#: Names that stand for the time at which the query runs, if nothing else has them.
CLOCK = {"CURRENT_DATE": ("current_date()", T.DateType()), "CURRENT_TIMESTAMP": ("localtimestamp()", T.TimestampNTZType()), "LOCALTIMESTAMP": ("localtimestamp()", T.TimestampNTZType())}


@dataclass
class Var:
    """A variable: a relation's row (alias and columns) or a single value."""

    name: str
    exact: bool
    alias: str | None = None
    columns: list[tuple[str, Val]] = field(default_factory=list)
    value: Val | None = None
    hidden: set[str] = field(default_factory=set)  # columns merged by USING

    def whole(self, c: Compiler) -> Val:
        return self.value if self.value is not None else c.tuple_of(self.columns)


@dataclass
class Scope:
    variables: list[Var] = field(default_factory=list)
    parent: Scope | None = None
    grouped: Grouped | None = None

    def extended(self, more: list[Var]) -> Scope:
        return Scope(self.variables + more, self.parent, self.grouped)


@dataclass
class Grouped:
    """After GROUP BY: keys by expression, and the aggregates asked for."""

    inner: Scope
    alias: str
    keys: list[tuple[Node, str, Val]]
    aggregates: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Rel:
    """A compiled query: its SQL, its columns, and whether its elements are values rather than tuples."""

    sql: str
    columns: list[tuple[str, Val]]
    scalar: bool = False
    # for single-level reuse in subqueries: (from, where, element, columns)
    parts: tuple | None = None

    def element(self, alias: str, c: Compiler) -> Val:
        found = [(n, Val(f"{alias}.{quote(n)}", v.type, v.bag)) for n, v in self.columns]
        return found[0][1] if self.scalar else c.tuple_of(found)


def same(a: Node, b: Node) -> bool:
    return a == b


class Compiler:
    def __init__(self, session, strict: bool = False, compat: str = "sql", sets: bool = False):
        self.sets = sets  # IN outside of conditions looks in a collected set, where Spark takes no subquery
        self.session, self.strict, self.reference, self.count = session, strict, compat == "reference", 0
        self.ctes: list[dict[str, Rel]] = [{}]

    # --- helpers -----------------------------------------------------------------------------------
    def fresh(self, prefix: str = "q") -> str:
        self.count += 1
        return f"{prefix}{self.count}"

    def mismatch(self, what: str) -> Val:
        if self.strict:
            raise QueryError(f"type error: {what}")
        return MISSING

    def tuple_of(self, pairs: list[tuple[str, Val]]) -> Val:
        pairs = [(n, v) for n, v in pairs if not v.missing]
        kind = T.StructType([T.StructField(n, v.type or T.NullType()) for n, v in pairs])
        if not pairs:
            return Val("named_struct()", kind) if False else Val("from_json('{}', 'struct<>')", kind)
        return Val(f"named_struct({', '.join(f'{text(n)}, {v.sql}' for n, v in pairs)})", kind)

    def alike(self, vals: list[Val]) -> list[Val]:
        to = common([v.type for v in vals])
        return [cast(v, to) for v in vals]

    def lookup(self, node: Node, scope: Scope | None) -> Val | None:
        """A local variable or an attribute of one, innermost first; None if there is none."""

        def matches(have: str, exact: bool = False) -> bool:
            return have == node.name if node.exact else have.lower() == node.name.lower()

        while scope is not None:
            if scope.grouped is not None:
                for key, alias, v in scope.grouped.keys:
                    if key == node or (alias and matches(alias)):
                        return v
            found = [v for v in scope.variables if matches(v.name)]
            if found:
                return found[-1].whole(self)
            fields = [(v, n, x) for v in scope.variables if v.value is None for n, x in v.columns if matches(n) and n not in v.hidden]
            fields += [(v, f.name, Val(f"{v.value.sql}.{quote(f.name)}", f.dataType)) for v in scope.variables if v.value is not None and v.value.struct for f in v.value.type.fields if matches(f.name)]
            if not fields:
                fields = [(v, node.name, self.step(v.value, Node("step_key", id=node))) for v in scope.variables if v.value is not None and v.value.variant]
            if len(fields) > 1:
                raise QueryError(f"{node.name} is ambiguous")
            if fields:
                return fields[0][2]
            scope = scope.parent
        return None

    def table(self, node: Node) -> tuple[str, list[tuple[str, Val]], bool] | None:
        """(relation SQL, columns with bare names, ordered) of a CTE or a registered table."""
        for level in reversed(self.ctes):
            for name, rel in level.items():
                if name == node.name if node.exact else name.lower() == node.name.lower():
                    return f"({rel.sql})" if rel.sql else quote(rel.columns[0][1].sql), rel.columns, False
        return self.session._table(node.name, node.exact)

    def is_relation(self, e: Node, scope: Scope) -> bool:
        if e.kind == "subquery" or e.kind == "match":
            return True
        if e.kind == "call":
            return self.session._table_function(e.name) is not None
        if e.kind == "path" and e.root.kind == "id" and self.lookup(e.root, scope) is None:
            return self.session._qualified(e) is not None
        if e.kind != "id":
            return False
        if e.local and self.lookup(e, scope) is not None:
            return False
        return self.table(e) is not None

    # --- queries -----------------------------------------------------------------------------------
    def query(self, node: Node, parent: Scope | None = None) -> Rel:
        return getattr(self, f"query_{node.kind}")(node, parent)

    def query_with(self, node: Node, parent: Scope | None) -> Rel:
        level: dict[str, Rel] = {}
        self.ctes.append(level)
        heads = []
        try:
            for cte in node.ctes:
                name = cte.name.name
                if node.recursive and cte.body.kind == "set" and cte.body.op == "UNION":
                    start = self.query(cte.body.left, parent)
                    names = [c.name for c in cte.columns] or [n for n, _ in start.columns]
                    sql_name = self.fresh("r")
                    columns = [(n, Val(quote(n), v.type)) for n, (_, v) in zip(names, start.columns, strict=True)]
                    level[name] = Rel("", [(n, Val(sql_name, v.type)) for n, v in columns])
                    step = self.query(cte.body.right, parent)
                    union = "UNION ALL" if cte.body.all else "UNION"
                    step_sql = f"SELECT {', '.join(cast(Val(quote(n), v.type), w.type).sql + ' AS ' + quote(n) for (n, v), (_, w) in zip(step.columns, columns, strict=True))} FROM ({step.sql})"
                    heads.append(f"{quote(sql_name)}({', '.join(map(quote, names))}) AS ({start.sql} {union} {step_sql})")
                else:
                    rel = self.query(cte.body, parent)
                    if cte.columns:
                        names = [c.name for c in cte.columns]
                        rel = Rel(f"SELECT {', '.join(f'{quote(o)} AS {quote(n)}' for n, (o, _) in zip(names, rel.columns, strict=True))} FROM ({rel.sql})", [(n, v) for n, (_, v) in zip(names, rel.columns, strict=True)])
                    sql_name = self.fresh("w")
                    heads.append(f"{quote(sql_name)} AS ({rel.sql})")
                    level[name] = Rel("", [(n, Val(sql_name, v.type, v.bag)) for n, v in rel.columns], rel.scalar)
            body = self.query(node.body, parent)
        finally:
            self.ctes.pop()
        return Rel(f"WITH {'RECURSIVE ' if node.recursive else ''}{', '.join(heads)} {body.sql}", body.columns, body.scalar)

    def query_subquery(self, node: Node, parent: Scope | None) -> Rel:
        return self.query(node.query, parent)

    def query_expression(self, node: Node, parent: Scope | None) -> Rel:
        e = node.e
        if e.kind in ("match", "subquery") or (e.kind == "id" and self.lookup(e, parent) is None) or self.is_relation(e, parent or Scope()):
            if e.kind == "subquery":
                return self.query(e.query, parent)
            sql, variables, _ = self.from_item(Node("scan", e=e, alias=Node("id", name="_", exact=True, local=False), at=None), Scope(parent=parent))
            return self.starred(variables, f" FROM {sql}")
        v = self.expression(e, Scope(parent=parent))
        if v.array and e.kind in ("list", "bag"):
            return Rel(f"SELECT _1 FROM explode({v.sql}) AS t(_1)", [("_1", Val("_1", v.element))], True)
        return Rel(f"SELECT {v.sql} AS `_1`", [("_1", v)], True)

    def query_values(self, node: Node, parent: Scope | None) -> Rel:
        rows = [[self.expression(e, Scope(parent=parent)) for e in r.items] for r in node.rows]
        if len({len(r) for r in rows}) != 1:
            raise QueryError("rows of VALUES must have the same length")
        kinds = [common([r[k].type for r in rows]) for k in range(len(rows[0]))]
        names = [f"_{k + 1}" for k in range(len(kinds))]
        body = ", ".join("(" + ", ".join(cast(v, t).sql for v, t in zip(r, kinds, strict=True)) + ")" for r in rows)
        return Rel(f"SELECT * FROM VALUES {body} AS t({', '.join(map(quote, names))})", [(n, Val(quote(n), t)) for n, t in zip(names, kinds, strict=True)])

    def query_table(self, node: Node, parent: Scope | None) -> Rel:
        return self.query_expression(Node("expression", e=node.name), parent)

    def query_ordered(self, node: Node, parent: Scope | None) -> Rel:
        rel = self.query(node.body, parent)
        alias = self.fresh()
        columns = [(n, Val(f"{alias}.{quote(n)}", v.type, v.bag)) for n, v in rel.columns]
        scope = Scope([Var("", True, alias, columns)], parent)
        order = self.order(node.order, scope, {})
        return Rel(f"SELECT {', '.join(v.sql + ' AS ' + quote(n) for n, v in columns)} FROM ({rel.sql}) AS {alias}{order}{self.limits(node)}", rel.columns, rel.scalar)

    def query_set(self, node: Node, parent: Scope | None) -> Rel:
        left, right = self.query(node.left, parent), self.query(node.right, parent)

        def projected(rel: Rel, wanted: list[tuple[str, str | None, T.DataType | None]]) -> str:
            have = dict(rel.columns)
            items = [f"{cast(Val(quote(o), have[o].type), t).sql if o else f'cast(null as {t.simpleString()})' if t is not None else 'null'} AS {quote(n)}" for n, o, t in wanted]
            return f"SELECT {', '.join(items)} FROM ({rel.sql})"

        if node.outer:
            names = list(dict.fromkeys([n for n, _ in left.columns] + [n for n, _ in right.columns]))
            kinds = {n: common([dict(r.columns)[n].type for r in (left, right) if n in dict(r.columns)]) for n in names}
            sides = [projected(r, [(n, n if n in dict(r.columns) else None, kinds[n]) for n in names]) for r in (left, right)]
        else:
            if len(left.columns) != len(right.columns):
                raise QueryError(f"operands of {node.op} have different numbers of columns")
            names = [n for n, _ in left.columns]
            kinds = {n: common([a.type, b.type]) for (n, a), (_, b) in zip(left.columns, right.columns, strict=True)}
            sides = [projected(r, [(n, o, kinds[n]) for n, (o, _) in zip(names, r.columns, strict=True)]) for r in (left, right)]
        if any(isinstance(t, T.VariantType) for t in kinds.values()) and not (node.op == "UNION" and node.all):
            # VARIANT can't be compared: its canonical text can
            turned = [f"SELECT {', '.join((f'to_json({quote(n)})' if isinstance(kinds[n], T.VariantType) else quote(n)) + ' AS ' + quote(n) for n in names)} FROM ({s})" for s in sides]
            back = ", ".join((f"parse_json({quote(n)})" if isinstance(kinds[n], T.VariantType) else quote(n)) + " AS " + quote(n) for n in names)
            sql = f"SELECT {back} FROM ({self.set_sql(node, turned)})"
        else:
            sql = self.set_sql(node, sides)
        return Rel(sql, [(n, Val(quote(n), kinds[n])) for n in names], left.scalar and right.scalar)

    @staticmethod
    def set_sql(node: Node, sides: list[str]) -> str:
        if node.outer and node.op == "EXCEPT" and not node.all:
            # the multiset difference first, then distinct
            return f"SELECT DISTINCT * FROM (({sides[0]}) EXCEPT ALL ({sides[1]}))"
        return f"({sides[0]}) {node.op} {'ALL' if node.all else 'DISTINCT'} ({sides[1]})"

    def limits(self, node: Node) -> str:
        def number(e: Node | None, name: str) -> str:
            if e is None:
                return ""
            v = self.expression(e, Scope())
            n = self.constant(e)
            if not isinstance(n, int):
                if self.strict or v.const is None and n is None:
                    raise QueryError(f"{name} must be a constant integer")
                return ""
            return f" {name} {n}" if n >= 0 else ""

        return number(node.limit, "LIMIT") + number(node.offset, "OFFSET")

    def constant(self, e: Node):
        if e.kind == "literal":
            return e.value
        if e.kind == "unary":
            v = self.constant(e.e)
            return None if v is None else -v if e.op == "-" else v
        if e.kind == "binary" and e.op in "+-*":
            a, b = self.constant(e.left), self.constant(e.right)
            return None if a is None or b is None else {"+": a + b, "-": a - b, "*": a * b}[e.op]
        return None

    def order(self, keys: list[Node], scope: Scope, aliases: dict[str, Val]) -> str:
        found = [f"{sql} {way}" for sql, way in self.order_terms(keys, scope, aliases)]
        return f" ORDER BY {', '.join(found)}" if found else ""

    def order_terms(self, keys: list[Node], scope: Scope, aliases: dict[str, Val]) -> list[tuple[str, str]]:
        """What to sort by, and the direction of each."""
        found = []
        for k in keys:
            v = None
            if k.e.kind == "id":
                name = next((n for n in aliases if n == k.e.name or (not k.e.exact and n.lower() == k.e.name.lower())), None)
                if name is not None:
                    v = Val(quote(name), aliases[name].type)
            v = v or self.expression(k.e, scope)
            way = "DESC" if k.descending else "ASC"
            if v.type is None:
                continue
            if v.variant:
                found.append((dynamic.key(v.sql), f"{way} NULLS {k.nulls}"))
            elif isinstance(v.type, FRACTIONAL):
                # NaN is the smallest number here, Spark's largest
                found += [(f"({v.sql} is null)", "DESC" if k.nulls == "FIRST" else "ASC"), (f"isnan({v.sql})", "ASC" if k.descending else "DESC"), (v.sql, way)]
            else:
                found.append((v.sql, f"{way} NULLS {k.nulls}"))
        return found

    def starred(self, variables: list[Var], rest: str) -> Rel:
        items = self.star(variables)
        return Rel(f"SELECT {', '.join(f'{v.sql} AS {quote(n)}' for n, v in items)}{rest}", items)

    def star(self, variables: list[Var]) -> list[tuple[str, Val]]:
        items: list[tuple[str, Val]] = []
        for v in variables:
            if v.value is None:
                items += [(n, x) for n, x in v.columns if n not in v.hidden]
            elif v.value.struct:
                items += [(f.name, Val(f"{v.value.sql}.{quote(f.name)}", f.dataType)) for f in v.value.type.fields]
            else:
                items.append((v.name, v.value))
        return items

    def query_select(self, node: Node, parent: Scope | None) -> Rel:
        scope, rest, unpivot = Scope(parent=parent), "", False
        if node.from_ is not None:
            sql, variables, unpivot = self.from_item(node.from_, scope)
            scope = scope.extended(variables)
            rest = f" FROM {sql}"
        for let in node.let:
            v = self.expression(let.e, scope)
            scope = scope.extended([Var(let.alias.name, let.alias.exact, value=v)])
        where = self.condition(node.where, scope)
        if where:
            rest += f" WHERE {where}"
        outputs = [i.e for i in node.items if i.kind == "item"] + ([node.value] if node.value is not None else []) + list(node.pivot or []) + [k.e for k in node.order] + ([node.having] if node.having is not None else [])
        plain_from, plain_where = (sql if node.from_ is not None else None), where
        if node.group is not None or any(self.aggregates(e) for e in outputs):
            return self.grouped(node, scope, rest)
        if node.having is not None:
            raise QueryError("HAVING needs GROUP BY")
        return self.projected(node, scope, rest, (plain_from, plain_where, unpivot))

    def aggregates(self, e: Node) -> bool:
        if e.kind == "aggregate":
            return True
        if e.kind in ("subquery", "match"):
            return False
        return any(self.aggregates(c) for _, c in e.children()) or any(self.aggregates(x) for pair in (e.get("whens") or e.get("pairs") or []) for x in pair)

    def projected(self, node: Node, scope: Scope, rest: str, parts: tuple | None = None) -> Rel:
        distinct = "DISTINCT " if node.distinct else ""
        if node.pivot is not None:
            value, key = (self.expression(e, scope) for e in node.pivot)
            if family(key.type) not in ("string", "variant", "null"):
                return Rel("SELECT cast(map() as map<string,string>) AS `_1`", [("_1", Val("_1", T.MapType(STRING, STRING)))], True)
            k = key.sql if not key.variant else f"try_variant_get({key.sql}, '$', 'string')"
            inner = f"SELECT {k} AS k, first({value.sql}) AS v{rest}{' AND ' if ' WHERE ' in rest else ' WHERE '}{k} IS NOT NULL GROUP BY {k}"
            return Rel(f"SELECT map_from_entries(collect_list(struct(k, v))) AS `_1` FROM ({inner})", [("_1", Val("_1", T.MapType(STRING, value.type or T.NullType())))], True)
        scalar = False
        if node.value is not None:
            v = self.expression(node.value, scope)
            items, scalar = [("_1", v)], True
        elif node.star:
            items = self.star(scope.variables) if scope.grouped is None else [(a or f"_{i + 1}", v) for i, (_, a, v) in enumerate(scope.grouped.keys)]
        else:
            items = []
            for n, item in enumerate(node.items):
                if item.kind == "item_star":
                    v = self.expression(item.e, scope)
                    found = next((x for x in scope.variables if item.e.kind == "id" and x.name.lower() == item.e.name.lower()), None)
                    items += self.star([found]) if found else [(f.name, Val(f"{v.sql}.{quote(f.name)}", f.dataType)) for f in (v.type.fields if v.struct else [])]
                else:
                    items.append((self.alias(item, n), self.expression(item.e, scope)))
        if node.exclude:
            items = self.excluded(items, node.exclude, scope)
        order = self.order(node.order, scope, dict(items) if node.value is None else {})
        limited = self.reference and (node.limit or node.offset)  # that takes the limit first, see below
        if distinct and node.order and not limited and self.hidden_keys(node, scope, items):
            return self.distinct_ordered(node, items, scope, rest, scalar)
        outer = ""
        if distinct and any(v.variant for _, v in items):
            inner = ", ".join(f"{f'to_json({v.sql})' if v.variant else v.sql} AS {quote(n)}" for n, v in items)
            outer = ", ".join(f"{f'parse_json({quote(n)})' if v.variant else quote(n)} AS {quote(n)}" for n, v in items)
            sql = f"SELECT {outer} FROM (SELECT DISTINCT {inner}{rest}){order}{self.limits(node)}"
        else:
            sql = f"SELECT {distinct}{', '.join(f'{v.sql} AS {quote(n)}' for n, v in items)}{rest}{order}{self.limits(node)}"
        if self.reference and distinct and (node.limit or node.offset):
            # clause order of the language's evaluator: limit, then distinct
            sql = f"SELECT DISTINCT * FROM (SELECT {', '.join(f'{v.sql} AS {quote(n)}' for n, v in items)}{rest}{order}{self.limits(node)})"
        simple = parts and parts[0] is not None and not (node.distinct or node.order or node.limit or node.offset or scope.grouped)
        return Rel(sql, [(n, Val(quote(n), v.type, v.bag, v.missing)) for n, v in items], scalar, (*parts[:2], items) if simple else None)

    def hidden_keys(self, node: Node, scope: Scope, items: list[tuple[str, Val]]) -> bool:
        """Whether a sort key isn't among the outputs."""
        for k in node.order:
            if k.e.kind == "id" and node.value is None and any(n == k.e.name or (not k.e.exact and n.lower() == k.e.name.lower()) for n, _ in items):
                continue
            v = self.expression(k.e, scope)
            if v.type is not None and all(v.sql != x.sql for _, x in items):
                return True
        return False

    def distinct_ordered(self, node: Node, items: list[tuple[str, Val]], scope: Scope, rest: str, scalar: bool) -> Rel:
        """DISTINCT sorted by what isn't an output: rows are sorted, each output stays where it comes first."""
        named = {n: v for n, v in items} if node.value is None else {}
        terms = [(named[sql.strip("`")].sql if sql.strip("`") in named and sql == quote(sql.strip("`")) else sql, way) for sql, way in self.order_terms(node.order, scope, named)]
        same = ", ".join(f"to_json({v.sql})" if v.variant else v.sql for _, v in items)
        turn, names = self.fresh("o"), [self.fresh("o") for _ in terms]
        columns = [*(f"{v.sql} AS {quote(n)}" for n, v in items), *(f"{sql} AS {o}" for (sql, _), o in zip(terms, names, strict=True))]
        columns.append(f"row_number() OVER (PARTITION BY {same} ORDER BY {', '.join(f'{sql} {way}' for sql, way in terms)}) AS {turn}")
        by = ", ".join(f"{o} {way}" for (_, way), o in zip(terms, names, strict=True))
        sql = f"SELECT {', '.join(quote(n) for n, _ in items)} FROM (SELECT {', '.join(columns)}{rest}) WHERE {turn} = 1 ORDER BY {by}{self.limits(node)}"
        return Rel(sql, [(n, Val(quote(n), v.type, v.bag, v.missing)) for n, v in items], scalar)

    def alias(self, item: Node, n: int) -> str:
        if item.alias is not None:
            return item.alias.name
        e = item.e
        if e.kind == "id":
            return e.name
        if e.kind == "path" and e.steps[-1].kind == "step_key":
            return e.steps[-1].id.name
        if e.kind == "path" and e.steps[-1].kind == "step_index" and e.steps[-1].e.kind == "literal" and isinstance(e.steps[-1].e.value, str):
            return e.steps[-1].e.value
        return f"_{n + 1}"

    def excluded(self, items: list[tuple[str, Val]], paths: list[Node], scope: Scope) -> list[tuple[str, Val]]:
        def drop(v: Val, steps: list) -> Val | None:
            if not steps:
                return None
            head, more = steps[0], steps[1:]
            if isinstance(head, Node) or head == "*":
                if not v.struct:
                    return v
                kept = []
                for f in v.type.fields:
                    x = Val(f"{v.sql}.{quote(f.name)}", f.dataType)
                    hit = head == "*" or (f.name == head.name if head.exact else f.name.lower() == head.name.lower())
                    y = drop(x, more) if hit else x
                    if y is not None:
                        kept.append((f.name, y))
                return self.tuple_of(kept)
            if not v.array:
                return v
            name = self.fresh("x")
            if head == "[*]":
                if not more:
                    return Val(f"filter({v.sql}, {name} -> false)", v.type, v.bag)
                y = drop(Val(name, v.element), more)
                return Val(f"transform({v.sql}, {name} -> {y.sql})", T.ArrayType(y.type), v.bag)
            if not more:
                return Val(f"filter({v.sql}, ({name}, i) -> i <> {head})", v.type, v.bag)
            raise QueryError("EXCLUDE can't change one element's type")

        for p in paths:
            named = next((v for v in scope.variables if v.name == p.root.name or (not p.root.exact and v.name.lower() == p.root.name.lower())), None)
            steps = list(p.steps) if named is not None else [p.root, *p.steps]
            out = []
            for n, v in items:
                head = steps[0] if steps else "*"
                owner = named is None or any(n == m for m, _ in self.star([named]))
                hit = owner and (head == "*" or (isinstance(head, Node) and (n == head.name if head.exact else n.lower() == head.name.lower())))
                y = drop(v, steps[1:]) if hit else v
                if y is not None:
                    out.append((n, y))
            items = out
        return items

    def grouped(self, node: Node, scope: Scope, rest: str) -> Rel:
        alias = self.fresh("g")
        if node.group is not None and node.group.partial:
            raise QueryError("GROUP PARTIAL BY is not defined")
        keys, inner = [], []
        for n, k in enumerate(node.group.keys if node.group is not None else []):
            v = self.expression(k.e, scope)
            name = f"k{n}"
            sql = f"to_json({v.sql})" if v.variant else v.sql
            inner.append((name, sql))
            out = Val(f"parse_json({alias}.{name})", v.type) if v.variant else Val(f"{alias}.{name}", v.type, v.bag)
            shown = k.alias.name if k.alias is not None else k.e.name if k.e.kind == "id" else k.e.steps[-1].id.name if k.e.kind == "path" and k.e.steps[-1].kind == "step_key" else None
            keys.append((k.e, shown, out))
        state = Grouped(scope, alias, keys)
        variables = []
        if node.group is not None and node.group.group_as is not None:
            whole = self.tuple_of([(v.name, v.whole(self)) for v in scope.variables])
            state.aggregates.append(("members", f"collect_list({whole.sql})"))
            variables.append(Var(node.group.group_as.name, node.group.group_as.exact, value=Val(f"{alias}.members", T.ArrayType(whole.type), bag=True)))
        after = Scope(variables, scope.parent, state)
        having = self.condition(node.having, after)
        hole = f"\x00{alias}\x00"  # the inner query is known when all aggregates are
        rel = self.projected(node, after, hole + (f" WHERE {having}" if having else ""))
        columns = [f"{sql} AS {name}" for name, sql in inner] + [f"{sql} AS {name}" for name, sql in state.aggregates]
        group = f" GROUP BY {', '.join(sql for _, sql in inner)}" if inner else ""
        if not inner and self.reference:
            group = " GROUP BY true"
        body = f" FROM (SELECT {', '.join(columns) or '1 AS one'}{rest}{group}) AS {alias}"
        return Rel(rel.sql.replace(hole, body), rel.columns, rel.scalar)

    def condition(self, e: Node | None, scope: Scope) -> str:
        if e is None:
            return ""
        return self.boolean(self.expression(e, scope, where=True)).sql

    def boolean(self, v: Val) -> Val:
        if v.type is None:
            return Val("cast(null as boolean)", BOOLEAN)
        if v.variant:
            return dynamic.typed(v.sql, "boolean", BOOLEAN)
        if family(v.type) != "boolean":
            m = self.mismatch("expected a boolean")
            return Val("cast(null as boolean)", BOOLEAN, missing=m.missing)
        return v

    # --- FROM --------------------------------------------------------------------------------------
    def from_item(self, node: Node, scope: Scope) -> tuple[str, list[Var], bool]:
        if node.kind == "join":
            return self.join(node, scope)
        sql, variables, lateral, unpivot = self.leaf(node, scope)
        return sql if not lateral else f"(SELECT 1) AS {self.fresh('o')} CROSS JOIN LATERAL {sql}", variables, unpivot

    def leaf(self, node: Node, scope: Scope) -> tuple[str, list[Var], bool, bool]:
        """(SQL, variables, lateral, unpivot)"""
        alias = self.fresh("f")
        if node.kind == "unpivot":
            return self.unpivot(node, scope, alias)
        e = node.e
        name = node.alias.name if node.alias is not None else e.name if e.kind == "id" else e.steps[-1].id.name if e.kind == "path" and e.steps[-1].kind == "step_key" else f"_{alias}"
        exact = bool(node.alias is not None and node.alias.exact)
        if self.is_relation(e, scope):
            sql, columns, scalar, lateral = self.relation(e, scope, alias)
            if scalar:
                variables = [Var(name, exact, value=Val(f"{alias}.{quote(columns[0][0])}", columns[0][1].type, columns[0][1].bag))]
            else:
                variables = [Var(name, exact, alias, [(n, Val(f"{alias}.{quote(n)}", v.type, v.bag)) for n, v in columns])]
            if node.at is not None:  # a relation has no positions
                variables.append(Var(node.at.name, node.at.exact, value=Val("cast(null as bigint)", LONG)))
            return f"{sql} AS {alias}", variables, lateral, False
        v = self.expression(e, scope)
        correlated = self.depends(e, scope)
        at = [Var(node.at.name, node.at.exact, value=Val(f"cast({alias}.p as bigint)", LONG))] if node.at is not None else []
        if v.variant:
            # an array's elements; anything else is itself
            items = f"coalesce(try_variant_get({v.sql}, '$', 'array<variant>'), array({v.sql}))"
            element: T.DataType | None = T.VariantType()
        elif v.array:
            items, element = f"coalesce({v.sql}, array(null))", v.element
        else:
            items, element = f"array({v.sql})", v.type
            at = [Var(x.name, x.exact, value=Val("cast(null as bigint)", LONG)) for x in at]
        if v.bag:
            at = [Var(x.name, x.exact, value=Val("cast(null as bigint)", LONG)) for x in at]
        variables = [Var(name, exact, value=Val(f"{alias}.v", element)), *at]
        return f"posexplode({items}) AS {alias}(p, v)" if at else f"explode({items}) AS {alias}(v)", variables, correlated, False

    def depends(self, e: Node, scope: Scope) -> bool:
        """Whether an expression reads variables of the FROM clause to its left (or outside)."""
        return any(n.kind == "id" and self.lookup(n, scope) is not None for n in e.walk())

    def relation(self, e: Node, scope: Scope, alias: str) -> tuple[str, list[tuple[str, Val]], bool, bool]:
        if e.kind == "id":
            sql, columns, _ = self.table(e)
            scalar = next((r.scalar for level in reversed(self.ctes) for n, r in level.items() if n.lower() == e.name.lower()), False)
            return sql, columns, scalar, False
        if e.kind == "path":
            sql, columns, _ = self.session._qualified(e)
            return sql, columns, False, False
        if e.kind == "call":
            sql, columns = self.session._call_table_function(e.name, [self.constant_argument(a) for a in e.args], {k: self.constant_argument(a) for k, a in (e.get("named") or {}).items()})
            return sql, columns, False, False
        if e.kind == "match":
            sql, columns = match_sql(self, e, scope)
            return f"({sql})", columns, False, False
        rel = self.query(e.query, scope)
        # a subquery that reads variables to its left is a lateral one
        inner = [n for n in e.query.walk() if n.kind == "id"]
        lateral = any(f"{v.alias}." in rel.sql or (v.value is not None and v.value.sql in rel.sql) for v in scope.variables if v.alias or v.value) and bool(inner)
        if rel.scalar and rel.columns[0][1].type is not None and isinstance(rel.columns[0][1].type, T.StructType):
            return f"({rel.sql})", rel.columns, True, lateral
        return f"({rel.sql})", rel.columns, rel.scalar, lateral

    def constant_argument(self, e: Node):
        if e.kind != "literal":
            raise QueryError("arguments of table functions must be literals")
        return e.value

    def unpivot(self, node: Node, scope: Scope, alias: str) -> tuple[str, list[Var], bool, bool]:
        if self.is_relation(node.e, scope):
            raise QueryError("UNPIVOT expects a tuple")
        v = self.expression(node.e, scope)
        value_name = node.value.name if node.value is not None else "_v"
        key_name = node.key.name if node.key is not None else None
        if v.variant:
            sql, element = f"(SELECT key AS k, value AS v FROM variant_explode({v.sql}))", T.VariantType()
            found = f"variant_explode({v.sql}) AS {alias}(p, k, v)"
        elif isinstance(v.type, T.MapType):
            found, element = f"explode({v.sql}) AS {alias}(k, v)", v.type.valueType
        else:
            fields = [(f.name, Val(f"{v.sql}.{quote(f.name)}", f.dataType)) for f in v.type.fields] if v.struct else [("_1", v)] if not v.missing else []
            element = common([x.type for _, x in fields])
            pairs = ", ".join(f"named_struct('k', {text(n)}, 'v', {cast(x, element).sql})" for n, x in fields)
            found = f"inline(array({pairs})) AS {alias}(k, v)" if fields else f"inline(cast(array() as array<struct<k:string,v:string>>)) AS {alias}(k, v)"
        variables = [Var(value_name, False, value=Val(f"{alias}.v", element))]
        if key_name:
            variables.append(Var(key_name, False, value=Val(f"{alias}.k", STRING)))
        return found, variables, self.depends(node.e, scope), True

    def join(self, node: Node, scope: Scope) -> tuple[str, list[Var], bool]:
        left, lvars, _ = self.from_item(node.left, scope)
        within = scope.extended(lvars)
        if node.right.kind == "join":
            right, rvars, _ = self.from_item(node.right, within)
            lateral = False
            right = f"({right})"
        else:
            right, rvars, lateral, _ = self.leaf(node.right, within)
        kind = node.type.removeprefix("NATURAL ")
        names = [n.name for n in node.using]
        if node.type.startswith("NATURAL"):
            mine = {n.lower() for v in lvars for n, _ in self.star([v])}
            names = [n for v in rvars for n, _ in self.star([v]) if n.lower() in mine]
        on = ""
        if names:
            tests = []
            for n in names:
                id_ = Node("id", name=n, exact=False, local=False)
                a, b = self.lookup(id_, Scope(lvars)), self.lookup(id_, Scope(rvars))
                if a is None or b is None:
                    raise QueryError(f"{n} is not a column of both sides")
                tests.append(self.compare("=", a, b).sql)
                keep, drop = (rvars, lvars) if kind == "RIGHT" else (lvars, rvars)
                for v in drop:
                    v.hidden.update(m for m, _ in v.columns if m.lower() == n.lower())
                if kind == "FULL":
                    for v in keep:
                        v.columns = [(m, Val(f"coalesce({x.sql}, {b.sql})", x.type) if m.lower() == n.lower() else x) for m, x in v.columns]
            on = f" ON {' AND '.join(tests)}"
        elif node.on is not None:
            if kind == "INNER" and not lateral and (keyed := self.any_key(node.on, left, lvars, right, rvars, scope)):
                return keyed, lvars + rvars, False
            on = f" ON {self.condition(node.on, scope.extended(lvars + rvars))}"
        elif kind in ("LEFT", "RIGHT", "FULL"):
            on = " ON true"
        if kind == "INNER" and not on:
            kind = "CROSS"
        if lateral and kind == "LEFT" and (m := re.fullmatch(r"(?:pos)?explode\((.*)\) AS (\w+)\((?:p, )?v\)", right, re.DOTALL)) and not re.search(r"SELECT|nestq_", on):
            # the elements that fit, or an empty row: Spark would join the rows with the distinct arrays
            items, alias = f"transform({m[1]}, (v, p) -> named_struct('p', p, 'v', v))", m[2]
            fit = f"filter({items}, {alias} -> {on.removeprefix(' ON ')})" if on != " ON true" else items
            return f"{left} CROSS JOIN LATERAL inline_outer({fit}) AS {alias}(p, v)", lvars + rvars, False
        word = "LATERAL " if lateral else ""
        if kind == "CROSS" and on:
            kind = "INNER"
        if lateral and kind in ("RIGHT", "FULL"):
            raise QueryError(f"{kind} JOIN can't be lateral")
        return f"{left} {kind} JOIN {word}{right}{on}", lvars + rvars, False

    def any_key(self, on: Node, left: str, lvars: list[Var], right: str, rvars: list[Var], scope: Scope) -> str | None:
        """An inner join on alternatives that each have an equality of both sides, as one equi-join; None if
        it isn't one.  Both sides have a row for each alternative, with its number and key; a pair is kept
        under the first alternative that holds for it, so once."""
        if self.strict or scope.variables or scope.parent is not None or on.kind != "binary" or on.op != "OR":
            return None

        def parts(e: Node, op: str) -> list[Node]:
            return parts(e.left, op) + parts(e.right, op) if e.kind == "binary" and e.op == op else [e]

        def reads(variables: list[Var], sql: str) -> bool:
            names = {n for v in variables for n in ([v.alias] if v.alias else re.findall(r"\b(\w+)\.", v.value.sql))}
            return any(re.search(rf"\b{n}\.", sql) for n in names)

        both, keys, tests = scope.extended(lvars + rvars), [], []
        for e in parts(on, "OR"):
            found = None
            for part in parts(e, "AND"):
                if part.kind != "binary" or part.op != "=":
                    continue
                a, b = (self.operand(x, both) for x in (part.left, part.right))
                if a.type != b.type or not isinstance(a.type, (*INTEGRAL, T.StringType, T.DateType)) or "SELECT" in a.sql + b.sql:
                    continue
                sides = [(reads(lvars, x.sql), reads(rvars, x.sql)) for x in (a, b)]
                if sides == [(True, False), (False, True)]:
                    found = a, b
                elif sides == [(False, True), (True, False)]:
                    found = b, a
            if found is None:
                return None
            keys.append(found)
            tests.append(self.condition(e, both))
        if len({a.type.simpleString() for a, _ in keys}) > 1:
            return None
        x, y = self.fresh("k"), self.fresh("k")
        first = " ".join(f"WHEN {sql} THEN {i}" for i, sql in enumerate(tests))
        sides = [f"{sql} CROSS JOIN LATERAL posexplode(array({', '.join(k[i].sql for k in keys)})) AS {name}(p, k)" for i, sql, name in ((0, left, x), (1, right, y))]
        return f"{sides[0]} INNER JOIN ({sides[1]}) ON {x}.p = {y}.p AND {x}.k = {y}.k AND CASE {first} END = {x}.p"

    # --- expressions -------------------------------------------------------------------------------
    def expression(self, e: Node, scope: Scope, where: bool = False) -> Val:
        if scope is not None and scope.grouped is not None and e.kind not in ("literal", "aggregate"):
            for key, _, v in scope.grouped.keys:
                if key == e:
                    return v
        if e.kind in ("binary", "not", "in", "exists") and where:
            return getattr(self, f"e_{e.kind}")(e, scope, True)
        found = getattr(self, f"e_{e.kind}", None)
        if found is None:
            raise QueryError(f"{e.kind} is not an expression")
        return found(e, scope)

    def e_literal(self, e: Node, scope: Scope) -> Val:
        return MISSING if e.get("missing") else literal(e.value)

    def e_ion(self, e: Node, scope: Scope) -> Val:
        from nestq.sources.ion import loads, to_json

        found = loads(e.text)
        if len(found) == 1 and isinstance(found[0], (bool, int, float, str, bytes)) or found == [None]:
            return literal(found[0])
        return Val(f"parse_json({text(to_json(found[0] if len(found) == 1 else found))})", T.VariantType())

    def e_temporal(self, e: Node, scope: Scope) -> Val:
        if e.type == "TIME":
            try:
                h, m, *s = e.text.split(":")
                return self.tuple_of([("hour", literal(int(h))), ("minute", literal(int(m))), ("second", Val(f"cast('{float(s[0]) if s else 0}' as decimal(11,9))", T.DecimalType(11, 9)))])
            except ValueError:
                raise QueryError(f"TIME {e.text!r} is not a time") from None
        return Val(f"{'TIMESTAMP_NTZ' if e.type == 'TIMESTAMP' else 'DATE'} {text(e.text)}", T.TimestampNTZType() if e.type == "TIMESTAMP" else T.DateType())

    def e_id(self, e: Node, scope: Scope) -> Val:
        found = self.lookup(e, scope)
        if found is not None:
            return found
        if self.table(e) is not None:
            return self.collected(self.query_expression(Node("expression", e=e), None))
        if not e.exact and e.name.upper() in CLOCK:
            return Val(*CLOCK[e.name.upper()])
        if self.strict:
            raise QueryError(f"{e.name} is not known")
        return MISSING

    def e_path(self, e: Node, scope: Scope) -> Val:
        if e.root.kind == "id" and self.lookup(e.root, scope) is None and (known := self.session._qualified(e)) is not None:
            alias = self.fresh("f")
            columns = [(n, Val(f"{alias}.{quote(n)}", v.type)) for n, v in known[1]]
            return self.collected(self.starred([Var("t", False, alias, columns)], f" FROM {known[0]} AS {alias}"))
        v = self.expression(e.root, scope)
        for i, s in enumerate(e.steps):
            if s.kind in ("step_all", "step_star"):
                return self.spread(v, e.steps[i:], scope)
            v = self.step(v, s, scope)
        return v

    def spread(self, v: Val, steps: list[Node], scope: Scope) -> Val:
        """[*] and .*: the rest of the path for every element, as a collection."""
        if steps[0].kind == "step_star":
            if not v.struct:
                return self.mismatch(".* expects a tuple")
            fields = self.alike([Val(f"{v.sql}.{quote(f.name)}", f.dataType) for f in v.type.fields])
            v = Val(f"array({', '.join(f.sql for f in fields)})", T.ArrayType(fields[0].type if fields else T.NullType()), bag=True)
        elif v.variant:
            v = Val(f"try_variant_get({v.sql}, '$', 'array<variant>')", T.ArrayType(T.VariantType()))
        if not v.array:
            return self.mismatch("[*] expects a collection")
        if len(steps) == 1:
            return v
        name = self.fresh("x")
        inner, flat = Val(name, v.element), False
        for i, s in enumerate(steps[1:], 1):
            if s.kind in ("step_all", "step_star"):
                inner, flat = self.spread(inner, steps[i:], scope), True
                break
            inner = self.step(inner, s, scope)
        if flat and inner.array:
            return Val(f"flatten(transform({v.sql}, {name} -> {inner.sql}))", inner.type, bag=True)
        return Val(f"transform({v.sql}, {name} -> {inner.sql})", T.ArrayType(inner.type or T.NullType()), bag=v.bag)

    def step(self, v: Val, s: Node, scope: Scope | None = None) -> Val:
        key = None
        if s.kind == "step_key":
            key = s.id
        elif s.e.kind == "literal" and isinstance(s.e.value, str):
            key = Node("id", name=s.e.value, exact=True, local=False)
        if key is not None:
            if v.struct:
                f = next((f for f in v.type.fields if f.name == key.name), None)
                if f is None and not key.exact:
                    f = next((f for f in v.type.fields if f.name.lower() == key.name.lower()), None)
                if f is None:
                    return MISSING
                return Val(f"{v.sql}.{quote(f.name)}", f.dataType)
            if v.variant:
                path = "$[" + "\"" + key.name.replace('"', "") + "\"]"
                return Val(f"try_variant_get({v.sql}, {text(path)}, 'variant')", T.VariantType())
            if isinstance(v.type, T.MapType):
                return Val(f"try_element_at({v.sql}, {text(key.name)})", v.type.valueType)
            return NULL if v.type is None else self.mismatch("a path step expects a tuple")
        index = self.expression(s.e, scope or Scope())
        if index.const is not None and isinstance(index.const, int) and index.const < 0:
            return MISSING
        if v.array and numeric(index.type):
            i = f"cast({index.sql} as int)"
            return Val(f"get({v.sql}, {i})", v.element)
        if v.variant and isinstance(index.const, int):
            return Val(f"try_variant_get({v.sql}, '$[{index.const}]', 'variant')", T.VariantType())
        if v.variant and numeric(index.type):
            return Val(f"get(try_variant_get({v.sql}, '$', 'array<variant>'), cast({index.sql} as int))", T.VariantType())
        if isinstance(v.type, T.MapType) and family(index.type) == "string":
            return Val(f"try_element_at({v.sql}, {index.sql})", v.type.valueType)
        return NULL if v.type is None else self.mismatch("an index expects a list")

    def e_tuple(self, e: Node, scope: Scope) -> Val:
        pairs = []
        for k, v in e.pairs:
            if k.kind == "literal" and isinstance(k.value, str):
                pairs.append((k.value, self.expression(v, scope)))
            elif k.kind == "id":
                key = self.expression(k, scope)
                if family(key.type) == "string":
                    raise QueryError("attribute names must be string literals")
            elif self.strict:
                raise QueryError("attribute names must be strings")
        return self.tuple_of(pairs)

    def e_list(self, e: Node, scope: Scope) -> Val:
        items = self.alike([self.expression(i, scope) for i in e.items])
        kind = T.ArrayType(common([i.type for i in items]) or T.NullType())
        return Val(f"array({', '.join(i.sql for i in items)})", kind, bag=e.kind == "bag")

    e_bag = e_list

    def e_unary(self, e: Node, scope: Scope) -> Val:
        v = self.expression(e.e, scope)
        if v.variant:
            return dynamic.arithmetic(e.op, literal(0), v, self.strict)
        if v.type is None:
            return v
        if not numeric(v.type):
            return self.mismatch("a sign expects a number")
        if isinstance(v.const, (int, float)) and e.op == "-":
            return literal(-v.const)
        return v if e.op == "+" else Val(f"(- {v.sql})", v.type)

    def e_not(self, e: Node, scope: Scope, where: bool = False) -> Val:
        v = self.boolean(self.expression(e.e, scope, where))
        return Val(f"(NOT {v.sql})", BOOLEAN)

    def e_binary(self, e: Node, scope: Scope, where: bool = False) -> Val:
        if e.op in ("AND", "OR"):
            a, b = (self.boolean(self.expression(x, scope, where)) for x in (e.left, e.right))
            return Val(f"({a.sql} {e.op} {b.sql})", BOOLEAN)
        a, b = self.operand(e.left, scope), self.operand(e.right, scope)
        if e.op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(e.op, a, b)
        if e.op == "||":
            return self.concat(a, b)
        return self.arithmetic(e.op, a, b)

    def operand(self, e: Node, scope: Scope) -> Val:
        """A subquery of one column is its single value here, as in SQL."""
        if e.kind == "subquery":
            rel = self.query(e.query, scope)
            if len(rel.columns) == 1:
                return Val(f"({rel.sql})", rel.columns[0][1].type)
        return self.expression(e, scope)

    def concat(self, a: Val, b: Val) -> Val:
        if a.type is None or b.type is None:
            return MISSING if a.missing or b.missing else NULL
        if a.array and b.array:
            a, b = self.alike([a, b])
            return Val(f"concat({a.sql}, {b.sql})", a.type, a.bag or b.bag)
        sides = [f"try_variant_get({v.sql}, '$', 'string')" if v.variant else v.sql if family(v.type) == "string" else f"cast({v.sql} as string)" for v in (a, b)]
        return Val(f"concat({', '.join(sides)})", STRING)

    def compare(self, op: str, a: Val, b: Val) -> Val:
        if a.missing or b.missing or a.type is None or b.type is None:
            return Val("cast(null as boolean)", BOOLEAN, missing=a.missing or b.missing)
        if a.variant and b.variant:
            return Val(dynamic.compare(op, a.sql, b.sql), BOOLEAN)
        if a.variant or b.variant:
            known = b if a.variant else a
            if family(known.type) in ("number", "string", "boolean"):
                # a cast alone would take '1' and true for the number 1
                kinds = {"number": "BIGINT|DOUBLE|FLOAT|DECIMAL", "string": "STRING", "boolean": "BOOLEAN"}[family(known.type)]
                to = DOUBLE if isinstance(known.type, (*FRACTIONAL, T.DecimalType)) else LONG if numeric(known.type) else known.type
                other = a if a.variant else b
                if numeric(known.type):
                    to = DOUBLE if not isinstance(known.const, int) and not isinstance(known.type, INTEGRAL) else T.DecimalType(38, 6)
                inner = Val(f"(case when schema_of_variant({other.sql}) rlike '^({kinds})' then try_variant_get({other.sql}, '$', '{to.simpleString()}') end)", to)
                found = f"({inner.sql} {op} {b.sql})" if a.variant else f"({a.sql} {op} {inner.sql})"
                if op in ("=", "<>"):
                    found = f"coalesce({found}, case when {other.sql} is not null and not is_variant_null({other.sql}) and {known.sql} is not null then {'false' if op == '=' else 'true'} end)"
                return Val(found, BOOLEAN)
            else:
                a, b = (v if v.variant else cast(v, T.VariantType()) for v in (a, b))
                return self.compare(op, a, b)
        if family(a.type) != family(b.type) and {family(a.type), family(b.type)} != {"null"}:
            if op in ("=", "<>"):
                return Val(f"(case when {a.sql} is not null and {b.sql} is not null then {'false' if op == '=' else 'true'} end)", BOOLEAN)
            found = self.mismatch("values of different types have no order")
            return Val("cast(null as boolean)", BOOLEAN, missing=found.missing)
        if op in ("=", "<>") and family(a.type) in ("struct", "array"):
            return self.equal(op, a, b)
        if family(a.type) == "map" and a.type != b.type:
            return Val(f"(to_json({a.sql}) {op} to_json({b.sql}))", BOOLEAN)
        if family(a.type) == "array" and a.type != b.type:
            a, b = self.alike([a, b])
        return Val(f"({a.sql} {op} {b.sql})", BOOLEAN)

    def equal(self, op: str, a: Val, b: Val) -> Val:
        """Tuples are equal by attribute name, lists by position, bags as multisets; a list is no bag."""
        unequal = Val(f"(case when {a.sql} is not null and {b.sql} is not null then {'false' if op == '=' else 'true'} end)", BOOLEAN)
        if a.array and a.bag != b.bag:
            return unequal
        x, y = self.canonical(a, b.type), self.canonical(b, a.type)
        if x is None or y is None:
            return unequal
        return Val(f"({x.sql} {op} {y.sql})", BOOLEAN)

    def canonical(self, v: Val, other: T.DataType | None) -> Val | None:
        """A value in a form in which it can be compared with one of type ``other``; None if it can't be equal."""
        if v.type is None or other is None or isinstance(other, T.NullType):
            return v
        if v.struct and isinstance(other, T.StructType):
            names = sorted(f.name for f in v.type.fields)
            if names != sorted(other.names) or len(set(names)) < len(names):
                return None
            pairs = [(n, self.canonical(Val(f"{v.sql}.{quote(n)}", v.type[n].dataType), other[n].dataType)) for n in names]
            if any(x is None for _, x in pairs):
                return None
            made = self.tuple_of(pairs)
            return Val(f"(case when {v.sql} is not null then {made.sql} end)", made.type)
        if v.array and isinstance(other, T.ArrayType):
            name, items = self.fresh("x"), v.sql
            element = v.type.elementType
            inner = self.canonical(Val(name, element), other.elementType)
            if inner is None:
                return None
            if inner.sql != name:
                items = f"transform({items}, {name} -> {inner.sql})"
            return Val(f"sort_array({items})" if v.bag else items, T.ArrayType(inner.type or T.NullType()), v.bag)
        if v.variant or isinstance(other, T.VariantType):
            return Val(dynamic.key(cast(v, dynamic.VARIANT).sql), T.StringType())
        if family(v.type) != family(other) and "null" not in (family(v.type), family(other)):
            return None
        return cast(v, common([v.type, other]))

    def arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if a.missing or b.missing:
            return MISSING
        if any(v.type is not None and not numeric(v.type) and not v.variant for v in (a, b)):
            return self.mismatch(f"{op} expects numbers")
        if a.type is None or b.type is None:
            return NULL
        if a.variant or b.variant:
            return dynamic.arithmetic(op, a, b, self.strict)
        kind = common_number(a.type, b.type)
        if self.reference and isinstance(kind, T.DoubleType) and any(isinstance(v.type, T.DecimalType) for v in (a, b)):
            kind = T.DecimalType(38, 18)
            a, b = cast(a, kind), cast(b, kind)
        if isinstance(kind, T.LongType):
            a, b = cast(a, LONG), cast(b, LONG)
        if op == "^":
            return Val(f"pow({a.sql}, {b.sql})", DOUBLE)
        if op == "/":
            if isinstance(kind, T.LongType):
                divisor = b.sql if self.strict else f"nullif({b.sql}, 0L)"
                return Val(f"({a.sql} div {divisor})", LONG)
            if isinstance(kind, T.DecimalType):
                kind = T.DecimalType(38, min(38, max(kind.scale, 6)))
            sql = f"({a.sql} / {b.sql})" if self.strict else f"try_divide({a.sql}, {b.sql})"
            return Val(f"cast({sql} as {kind.simpleString()})", kind)
        if self.strict:
            sql = f"({a.sql} {op} {b.sql})"
        else:
            sql = f"try_{ {'+': 'add', '-': 'subtract', '*': 'multiply', '%': 'mod'}[op]}({a.sql}, {b.sql})"
        if isinstance(kind, T.DecimalType):
            kind = T.DecimalType(38, min(38, kind.scale * (2 if op == "*" else 1)))
            sql = f"cast({sql} as {kind.simpleString()})"
        return Val(sql, kind)

    def e_between(self, e: Node, scope: Scope) -> Val:
        v, low, high = (self.operand(x, scope) for x in (e.e, e.low, e.high))
        sql = f"({self.compare('>=', v, low).sql} AND {self.compare('<=', v, high).sql})"
        return Val(f"(NOT {sql})" if e.negated else sql, BOOLEAN)

    def e_like(self, e: Node, scope: Scope) -> Val:
        v, p = self.expression(e.e, scope), self.expression(e.pattern, scope)
        v, p = (dynamic.typed(x.sql, "string", STRING) if x.variant else x for x in (v, p))
        if v.type is None or p.type is None:
            return Val("cast(null as boolean)", BOOLEAN)
        if family(v.type) != "string" or family(p.type) != "string":
            return self.mismatch("LIKE expects strings")
        escape = self.expression(e.escape, scope) if e.escape is not None else None
        if escape is not None and isinstance(escape.const, str):
            if len(escape.const) > 1:
                raise QueryError("ESCAPE takes one character")
        if escape is not None and escape.const is None:
            # a regular expression made of pattern and escape character, row by row
            quoted = rf"concat('(?s)^', regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({p.sql}, concat('\\Q', {escape.sql}, '\\E([%_])'), '\u0001$1'), '([\\\\.\\[\\](){{}}*+?^$|])', '\\\\$1'), '(?<!\u0001)%', '.*'), '(?<!\u0001)_', '.'), '\u0001', ''), '$')"
            sql = f"({v.sql} RLIKE {quoted})"
        else:
            # no default escape in the language: pass a character that patterns don't use
            sql = f"({v.sql} LIKE {p.sql} ESCAPE {text(escape.const if escape is not None and escape.const else chr(1))})"
        return Val(f"(NOT {sql})" if e.negated else sql, BOOLEAN)

    def e_in(self, e: Node, scope: Scope, where: bool = False) -> Val:
        v = self.expression(e.e, scope)
        negate = (lambda s: f"(NOT {s})") if e.negated else (lambda s: s)
        w = e.within
        if w.kind == "subquery" or (w.kind == "id" and self.lookup(w, scope) is None and self.table(w) is not None):
            array = self.array_source(w, scope)
            if array is None:
                rel = self.query(w.query if w.kind == "subquery" else Node("expression", e=w), scope)
                if len(rel.columns) != 1:
                    return Val("cast(null as boolean)", BOOLEAN)
                t = rel.columns[0][1].type
                if family(t) != family(v.type):
                    return Val(negate(f"(case when {v.sql} is not null then false end)"), BOOLEAN)
                if where:
                    return Val(negate(f"({v.sql} IN ({rel.sql}))"), BOOLEAN)
                c = quote(rel.columns[0][0])
                if self.sets or not isinstance(v.type, T.AtomicType) or v.variant:
                    found = f"array_contains((SELECT collect_set({c}) FROM ({rel.sql})), {v.sql})"
                else:
                    found = f"({v.sql} IN (SELECT {c} FROM ({rel.sql}) WHERE {c} IS NOT NULL))"
                absent = f"(SELECT count_if({c} IS NULL) FROM ({rel.sql})) > 0"
                return Val(negate(f"(case when {found} then true when {v.sql} is null or {absent} then cast(null as boolean) else false end)"), BOOLEAN)
            items = array
        elif w.kind in ("list", "bag"):
            vals = [self.expression(i, scope) for i in w.items]
            if v.type is None:
                return Val("cast(null as boolean)", BOOLEAN)
            if not vals:
                return Val("true" if e.negated else "false", BOOLEAN)
            fit = [x for x in vals if x.type is None or x.variant or v.variant or family(x.type) == family(v.type)]
            if not any(x.variant for x in [v, *fit]) and fit and any(x.type is not None for x in fit):
                sql = f"({v.sql} IN ({', '.join(x.sql for x in fit)}))"
            elif fit:
                sql = "(" + " OR ".join(self.compare("=", v, x).sql for x in fit) + ")"
            else:
                sql = f"(case when {v.sql} is not null then false end)"
            return Val(negate(sql), BOOLEAN)
        else:
            items = self.expression(w, scope)
        if items.variant:
            items = Val(f"try_variant_get({items.sql}, '$', 'array<{v.type.simpleString() if v.type is not None else 'string'}>')", T.ArrayType(v.type or STRING))
        if not items.array or v.type is None or (items.element is not None and family(items.element) != family(v.type)):
            return Val("cast(null as boolean)", BOOLEAN)
        return Val(negate(f"array_contains({items.sql}, {v.sql})"), BOOLEAN)

    def e_is(self, e: Node, scope: Scope) -> Val:
        v = self.expression(e.e, scope)
        if e.type == "NULL":
            sql = "true" if v.type is None else f"({v.sql} IS NULL OR is_variant_null({v.sql}))" if v.variant else f"({v.sql} IS NULL)"
        elif e.type == "MISSING":
            sql = "true" if v.missing else "false" if not v.variant else f"({v.sql} IS NULL)"
        else:
            sql = self.is_type(v, e.type)
        return Val(f"(NOT {sql})" if e.negated else sql, BOOLEAN)

    def is_type(self, v: Val, name: str) -> str:
        to = TYPES[name]
        if v.variant:
            kind = {"bigint": "BIGINT", "int": "BIGINT", "smallint": "BIGINT", "double": "DOUBLE|DECIMAL.*", "float": "DOUBLE|FLOAT", "decimal": "DECIMAL.*|BIGINT", "boolean": "BOOLEAN", "string": "STRING", "binary": "BINARY", "date": "DATE", "timestamp_ntz": "TIMESTAMP.*", "tuple": "OBJECT.*", "list": "ARRAY.*", "bag": "ARRAY.*"}.get(to, ".*")
            return f"coalesce(schema_of_variant({v.sql}) RLIKE '^({kind})', false)"
        if v.type is None:
            return "false"
        t, known = v.type, family(v.type)
        hit = {
            "bigint": isinstance(t, INTEGRAL), "int": isinstance(t, INTEGRAL), "smallint": isinstance(t, INTEGRAL), "tinyint": isinstance(t, INTEGRAL), "double": isinstance(t, FRACTIONAL), "float": isinstance(t, FRACTIONAL),
            "decimal": isinstance(t, T.DecimalType), "list": v.array and not v.bag, "bag": v.array and v.bag, "tuple": v.struct, "date": isinstance(t, T.DateType), "timestamp_ntz": known == "temporal" and not isinstance(t, T.DateType), "any": True,
        }.get(to, known == to)
        return f"({v.sql} IS NOT NULL)" if hit else "false"

    def e_case(self, e: Node, scope: Scope) -> Val:
        subject = self.expression(e.subject, scope) if e.subject is not None else None
        tests, results = [], []
        for c, r in e.whens:
            v = self.expression(c, scope)
            tests.append((self.compare("=", subject, v) if subject is not None else self.boolean(v)).sql)
            results.append(self.expression(r, scope))
        results.append(self.expression(e.other, scope) if e.other is not None else NULL)
        results = self.alike(results)
        whens = " ".join(f"WHEN {t} THEN {r.sql}" for t, r in zip(tests, results))  # noqa: B905  the last is ELSE
        return Val(f"(CASE {whens} ELSE {results[-1].sql} END)", common([r.type for r in results]))

    def e_cast(self, e: Node, scope: Scope) -> Val:
        v, name, arguments = self.expression(e.e, scope), TYPES[e.type.name], e.type.arguments
        if name == "any":
            return v
        if name in ("tuple", "list", "bag"):
            return self.cast_collection(v, name)
        if name in ("null", "missing", "time"):
            raise QueryError(f"CAST to {e.type.name} is not defined")
        to = T._parse_datatype_string(f"decimal({', '.join(map(str, arguments))})" if name == "decimal" and arguments else "decimal(38,18)" if name == "decimal" else name)
        if v.type is None:
            return Val(f"cast(null as {to.simpleString()})", to)
        if v.variant:
            return Val(f"try_variant_get({v.sql}, '$', '{to.simpleString()}')", to)
        sql = f"{'cast' if self.strict else 'try_cast'}({v.sql} as {to.simpleString()})"
        if e.type.name in ("CHAR", "VARCHAR", "CHARACTER") and arguments:
            sql = f"left({sql}, {arguments[0]})"
        return Val(sql, to)

    def cast_collection(self, v: Val, name: str) -> Val:
        if v.type is None:
            return v
        if v.variant:
            kind = "tuple" if name == "tuple" else "list"
            found = f"(case when {dynamic.is_a(v.sql, kind)} then {v.sql} end)"
            return Val(found, v.type) if name == "tuple" else Val(dynamic.get(found, "array<variant>"), T.ArrayType(v.type), bag=name == "bag")
        if name == "tuple":
            return v if v.struct or isinstance(v.type, T.MapType) else self.mismatch("CAST to a tuple expects a tuple")
        return Val(v.sql, v.type, bag=name == "bag") if v.array else self.mismatch(f"CAST to a {name} expects a collection")

    def e_trim(self, e: Node, scope: Scope) -> Val:
        v, chars = self.expression(e.e, scope), self.expression(e.chars, scope) if e.chars is not None else literal(" ")
        v, chars = (dynamic.typed(x.sql, "string", STRING) if x.variant else x for x in (v, chars))
        if v.type is None or chars.type is None:
            return NULL
        if family(v.type) != "string" or family(chars.type) != "string":
            return self.mismatch("TRIM expects strings")
        return Val(f"trim({e.side} {chars.sql} FROM {v.sql})", STRING)

    def e_call(self, e: Node, scope: Scope) -> Val:
        if e.name in FUNCTIONS:
            build, least, most = FUNCTIONS[e.name]
            if not least <= len(e.args) <= most or e.get("named"):
                raise QueryError(f"{e.name} takes {least} to {most} arguments")
            return build(self, *(None if a is None else self.expression(a, scope) for a in e.args))
        found = self.session._scalar_function(e.name)
        if found is not None:
            return found(self, *(self.expression(a, scope) for a in e.args), **{k: self.expression(a, scope) for k, a in (e.get("named") or {}).items()})
        raise QueryError(f"there is no function {e.name}")

    def e_aggregate(self, e: Node, scope: Scope) -> Val:
        state = scope.grouped if scope is not None else None
        if state is None:
            raise QueryError(f"{e.name} is not allowed here")
        sql, kind = self.aggregate(e, self.expression(e.e, state.inner) if e.e is not None else None)
        known = next((n for n, s in state.aggregates if s == sql), None)
        if known is None:
            known = f"a{len(state.aggregates)}"
            state.aggregates.append((known, sql))
        return Val(f"{state.alias}.{known}", kind)

    def aggregate(self, e: Node, v: Val | None) -> tuple[str, T.DataType | None]:
        d = "DISTINCT " if e.distinct else ""
        if v is None:
            return "count(1)", LONG
        if v.variant:
            return dynamic.aggregate(e.name, e.distinct, v.sql)
        if e.name == "COUNT":
            return f"count({d}{v.sql})", LONG
        if v.type is None:
            return "max(null)", None
        if e.name in ("MIN", "MAX"):
            if isinstance(v.type, FRACTIONAL) and e.name == "MAX":
                # NaN is below all numbers here
                return f"coalesce(max(nullif({v.sql}, double('NaN'))), max({v.sql}))", v.type
            if isinstance(v.type, FRACTIONAL):
                return f"(case when max(isnan({v.sql})) then double('NaN') else min({v.sql}) end)", v.type
            return f"{e.name.lower()}({v.sql})", v.type
        if e.name in ("ANY", "SOME", "EVERY"):
            if family(v.type) != "boolean":
                return ("max(null)", self.mismatch(f"{e.name} expects booleans").type)
            return f"{'bool_and' if e.name == 'EVERY' else 'bool_or'}({v.sql})", BOOLEAN
        if not numeric(v.type):
            return ("max(null)", self.mismatch(f"{e.name} expects numbers").type)
        if e.name == "AVG":
            if self.reference:
                return f"avg({d}cast({v.sql} as decimal(38,10)))", T.DecimalType(38, 14)
            return f"avg({d}{v.sql})", DOUBLE if not isinstance(v.type, T.DecimalType) else T.DecimalType(min(38, v.type.precision + 4), min(38, v.type.scale + 4))
        f = "sum" if self.strict or d else "try_sum"
        return f"{f}({d}{v.sql})", LONG if isinstance(v.type, INTEGRAL) else DOUBLE if isinstance(v.type, FRACTIONAL) else T.DecimalType(min(38, v.type.precision + 10), v.type.scale)

    def e_coll(self, e: Node, scope: Scope) -> Val:
        if e.e.kind == "subquery":
            array = self.array_source(e.e, scope)
            if array is not None:
                return collection(self, e.name, array, e.distinct)
            rel = self.query(e.e.query, scope)
            if len(rel.columns) != 1:
                return self.mismatch(f"COLL_{e.name} expects single values")
            agg = Node("aggregate", name=e.name, e=e.e, distinct=e.distinct)
            if rel.parts is not None:
                from_, where, items = rel.parts
                sql, kind = self.aggregate(agg, items[0][1])
                return Val(f"(SELECT {sql} FROM {from_}{' WHERE ' + where if where else ''})", kind)
            sql, kind = self.aggregate(agg, Val(quote(rel.columns[0][0]), rel.columns[0][1].type))
            return Val(f"(SELECT {sql} FROM ({rel.sql}))", kind)
        return collection(self, e.name, self.expression(e.e, scope), e.distinct)

    # --- subqueries as values -------------------------------------------------------------------------
    def array_source(self, e: Node, scope: Scope) -> Val | None:
        """A subquery over one nested collection as array functions; None if it isn't one."""
        if e.kind != "subquery" or e.query.kind != "select":
            return None
        q = e.query
        if q.from_ is None or q.from_.kind != "scan" or q.group or q.having or q.order or q.limit or q.offset or q.distinct or q.let or q.pivot or q.exclude:
            return None
        if self.is_relation(q.from_.e, scope) or not self.depends(q.from_.e, scope):
            return None
        if any(self.aggregates(x) for x in ([i.e for i in q.items] + ([q.value] if q.value is not None else []))):
            return None
        source = self.expression(q.from_.e, scope)
        if source.variant:
            source = Val(f"try_variant_get({source.sql}, '$', 'array<variant>')", T.ArrayType(T.VariantType()))
        if not source.array or any(n.kind in ("subquery", "aggregate") for x in (q.where, q.value) if x is not None for n in x.walk()):
            return None
        name, at = self.fresh("x"), self.fresh("i")
        alias = q.from_.alias.name if q.from_.alias is not None else q.from_.e.steps[-1].id.name if q.from_.e.kind == "path" and q.from_.e.steps[-1].kind == "step_key" else q.from_.e.name if q.from_.e.kind == "id" else name
        variables = [Var(alias, bool(q.from_.alias is not None and q.from_.alias.exact), value=Val(name, source.element))]
        items = source.sql
        if q.from_.at is not None:
            items = f"transform({items}, (v, i) -> named_struct('v', v, 'i', cast(i as bigint)))"
            variables = [Var(alias, False, value=Val(f"{name}.v", source.element)), Var(q.from_.at.name, False, value=Val(f"{name}.i", LONG) if not source.bag else NULL)]
        inner = Scope(variables, scope)
        where = self.condition(q.where, inner)
        if where:
            items = f"filter({items}, {name} -> {where})"
        if q.value is not None:
            v = self.expression(q.value, inner)
        elif q.star:
            v = variables[0].value if variables[0].value.struct else self.tuple_of([(alias, variables[0].value)])
        else:
            v = self.tuple_of([(self.alias(i, n), self.expression(i.e, inner)) for n, i in enumerate(q.items)])
            if len(q.items) == 1 and not q.value:
                v = self.expression(q.items[0].e, inner) if e.get("flat") else v
        if v.sql == name:
            return Val(items, source.type, bag=True)
        return Val(f"transform({items}, {name} -> {v.sql})", T.ArrayType(v.type or T.NullType()), bag=True)

    def collected(self, rel: Rel) -> Val:
        """A query's elements as one collection; absent elements are kept."""
        if rel.parts is not None:
            from_, where, items = rel.parts
            element = items[0][1] if rel.scalar else self.tuple_of(items)
            body = f"FROM {from_}{' WHERE ' + where if where else ''}"
        else:
            alias = self.fresh()
            element, body = rel.element(alias, self), f"FROM ({rel.sql}) AS {alias}"
        kind = T.ArrayType(element.type or T.NullType())
        if rel.scalar:
            return Val(f"(SELECT transform(collect_list(struct({element.sql} AS v)), s -> s.v) {body})", kind, bag=True)
        return Val(f"(SELECT collect_list({element.sql}) {body})", kind, bag=True)

    def e_subquery(self, e: Node, scope: Scope) -> Val:
        if e.query.kind == "select" and e.query.pivot is not None:
            rel = self.query(e.query, scope)
            return Val(f"({rel.sql})", rel.columns[0][1].type)
        array = self.array_source(e, scope)
        return array if array is not None else self.collected(self.query(e.query, scope))

    def e_match(self, e: Node, scope: Scope) -> Val:
        sql, columns = match_sql(self, e, scope)
        return self.collected(Rel(sql, columns))

    def e_exists(self, e: Node, scope: Scope, where: bool = False) -> Val:
        if e.e.kind == "subquery":
            array = self.array_source(e.e, scope)
            if array is None:
                return Val(f"EXISTS ({self.query(e.e.query, scope).sql})", BOOLEAN)
            return Val(f"(size({array.sql}) > 0)", BOOLEAN)
        v = self.expression(e.e, scope)
        if v.type is None:
            return Val("cast(null as boolean)", BOOLEAN)
        if family(v.type) in ("array", "map"):
            return Val(f"(case when {v.sql} is not null then size({v.sql}) > 0 end)", BOOLEAN)
        if v.struct:
            return Val(f"(case when {v.sql} is not null then {'true' if v.type.fields else 'false'} end)", BOOLEAN)
        return Val(f"(case when {v.sql} is not null then false end)", BOOLEAN)
