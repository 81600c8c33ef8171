"""Graph patterns as equi-joins.

A graph is two relations: nodes (id, labels, payload) and edges (id, src, dst, directed, labels, payload).
A path pattern becomes a chain node - edge - node - ...; every edge is seen in the orientations its
direction allows, so each step is an equi-join on a node id.  Names used twice are further equalities,
path modes are inequalities of ids, and repeated edges {m,n} are alternatives joined by UNION ALL.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import types as T

from nestq.ast import Node, QueryError
from nestq.plans.values import Val, quote, text

#: Orientations (forward, backward, undirected) that a direction allows.
DIRECTIONS = {"->": (1, 0, 0), "<-": (0, 1, 0), "~": (0, 0, 1), "<~": (0, 1, 1), "~>": (1, 0, 1), "<->": (1, 1, 0), "-": (1, 1, 1), "<~>": (1, 1, 1)}


@dataclass
class Graph:
    """A registered graph: the views of its nodes and edges, and their payload types."""

    nodes: str
    edges: str
    node_payload: T.DataType
    edge_payload: T.DataType


@dataclass
class Element:
    edge: bool
    specs: list[Node] = field(default_factory=list)
    alias: str = ""


@dataclass
class Path:
    elements: list[Element]
    rules: list[tuple[str, int, int, Node | None]]  # mode, first and last element, condition


def flattened(path: Node) -> list[Path]:
    """The alternatives of a path pattern, each a strict alternation of nodes and edges."""

    def sequences(p: Node) -> list[tuple[list, list]]:
        """(items, rules) with rules as (mode, from, to, where) over items."""
        options: list[list[tuple[list, list]]] = []
        for e in p.elements:
            if e.kind == "gpath":
                inner = sequences(e)
                low, high = e.get("quantifier") or (1, 1)
                options.append([repeated for n in counts(low, high) for combo in itertools.product(inner, repeat=n) for repeated in [joined(list(combo))]])
            else:
                low, high = e.get("quantifier") or (1, 1)
                options.append([([Node(e.kind, **{**e.fields, "quantifier": None}) for _ in range(n)] if (n, n) != (1, 1) else [e], []) for n in counts(low, high)])
        found = []
        for combo in itertools.product(*options):
            items, rules = joined(list(combo))
            found.append((items, [*rules, (p.mode, 0, len(items), p.where)]))
        return found

    def counts(low: int, high: int | None) -> range:
        if high is None:
            raise QueryError("unbounded repetition of a graph pattern; give an upper bound as in {1,5}")
        return range(low, high + 1)

    def joined(parts: list[tuple[list, list]]) -> tuple[list, list]:
        items, rules = [], []
        for i, r in parts:
            rules += [(m, a + len(items), b + len(items), w) for m, a, b, w in r]
            items += i
        return items, rules

    paths = []
    for items, rules in sequences(path):
        elements: list[Element] = []
        where: list[int] = []  # element of each item
        for item in items:
            if item.kind == "gnode":
                if elements and not elements[-1].edge:
                    elements[-1].specs.append(item)  # the same node, named again
                else:
                    elements.append(Element(False, [item]))
            else:
                if not elements or elements[-1].edge:
                    elements.append(Element(False))
                elements.append(Element(True, [item]))
            where.append(len(elements) - 1)
        if not elements or elements[-1].edge:
            elements.append(Element(False))
        spans = []
        for mode, a, b, condition in rules:
            if a < b:
                first, last = where[a], where[b - 1]
                spans.append((mode, first - (elements[first].edge), last + elements[last].edge, condition))
            elif condition is not None:
                spans.append((mode, 0, len(elements) - 1, condition))
        paths.append(Path(elements, spans))
    return paths


def label_sql(label: Node | None, alias: str) -> str | None:
    if label is None:
        return None
    if label.kind == "label_name":
        return f"array_contains({alias}.labels, {text(label.id.name)})"
    if label.kind == "label_any":
        return f"size({alias}.labels) > 0"
    if label.kind == "label_not":
        return f"NOT coalesce({label_sql(label.e, alias)}, false)"
    return f"({label_sql(label.left, alias)} {'AND' if label.kind == 'label_and' else 'OR'} {label_sql(label.right, alias)})"


def oriented(graph: Graph, direction: str) -> str:
    """Edges as (id, labels, payload, a, b): from a to b in reading order; one scan of the edges."""
    forward, backward, undirected = DIRECTIONS[direction]
    columns = "id, labels, payload"
    if not undirected and forward != backward:
        a, b = ("src", "dst") if forward else ("dst", "src")
        return f"(SELECT {columns}, {a} AS a, {b} AS b FROM {graph.edges} WHERE directed)"
    ways = []
    if forward or undirected:
        test = "true" if forward and undirected else "directed" if forward else "NOT directed"
        ways.append(f"named_struct('a', src, 'b', dst, 'ok', {test})")
    if backward or undirected:
        test = "true" if backward and undirected else "directed" if backward else "NOT directed"
        ways.append(f"named_struct('a', dst, 'b', src, 'ok', {test})")
    return f"(SELECT {columns}, w.a, w.b FROM (SELECT {columns}, explode(filter(array({', '.join(ways)}), w -> w.ok)) AS w FROM {graph.edges}))"


def match_sql(c, e: Node, scope) -> tuple[str, list[tuple[str, Val]]]:
    """SQL of a MATCH and its columns: a payload for each name."""
    if e.graph.kind != "id" or (graph := c.session._graph(e.graph.name)) is None:
        raise QueryError("MATCH needs the name of a registered graph")
    alternatives = []
    for combination in itertools.product(*(flattened(p) for p in e.patterns)):
        alternatives.append(_one(c, graph, combination, e.get("where"), scope))
    names = list(dict.fromkeys(n for _, columns in alternatives for n, _ in columns))
    kinds = {n: v.type for _, columns in alternatives for n, v in columns}
    columns = [(n, Val(quote(n), kinds[n])) for n in names]
    if len(alternatives) == 1:
        return alternatives[0][0], columns
    parts = []
    for sql, have in alternatives:
        items = ", ".join(quote(n) if n in dict(have) else f"cast(null as {kinds[n].simpleString()}) AS {quote(n)}" for n in names)
        parts.append(f"(SELECT {items} FROM ({sql}))")
    return " UNION ALL ".join(parts), columns


def _one(c, graph: Graph, paths: tuple[Path, ...], condition: Node | None, scope) -> tuple[str, list[tuple[str, Val]]]:
    from nestq.plans.compiler import Scope, Var

    joins, tests, bound = [], [], {}  # bound: name -> (alias, edge)
    everything: list[tuple[str, int, int, Node | None, list[Element]]] = []
    for path in paths:
        for k, el in enumerate(path.elements):
            el.alias = c.fresh("m")
            kind = graph.edge_payload if el.edge else graph.node_payload
            own = []
            for spec in el.specs:
                if (sql := label_sql(spec.label, el.alias)) is not None:
                    tests.append(sql)
                if spec.name is not None:
                    name = spec.name.name
                    if name in bound:
                        if bound[name][1] != el.edge:
                            raise QueryError(f"{name} names a node and an edge")
                        own.append(f"{el.alias}.id = {bound[name][0]}.id")
                    else:
                        bound[name] = (el.alias, el.edge)
                if spec.where is not None:
                    here = [Var(spec.name.name, spec.name.exact, value=Val(f"{el.alias}.payload", kind))] if spec.name is not None else []
                    tests.append(c.condition(spec.where, Scope(here, scope)))
            if el.edge:
                on = [f"{el.alias}.a = {path.elements[k - 1].alias}.id", *own]
                joins.append(f"JOIN {oriented(graph, el.specs[0].direction)} AS {el.alias} ON {' AND '.join(on)}")
            elif k:
                on = [f"{el.alias}.id = {path.elements[k - 1].alias}.b", *own]
                joins.append(f"JOIN {graph.nodes} AS {el.alias} ON {' AND '.join(on)}")
            else:
                word = "FROM" if not joins else "JOIN" if own else "CROSS JOIN"
                joins.append(f"{word} {graph.nodes} AS {el.alias}{' ON ' + ' AND '.join(own) if own and joins else ''}")
        everything += [(*rule, path.elements) for rule in path.rules]
    variables = [Var(n, False, value=Val(f"{a}.payload", graph.edge_payload if edge else graph.node_payload)) for n, (a, edge) in bound.items()]
    for mode, first, last, where, elements in everything:
        part = elements[first : last + 1]
        if mode == "TRAIL":
            ids = [x.alias for x in part if x.edge]
            tests += [f"{a}.id <> {b}.id" for a, b in itertools.combinations(ids, 2)]
        elif mode in ("ACYCLIC", "SIMPLE"):
            ids = [x.alias for x in part if not x.edge]
            pairs = list(itertools.combinations(ids, 2))
            if mode == "SIMPLE" and len(ids) > 2:
                pairs.remove((ids[0], ids[-1]))
            tests += [f"{a}.id <> {b}.id" for a, b in pairs]
        if where is not None:
            tests.append(c.condition(where, Scope(variables, scope)))
    if condition is not None:
        tests.append(c.condition(condition, Scope(variables, scope)))
    columns = [(v.name, v.value) for v in variables if not isinstance(v.value.type, T.NullType)]
    items = ", ".join(f"{v.sql} AS {quote(n)}" for n, v in columns) or "true AS `_matched`"
    sql = f"SELECT {items} {' '.join(joins)}{' WHERE ' + ' AND '.join(tests) if tests else ''}"
    return sql, [(n, Val(quote(n), v.type)) for n, v in columns] or [("_matched", Val("`_matched`", T.BooleanType()))]
