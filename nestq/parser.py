"""Recursive-descent parser: text to syntax tree."""

from __future__ import annotations

from decimal import Decimal

from nestq.ast import Node, QueryError
from nestq.lexer import Token, tokens

#: Words that end an expression or an implicit alias.
RESERVED = set(
    """ALL AND ANTI AS ASC AT BETWEEN BY CASE CROSS DESC DISTINCT ELSE END ESCAPE EXCEPT EXCLUDE FIRST FROM FULL GROUP HAVING IN INNER
    INTERSECT IS JOIN LAST LATERAL LEFT LET LIKE LIMIT MATCH NATURAL NOT NULLS OFFSET ON OR ORDER OUTER PIVOT PRESERVE RIGHT SELECT THEN
    UNION UNPIVOT USING VALUE VALUES WHEN WHERE WITH COLUMNS KEEP""".split()
)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "ANY", "SOME", "EVERY"}
COLLECTION_AGGREGATES = {f"COLL_{a}" for a in AGGREGATES}
TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "INT8": "bigint", "BIGINT": "bigint", "INT4": "int", "SMALLINT": "smallint", "INT2": "smallint", "TINYINT": "tinyint",
    "REAL": "float", "FLOAT": "double", "DOUBLE": "double", "DECIMAL": "decimal", "DEC": "decimal", "NUMERIC": "decimal", "BOOL": "boolean", "BOOLEAN": "boolean",
    "STRING": "string", "VARCHAR": "string", "CHAR": "string", "CHARACTER": "string", "SYMBOL": "string", "CLOB": "string", "BLOB": "binary", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIME": "time", "TUPLE": "tuple", "STRUCT": "tuple", "LIST": "list", "ARRAY": "list", "BAG": "bag", "SEXP": "list", "ANY": "any", "NULL": "null", "MISSING": "missing",
}
COMPARISONS = {"=", "<>", "!=", "<", "<=", ">", ">="}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    # --- helpers -----------------------------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def is_word(self, *words: str, n: int = 0) -> bool:
        t = self.ahead(n)
        return t.kind == "word" and t.text.upper() in words

    def is_op(self, *ops: str, n: int = 0) -> bool:
        t = self.ahead(n)
        return t.kind == "op" and t.text in ops

    def take(self, *words: str) -> str | None:
        """The next token's text in upper case, if it is one of these words or operators."""
        if self.is_word(*words) or self.is_op(*words):
            self.at += 1
            return self.tokens[self.at - 1].text.upper()
        return None

    def need(self, *words: str) -> str:
        found = self.take(*words)
        if found is None:
            raise self.error(f"expected {' or '.join(words)}")
        return found

    def error(self, what: str) -> QueryError:
        t = self.now
        return QueryError(f"{what}, found {t.text!r} at {t.at}" if t.kind != "end" else f"{what}, found the end of the query")

    def name(self) -> Node:
        t = self.now
        if t.kind == "quoted":
            self.at += 1
            return Node("id", name=t.text, exact=True, local=False)
        if t.kind == "word" and t.text.upper() not in RESERVED:
            self.at += 1
            return Node("id", name=t.text.lstrip("@"), exact=False, local=t.text.startswith("@"))
        raise self.error("expected a name")

    def listed(self, item, close: str) -> list:
        found = []
        if not self.is_op(close):
            found.append(item())
            while self.take(","):
                found.append(item())
        self.need(close)
        return found

    def separated(self, item) -> list:
        found = [item()]
        while self.take(","):
            found.append(item())
        return found

    # --- queries -----------------------------------------------------------------------------------
    def statement(self) -> Node:
        found = self.query()
        self.take(";")
        if self.now.kind != "end":
            raise self.error("expected the end of the query")
        return found

    def query(self) -> Node:
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = bool(self.take("RECURSIVE"))
            ctes = self.separated(self.cte)
        body = self.set_operation()
        order, limit, offset = self.tail()
        if order or limit or offset:
            if body.kind == "select" and not (body.order or body.limit or body.offset):
                body.fields.update(order=order, limit=limit, offset=offset)
            else:
                body = Node("ordered", body=body, order=order, limit=limit, offset=offset)
        return Node("with", ctes=ctes, recursive=recursive, body=body) if ctes else body

    def cte(self) -> Node:
        name = self.name()
        columns = self.listed(self.name, ")") if self.take("(") else []
        self.need("AS")
        self.need("(")
        body = self.query()
        self.need(")")
        return Node("cte", name=name, columns=columns, body=body)

    def tail(self) -> tuple[list, Node | None, Node | None]:
        order, limit, offset = [], None, None
        if self.is_word("ORDER"):
            self.need("ORDER")
            self.need("BY")
            order = self.separated(self.sort_key)
        while True:
            if self.take("LIMIT"):
                limit = self.expression()
            elif self.take("OFFSET"):
                offset = self.expression()
            else:
                return order, limit, offset

    def sort_key(self) -> Node:
        e = self.expression()
        descending = self.take("ASC", "DESC") == "DESC"
        nulls = self.need("FIRST", "LAST") if self.take("NULLS") else ("FIRST" if descending else "LAST")
        return Node("sort_key", e=e, descending=descending, nulls=nulls)

    def set_operation(self) -> Node:
        left = self.term()
        while self.is_word("UNION", "INTERSECT", "EXCEPT") or (self.is_word("OUTER") and self.is_word("UNION", "INTERSECT", "EXCEPT", n=1)):
            outer = bool(self.take("OUTER"))
            op = self.need("UNION", "INTERSECT", "EXCEPT")
            quantifier = self.take("ALL", "DISTINCT") or "DISTINCT"
            left = Node("set", op=op, all=quantifier == "ALL", outer=outer, left=left, right=self.term())
        return left

    def term(self) -> Node:
        if self.is_word("SELECT", "PIVOT", "FROM"):
            return self.select()
        if self.take("VALUES"):
            return Node("values", rows=self.separated(self.row))
        if self.is_word("TABLE") and self.ahead().kind in ("word", "quoted"):
            self.at += 1
            return Node("table", name=self.name())
        if self.is_op("(") and self.starts_query(1):
            self.need("(")
            inner = self.query()
            self.need(")")
            # what follows may make it an operand of an expression
            return self.expression(Node("subquery", query=inner)) if self.continues() else inner
        return Node("expression", e=self.expression())

    def starts_query(self, n: int) -> bool:
        while self.is_op("(", n=n):
            n += 1
        return self.is_word("SELECT", "PIVOT", "FROM", "WITH", n=n) or (self.is_word("VALUES", n=n)) or (self.is_word("TABLE", n=n) and self.ahead(n + 1).kind in ("word", "quoted"))

    def continues(self) -> bool:
        return self.is_op("+", "-", "*", "/", "%", "^", "||", ".", "[", *COMPARISONS) or self.is_word("IS", "IN", "LIKE", "BETWEEN", "AND", "OR")

    def row(self) -> Node:
        self.need("(")
        return Node("list", items=self.listed(self.expression, ")"))

    def select(self) -> Node:
        fields: dict = {"distinct": False, "items": [], "value": None, "star": False, "pivot": None, "exclude": [], "from_": None, "let": [], "where": None, "group": None, "having": None, "order": [], "limit": None, "offset": None}
        first = self.is_word("FROM")
        if first:
            self.from_clauses(fields)
        if self.take("PIVOT"):
            value = self.expression()
            self.need("AT")
            fields["pivot"] = (value, self.expression())
        else:
            self.need("SELECT")
            fields["distinct"] = self.take("ALL", "DISTINCT") == "DISTINCT"
            if self.take("VALUE"):
                fields["value"] = self.expression()
            elif self.take("*"):
                fields["star"] = True
            else:
                fields["items"] = self.separated(self.item)
        if self.take("EXCLUDE"):
            fields["exclude"] = self.separated(self.excluded)
        if not first and self.is_word("FROM"):
            self.from_clauses(fields)
        return Node("select", **fields)

    def item(self) -> Node:
        e = self.expression()
        if self.is_op(".") and self.is_op("*", n=1):
            self.at += 2
            return Node("item_star", e=e)
        return Node("item", e=e, alias=self.alias())

    def alias(self) -> Node | None:
        if self.take("AS"):
            return self.name()
        return self.name() if self.now.kind == "quoted" or (self.now.kind == "word" and self.now.text.upper() not in RESERVED) else None

    def excluded(self) -> Node:
        root, steps = self.name(), []
        while True:
            if self.take("."):
                steps.append("*" if self.take("*") else self.name())
            elif self.take("["):
                steps.append("[*]" if self.take("*") else int(self.now.text) if self.now.kind == "int" else Node("id", name=self.now.text, exact=True, local=False))
                if steps[-1] != "[*]":
                    self.at += 1
                self.need("]")
            else:
                return Node("excluded", root=root, steps=steps)

    def from_clauses(self, fields: dict) -> None:
        self.need("FROM")
        fields["from_"] = self.from_list()
        if self.take("LET"):
            fields["let"] = self.separated(lambda: Node("let", e=self.expression(), alias=(self.need("AS"), self.name())[1]))
        if self.take("WHERE"):
            fields["where"] = self.expression()
        if self.take("GROUP"):
            partial = bool(self.take("PARTIAL"))
            self.need("BY")
            keys = self.separated(lambda: Node("key", e=self.expression(), alias=self.name() if self.take("AS") else None))
            group_as = None
            if self.is_word("GROUP") and self.is_word("AS", n=1):
                self.at += 2
                group_as = self.name()
            fields["group"] = Node("group", keys=keys, group_as=group_as, partial=partial)
        if self.take("HAVING"):
            fields["having"] = self.expression()
        order, limit, offset = self.tail()
        fields.update(order=order, limit=limit, offset=offset)

    def from_list(self) -> Node:
        left = self.joined()
        while self.take(","):
            left = Node("join", type="CROSS", left=left, right=self.joined(), on=None, using=[])
        return left

    def joined(self) -> Node:
        left = self.from_item()
        while True:
            natural = bool(self.take("NATURAL"))
            kind = None
            if self.is_word("CROSS", "INNER", "LEFT", "RIGHT", "FULL"):
                kind = self.need("CROSS", "INNER", "LEFT", "RIGHT", "FULL")
                self.take("OUTER")
                self.take("CROSS")
            if not self.is_word("JOIN"):
                if kind or natural:
                    raise self.error("expected JOIN")
                return left
            self.need("JOIN")
            self.take("LATERAL")
            right = self.from_item()
            on, using = None, []
            if self.take("ON"):
                on = self.expression()
            elif self.take("USING"):
                self.need("(")
                using = self.listed(self.name, ")")
            left = Node("join", type="NATURAL " + (kind or "INNER") if natural else kind or "INNER", left=left, right=right, on=on, using=using)

    def from_item(self) -> Node:
        self.take("LATERAL")
        if self.take("UNPIVOT"):
            e, value, key = self.expression(), None, None
            while self.is_word("AS", "AT"):
                if self.take("AS"):
                    value = self.name()
                else:
                    self.need("AT")
                    key = self.name()
            return Node("unpivot", e=e, value=value, key=key)
        if self.is_word("GRAPH_TABLE") and self.is_op("(", n=1):
            self.at += 2
            graph = self.name()
            graph = Node("id", name=graph.name, exact=graph.exact, local=False)
            found = Node("match", graph=graph, **self.match())
            self.need(")")
            return Node("scan", e=found, alias=self.alias(), at=None, by=None)
        if self.is_op("(") and not self.starts_query(1):
            saved = self.at
            try:
                e = self.expression()
            except QueryError:
                self.at = saved
                self.need("(")
                inner = self.from_list()
                self.need(")")
                return inner
        else:
            e = self.expression()
        alias = self.alias()
        at = by = None
        if self.take("AT"):
            at = self.name()
        if self.take("BY"):
            by = self.name()
        return Node("scan", e=e, alias=alias, at=at, by=by)

    # --- expressions -------------------------------------------------------------------------------
    def expression(self, left: Node | None = None) -> Node:
        left = self.conjunction(left)
        while self.take("OR"):
            left = Node("binary", op="OR", left=left, right=self.conjunction())
        return left

    def conjunction(self, left: Node | None = None) -> Node:
        left = self.negation(left)
        while self.take("AND"):
            left = Node("binary", op="AND", left=left, right=self.negation())
        return left

    def negation(self, left: Node | None = None) -> Node:
        if left is None and self.take("NOT"):
            return Node("not", e=self.negation())
        return self.predicate(left)

    def predicate(self, left: Node | None = None) -> Node:
        left = self.additive(left)
        while True:
            if self.now.kind == "op" and self.now.text in COMPARISONS:
                op = self.need(*COMPARISONS)
                left = Node("binary", op="<>" if op == "!=" else op, left=left, right=self.additive())
                continue
            if self.take("IS"):
                negated = bool(self.take("NOT"))
                t = self.now.text.upper()
                if t not in TYPES:
                    raise self.error("expected a type")
                self.at += 1
                left = Node("is", e=left, type=t, negated=negated)
                continue
            negated = self.is_word("NOT") and self.is_word("IN", "LIKE", "BETWEEN", n=1)
            if negated:
                self.at += 1
            if self.take("BETWEEN"):
                low = self.additive()
                self.need("AND")
                left = Node("between", e=left, low=low, high=self.additive(), negated=negated)
            elif self.take("LIKE"):
                pattern = self.additive()
                left = Node("like", e=left, pattern=pattern, escape=self.additive() if self.take("ESCAPE") else None, negated=negated)
            elif self.take("IN"):
                left = Node("in", e=left, within=self.within(), negated=negated)
            else:
                return left

    def within(self) -> Node:
        if self.is_op("(") and not self.starts_query(1):
            self.need("(")
            return Node("list", items=self.listed(self.expression, ")"))
        return self.additive()

    def additive(self, left: Node | None = None) -> Node:
        left = self.multiplicative(left)
        while self.is_op("+", "-", "||"):
            left = Node("binary", op=self.need("+", "-", "||"), left=left, right=self.multiplicative())
        return left

    def multiplicative(self, left: Node | None = None) -> Node:
        left = self.power(left)
        while self.is_op("*", "/", "%") and not (self.is_op("*") and self.is_op("]", n=1)):
            left = Node("binary", op=self.need("*", "/", "%"), left=left, right=self.power())
        return left

    def power(self, left: Node | None = None) -> Node:
        left = self.unary() if left is None else self.path(left)
        if self.take("^"):
            return Node("binary", op="^", left=left, right=self.power())
        return left

    def unary(self) -> Node:
        if op := self.take("+", "-"):
            e = self.unary()
            return Node("unary", op=op, e=e)
        return self.path(self.primary())

    def path(self, root: Node) -> Node:
        steps = []
        while True:
            if self.is_op(".") and self.is_op("*", n=1):
                # t.* as a select item ends here; a further step makes it a path
                if not self.is_op(".", "[", n=2):
                    break
                self.at += 2
                steps.append(Node("step_star"))
            elif self.take("."):
                steps.append(Node("step_key", id=self.name() if self.now.kind == "quoted" else self.any_word()))
            elif self.take("["):
                if self.take("*"):
                    steps.append(Node("step_all"))
                else:
                    steps.append(Node("step_index", e=self.expression()))
                self.need("]")
            else:
                break
        return Node("path", root=root, steps=steps) if steps else root

    def any_word(self) -> Node:
        if self.now.kind != "word":
            raise self.error("expected a name")
        self.at += 1
        return Node("id", name=self.tokens[self.at - 1].text, exact=False, local=False)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "int":
            self.at += 1
            return Node("literal", value=int(t.text))
        if t.kind == "decimal":
            self.at += 1
            return Node("literal", value=Decimal(t.text))
        if t.kind == "real":
            self.at += 1
            return Node("literal", value=float(t.text))
        if t.kind == "string":
            self.at += 1
            return Node("literal", value=t.text)
        if t.kind == "bits":
            self.at += 1
            digits = t.text[2:-1]
            return Node("literal", value=bytes.fromhex(digits) if t.text[0] in "xX" else int(digits or "0", 2).to_bytes((len(digits) + 7) // 8, "big"))
        if t.kind == "ion":
            self.at += 1
            return Node("ion", text=t.text)
        if self.is_op("?"):
            raise self.error("parameters are not supported")
        if self.take("("):
            if self.at >= 1 and self.is_word("SELECT", "PIVOT", "FROM", "WITH", "VALUES", "TABLE") or (self.is_op("(") and self.starts_query(0)):
                inner = self.query()
                self.need(")")
                return Node("subquery", query=inner)
            e = self.expression()
            if self.is_word("MATCH"):
                found = Node("match", graph=e, **self.match())
                self.need(")")
                return found
            if self.is_op(","):
                self.need(",")
                return Node("list", items=[e, *self.listed(self.expression, ")")])
            if self.is_word("UNION", "INTERSECT", "EXCEPT", "OUTER"):
                raise self.error("put set operands in parentheses")
            self.need(")")
            return e
        if self.take("["):
            return Node("list", items=self.listed(self.expression, "]"))
        if self.take("<<"):
            return Node("bag", items=self.listed(self.expression, ">>"))
        if self.take("{"):
            return Node("tuple", pairs=self.listed(lambda: (self.expression(), (self.need(":"), self.expression())[1]), "}"))
        if t.kind == "quoted":
            return self.name()
        if t.kind != "word":
            raise self.error("expected an expression")
        word = t.text.upper()
        if word in ("NULL", "MISSING", "TRUE", "FALSE"):
            self.at += 1
            return Node("literal", value=None, missing=True) if word == "MISSING" else Node("literal", value={"NULL": None, "TRUE": True, "FALSE": False}[word])
        if word == "CASE":
            return self.case()
        if word in ("DATE", "TIMESTAMP", "TIME") and self.ahead().kind == "string":
            self.at += 2
            return Node("temporal", type=word, text=self.tokens[self.at - 1].text)
        if word == "VALUES":
            self.at += 1
            return Node("subquery", query=Node("values", rows=self.separated(self.row)))
        if self.is_op("(", n=1) and (word not in RESERVED or word in ("LEFT", "RIGHT")):
            self.at += 2
            return self.call(word)
        return self.name()

    def case(self) -> Node:
        self.need("CASE")
        subject = None if self.is_word("WHEN") else self.expression()
        whens = []
        while self.take("WHEN"):
            c = self.expression()
            self.need("THEN")
            whens.append((c, self.expression()))
        other = self.expression() if self.take("ELSE") else None
        self.need("END")
        return Node("case", subject=subject, whens=whens, other=other)

    def type(self) -> Node:
        word = self.now.text.upper()
        if word not in TYPES:
            raise self.error("expected a type")
        self.at += 1
        arguments = []
        self.take("PRECISION", "VARYING")
        if self.take("("):
            arguments = [int(x.value) for x in self.listed(self.primary, ")")]
        return Node("type", name=word, arguments=arguments)

    def call(self, name: str) -> Node:
        if name == "EXISTS":
            return Node("exists", e=self.closing(self.argument()))
        if name == "CAST":
            e = self.expression()
            self.need("AS")
            return Node("cast", e=e, type=self.closing(self.type()))
        if name == "EXTRACT":
            part = self.any_word().name.upper()
            self.need("FROM")
            return Node("call", name="EXTRACT", args=[Node("literal", value=part), self.closing(self.expression())])
        if name == "TRIM":
            side = self.take("LEADING", "TRAILING", "BOTH") or "BOTH"
            chars = None if self.is_word("FROM") else self.expression()
            if self.take("FROM"):
                return Node("trim", side=side, chars=chars, e=self.closing(self.expression()))
            return Node("trim", side=side, chars=None, e=self.closing(chars))
        if name == "POSITION":
            x = self.additive()
            if self.take("IN") or self.take(","):
                return Node("call", name="POSITION", args=[x, self.closing(self.expression())])
        if name == "SUBSTRING":
            args = [self.expression()]
            if self.take("FROM"):
                args.append(self.expression())
                if self.take("FOR"):
                    args.append(self.expression())
            elif self.take("FOR"):
                args += [None, self.expression()]
            else:
                while self.take(","):
                    args.append(self.expression())
            return Node("call", name="SUBSTRING", args=self.closing(args))
        if name == "OVERLAY":
            args = [self.expression()]
            for word in ("PLACING", "FROM", "FOR"):
                if self.take(word) or self.take(","):
                    args.append(self.expression())
            return Node("call", name="OVERLAY", args=self.closing(args))
        if name in AGGREGATES | COLLECTION_AGGREGATES:
            if name == "COUNT" and self.take("*"):
                return Node("aggregate", name="COUNT", e=None, distinct=False) if self.need(")") else None
            distinct = self.take("ALL", "DISTINCT") == "DISTINCT"
            e = self.closing(self.argument())
            return Node("aggregate" if name in AGGREGATES else "coll", name=name.removeprefix("COLL_"), e=e, distinct=distinct)
        args, named = [], {}
        if not self.is_op(")"):
            while True:
                if self.now.kind == "word" and self.is_op(":", n=1):
                    key = self.any_word().name
                    self.need(":")
                    named[key] = self.expression()
                else:
                    args.append(self.argument())
                if not self.take(","):
                    break
        return Node("call", name=name, args=self.closing(args), named=named)

    def argument(self) -> Node:
        if self.is_word("SELECT", "PIVOT", "FROM", "WITH"):
            return Node("subquery", query=self.query())
        return self.expression()

    def closing(self, found):
        self.need(")")
        return found

    # --- graph patterns ----------------------------------------------------------------------------
    def match(self) -> dict:
        self.need("MATCH")
        patterns = self.separated(self.graph_path)
        where = self.expression() if self.take("WHERE") else None
        return {"patterns": patterns, "where": where}

    def graph_path(self) -> Node:
        mode = self.take("WALK", "TRAIL", "ACYCLIC", "SIMPLE") or "WALK"
        self.take("PATH", "PATHS")
        elements, where = self.graph_elements(")", "]", ","), None
        return Node("gpath", mode=mode, elements=elements, where=where)

    def graph_elements(self, *stops: str) -> list[Node]:
        found = []
        while not self.is_op(*stops) and not self.is_word("WHERE") and self.now.kind != "end":
            if self.is_op("(") or self.is_op("["):
                if self.is_op("(") and not self.is_subpath():
                    found.append(self.graph_node())
                else:
                    close = ")" if self.take("(") else (self.need("["), "]")[1]
                    mode = self.take("WALK", "TRAIL", "ACYCLIC", "SIMPLE") or "WALK"
                    inner = self.graph_elements(close)
                    where = self.expression() if self.take("WHERE") else None
                    self.need(close)
                    found.append(Node("gpath", mode=mode, elements=inner, where=where, quantifier=self.quantifier()))
            else:
                found.append(self.graph_edge())
        if not found:
            raise self.error("expected a graph pattern")
        return found

    def is_subpath(self) -> bool:
        return self.is_op("(", "[", "-", "<", "~", n=1) or self.is_word("WALK", "TRAIL", "ACYCLIC", "SIMPLE", n=1) and self.is_op("(", n=2)

    def element(self, close: str) -> dict:
        name = label = where = None
        if self.now.kind == "quoted" or (self.now.kind == "word" and not self.is_word("WHERE")):
            name = self.name()
        if self.take(":"):
            label = self.label()
        if self.take("WHERE"):
            where = self.expression()
        self.need(close)
        return {"name": name, "label": label, "where": where}

    def graph_node(self) -> Node:
        self.need("(")
        return Node("gnode", **self.element(")"))

    def graph_edge(self) -> Node:
        left = ""
        if self.take("<"):
            left = "<"
        dash = self.need("-", "~")
        spec = self.element("]") if self.take("[") else None
        right = ""
        if spec is not None:
            if self.need("-", "~") != dash:
                raise self.error("an edge must begin and end alike")
        if self.take(">"):
            right = ">"
        elif spec is None and dash == "-" and not left and self.is_op("-") and not self.is_op(">", n=1):
            self.need("-")
        direction = left + dash + right
        return Node("gedge", direction=direction, quantifier=self.quantifier(), **(spec or {"name": None, "label": None, "where": None}))

    def quantifier(self) -> tuple[int, int | None] | None:
        if self.take("*"):
            return (0, None)
        if self.take("+"):
            return (1, None)
        if self.take("?"):
            return (0, 1)
        if self.take("{"):
            low = 0
            if self.now.kind == "int":
                low = int(self.now.text)
                self.at += 1
            high: int | None = low
            if self.take(","):
                high = None
                if self.now.kind == "int":
                    high = int(self.now.text)
                    self.at += 1
            self.need("}")
            return (low, high)
        return None

    def label(self) -> Node:
        left = self.label_and()
        while self.take("|"):
            left = Node("label_or", left=left, right=self.label_and())
        return left

    def label_and(self) -> Node:
        left = self.label_not()
        while self.take("&"):
            left = Node("label_and", left=left, right=self.label_not())
        return left

    def label_not(self) -> Node:
        if self.take("!"):
            return Node("label_not", e=self.label_not())
        if self.take("%"):
            return Node("label_any")
        if self.take("("):
            return self.closing(self.label())
        return Node("label_name", id=self.name() if self.now.kind == "quoted" else self.any_word())


def parse(text: str) -> Node:
    """The syntax tree of a query; raises QueryError."""
    return Parser(text).statement()
