"""Syntax trees: one generic node type, so that printers and walkers need no visitor per kind."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class QueryError(ValueError):
    """A query that can't be parsed, resolved or compiled."""


class Node:
    """A tree node: a kind and named fields, which are read as attributes."""

    __slots__ = ("kind", "fields")

    def __init__(self, kind: str, **fields: Any):
        self.kind, self.fields = kind, fields

    def __getattr__(self, name: str) -> Any:
        try:
            return self.fields[name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.fields.get(name, default)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Node) and self.kind == other.kind and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.fields.items() if v not in (None, [], False))})"

    def children(self) -> Iterator[tuple[str, Node]]:
        for name, value in self.fields.items():
            for v in value if isinstance(value, (list, tuple)) else [value]:
                if isinstance(v, Node):
                    yield name, v
                elif isinstance(v, (list, tuple)):
                    yield from ((name, x) for x in v if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        yield self
        for _, child in self.children():
            yield from child.walk()
