"""nestq: a query engine for nested, schema-optional data that compiles to Spark DataFrames."""

from nestq.ast import QueryError
from nestq.parser import parse
from nestq.session import Session

__all__ = ["QueryError", "Session", "parse"]
