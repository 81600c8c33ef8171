"""The public entry point: a session with its tables, graphs and functions."""

from __future__ import annotations

import re
import uuid
import weakref
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from nestq.ast import Node, QueryError
from nestq.operators.graph import Graph
from nestq.parser import parse
from nestq.plans.compiler import Compiler
from nestq.plans.values import Val, quote
from nestq.sources.delimited import scan_csv
from nestq.sources.ion import read_ion, scan_ion


def _drop_views(spark: SparkSession, names: list[str]) -> None:
    """A query that was analysed no longer needs the views that it reads."""
    while names:
        name = names.pop()
        try:
            spark.catalog.dropTempView(name)
        except Exception:  # the Spark session has ended, and its views with it
            return


#: What Spark says of a job that data did not end: a cancelled one, a lost executor, a full memory or disk.
_UNFINISHED = re.compile("ExecutorLost|OutOfMemory|MemoryError|Python worker exited|python worker.*crash|FetchFailed|No space left|cancelled|SparkContext was shut down|SparkContext.*stopped|maxResultSize|exceeds.*memory", re.IGNORECASE)


def _unfinished(error: Exception) -> bool:
    """Whether a table function was stopped in the middle of good data, which an empty table must not hide."""
    return isinstance(error, MemoryError) or (isinstance(error, Py4JError | PySparkException) and bool(_UNFINISHED.search(str(error))))


class Session:
    """Runs queries over registered tables.

    ``mode`` is "permissive" (static and run-time type errors give NULL) or "strict" (they are errors).
    ``compat`` is "sql" or "reference": the latter follows the language's original evaluator where it
    departs from SQL (limit before distinct, empty global aggregates, byte positions, decimal averages).
    """

    def __init__(self, spark: SparkSession, mode: str = "permissive", compat: str = "sql", context: dict[str, Any] | None = None):
        if mode not in ("permissive", "strict") or compat not in ("sql", "reference"):
            raise QueryError("mode is permissive or strict, compat is sql or reference")
        self.spark, self.strict, self.compat, self.context = spark, mode == "strict", compat, dict(context or {})
        self.errors: list[str] = []
        self._tables: dict[str, Any] = {}
        self._graphs: dict[str, Graph] = {}
        self._scalars: dict[str, Callable] = {}
        self._table_functions: dict[str, Callable] = {"SCAN_CSV": scan_csv, "READ_ION": read_ion, "SCAN_ION": scan_ion}
        self._types: dict[str, T.DataType] = {}
        self._views: list[str] = []  # of tables and graphs, until the session ends
        self._passing: list[str] = []  # of table functions, until their query is analysed
        self._finalizer = weakref.finalize(self, _drop_views, spark, self._views)

    # --- registration ------------------------------------------------------------------------------
    def register(self, name: str, source: DataFrame | Callable[[], DataFrame]) -> Session:
        """A table by name (dots allowed); a callable is only called when a query uses the table."""
        self._tables[name] = source
        return self

    def register_directory(self, path: str, names: list[str]) -> Session:
        """Parquet tables ``path/<name>.parquet``."""
        for n in names:
            self.register(n, lambda n=n: self.spark.read.parquet(f"{path}/{n}.parquet"))
        return self

    def register_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> Session:
        """nodes: id, labels array<string>, payload; edges: id, src, dst, directed, labels, payload."""
        for df, columns in ((nodes, ("id", "labels", "payload")), (edges, ("id", "src", "dst", "directed", "labels", "payload"))):
            if missing := set(columns) - set(df.columns):
                raise QueryError(f"a graph's relation lacks {', '.join(sorted(missing))}")
        self._graphs[name.lower()] = Graph(self._view(nodes), self._view(edges), nodes.schema["payload"].dataType, edges.schema["payload"].dataType)
        return self

    def register_function(self, name: str, returns: T.DataType | str, sql: str | None = None, udf: Callable | None = None) -> Session:
        """A scalar function: a SQL template over {0}, {1}, ..., or a (pandas) UDF registered with Spark."""
        kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns
        if udf is not None:
            known = f"nestq_{uuid.uuid4().hex}"
            self.spark.udf.register(known, udf) if hasattr(udf, "returnType") else self.spark.udf.register(known, udf, kind)
            self._scalars[name.upper()] = lambda c, *args: Val(f"{known}({', '.join(a.sql for a in args)})", kind)
        elif sql is not None:
            self._scalars[name.upper()] = lambda c, *args: Val(sql.format(*(a.sql for a in args)), kind)
        else:
            raise QueryError("a function needs sql or udf")
        return self

    def register_table_function(self, name: str, function: Callable[..., DataFrame]) -> Session:
        """A function of the session and literal arguments that returns a DataFrame."""
        self._table_functions[name.upper()] = function
        return self

    def register_type(self, name: str, kind: T.DataType) -> Session:
        self._types[name] = kind
        return self

    def load(self, extension: Any) -> Session:
        """An object with load(session)."""
        extension.load(self)
        return self

    # --- queries -----------------------------------------------------------------------------------
    def parse(self, text: str) -> Node:
        return parse(text)

    def compile(self, query: str | Node, sets: bool = False):
        """The compiled query: Spark SQL and result columns."""
        return Compiler(self, self.strict, self.compat, sets).query(parse(query) if isinstance(query, str) else query)

    def sql(self, query: str | Node) -> DataFrame:
        """The result as a DataFrame; a query of tuples has their attributes as columns, one of other
        values the column _1."""
        rel = self.compile(query)
        try:
            try:
                df = self.spark.sql(rel.sql)
            except AnalysisException as error:
                if "IN_EXISTS_SUBQUERY" not in (error.getCondition() or ""):
                    raise
                rel = self.compile(query, sets=True)
                df = self.spark.sql(rel.sql)
        finally:
            _drop_views(self.spark, self._passing)
        if rel.scalar and isinstance(df.schema[0].dataType, T.StructType) and len(df.columns) == 1 and df.schema[0].dataType.fields:
            df = df.select(f"{df.columns[0]}.*")
        return df

    def close(self) -> None:
        """Drop the views of the session's tables; results made so far stay usable."""
        self._finalizer()
        self._tables = {n: t for n, t in self._tables.items() if not isinstance(t, tuple)}

    # --- what the compiler asks --------------------------------------------------------------------
    def _view(self, df: DataFrame, passing: bool = False) -> str:
        name = f"nestq_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        (self._passing if passing else self._views).append(name)
        return name

    def _table(self, name: str, exact: bool):
        found = name if name in self._tables else None if exact else next((n for n in self._tables if n.lower() == name.lower()), None)
        if found is None:
            return None
        entry = self._tables[found]
        if not isinstance(entry, tuple):
            df = entry() if not isinstance(entry, DataFrame) else entry
            entry = self._tables[found] = (self._view(df), [(f.name, Val(quote(f.name), f.dataType)) for f in df.schema.fields], False)
        return entry

    def _qualified(self, path: Node):
        if path.root.kind != "id" or any(s.kind != "step_key" for s in path.steps):
            return None
        return self._table(".".join([path.root.name, *(s.id.name for s in path.steps)]), False)

    def _graph(self, name: str) -> Graph | None:
        return self._graphs.get(name.lower())

    def _scalar_function(self, name: str) -> Callable | None:
        return self._scalars.get(name.upper())

    def _table_function(self, name: str) -> Callable | None:
        return self._table_functions.get(name.upper())

    def _call_table_function(self, name: str, args: list, named: dict):
        try:
            df = self._table_function(name)(self, *args, **named)
            columns = [(f.name, Val(quote(f.name), f.dataType)) for f in df.schema.fields]
        except QueryError:
            raise
        except Exception as error:
            if self.strict:
                raise QueryError(f"{name}: {error}") from error
            if _unfinished(error):
                raise
            self.errors.append(f"{name}: {error}")
            df = self.spark.createDataFrame([], "_1 string")
            columns = [("_1", Val("`_1`", T.StringType()))]
        return self._view(df, passing=True), columns


__all__ = ["Column", "Session"]
