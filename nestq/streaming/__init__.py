"""Queries over streams.

The language has no windows, watermarks or state.  Its stateless plans (projections, filters, scalar
functions, lateral iteration, joins with static tables) compile to the same Spark SQL whether a table is
static or streaming, so a streaming DataFrame is registered like any other.
"""

from __future__ import annotations

from pyspark.sql.streaming.query import StreamingQuery


def start(session, query: str, path: str, checkpoint: str, format: str = "parquet", **trigger) -> StreamingQuery:
    """Run a query over registered streams continuously, appending its result to files at ``path``."""
    writer = session.sql(query).writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start(path)
