"""scan_csv: a CSV file with a header, all values strings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def scan_csv(session, path: str) -> DataFrame:
    """Rows of the file; malformed rows have NULL where values lack (permissive) or fail (strict)."""
    reader = session.spark.read.option("header", True).option("inferSchema", False)
    return reader.option("mode", "FAILFAST" if session.strict else "PERMISSIVE").csv(path)
