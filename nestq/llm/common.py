"""What the operators share: reading tables, cutting lineage, Arrow helpers and word splitting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: space and U+0009 to U+000D, which is what bytes.split() uses.
WHITE = b" \t\n\x0b\x0c\r"
#: Rows that a task hands to vectorised code at once are cut so that their arrays stay in cache.
CHUNK_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where that is unset a local session, as in tests, gets a
    folder of its own; on a cluster, whose machines share no such folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="nestq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the cluster owner cleans the folder then
        pass


#: Makes Spark remove the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, files survive executors.

    The files go with ``discard``, or else when Python ends, since any later plan may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nestq-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._nestq_written = (path, atexit.register(_remove, spark, path))
    return made


def discard(*written: DataFrame) -> None:
    """Remove the files of results of ``cut`` that nothing will read again."""
    for df in written:
        _remove(df.sparkSession, df._nestq_written[0])


#: Rows and bytes (of the rows as Spark holds them) that Spark hands to Python at once in ``small_batches``.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Spark sends to Python; smaller settings of the session are kept.

    Spark's own 10,000 rows or 64 MB are allocated outside the heap for every task, and executors that go on
    to other work keep much of that.  The operators slice what they get, so results are the same.  Spark reads
    these settings when a result is computed, hence they stay in the session.
    """
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, read in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, to_bytes)):
        if not 0 < read(spark.conf.get(f"spark.sql.execution.arrow.{name}")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def integer_key(docs: DataFrame, key: str) -> Column:
    """The id column as bigint, for operators that order documents by it."""
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise ValueError(f"{key} must be an integer column, it is {kind.simpleString()}")
    return F.col(f"`{key}`").cast("bigint")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, which by itself can't take columns with dots in their names."""
    names = df.columns
    if not any("." in n for n in names):
        return df.mapInArrow(fn, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.rename_columns(names) for b in batches)

    return df.toDF(*(f"_{i}" for i in range(len(names)))).mapInArrow(named, schema)


def as_texts(column: pa.Array) -> list[str | None]:
    """A string column as Python strings; ill-formed UTF-8 becomes U+FFFD, as everywhere in this package."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode(errors="replace") for x in column.cast(pa.binary()).to_pylist()]


def as_bytes(column: pa.Array, null: bytes = b"") -> list[bytes]:
    """A string column as UTF-8 bytes objects; nulls as ``null``."""
    return [null if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterable[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each, one row at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 8
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterable[pa.RecordBatch], column: int = -1, rows: int = 1024, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``limit`` bytes in one column, one row at
    least, so that what a worker makes of a slice (lists, strings, results) stays small whatever Spark sends."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > limit or i - start >= rows):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += size
        yield b.slice(start)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def null_safe(pairs: list[tuple[Column, Column]]) -> Column:
    """A join condition under which nulls are equal."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in pairs])


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; looks at no more than one row beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows


def restored(cls: type, state: dict):
    """An object of ``cls`` with these attributes.  Broadcasts carry ``vars(object)``, not the object:
    workers may have no copy of this package, and broadcasts are pickled by reference to it."""
    made = cls.__new__(cls)
    made.__dict__.update(state)
    return made
