"""Removal of lines that many documents share.

A line's key is its text without white space at both ends and with A-Z in lower case; keys are told
apart by a 128-bit hash.  (key, document, position) rows are range-partitioned on key and document and
sorted by key, document and position.  Each partition is then streamed once: equal keys are adjacent,
distinct documents are counted on the way, and a key is decided as soon as its run reaches the limit,
so no more than ``min_docs`` documents of one key are held.  A key with a third of all lines spans
many partitions: the first and the last run of a partition, which may go on next door, also report
their counts, two rows per partition, and only their undecided rows wait for the sum.

The result is, per document with dropped lines, a zlib-compressed bitmap of the lines to keep, one
bit per line (lines beyond its end are kept).  ``dedup_lines`` applies the bitmaps.

Two rules: ``drop_all`` drops every line whose key is in ``min_docs`` documents or more; with
``keep_first`` the key's first line (smallest document, then position) stays.

Null and empty texts are one empty line.  Keys below ``min_chars`` code points are never dropped.
Rows that repeat id and text are one document (they share its bitmap); a null id is an id of its own,
before all others.  Ids must be integers.  Of lines that tie on document and position (repeated rows) all are
one line.  A text of any length is split line by line in its worker, which holds it once.  Ill-formed UTF-8
becomes U+FFFD in the text that stays.  An empty table gives an empty result.  Other columns pass through,
but for n_lines and n_dropped, which are replaced; internal names start with ``_ld_``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import WHITE, arrow_map, as_bytes, batch, cut, integer_key, null_safe, sliced, table

MIN_DOCS = 10
MIN_CHARS = 1
DROP, OPEN, RUN = 0, 1, 2
LINES = pa.schema([("_ld_h1", pa.int64()), ("_ld_h2", pa.int64()), ("_ld_id", pa.int64()), ("_ld_text_hash", pa.int64()), ("_ld_pos", pa.int32())])
MARKS = pa.schema([("_ld_kind", pa.int32()), *LINES, ("_ld_docs", pa.int64()), ("_ld_first", pa.bool_())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "bool": "boolean", "binary": "binary"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with _ld_id and _ld_text_hash, which tell documents apart."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn("_ld_id", integer_key(docs, key)).withColumn("_ld_text_hash", F.xxhash64(whole))


def line_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """A row for each line long enough: key hashes, document, position."""
    rows = docs.select("_ld_id", "_ld_text_hash", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_ld_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in sliced(batches):
            ids, hashes, texts = b.column(0), b.column(1), as_bytes(b.column(2))
            found, row, position = [], [], []
            for i, data in enumerate(texts):
                for n, line in enumerate(data.split(b"\n")):
                    line = line.strip(WHITE).lower()
                    if len(line) >= min_chars and (min_chars <= 1 or len(line.decode(errors="replace")) >= min_chars):
                        found.append(digest(line))
                        row.append(i)
                        position.append(n)
            h = np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, type=pa.int64())
            yield batch(LINES, pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(at), hashes.take(at), pa.array(position, type=pa.int32()))

    return arrow_map(rows, run, _ddl(LINES))


class _Run:
    """A run of one key that the batch's end has cut."""

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first, self.docs, self.last, self.rows, self.started = key, first, 0, None, [], False


def streamed(min_docs: int, keep_first: bool):
    """The function that streams a sorted partition and marks lines; see the module."""

    def marks(kind: int, rows: np.ndarray, missing: np.ndarray, docs: int = 0, first: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rows)
        ids = pa.array(rows[:, 2], mask=missing)
        return batch(MARKS, pa.array(np.full(n, kind, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), ids, pa.array(rows[:, 3]), pa.array(rows[:, 4].astype(np.int32)), pa.array(np.full(n, docs, np.int64)), pa.array(np.zeros(n, bool) if first is None else first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Run | None = None

        def close(r: _Run, last: bool) -> Iterator[pa.RecordBatch]:
            """The end of a run that was cut: rows still held are open if the run may go on elsewhere."""
            if r.first or last:
                key = np.array([[*r.key, 0, 0, 0]], dtype=np.int64)
                yield marks(RUN, key, np.zeros(1, bool), r.docs)
                for rows, missing, lead in r.rows:
                    yield marks(OPEN, rows, missing, r.docs, lead)

        for b in batches:
            if not b.num_rows:
                continue
            missing = b.column(2).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), ids, b.column(3).to_numpy(), b.column(4).to_numpy().astype(np.int64)], axis=1)
            same_key = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
            same_doc = same_key & (rows[1:, 2:4] == rows[:-1, 2:4]).all(axis=1) & (missing[1:] == missing[:-1])
            new_doc = np.concatenate([[True], ~same_doc])
            starts = np.concatenate([[0], np.flatnonzero(~same_key) + 1, [len(rows)]])
            first_run, last_run = current is None, len(starts) - 2
            counts = np.add.reduceat(new_doc, starts[:-1].astype(np.intp)).astype(np.int64)
            # Runs inside the batch: decided at once.
            if last_run > 1:
                full = np.zeros(last_run + 1, bool)
                full[1:last_run] = counts[1:last_run] >= min_docs
                chosen = np.repeat(full, np.diff(starts))
                if keep_first:
                    chosen[starts[:-1]] = False
                if chosen.any():
                    yield marks(DROP, rows[chosen], missing[chosen])
            # The first and the last: they may go on.
            for k in {0, last_run}:
                start, end = starts[k], starts[k + 1]
                key = (int(rows[start, 0]), int(rows[start, 1]))
                if current is not None and current.key != key:
                    yield from close(current, False)
                    current = None
                if current is None:
                    current = _Run(key, first_run and k == 0)
                here, gone = rows[start:end], missing[start:end]
                one = (int(here[0, 2]), int(here[0, 3]), bool(gone[0]))
                current.docs += int(counts[k]) - (current.last == one)
                current.last = (int(here[-1, 2]), int(here[-1, 3]), bool(gone[-1]))
                lead = np.zeros(len(here), bool)
                if not current.started:
                    lead[0] = current.started = True
                current.rows.append((here, gone, lead))
                if current.docs >= min_docs:
                    for held, absent, led in current.rows:
                        if keep_first and led.any():
                            # whether it is the key's very first line shows next door
                            yield marks(OPEN, held[led], absent[led], current.docs, led[led])
                            held, absent = held[~led], absent[~led]
                        if len(held):
                            yield marks(DROP, held, absent)
                    current.rows = []
        if current is not None:
            yield from close(current, True)

    return run


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(_ld_id, _ld_text_hash, keep): the compressed bitmap of each document that loses lines."""
    spark = docs.sparkSession
    lines = line_keys(_identified(docs, text, key), text, min_chars)
    order = ["_ld_h1", "_ld_h2", "_ld_id", "_ld_text_hash"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows that repeat id and text stand for one document: their equal positions are adjacent and harmless.
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order, "_ld_pos")
    marks = cut(arrow_map(dealt, streamed(min_docs, keep_first), _ddl(MARKS)), "line-marks")
    keys = ["_ld_h1", "_ld_h2"]
    # At most two rows per partition, whatever the data.
    full = F.broadcast(marks.where(F.col("_ld_kind") == RUN).groupBy(*keys).agg(F.sum("_ld_docs").alias("_ld_total")).where(F.col("_ld_total") >= min_docs))
    opened = marks.where(F.col("_ld_kind") == OPEN).join(full, keys, "left_semi")
    if keep_first:
        firsts = opened.where("_ld_first").groupBy(*keys).agg(F.min(F.struct("_ld_id", "_ld_text_hash", "_ld_pos")).alias("_ld_lead"))
        opened = opened.join(F.broadcast(firsts), keys, "left").where(~F.coalesce(F.struct("_ld_id", "_ld_text_hash", "_ld_pos").eqNullSafe(F.col("_ld_lead")), F.lit(False)))
    dropped = marks.where(F.col("_ld_kind") == DROP).select("_ld_id", "_ld_text_hash", "_ld_pos").unionByName(opened.select("_ld_id", "_ld_text_hash", "_ld_pos"))
    lists = dropped.groupBy("_ld_id", "_ld_text_hash").agg(F.collect_set("_ld_pos").alias("_ld_lines"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_ld_id", pa.int64()), ("_ld_text_hash", pa.int64()), ("keep", pa.binary())])
        for b in batches:
            maps = []
            for positions in b.column(2).to_pylist():
                bits = np.ones(-(-(max(positions) + 1) // 8) * 8, bool)  # whole bytes
                bits[positions] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield batch(schema, b.column(0), b.column(1), pa.array(maps, type=pa.binary()))

    return arrow_map(lists, packed, "_ld_id bigint, _ld_text_hash bigint, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text that stays, its lines before and the lines dropped."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool)[: len(lines)]
    stay = [x for x, k in zip(lines, bits.tolist()) if k] + lines[len(bits) :]  # noqa: B905
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False, **rule) -> DataFrame:
    """``docs`` with the text that stays, and the columns n_lines and n_dropped; with ``digest`` the
    text is replaced by kept_sha256.  A null text becomes empty."""
    bitmaps = keep_bitmaps(docs, text, key, **rule)
    bitmaps = bitmaps.select(F.col("_ld_id").alias("_ld_id2"), F.col("_ld_text_hash").alias("_ld_text_hash2"), F.col("keep").alias("_ld_keep"))
    left = _identified(docs.drop("n_lines", "n_dropped"), text, key)
    joined = left.join(bitmaps, null_safe([(F.col("_ld_id"), F.col("_ld_id2"))]) & (F.col("_ld_text_hash") == F.col("_ld_text_hash2")), "left")
    others = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    rows = joined.select(*(F.col(f"`{c}`") for c in others), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_ld_text"), "_ld_keep")
    name = "kept_sha256" if digest else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, -2):
            done = [apply_bitmap(t, k) for t, k in zip(as_bytes(b.column(b.num_columns - 2)), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            texts = [hashlib.sha256(d[0]).hexdigest() if digest else d[0].decode(errors="replace") for d in done]
            arrays = [pa.array(texts, type=pa.string()), pa.array([d[1] for d in done], type=pa.int64()), pa.array([d[2] for d in done], type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], names=[*b.schema.names[:-2], name, "n_lines", "n_dropped"])

    schema = rows.drop("_ld_text", "_ld_keep").schema.add(name, T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType())
    return arrow_map(rows, run, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), full_keys AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (f.key IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN full_keys f ON keyed.key = f.key
GROUP BY doc_id
"""
