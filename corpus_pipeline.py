"""The corpus pipeline: from raw documents to tokens, each stage one of the operators in ``nestq.llm``.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last
one returns token ids.  The stages run one after the other on the same executors, so each bounds the batches
that Spark hands to Python (``small_batches``), a setting that stays in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.llm import bpe_stream, decontaminate, language_id, line_dedup, near_dedup
from nestq.llm.common import cut, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; a missing label is filled in."""
    small_batches(spark)
    found = language_id.identify(docs, language_id.fit(docs)).where(~F.col("lang_rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share, each of which stays where it comes first:
    a group of many copies keeps one document with its text."""
    small_batches(spark)
    found = line_dedup.dedup_lines(docs, keep_first=True)
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    small_batches(spark)
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    small_batches(spark)
    coded = bpe_stream.encode_decode(docs)
    same = F.col("bpe_decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("bpe_ids").cast("bigint").alias("n_tokens"), F.col("bpe_ids").alias("token_ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: Compression, MinHash and BPE can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
