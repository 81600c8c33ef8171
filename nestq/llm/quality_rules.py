"""Quality rules judged per document and per host.

Every document gets word statistics and the rules it fails.  Failures are summed by host (the column
``source``); a beta prior is fitted to the hosts' failure rates by the method of moments, weighted by
their documents, and each host's rate is shrunk to it, so a host with few documents stays near the
common rate.  A host whose shrunk rate exceeds the rule's limit fails, and its documents with it.

Sums are partial before the shuffle, so a host with a third of all rows is one row per task.  Verdicts
return to the documents by broadcast if there are at most ``BROADCAST_HOSTS`` hosts that fail, else by
a join on the host, which adaptive execution splits where a host is large.

Null or empty texts have no words and fail the base rule.  A null host is no host: its documents are
judged alone.  Repeated rows are judged and counted each.  An empty table gives an empty result.
Of equal windows and lines all but the first line count as repeats, all windows do.  The windows of texts with more than
``LONG_WORDS`` words are ranked in arrays, with equal results.  Ids of any type and other columns pass
through; columns of the result's names are replaced, internal names start with ``_quality_``.  Ill-formed
UTF-8 is read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_texts, cut, sliced, small_enough, table

SYMBOLS = "#*$%&|<>"
#: Rules by name: the documents' condition (over the statistics), and the shrunk rate at which a host fails.
RULES = {
    "base": ("base_failed", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.5),
    "lines": ("n_lines_with_words >= 3 and 10 * n_dup_lines > 6 * n_lines_with_words", 0.5),
    "word_length": ("word_chars > 25 * n_words or word_chars < 2 * n_words", 0.5),
}
BROADCAST_HOSTS = 100_000
#: Pseudo-documents that the prior counts as, at most.
MOST_STRENGTH = 1000.0
WINDOW = 5
LONG_WORDS = 50_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` words that the text has twice or more."""
    if len(words) > LONG_WORDS:
        return _repeated_in_arrays(words, window)
    grams = list(zip(*(words[i:] for i in range(window))))  # noqa: B905  shorter ones end it
    if len(set(grams)) == len(grams):
        return 0
    seen: dict[tuple, int] = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def _repeated_in_arrays(words: list[bytes], window: int) -> int:
    """The same for long texts: words are numbered, windows ranked by one word more at a time."""
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n = len(codes) - window + 1
    rank = codes[:n]
    for k in range(1, window):
        rank = np.unique(rank * len(known) + codes[k : k + n], return_inverse=True)[1]
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(starts):
        return 0
    return window + int(np.minimum(np.diff(starts), window).sum())


def statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_with_words."""
    data = text.encode()
    words = data.split()
    white = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_with_words")


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics, base_failed and a boolean failed_<rule> for each rule."""
    mine = {*STATS, "base_failed", *(f"failed_{r}" for r in RULES)}
    kept = docs.withColumn("_quality_text", F.col(f"`{text}`").cast("string")).drop(*(mine - {text}), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [statistics(t or "") for t in as_texts(b.column(b.num_columns - 1))]
            columns = list(zip(*found, strict=True)) if found else [[] for _ in STATS]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, type=pa.int64()) for c in columns)], names=[*b.schema.names[:-1], *STATS])

    schema = kept.drop("_quality_text").schema
    for name in STATS:
        schema = schema.add(name, T.LongType())
    judged = arrow_map(kept, run, schema).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return judged.withColumns({f"failed_{r}": F.expr(rule) for r, (rule, _) in RULES.items()})


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, and for each rule its failures and its rate shrunk by the empirical prior."""
    sums = judged.where(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count("*").alias("n_docs"), *(F.sum(F.col(f"failed_{r}").cast("bigint")).alias(f"n_{r}") for r in RULES)
    )
    sums = cut(sums, "host-sums")
    # Moments over hosts: mean rate m, weighted variance v of the rates, less what sampling adds to it.
    found = sums.agg(
        F.count("*").alias("hosts"),
        F.sum("n_docs").alias("docs"),
        *(F.sum(f"n_{r}").alias(f"f_{r}") for r in RULES),
        *(F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in RULES),
    ).first()
    out = sums
    for r in RULES:
        mean, strength = prior(found["hosts"], found["docs"] or 0, found[f"f_{r}"] or 0, found[f"q_{r}"] or 0.0)
        out = out.withColumn(f"rate_{r}", (F.col(f"n_{r}") + strength * mean) / (F.col("n_docs") + strength))
    return out


def prior(hosts: int, docs: int, failures: int, squares: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the beta prior, by moments; squares: sum of failures^2 / documents."""
    if not docs:
        return 0.0, 1.0
    mean = failures / docs
    spread = squares / docs - mean * mean - mean * (1 - mean) * hosts / docs
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else MOST_STRENGTH
    return mean, min(max(strength, 1.0), MOST_STRENGTH)


def judge(docs: DataFrame, text: str = "text", host: str = "source", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The rows of ``docs`` without text, with statistics, base_failed, host_failed and kept."""
    judged = cut(document_rules(docs, text), "rules")
    failed = cut(host_rates(judged, host).where(" or ".join(f"rate_{r} > {limit}" for r, (_, limit) in RULES.items())).select(F.col("host").alias("_quality_host")), "hosts")
    # decided on the verdicts written, which are no more than the hosts
    verdicts = F.broadcast(failed) if small_enough(failed, broadcast_hosts) else failed
    joined = judged.join(verdicts, F.col(f"`{host}`") == F.col("_quality_host"), "left")
    return joined.withColumn("host_failed", F.col("_quality_host").isNotNull()).drop("_quality_host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base statistics, base_failed and the verdict of document and host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    rules = {"base": "base_failed", **{r: rule for r, (rule, _) in RULES.items() if r != "base"}}
    sums = ", ".join(f"CAST(count(*) FILTER ({rule}) AS DOUBLE) AS n_{r}" for r, rule in rules.items())
    totals = ", ".join(f"sum(n_{r}) / sum(n_docs) AS m_{r}, sum(n_{r} * n_{r} / n_docs) / sum(n_docs) AS q_{r}" for r in rules)
    spreads = ", ".join(f"q_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * hosts / docs AS v_{r}" for r in rules)
    strengths = ", ".join(f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1), {MOST_STRENGTH}) ELSE {MOST_STRENGTH} END AS s_{r}" for r in rules)
    failed = " OR ".join(f"(n_{r} + s_{r} * m_{r}) / (n_docs + s_{r}) > {limit}" for r, (_, limit) in RULES.items())
    return rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
  FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW}))
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM grams WHERE n > 1) GROUP BY doc_id
), stats AS (
  SELECT s.doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(lines) AS n_lines_with_words, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats
), hosts AS (
  SELECT source AS host, CAST(count(*) AS DOUBLE) AS n_docs, {sums} FROM judged WHERE source IS NOT NULL GROUP BY source
), totals AS (
  SELECT count(*) AS hosts, sum(n_docs) AS docs, {totals} FROM hosts
), spreads AS (SELECT *, {spreads} FROM totals), strengths AS (SELECT *, {strengths} FROM spreads), failed AS (
  SELECT host FROM hosts, strengths WHERE {failed}
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND host IS NULL AS kept
FROM judged LEFT JOIN failed ON source = host
"""


ORACLE = _oracle()
