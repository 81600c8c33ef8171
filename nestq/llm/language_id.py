"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of text in that language.  A text is put
in lower case, its letters are kept, and it is cut into blocks; every block is compressed with each
dictionary, and the language with the smallest total wins, at equal totals the first by name (its margin
is 0, so it is rejected).  Cutting keeps the dictionary's part in the result the same for long texts, whose
own past would otherwise do its work.  The whole text counts, block by block, whatever its length.  The score is the margin: how much smaller the best
total is than the second best, as a share of the latter.  Texts with a margin below ``least_margin``
are marked as rejected.

The dictionaries are fitted on a bounded sample of labelled rows (``docs_per_language`` documents,
``piece_bytes`` of each, ``dictionary_bytes`` per language), chosen by a hash of the id, so that what
reaches the driver does not grow with the data.  A column with more than ``most_languages`` distinct labels
is an error: it holds something else than languages.

Null texts and texts without a letter are ``und`` with score 0 and are rejected, as is everything if
no row is labelled.  With a single language the margin is 1.  Rows are independent; repeated rows get
equal results, ids of any type and other columns pass through, columns of the result's names are
replaced.  Ill-formed UTF-8 is read as U+FFFD.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_texts, fold, sliced, table

LETTER = re.compile(r"[^\W\d_]")
#: What is not a letter becomes one space before compression, so that marks and digits don't break matches.
OTHER = re.compile(r"[\W\d_]+")
DOCS_PER_LANGUAGE = 400
PIECE_BYTES = 600
DICTIONARY_BYTES = 96 << 10
BLOCK = 1024
LEVEL = 9
LEAST_MARGIN = 0.005
UNKNOWN = "und"
MOST_LANGUAGES = 1000


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, most_languages: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled``, from its bounded sample."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"), F.col(text).alias("t"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}  # a row for each language
    if len(counts) > most_languages:
        raise ValueError(f"{lang} has more than {most_languages} distinct labels")
    if not counts:
        return {}
    # A share of each language's rows by hash, twice what is needed; of those the lowest hashes are used.
    span = 1 << 40
    share = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, int(span * min(1.0, 2 * docs_per_language / n)))))
    chosen = F.pmod("h", F.lit(span)) < F.element_at(share, F.col("lang"))
    # a stretch from the middle of the text, where headers and notices are rare
    start = F.greatest(F.lit(1), (F.length("t") / 2).cast("int") - piece_bytes // 2)
    sample = rows.where(chosen).select("lang", "h", F.substring("t", start, F.lit(piece_bytes)).alias("piece")).collect()
    made: dict[str, bytes] = {}
    for name in sorted(counts):
        pieces = sorted((r["h"], r["piece"]) for r in sample if r["lang"] == name)[:docs_per_language]
        data = normal(" ".join(p for _, p in reversed(pieces)))
        made[name] = data[-dictionary_bytes:]
    return made


def normal(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode()


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, level: int = LEVEL):
        self.names, self.block, self.machines = sorted(dictionaries), block, []
        for name in self.names:
            held = zstandard.ZstdCompressionDict(dictionaries[name] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.machines.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False).compress)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = normal(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = sorted((sum(len(press(b)) for b in blocks), name) for press, name in zip(self.machines, self.names, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; nothing but the text is looked at."""
    mine = ["lang_pred", "lang_score", "lang_rejected"]
    kept = docs.drop(*mine).withColumn("_lang_text", F.col(f"`{text}`").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(sent.value)
        for b in sliced(batches):
            found = [judge.predict(t) for t in as_texts(b.column(b.num_columns - 1))]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[1] < least_margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], *mine])

    schema = kept.drop("_lang_text").schema.add("lang_pred", T.StringType()).add("lang_score", T.DoubleType()).add("lang_rejected", T.BooleanType())
    return arrow_map(kept, run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the predicted language, the margin and whether it is too narrow, learnt from two of three folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = identify(docs.select("doc_id", "text"), made)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
