"""Benchmark decontamination by template canonicalisation, with DataFrame and SQL functions only.

Texts become templates: runs of letters and digits are tokens in lower case; a number (with its minus
sign, separators and decimals, or each word of one in words) becomes ``#``, a run of capitalised words inside a sentence
``@`` (a name), a unit after a number ``%``.  A capitalised word that opens a sentence may be a name or
not and stays a word: where it is another one, the windows that hold it don't match, those to its sides do.
(As a placeholder of its own it raised the operator's cost from 492 to 823 CPU seconds a GB.)  Windows of
``WINDOW`` template tokens are hashed; the documents' windows are joined with the benchmark's.  Matches
of a document and an item are put on diagonals (token position in the document less that in the item);
on a diagonal the tokens covered by matching windows are counted.  Where they make up ``coverage`` of
the item, or where no diagonal does so alone but those within ``BAND`` tokens do so together (words were
inserted or left out), slots are checked: over the covered placeholders, equal item values must stand for equal
document values.  So both verbatim copies and questions with other numbers or names are found, while
a chance match of templates with contradictory values is not.

The documents' windows are exploded without a shuffle and meet the benchmark's by a broadcast if the
latter has at most ``BROADCAST_WINDOWS`` rows, else by a join on the hash.  A window that occurs twice
in an item is looked for once and found at all its positions: each is a hit on a diagonal of its own.

A template with fewer than ``LEAST_WORDS`` plain words says little, so such windows are hashed by their
values instead.  Items with fewer than ``WINDOW`` tokens are searched whole and verbatim, in the lengths
that the benchmark has: an item of one word is found in each document with that word.

A text of any length is one row of tokens in the JVM (some 60 bytes a token).  Null and empty texts match
nothing.  Rows that repeat id and text are one document; a null id is an id, ids may be of any type.  Of
equally good matches of a document and an item one is returned.  An empty table on either side gives an
empty result.  Other columns pass through ``decontaminate``; internal names start with ``_dc_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestq.llm.common import cut, null_safe, small_enough, table

WINDOW = 8
LEAST_WORDS = 4
COVERAGE = 0.6
#: Diagonals up to this many tokens apart count together.
BAND = 64
BROADCAST_WINDOWS = 1_000_000
BROADCAST_KEYS = 500_000
#: Units that count as such after a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l s sec min h hr hours minutes seconds days weeks months years percent c f k usd eur gbp dollars euros cents kb mb gb tb hz khz mhz ghz w kw v a j n pa mph kmh meters metres kilometers grams kilograms pounds miles feet inches liters litres".split()
#: Words that are numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
_NAME = "\u0001"
#: Joins the parts of a number or name and stands for a minus sign.
_JOIN = "\u0002"
_NUMBER = r"^\x02?\p{N}+(\x02\p{N}+)*$"


def tokens(text: Column) -> Column:
    """Tokens in lower case; names still carry their mark."""
    whole = F.translate(F.coalesce(text.cast("string"), F.lit("")), _JOIN, " ")
    marked = F.regexp_replace(whole, r"([\p{Ll}\p{N}],?[ \t\n\r])(\p{Lu})", "$1" + _NAME + "$2")
    numbers = F.regexp_replace(F.lower(marked), r"(?<=\p{N})(?:[.,'\u2019](?=\p{N})|[\u00A0\u2009\u202F](?=\p{N}{3}(?!\p{N})))|(?<![\p{L}\p{N}])[-\u2212](?=[\p{N}.,]++(?!\p{L}))(?=\p{N})", _JOIN)
    names = F.regexp_replace(numbers, "(" + _NAME + r"[\p{L}\p{N}]+)[ \t\n\r]+(?=" + _NAME + ")", "$1" + _JOIN)
    plain = F.trim(F.regexp_replace(names, r"[^\p{L}\p{N}" + _NAME + _JOIN + "]+", " "))
    return F.filter(F.split(plain, " "), lambda t: t != "")


def template(column: str) -> Column:
    """The template of an array of tokens."""
    units, words = (", ".join(f"'{u}'" for u in found) for found in (UNITS, NUMBER_WORDS))
    return F.expr(
        rf"""transform({column}, (t, i) -> CASE
            WHEN t RLIKE r'{_NUMBER}' OR t IN ({words}) THEN '#'
            WHEN startswith(t, '{_NAME}') THEN '@'
            WHEN t IN ({units}) AND i > 0 AND (get({column}, i - 1) RLIKE r'{_NUMBER}' OR get({column}, i - 1) IN ({words})) THEN '%'
            ELSE t END)"""
    )


def windows(template: str, values: str) -> Column:
    """Hashes of all windows of an array of template tokens, by position; a window with fewer than
    ``LEAST_WORDS`` plain words is hashed by its values."""
    count = f"size({template}) - {WINDOW - 1}"
    whole = f"xxhash64(slice({template}, i, {WINDOW}))"
    plain = f"size(filter(slice({template}, i, {WINDOW}), x -> x NOT IN ('#', '@', '%')))"
    either = f"CASE WHEN {plain} >= {LEAST_WORDS} THEN {whole} ELSE xxhash64(translate(array_join(slice({values}, i, {WINDOW}), ' '), '{_NAME}', '')) END"
    return F.expr(
        f"""CASE WHEN size({template}) < {WINDOW} THEN cast(array() AS array<bigint>)
            WHEN size(filter({template}, x -> x IN ('#', '@', '%'))) > {WINDOW - LEAST_WORDS} THEN transform(sequence(1, {count}), i -> {either})
            ELSE transform(sequence(1, {count}), i -> {whole}) END"""
    )


def parts(column: str) -> Column:
    """The tokens of an array with names and numbers taken apart and no marks."""
    return F.expr(f"filter(split(translate(array_join({column}, ' '), '{_JOIN}{_NAME}', ' '), ' '), x -> x <> '')")


def brief_found(source: DataFrame, benchmark: DataFrame, text: str, item: str) -> DataFrame | None:
    """Documents that hold an item of fewer than ``WINDOW`` tokens whole and verbatim; None without such items."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), tokens(F.col(f"`{text}`")).alias("iv")).withColumn("it", template("iv"))
    items = items.where(F.size("it").between(1, WINDOW - 1)).withColumn("u", parts("iv"))
    brief = items.select("item", F.xxhash64("u").alias("w"), F.size("u").alias("n"), F.size("it").cast("bigint").alias("n_tokens"), F.size(F.filter("it", lambda t: t.isin("#", "@", "%"))).cast("bigint").alias("n_slots"))
    brief = cut(brief.groupBy("item", "w", "n").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_slots").alias("n_slots")), "benchmark-brief")
    sizes = sorted(r.n for r in brief.select("n").distinct().collect())
    if not sizes:
        return None
    brief = F.broadcast(brief) if small_enough(brief, BROADCAST_WINDOWS) else brief
    runs = F.expr("array_distinct(flatten(array(" + ", ".join(f"CASE WHEN size(u) >= {n} THEN transform(sequence(1, size(u) - {n - 1}), i -> xxhash64(slice(u, i, {n}))) ELSE cast(array() AS array<bigint>) END" for n in sizes) + ")))")
    placed = source.withColumn("u", parts("v")).select("id", "text_hash", F.explode(runs).alias("w"))
    return placed.join(brief, "w").select("id", "text_hash", "item", F.lit(1).cast("bigint").alias("n_windows"), F.col("n_tokens").alias("n_covered"), "n_tokens", "n_slots", F.lit(True).alias("verbatim"))


def covered_tokens(column: str) -> Column:
    """The number of tokens in the windows at an array of sorted positions."""
    gaps = f"zip_with(slice({column}, 2, size({column}) - 1), slice({column}, 1, size({column}) - 1), (b, a) -> least({WINDOW}, b - a))"
    return F.expr(f"aggregate({gaps}, {WINDOW}, (s, x) -> s + x)")


def benchmark_windows(benchmark: DataFrame, text: str, item: str) -> DataFrame:
    """(w, item, ats): each window of an item and all its positions."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), tokens(F.col(f"`{text}`")).alias("v")).withColumn("t", template("v"))
    exploded = items.select("item", F.posexplode(windows("t", "v")).alias("at", "w"))
    return exploded.groupBy("item", "w").agg(F.collect_set("at").alias("ats")).select("w", "item", "ats")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """(id, text_hash, item, n_windows, n_covered, n_tokens, n_slots, verbatim): the best match of each document and item."""
    wanted = cut(benchmark_windows(benchmark, item_text, item), "benchmark-windows")
    wanted = F.broadcast(wanted) if small_enough(wanted, BROADCAST_WINDOWS) else wanted
    whole = F.col(f"`{text}`").cast("string")
    source = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(whole).alias("text_hash"), tokens(whole).alias("v"))
    placed = source.withColumn("t", template("v")).select("id", "text_hash", F.posexplode(windows("t", "v")).alias("place", "w"))
    hits = placed.join(wanted, "w").select("id", "text_hash", "item", "place", F.explode("ats").alias("at")).withColumn("diagonal", F.col("place") - F.col("at"))
    sets = hits.groupBy("id", "text_hash", "item", "diagonal").agg(F.array_sort(F.collect_set("at")).alias("p"))
    pair = Window.partitionBy("id", "text_hash", "item")
    covered = sets.withColumn("n_covered", covered_tokens("p")).withColumn("n_alone", F.max("n_covered").over(pair)).withColumn("n_all", F.sum("n_covered").over(pair))
    items = benchmark.select(F.col(f"`{item}`").alias("item"), tokens(F.col(f"`{item_text}`")).alias("iv")).withColumn("it", template("iv")).where(F.size("it") >= WINDOW).dropDuplicates(["item", "iv"])
    needed = coverage * F.size("it")
    likely = covered.join(items.select(F.col("item").alias("item2"), "iv", "it"), F.col("item").eqNullSafe(F.col("item2"))).drop("item2").where(F.col("n_all") >= needed)
    likely = cut(likely, "benchmark-likely").withColumn("part", F.struct("n_covered", "diagonal", "p"))
    alone = likely.where(F.col("n_covered") >= needed).withColumn("parts", F.array("part"))
    band = Window.partitionBy("id", "text_hash", "item", "iv").orderBy("diagonal").rangeBetween(0, BAND)
    together = likely.where(F.col("n_alone") < needed).withColumn("parts", F.sort_array(F.collect_list("part").over(band), asc=False))
    together = together.withColumn("p", F.expr("array_sort(array_distinct(flatten(parts.p)))"))
    # A passage of the document does not count for several places of the item.
    together = together.withColumn("places", F.expr("array_sort(array_distinct(flatten(transform(parts, x -> transform(x.p, q -> q + x.diagonal)))))"))
    together = together.withColumn("n_covered", F.least(covered_tokens("p"), covered_tokens("places"))).where(F.col("n_covered") >= needed)
    chosen = alone.unionByName(together.drop("places")).select("id", "text_hash", "item", "iv", "it", "p", "n_covered", "parts")
    chosen = cut(chosen, "benchmark-candidates")
    # Only the candidates' documents are read again: their keys go to the scan if they are few, else both meet in a join.
    keys = chosen.select(F.col("id").alias("id3"), F.col("text_hash").alias("hash3")).distinct()
    keys = F.broadcast(keys) if small_enough(keys, BROADCAST_KEYS) else keys
    again = docs.select(F.col(f"`{key}`").alias("id2"), whole.alias("whole"), F.xxhash64(whole).alias("hash2"))
    again = again.join(keys, null_safe([(F.col("id2"), F.col("id3"))]) & (F.col("hash2") == F.col("hash3")), "left_semi")
    values = again.dropDuplicates(["id2", "hash2"]).select("id2", "hash2", tokens(F.col("whole")).alias("v"))
    both = chosen.join(values, null_safe([(F.col("id"), F.col("id2"))]) & (F.col("text_hash") == F.col("hash2")))
    under = f"q -> k >= q AND k < q + {WINDOW}"
    slots = F.expr(f"transform(filter(sequence(0, size(it) - 1), k -> it[k] IN ('#', '@', '%') AND exists(p, {under})), k -> struct(it[k] AS kind, translate(iv[k], '{_NAME}', '') AS item_value, translate(get(v, k + filter(parts, x -> exists(x.p, {under}))[0].diagonal), '{_NAME}', '') AS value))")
    checked = both.withColumn("slots", slots).where("size(array_distinct(slots)) = size(array_distinct(transform(slots, s -> struct(s.kind, s.item_value))))")
    judged = checked.select(
        "id", "text_hash", "item", F.size("p").cast("bigint").alias("n_windows"), F.col("n_covered").cast("bigint").alias("n_covered"), F.size("it").cast("bigint").alias("n_tokens"),
        F.size("slots").cast("bigint").alias("n_slots"), F.forall("slots", lambda s: s["item_value"] == s["value"]).alias("verbatim"),
    )
    brief = brief_found(source, benchmark, item_text, item)
    judged = judged if brief is None else judged.unionByName(brief)
    best = judged.groupBy("id", "text_hash", "item").agg(F.max(F.struct("n_covered", "verbatim", "n_windows", "n_slots", "n_tokens")).alias("b"))
    return best.select("id", "text_hash", "item", *(F.col(f"b.{c}").alias(c) for c in ("n_windows", "n_covered", "n_tokens", "n_slots", "verbatim")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = contaminated(docs, benchmark, text, key, **options).select(F.col("id").alias("_dc_id"), F.col("text_hash").alias("_dc_hash")).distinct()
    found = cut(found, "contaminated")
    found = F.broadcast(found) if small_enough(found, BROADCAST_KEYS) else found
    marked = docs.withColumn("_dc_text", F.xxhash64(F.col(f"`{text}`").cast("string")))
    return marked.join(found, null_safe([(F.col(f"`{key}`"), F.col("_dc_id"))]) & (F.col("_dc_text") == F.col("_dc_hash")), "left_anti").drop("_dc_text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "n_covered", "n_tokens", "n_slots", "verbatim")


def _oracle() -> str:
    units, numbers = (", ".join(f"'{u}'" for u in found) for found in (UNITS, NUMBER_WORDS))

    def prepared(name: str, key: str) -> str:
        return rf"""
{name}_v AS (
  SELECT {key} AS key, list_filter(string_split(trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '([\p{{Ll}}\p{{N}}],?[ \t\n\r])(\p{{Lu}})', '\1' || chr(1) || '\2', 'g')), '[^\p{{L}}\p{{N}}\x01]+', ' ', 'g')), ' '), lambda t: t <> '') AS v
  FROM {name}
), {name}_t AS (
  SELECT key, v, list_transform(range(1, len(v) + 1), lambda i: CASE
      WHEN regexp_matches(v[i], '^\p{{N}}+$') OR v[i] IN ({numbers}) THEN '#'
      WHEN starts_with(v[i], chr(1)) THEN '@'
      WHEN v[i] IN ({units}) AND i > 1 AND (regexp_matches(v[i - 1], '^\p{{N}}+$') OR v[i - 1] IN ({numbers})) THEN '%'
      ELSE v[i] END) AS t
  FROM {name}_v
), {name}_w AS (
  SELECT key, i - 1 AS pos, CASE WHEN len(list_filter(list_slice(t, i, i + {WINDOW - 1}), lambda x: x NOT IN ('#', '@', '%'))) >= {LEAST_WORDS}
              THEN array_to_string(list_slice(t, i, i + {WINDOW - 1}), ' ') ELSE chr(2) || translate(array_to_string(list_slice(v, i, i + {WINDOW - 1}), ' '), chr(1), '') END AS w
  FROM (SELECT key, t, v, unnest(range(1, len(t) - {WINDOW - 2})) AS i FROM {name}_t WHERE len(t) >= {WINDOW})
)"""

    return rf"""
WITH {prepared("documents", "doc_id")}, {prepared("benchmark", "item_id")}, wanted AS (
  SELECT key AS item, w, pos FROM benchmark_w
), hits AS (
  SELECT DISTINCT d.key AS doc_id, b.item, d.pos - b.pos AS diagonal, b.pos
  FROM documents_w d JOIN wanted b ON d.w = b.w
), stepped AS (
  SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id, item, diagonal ORDER BY pos), 0) AS step FROM hits
), covered AS (
  SELECT doc_id, item, diagonal, count(*) AS n_windows, {WINDOW} + sum(least({WINDOW}, step)) AS n_covered, list(pos) AS p
  FROM stepped GROUP BY doc_id, item, diagonal
), joined AS (
  SELECT c.*, len(b.t) AS n_tokens,
         list_transform(list_filter(range(0, len(b.t)), lambda k: b.t[k + 1] IN ('#', '@', '%') AND len(list_filter(c.p, lambda q: k >= q AND k < q + {WINDOW})) > 0),
                        lambda k: {{'kind': b.t[k + 1], 'item_value': translate(b.v[k + 1], chr(1), ''), 'value': translate(d.v[k + 1 + c.diagonal], chr(1), '')}}) AS slots
  FROM covered c JOIN benchmark_t b ON c.item = b.key JOIN documents_t d ON c.doc_id = d.key
  WHERE c.n_covered >= {COVERAGE} * len(b.t)
), judged AS (
  SELECT doc_id, item, n_windows, n_covered, n_tokens, len(slots) AS n_slots,
         len(list_filter(slots, lambda s: s.item_value <> s.value)) = 0 AS verbatim
  FROM joined
  WHERE len(list_distinct(slots)) = len(list_distinct(list_transform(slots, lambda s: {{'kind': s.kind, 'item_value': s.item_value}})))
)
SELECT doc_id, item AS item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_covered AS BIGINT) AS n_covered,
       CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_slots AS BIGINT) AS n_slots, verbatim
FROM judged
QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY n_covered DESC, verbatim DESC, n_windows DESC, n_slots DESC) = 1
"""


ORACLE = _oracle()
