"""Near-duplicate documents by MinHash, sequential Bayesian verification and connected components.

Two documents are linked if the Jaccard similarity of their word-shingle sets is at least
``threshold_percent``.  Shingles are hashed to 64 bits.

1.  Documents with equal sets are one *class*; all later steps are about classes, so thousands of exact
    copies cost one row per task.
2.  Signatures (``BANDS * ROWS`` MinHash values, 16 bits of each) are banded.  Each bucket's smallest
    class is compared with all others in the bucket: a star, not all pairs.
3.  Sequential verification: signatures are compared ``BATCH`` values at a time.  With m of n equal, the
    posterior of the similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair goes once the
    probability that it reaches the threshold falls below ``MISS``.  Survivors are verified exactly on
    their full sets.
4.  Components of verified links by alternating large-star and small-star steps, on DataFrames.
5.  Similarity isn't transitive, so a star alone could lose a link.  Buckets which still hold several
    components are compared by pairs of blocks of bounded size, with their full sets at hand: pairs of
    different components that pass the sequential test are verified exactly there, and a block returns
    the links that join components, at most one less than its rows.  Pairs inside one component can't
    change the result and aren't looked at; a pair is left to the first band that it shares.

A pair at the threshold of 0.85 misses every band with probability (1 - 0.85^5)^25 < 5e-7.

Texts without words have an empty set, are linked with nothing and form their own component.  A null id
never is the smallest of a component, unless all ids of it are null.  Repeated rows are equal sets.  An
empty table gives an empty result.  Ids may be of any type that has an order.  A text of any length is one
array of words in its worker.  Other columns pass through, but for those of the result's names, which are
replaced; internal names start with ``_nd_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_bytes, batch, cut, discard, sliced, table

SHINGLE = 5
THRESHOLD_PERCENT = 80
BANDS, ROWS = 25, 5
BATCH = 25
MISS = 1e-6
#: Classes of one bucket that are compared in a block.
BLOCK_ROWS = 1500
SIGNATURE = BANDS * ROWS
#: Documents for each file of a step that is written.
FILE_ROWS = 2000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word shingles; remembers the hashes of a bounded number of words."""

    def __init__(self, size: int, remembered: int = 300_000):
        self.size, self.remembered, self.known = size, remembered, {}

    def hashes(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of all of them as one."""
        words, known, digest = text.lower().split(), self.known, xxhash.xxh3_64_intdigest
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > self.remembered:
            known.clear()
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = digest(w)
            codes.append(code)
        h = np.array(codes, dtype=np.uint64)
        n = max(1, len(words) - self.size + 1)
        out = np.full(n, min(len(words), self.size), np.uint64)
        for k in range(min(self.size, len(words))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> bytes:
    """16 bits of the minimum of each hash function; long sets are taken in blocks."""
    low = np.full(SIGNATURE, np.uint32(0xFFFFFFFF), np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for start in range(0, len(x), 2048):
        low = np.minimum(low, (x[None, start : start + 2048] * factors[:, None] + offsets[:, None]).min(axis=1))
    return ((low >> np.uint32(16)) ^ (low & np.uint32(0xFFFF))).astype("<u2").tobytes()


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For n = 0..SIGNATURE: the fewest equal values with which a pair stays.

    P(similarity >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(SIGNATURE + 1):
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        found.append(m)
    return found


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indexes of the rows whose signatures a and b pass every batch."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for start in range(0, SIGNATURE, BATCH):
        end = min(start + BATCH, SIGNATURE)
        equal += (a[left, start:end] == b[left, start:end]).sum(axis=1)
        stay = equal >= least[end]
        left, equal = left[stay], equal[stay]
    return left


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, SIGNATURE)


def sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` without text, with _nd_n (set size), _nd_c1, _nd_c2 (128-bit digest of the set) and _nd_sig."""
    rows = docs.withColumn("_nd_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    rows = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, (factors, offsets) = Shingler(shingle), hash_functions(SIGNATURE)
        for b in sliced(batches):
            sizes, digests, made, last = [], [], [], {}
            for t in as_bytes(b.column(b.num_columns - 1)):
                s = maker.hashes(t)
                sizes.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                digests.append(digest)
                if digest not in last:  # copies in one batch share their signature
                    last[digest] = signature(s, factors, offsets) if len(s) else None
                made.append(last[digest])
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            arrays = [pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*b.schema.names[:-1], "_nd_n", "_nd_c1", "_nd_c2", "_nd_sig"])

    schema = rows.drop("_nd_text").schema.add("_nd_n", T.LongType()).add("_nd_c1", T.LongType()).add("_nd_c2", T.LongType()).add("_nd_sig", T.BinaryType())
    return arrow_map(rows, run, schema)


def written(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``cut`` in as many files as ``rows`` documents take where Spark itself merges no small partitions.

    A file on a local file system starts processes (chmod, without Hadoop's native library), each of which
    for an instant counts with all of an executor's memory.
    """
    conf = df.sparkSession.conf
    merges = conf.get("spark.sql.adaptive.enabled") == conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    files = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return cut(df if merges or files >= int(conf.get("spark.sql.shuffle.partitions")) else df.repartition(files), name)


def _class() -> F.Column:
    return F.struct("_nd_c1", "_nd_c2")


CLASS = "struct<_nd_c1:bigint,_nd_c2:bigint>"


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, band, c) for each class and band."""
    banded = classes.select("c", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return banded.select(F.xxhash64("band", F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket"), "band", "c")


def passed(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""
    # the side with few distinct keys comes second: adaptive execution splits it where it is skewed
    one = pairs.join(classes.select(F.col("c").alias("b"), F.col("sig").alias("sig_b")), "b")
    both = one.join(classes.select(F.col("c").alias("a"), F.col("sig").alias("sig_a")), "a").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                stay = pa.array(survivors(_signatures(b.column(2)), _signatures(b.column(3)), least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(stay), b.column(1).take(stay)], names=["a", "b"])

    return arrow_map(both, run, f"a {CLASS}, b {CLASS}")


def full_sets(needed: DataFrame, docs: DataFrame, members: DataFrame, text: str, shingle: int, rows: int) -> DataFrame:
    """(c, shingles) of the classes in ``needed``.  members: (c, place), a row of ``docs`` for each class."""
    places = members.join(needed.distinct(), "c")
    texts = docs.select("_nd_row", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_nd_text")).join(places.select(F.col("place").alias("_nd_row"), "c"), "_nd_row").select("c", "_nd_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingler(shingle)
        for b in sliced(batches):
            # a row's place is a hash of id and text: the digest says whether it is the text meant
            keys, found, stay = b.column(0), [], []
            for i, (c, t) in enumerate(zip(keys.to_pylist(), as_bytes(b.column(1)), strict=True)):
                s = maker.hashes(t)
                if np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8").tolist() == [c["_nd_c1"], c["_nd_c2"]]:
                    found.append(s.tobytes())
                    stay.append(i)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(stay, pa.int64())), pa.array(found, pa.binary())], names=["c", "shingles"])

    return written(arrow_map(texts, shingled, f"c {CLASS}, shingles binary"), "near-sets", rows).dropDuplicates(["c"])


def linked_sets(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of sorted hashes reach the similarity."""
    n, m = len(x) // 8, len(y) // 8
    if 100 * min(n, m) < percent * max(n, m):
        return False
    merged = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, text: str, shingle: int, percent: int, rows: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    full = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("c")), docs, members, text, shingle, rows)
    both = pairs.join(full.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b").join(full.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            stay = [i for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if linked_sets(x, y, percent)]
            at = pa.array(stay, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return arrow_map(both, exact, f"a {CLASS}, b {CLASS}")


def components(links: DataFrame, rows: int) -> DataFrame:
    """(c, root) for every class that has a link; root is the smallest class of its component.

    A round is written once, and the last is known by its form.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        # large star: all larger neighbours of a node, to the smallest of node and neighbours
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all smaller neighbours and the node itself, to the smallest
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = written(small, "edges", rows)
        if are_stars(edges):
            return edges.select(F.col("u").alias("c"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("c"), F.col("v").alias("root")).distinct())


def are_stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has a single v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    return ends.groupBy("node").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 OR u = 1 AND v = 1").isEmpty()


def compared(rest: DataFrame, least: list[int], percent: int) -> DataFrame:
    """Verified links between components of a bucket; rest: (bucket, band, n, c, root, sig, shingles)."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # block i meets every block j: a row goes to the pairs (i, j) and (j, i), once where i = j
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    spread = dealt.select("bucket", "band", "block", "c", "root", "sig", "shingles", other)
    spread = spread.select("bucket", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "root", "sig", "shingles")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, sig, sets_ = group.column("block").to_numpy(), _signatures(group.column("sig")), group.column("shingles")
        c = group.column("c")
        roots: dict[tuple, int] = {}
        root = np.array([roots.setdefault((r["_nd_c1"], r["_nd_c2"]), len(roots)) for r in group.column("root").to_pylist()])
        i, j, band = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("band")[0].as_py()
        earlier = sig.reshape(len(sig), BANDS, ROWS)[:, :band]
        first = np.flatnonzero(block == i)
        second = first if i == j else np.flatnonzero(block == j)
        left, right = [], []
        for p in range(len(first)):
            me = int(first[p])
            against = first[p + 1 :] if i == j else second
            against = against[root[against] != root[me]]
            if not len(against):
                continue
            against = against[survivors(np.broadcast_to(sig[me], (len(against), SIGNATURE)), sig[against], least)]
            if band and len(against):
                against = against[~(earlier[against] == earlier[me]).all(axis=2).any(axis=1)]
            likely = np.argsort(-(sig[against] == sig[me]).sum(axis=1), kind="stable")
            mine = sets_[me].as_py()
            for q in against[likely].tolist():
                if root[q] != root[me] and linked_sets(mine, sets_[q].as_py(), percent):
                    left.append(me)
                    right.append(q)
                    root[root == root[q]] = root[me]
        return pa.table({"a": c.take(pa.array(left, pa.int64())), "b": c.take(pa.array(right, pa.int64()))})

    return spread.groupBy("bucket", "i", "j").applyInArrow(run, f"a {CLASS}, b {CLASS}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` without its text, with n_shingles, component_id and kept (id = component_id).

    Of rows that repeat the component's id all are kept; ``deduplicate`` keeps one.
    """
    return _linked(docs, text, key, shingle, threshold_percent).drop("_nd_row", "_nd_root")


def _linked(docs: DataFrame, text: str, key: str, shingle: int, threshold_percent: int) -> DataFrame:
    """``link``'s result with _nd_row (hash of id and text) and _nd_root (component, null for empty sets)."""
    made = ["n_shingles", "component_id", "kept"]
    least = least_matches(threshold_percent / 100)
    others = [c for c in docs.columns if c != text and c not in made]
    row = F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("\x00"), F.col(f"`{text}`").cast("string"))
    source = docs.withColumn("_nd_row", row)
    features = cut(sets(source.select(*(F.col(f"`{c}`") for c in others), "_nd_row", F.col(f"`{text}`").alias("_nd_source")), "_nd_source", shingle), "near-features")
    rows = features.count()
    grouped = features.where("_nd_n > 0").groupBy("_nd_c1", "_nd_c2").agg(F.min(F.col(f"`{key}`")).alias("lowest"), F.min("_nd_row").alias("place"), F.min("_nd_sig").alias("sig"))
    classes = written(grouped.select(_class().alias("c"), "lowest", "place", "sig"), "near-classes", rows)
    banded = buckets(classes)
    lead = banded.groupBy("bucket").agg(F.min("c").alias("a"), F.count("*").alias("n")).where("n > 1")
    full = written(banded.join(lead, "bucket"), "near-buckets", rows)
    stars = full.where("a != c").select("a", F.col("c").alias("b")).distinct()
    pairs = written(passed(stars, classes, least), "near-pairs", rows)
    links = written(verified(pairs, source, classes.select("c", "place"), text, shingle, threshold_percent, rows), "near-links", rows)
    roots = components(links, rows)
    labelled = full.join(roots, "c", "left").select("bucket", "band", "n", "c", F.coalesce("root", "c").alias("root"))
    open_ = labelled.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("bucket")
    rest = written(labelled.join(open_, "bucket", "left_semi"), "near-open", rows)
    if not rest.isEmpty():
        sized = full_sets(rest.select("c"), source, classes.select("c", "place"), text, shingle, rows).join(classes.select("c", "sig"), "c")
        more = written(compared(rest.join(sized, "c"), least, threshold_percent), "near-rest", rows)
        roots = components(links.unionByName(more), rows)
    rooted = classes.select("c", "lowest").join(roots, "c", "left").select("c", "lowest", F.coalesce("root", "c").alias("root"))
    names = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    known = rooted.join(names, "root").select(F.col("c._nd_c1").alias("_nd_c1"), F.col("c._nd_c2").alias("_nd_c2"), "component_id", F.col("root").alias("_nd_root"))
    joined = features.join(known, ["_nd_c1", "_nd_c2"], "left")
    id_ = F.col(f"`{key}`")
    component = F.when(F.col("_nd_n") == 0, id_).otherwise(F.col("component_id"))
    out = joined.select(*(F.col(f"`{c}`") for c in others), "_nd_row", "_nd_root", F.col("_nd_n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", id_.eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id.

    Texts without words all stay, except that a row which repeats id and text stays once.
    """
    linked = cut(_linked(docs.select(key, text), text, key, shingle, threshold_percent).select("_nd_row", "_nd_root", F.col(f"`{key}`").alias("_nd_key")), "near-linked")
    first = linked.where(F.col("_nd_root").isNotNull()).groupBy("_nd_root").agg(F.min(F.struct(F.col("_nd_key").isNull(), "_nd_key", "_nd_row")).alias("f")).select("f._nd_row")
    stay = first.unionByName(linked.where(F.col("_nd_root").isNull()).select("_nd_row"))
    marked = docs.withColumn("_nd_row", F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit("\x00"), F.col(f"`{text}`").cast("string")))
    out = marked.join(stay, "_nd_row", "left_semi")
    if not linked.groupBy("_nd_row").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["_nd_row"])
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: set size, component and whether it is the one that stays; three-word shingles, 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link(docs, shingle=3, threshold_percent=85).select("doc_id", "n_shingles", "component_id", "kept")
