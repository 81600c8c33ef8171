"""Removal of long repeated byte strings across the whole corpus.

A byte goes if it lies in a string of ``min_bytes`` bytes that also starts earlier: in a smaller
document id, or in the same document further left.  Matches don't cross documents; strings are judged
on the input.

1.  *Anchors.*  In every window of ``min_bytes`` bytes the k-gram with the smallest hash is an anchor.
    It depends on the window's content alone, so equal windows have equal anchors at equal offsets.
    With its surroundings (what all windows around an anchor can cover) it is a *segment*.
2.  *Runs.*  Anchors are range-partitioned and sorted by (anchor hash, segment hash, id, position) and
    streamed.  Segments equal to an earlier one are covered wholly.  What is left of an anchor's group
    is one representative for each distinct segment; groups with a single one need no further look.
    Range partitions split a group of any size; the groups at a partition's ends count as unfinished.
3.  *Expansion.*  Representatives fetch their bytes from their documents.  Groups are packed into blocks of
    bounded size; a block's Burrows-Wheeler transform is expanded breadth-first by backward extension,
    which derives the common prefixes of neighbouring suffixes by increasing value and stops at
    ``min_bytes``.  Neighbours without a value by then share a window; of each class of equal windows
    all but the earliest are covered.  Groups with more than ``GROUP_ROWS`` distinct segments don't
    fit a block: their windows are hashed (128 bits), range-partitioned by hash, sorted and streamed.
    Segments that share no half window to either side of the anchor with another are left out before.
4.  Covered ranges are merged per document and cut out.

A text above ``LONG_BYTES`` is walked in overlapping stretches, at about 50 bytes of memory a byte of a
stretch.  Equal segments are told by 128 bits: the hash of the anchor and that of the segment.

Null and empty texts have no bytes.  Ids must be integers.  Rows that repeat id and text are one document.  Rows that share
only the id are ordered by the CRC-32 of their text.  A null id comes before all others and takes the
smallest bigint's place internally.  An empty table gives an empty result; other columns pass through.
Internal names start with ``_sd_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_bytes, batch, chunks, cut, integer_key, sliced, small_enough, table

MIN_BYTES = 100
KGRAM = 32
#: Distinct segments of one anchor that are expanded in a block; larger groups are hashed.
GROUP_ROWS = 8000
BLOCK_BYTES = 1 << 19
BROADCAST_GROUPS = 100_000
NULL_ID = -(1 << 63)
FULL, REPRESENTATIVE = 0, 1
#: Bytes of a text whose anchors are sought at once; positions in them take POSITION_BITS of a key.
LONG_BYTES = 1 << 20
POSITION_BITS = 28
ANCHORS = pa.schema([("_sd_h", pa.int64()), ("_sd_seg", pa.int64()), ("_sd_id", pa.int64()), ("_sd_crc", pa.int64()), ("_sd_at", pa.int64())])
MARKS = pa.schema([("_sd_kind", pa.int32()), ("_sd_h", pa.int64()), ("_sd_id", pa.int64()), ("_sd_crc", pa.int64()), ("_sd_at", pa.int64())])
RANGES = pa.schema([("_sd_id", pa.int64()), ("_sd_crc", pa.int64()), ("_sd_from", pa.int64()), ("_sd_to", pa.int64())])
WINDOWS = pa.schema([("_sd_w1", pa.int64()), ("_sd_w2", pa.int64()), ("_sd_id", pa.int64()), ("_sd_crc", pa.int64()), ("_sd_from", pa.int64())])
LATER = pa.schema([*WINDOWS, ("_sd_end", pa.bool_())])
_BASE = 0x9E3779B97F4A7C15 | 1


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "binary": "binary", "bool": "boolean"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _byte_values() -> np.ndarray:
    return _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of each size (powers of two); entries near the end are unspecified."""
    h, size, power, out = _byte_values()[data], 1, _BASE, {}
    while True:
        if size in sizes:
            out[size] = h
        if size == max(sizes):
            return out
        follow = np.zeros_like(h)
        follow[:-size] = h[size:]
        h = h * np.uint64(power) + follow
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, size * 2


def anchors(texts: list[bytes], min_bytes: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: row, hash, segment hash, position, segment start, segment end (in its text)."""
    windows, lengths = min_bytes - KGRAM + 1, np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    long = np.flatnonzero(lengths >= min_bytes)
    if not len(long):
        return (np.zeros(0, np.int64),) * 6
    hashes = rolling(data, (KGRAM, 64))
    key = _mix(hashes[KGRAM])
    low = (key >> np.uint64(POSITION_BITS)) << np.uint64(POSITION_BITS) | np.arange(len(data), dtype=np.uint64)
    size = 1
    while size * 2 <= windows:
        low[:-size] = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = windows - size
    if rest:
        low[:-rest] = np.minimum(low[:-rest], low[rest:])
    starts = np.zeros(len(data) + 1, np.int64)
    starts[begins[long]] += 1
    np.add.at(starts, begins[long] + lengths[long] - min_bytes + 1, -1)
    chosen = (low[np.cumsum(starts[:-1]) > 0] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    at = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    row = np.searchsorted(begins, at, side="right") - 1
    left, right = np.maximum(begins[row], at - (windows - 1)), np.minimum(begins[row + 1], at + min_bytes)
    # Three blocks of 64 bytes cover a segment of 100 to 168 bytes; for other sizes the bytes are hashed.
    if min_bytes == MIN_BYTES:
        h64 = hashes[64]
        seg = _mix(h64[left]) * np.uint64(3) + _mix(h64[np.minimum(left + 52, right - 64)]) * np.uint64(5) + _mix(h64[right - 64]) * np.uint64(7)
        seg = _mix(seg + (at - left).astype(np.uint64) * np.uint64(1009) + (right - left).astype(np.uint64))
    else:
        seg = np.array([xxhash.xxh3_64_intdigest(data[a:b].tobytes(), seed=int(p - a)) for a, b, p in zip(left, right, at, strict=True)], dtype=np.uint64)
    return row, key[at].view(np.int64), seg.view(np.int64), at - begins[row], left - begins[row], right - begins[row]


def stretches(texts: list[bytes], min_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a chunk, at offset 0; or a long text in stretches that overlap by a window less a byte,
    so that every window lies in one of them, with their offsets."""
    if len(texts) > 1 or len(texts[0]) <= LONG_BYTES:
        yield 0, texts
        return
    for offset in range(0, max(1, len(texts[0]) - min_bytes + 1), LONG_BYTES):
        yield offset, [texts[0][offset : offset + LONG_BYTES + min_bytes - 1]]


def pack(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Position, bytes before it and bytes from it on, in one number that sorts by position."""
    return at << 24 | (at - left) << 12 | (right - at)


def unpack(packed):
    at = packed >> 24
    return at, at - (packed >> 12 & 4095), at + (packed & 4095)


def _identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("_sd_id", F.coalesce(integer_key(docs, key), F.lit(NULL_ID))).withColumn("_sd_text", whole).withColumn("_sd_crc", F.crc32("_sd_text"))


def anchor_rows(docs: DataFrame, min_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = as_bytes(b.column(2))
            ids, crcs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for start, end in chunks(texts):
                for offset, part in stretches(texts[start:end], min_bytes):
                    row, h, seg, at, left, right = anchors(part, min_bytes)
                    yield batch(ANCHORS, pa.array(h), pa.array(seg), pa.array(ids[start:end][row]), pa.array(crcs[start:end][row]), pa.array(pack(at + offset, left + offset, right + offset)))

    # distinct rows of one document would be each other's earlier copy at equal places; runs drop those below
    return arrow_map(docs.select("_sd_id", "_sd_crc", "_sd_text"), run, _ddl(ANCHORS))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a sorted partition: later copies of a segment, and representatives of groups with several."""

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return batch(MARKS, pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(np.ascontiguousarray(rows[:, c])) for c in (0, 2, 3, 4)))

    before = pending = None  # the last row; a group's only representative so far, if not yet emitted
    first_group, emitted = True, False
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
        joined = rows if before is None else np.concatenate([before, rows])
        same = joined[1:] == joined[:-1]
        if before is None:
            same = np.concatenate([np.zeros((1, 5), bool), same])
        new_group, new_segment = ~same[:, 0], ~(same[:, 0] & same[:, 1])
        repeated_row = same.all(axis=1)  # the same place again, from a repeated row of the table
        copies = rows[~new_segment & ~repeated_row]
        if len(copies):
            yield out(FULL, copies)
        starts = np.flatnonzero(new_group)
        goes_on = not len(starts) or starts[0] > 0
        edges = np.concatenate([[0], starts]) if goes_on else starts
        counts = np.add.reduceat(new_segment.astype(np.int64), edges)
        emit = counts >= 2
        if goes_on:
            if pending is not None and counts[0] >= 1:
                yield out(REPRESENTATIVE, pending)
                pending, emitted = None, True
            emit[0] = emitted or first_group
        else:
            emit[0] = emit[0] or before is None
            pending = None
            first_group = before is None
        emit = emit.copy()
        last = len(edges) - 1
        if last > 0:
            first_group, pending, emitted = False, None, bool(emit[last])
        else:
            emitted = bool(emit[0])
        chosen = np.repeat(emit, np.diff(np.concatenate([edges, [len(rows)]]))) & new_segment
        if chosen.any():
            yield out(REPRESENTATIVE, rows[chosen])
        if not emitted and pending is None:
            held = np.flatnonzero(new_segment[edges[last] :])
            if len(held):
                pending = rows[edges[last] + held[0]][None, :]
        before = rows[-1:]
    if pending is not None:
        yield out(REPRESENTATIVE, pending)


def suffixes(symbols: np.ndarray, least: int) -> np.ndarray:
    """Start positions of the suffixes, sorted by their first ``least`` symbols at least (9 bits each)."""
    n, width = len(symbols), 4
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << 9 | padded[j : j + n]
    while True:
        order, ordered = _sorted(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if width >= least or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[:-width] = rank[width:] + 1
        key, width = rank * (n + 1) + follow, width * 2


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and sorted keys; where both fit 63 bits the index rides along in one number."""
    bits = len(key).bit_length()
    if int(key.max()).bit_length() + bits <= 63:
        both = np.sort(key << bits | np.arange(len(key)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(key)
    return order, key[order]


def window_classes(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, class of each): neighbours are in one class if ``least`` symbols are equal.

    ``symbols`` must end in ``least`` zeros.  Intervals of the Burrows-Wheeler transform are extended
    backward breadth-first; an interval that ends at an entry without a value gives it the present depth.
    """
    n = len(symbols)
    order = suffixes(symbols, least)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")  # 16-bit numbers: a radix sort
    lf = np.empty(n, np.int64)  # symbols before in the alphabet, and equal ones before in the transform
    lf[by_symbol] = np.arange(n)
    symbol_at = bwt[by_symbol]
    known = np.zeros(n + 1, bool)
    known[n] = known[0] = True
    low, high = np.array([0]), np.array([n])
    for _depth in range(least):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        if len(inside) * 8 > n:  # places are distinct: writing to them sorts them
            owners = np.full(n, -1, np.int32)
            owners[lf[inside]] = owner
            place = np.flatnonzero(owners >= 0)
            owner = owners[place]
        else:
            reached = np.sort(lf[inside] << 32 | owner)
            place, owner = reached >> 32, reached & 0xFFFFFFFF
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (symbol_at[place[1:]] != symbol_at[place[:-1]])) + 1
        new_low, new_high = place[np.concatenate([[0], edge])], place[np.concatenate([edge - 1, [len(place) - 1]])] + 1
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
    return order, np.cumsum(known[:-1])


def block_ranges(segments: list[bytes], ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments that have an equal, earlier one: (segment, start, end) of merged ranges."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(segments) + least + 1, np.int16)
    for a, s in zip(begins.tolist(), segments, strict=True):
        symbols[a : a + len(s)] = np.frombuffer(s, np.uint8)
        symbols[a : a + len(s)] += 1
    order, classes = window_classes(symbols, least)
    segment = np.searchsorted(begins, order, side="right") - 1
    inside = order - begins[segment]
    valid = inside + least <= sizes[segment]
    segment, inside, classes = segment[valid], inside[valid], classes[valid]
    equal = classes[1:] == classes[:-1]
    shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])  # windows alone in their class go nowhere
    segment, inside, classes = segment[shared], inside[shared], classes[shared]
    if not len(segment):
        return (np.zeros(0, np.int64),) * 3
    first = np.lexsort((starts[segment] + inside, crcs[segment], ids[segment], classes))
    segment, inside, classes = segment[first], inside[first], classes[first]
    place = starts[segment] + inside
    lead = np.concatenate([[True], classes[1:] != classes[:-1]])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    earliest = (ids[segment] == ids[segment[head]]) & (crcs[segment] == crcs[segment[head]]) & (place == place[head])
    segment, place = segment[~earliest], place[~earliest]
    again = np.lexsort((place, segment))
    segment, place = segment[again], place[again]
    if not len(segment):
        return (np.zeros(0, np.int64),) * 3
    cut_at = np.concatenate([[True], (segment[1:] != segment[:-1]) | (place[1:] > place[:-1] + least)])
    return segment[cut_at], place[cut_at], place[np.concatenate([np.flatnonzero(cut_at)[1:] - 1, [len(place) - 1]])] + least


def promising(rows: list[tuple[int, int, int, int, int, bytes]], least: int) -> list[int]:
    """Rows that may share a window: a window reaches half of what isn't the anchor to one side at least,
    and there another segment of the group must be equal.  Rows: (anchor, id, crc, start, place, bytes)."""
    half, digest = (least - KGRAM + 1) // 2, xxhash.xxh3_64_intdigest
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    stay = np.zeros(len(rows), bool)
    for side in (0, 1):
        keys = np.array([digest(r[5][max(0, r[4] - half) : r[4] + KGRAM] if side else r[5][r[4] : r[4] + KGRAM + half]) for r in rows], np.uint64)
        both = _mix(h + np.uint64(side)) + keys
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        stay[order[1:][same]] = True
        stay[order[:-1][same]] = True
    return np.flatnonzero(stay).tolist()


def expanded(least: int):
    """Stream representatives sorted by anchor; whole groups are gathered into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # rows of the present anchor
        block: list[tuple] = []  # promising rows of whole groups
        waiting: list[tuple] = []  # whole groups not looked at yet
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if block:
                ids, crcs, starts = (np.array([r[c] for r in block], np.int64) for c in (1, 2, 3))
                segment, start, end = block_ranges([r[5] for r in block], ids, crcs, starts, least)
                block.clear()
                size = 0
                yield batch(RANGES, pa.array(ids[segment]), pa.array(crcs[segment]), pa.array(start), pa.array(end))

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for i in promising(waiting, least):
                if size >= BLOCK_BYTES and block[-1][0] != waiting[i][0]:
                    yield from flush()
                block.append(waiting[i])
                size += len(waiting[i][5]) + 1
            waiting.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][0] != row[0]:
                    waiting += group
                    group = []
                    if len(waiting) >= GROUP_ROWS:
                        yield from look()
                group.append(row)
        waiting += group
        if waiting:
            yield from look()
        yield from flush()

    return run


def hashed_windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, row, place = [], [], []
            for i, (start, seg) in enumerate(zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)):
                for o in range(len(seg) - least + 1):
                    digests.append(xxhash.xxh3_128_digest(seg[o : o + least]))
                    row.append(i)
                    place.append(start + o)
            w = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, type=pa.int64())
            yield batch(WINDOWS, pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1])), b.column(1).take(at), b.column(2).take(at), pa.array(place, type=pa.int64()))

    return run


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream windows sorted by hash and place: all but the first of each hash, and the first of the runs
    at both ends (those may have begun in the partition before)."""

    def out(rows: np.ndarray, end: bool) -> pa.RecordBatch:
        return batch(LATER, *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(5)), pa.array(np.full(len(rows), end)))

    before = lead = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
        joined = rows if before is None else np.concatenate([before, rows])
        same = joined[1:] == joined[:-1]
        if before is None:
            same = np.concatenate([np.zeros((1, 5), bool), same])
            yield out(rows[:1], True)
        again = same[:, :2].all(axis=1)
        starts = np.flatnonzero(~again)
        if len(starts):
            lead = rows[starts[-1]][None, :]
        later = rows[again & ~same.all(axis=1)]
        if len(later):
            yield out(later, False)
        before = rows[-1:]
    if lead is not None:
        yield out(lead, True)


def repeated_ranges(docs: DataFrame, text: str = "text", key: str = "doc_id", min_bytes: int = MIN_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(_sd_id, _sd_crc, _sd_from, _sd_to): byte ranges that repeat something earlier; they may overlap."""
    if not 2 * KGRAM < min_bytes <= 2048:
        raise ValueError(f"min_bytes must be above {2 * KGRAM} and at most 2048")
    spark = docs.sparkSession
    source = _identified(docs, text, key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [f.name for f in ANCHORS]
    dealt = anchor_rows(source, min_bytes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marks = cut(arrow_map(dealt, runs, _ddl(MARKS)), "anchor-marks")
    at = F.col("_sd_at")
    before, after = F.shiftright(at, 12).bitwiseAND(F.lit(4095)), at.bitwiseAND(F.lit(4095))
    place = F.shiftright(at, 24)
    copies = marks.where(F.col("_sd_kind") == FULL).select("_sd_id", "_sd_crc", (place - before).alias("_sd_from"), (place + after).alias("_sd_to"))
    kept = marks.where(F.col("_sd_kind") == REPRESENTATIVE).drop("_sd_kind")
    large = cut(kept.groupBy("_sd_h").agg(F.count("*").alias("_sd_n")).where(F.col("_sd_n") > group_rows).select("_sd_h", F.lit(True).alias("_sd_large")), "large-anchors")
    large = F.broadcast(large) if small_enough(large, BROADCAST_GROUPS) else large
    places = kept.join(large, "_sd_h", "left").groupBy("_sd_id", "_sd_crc").agg(F.collect_list(F.struct("_sd_h", "_sd_at", F.coalesce("_sd_large", F.lit(False)).alias("_sd_large"))).alias("_sd_places"))
    fetched = source.select("_sd_id", "_sd_crc", "_sd_text").join(places, ["_sd_id", "_sd_crc"]).select("_sd_id", "_sd_crc", "_sd_text", "_sd_places")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_sd_h", pa.int64()), ("_sd_id", pa.int64()), ("_sd_crc", pa.int64()), ("_sd_from", pa.int64()), ("_sd_place", pa.int32()), ("_sd_bytes", pa.binary()), ("_sd_large", pa.bool_())])
        for b in sliced(batches, 2):
            rows = []
            for id_, crc, data, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for p in wanted:
                    place, left, right = unpack(p["_sd_at"])
                    rows.append((p["_sd_h"], id_, crc, left, place - left, data[left:right], p["_sd_large"]))
            yield batch(schema, *(list(zip(*rows, strict=True)) if rows else [[]] * 7))

    segments = cut(arrow_map(fetched, fetch, "_sd_h bigint, _sd_id bigint, _sd_crc bigint, _sd_from bigint, _sd_place int, _sd_bytes binary, _sd_large boolean"), "segments")
    small = segments.where(~F.col("_sd_large")).drop("_sd_large").repartition(parts, "_sd_h").sortWithinPartitions("_sd_h")
    expanded_ranges = arrow_map(small, expanded(min_bytes), _ddl(RANGES))
    found = copies.unionByName(expanded_ranges)
    if not large.isEmpty():
        big = segments.where("_sd_large").drop("_sd_large")
        names = [f.name for f in WINDOWS]
        windows = arrow_map(big, hashed_windows(min_bytes), _ddl(WINDOWS)).repartitionByRange(parts, *names).sortWithinPartitions(*names)
        seen = cut(arrow_map(windows, later_windows, _ddl(LATER)), "windows")
        # Leads of the runs at the partitions' ends, two rows for each: all but a window's very first are later ones.
        keys = ["_sd_w1", "_sd_w2"]
        where = F.struct("_sd_id", "_sd_crc", "_sd_from")
        ends = seen.where("_sd_end")
        first = ends.groupBy(*keys).agg(F.min(where).alias("_sd_first"))
        more = ends.join(F.broadcast(first), keys).where(where != F.col("_sd_first"))
        later = seen.where("not _sd_end").select("_sd_id", "_sd_crc", "_sd_from").unionByName(more.select("_sd_id", "_sd_crc", "_sd_from"))
        found = found.unionByName(later.select("_sd_id", "_sd_crc", "_sd_from", (F.col("_sd_from") + min_bytes).alias("_sd_to")))
    return found


def cut_out(data: bytes, ranges: list[int]) -> tuple[bytes, int, int]:
    """What stays, bytes removed and maximal removed runs; ranges are packed as from << 24 | length."""
    if not ranges:
        return data, 0, 0
    packed = np.sort(np.array(ranges, np.int64))
    start, end = packed >> 24, (packed >> 24) + (packed & 0xFFFFFF)
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", min_bytes: int = MIN_BYTES, digest: bool = False, **sizes) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans and kept (binary: removal may cut a
    character; with ``digest`` kept_sha256 instead)."""
    name = "kept_sha256" if digest else "kept"
    made = ["n_bytes", "n_removed", "n_spans", name]
    ranges = repeated_ranges(docs, text, key, min_bytes, **sizes)
    lists = ranges.groupBy("_sd_id", "_sd_crc").agg(F.collect_set(F.shiftleft("_sd_from", 24).bitwiseOR(F.col("_sd_to") - F.col("_sd_from"))).alias("_sd_ranges"))
    others = [c for c in docs.columns if c != text and c not in made]
    rows = _identified(docs, text, key).join(lists, ["_sd_id", "_sd_crc"], "left").select(*(F.col(f"`{c}`") for c in others), "_sd_text", "_sd_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, -2):
            texts = as_bytes(b.column(b.num_columns - 2))
            done = [cut_out(t, r) for t, r in zip(texts, b.column(b.num_columns - 1).to_pylist(), strict=True)]
            stay = pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string()) if digest else pa.array([d[0] for d in done], pa.binary())
            arrays = [pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), stay]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *arrays], names=[*b.schema.names[:-2], *made])

    schema = rows.drop("_sd_text", "_sd_ranges").schema
    for n in made[:3]:
        schema = schema.add(n, T.LongType())
    return arrow_map(rows, run, schema.add(name, T.StringType() if digest else T.BinaryType()))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
