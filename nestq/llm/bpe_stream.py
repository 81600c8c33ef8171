"""BPE encoding and decoding as streaming transducers with constant memory.

Encoding.  A byte-level merge list has a *sufficient lookahead* L: how text is cut up to a position
depends on at most L bytes after it.  ``sufficient_lookahead`` derives L from the list.  A merge
(u, v) of rank r can only be undone from the right by a merge of lower rank whose left operand lies
on the right spine of v (v itself, its right part, that part's right part, ...).  Ranks fall along
such a chain, so one pass over the merges in rank order gives the longest chain in bytes.

``tokens`` is the transducer: it walks the text in stretches of ``STRETCH`` characters that end where
no piece can go on (before a space between two other characters), cuts each into pieces, and runs
each piece through a window of bytes.  Tokens that end L bytes or more before the end of the window
are final and leave, and encoding resumes at the last final boundary.  Nothing merges across a final
boundary, so both sides stand alone and the result is that of the whole piece.  A piece that fits the
window is its own last window; what it becomes is remembered in a table of bounded size.  So a stretch
and a window are all that is held, however long the text is; a text without spaces is one stretch.
Where a vocabulary's tokens are so long that none ends before the stable point, the window doubles.

Decoding.  Token bytes run through an incremental UTF-8 state machine which holds at most three
pending bytes; ill-formed sequences become U+FFFD.  With ``digest`` ids and decoded text run on into
their hashes and are never held either.

Nulls and empty texts give no tokens and decode to the empty text.  Ill-formed UTF-8 in a text is read
as U+FFFD.  Rows are independent, so repeated rows get equal results, ids of any type and other columns
pass through untouched; columns of the result's names are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_texts, sliced, table

#: Fixed value: the pattern that splits text before byte-level merges, with the white space of Unicode spelled out.
_S = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: The same split for texts below U+0250, whose letters and numbers fit a short class that is faster to scan.
_L, _N = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Bytes of a piece that are merged at once, at least; twice the lookahead if that is more.
WINDOW = 512
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 16
#: Pieces that a worker remembers with their tokens, in two generations of this size; the older one goes.
REMEMBERED = 250_000
#: Where a stretch may end: a space between two characters that are no white space starts a piece.
SAFE = re.compile(rf"[^{_S}](?=\x20[^{_S}])")
#: Stands for the rank of a pair that no merge joins.
NONE = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token's end that can change it; ``merges`` are (left, right, made) in rank order."""
    right_part = {made: right for _, right, made in merges}
    reach: dict[int, int] = {}  # by left operand: the longest chain that starts with one of its merges
    most = 0
    for left, right, _made in merges:
        node, chain = right, 0
        while True:
            chain = max(chain, reach.get(node, 0))
            if node not in right_part:
                break
            node = right_part[node]
        chain += length[right]
        if chain > reach.get(left, 0):
            reach[left] = chain
            most = max(most, chain)
    return most


class Transducer:
    """Encoder and decoder for one byte-level BPE file in the JSON format of public tokenizers."""

    def __init__(self, content: str, window: int = WINDOW):
        spec = json.loads(content)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.token_bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.first = [vocab[c] for c in symbols]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): n for n, (a, b, _) in reversed(list(enumerate(merges)))}
        self.made = [made for _, _, made in merges]
        self.lookahead = sufficient_lookahead(merges, {i: len(x) for i, x in self.token_bytes.items()})
        self.window = max(window, 2 * self.lookahead + 64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: t.encode() for t, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces, self.latin = regex.compile(PATTERN), re.compile(LATIN)
        self.is_latin = re.compile("[\0-\u024f]*").fullmatch
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one piece, by repeatedly merging the leftmost pair of lowest rank."""
        ids = [self.first[b] for b in data]
        rank = self.rank
        if len(ids) > 48:
            return self._merge_heap(ids)
        get, made = rank.get, self.made
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            ids[at] = token = made[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], token), NONE)
            if at < len(ranks):
                ranks[at] = get((token, ids[at + 1]), NONE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[rank[a, b]], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (ids[i], ids[after[j]])) in rank:
                    heapq.heappush(heap, (rank[p], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in rank:
                heapq.heappush(heap, (rank[p], before[i], *p))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of a long piece, emitted as soon as no later byte can change them."""
        start, window = 0, self.window
        while len(data) - start > window:
            part = data[start : start + window]
            end, stable = 0, len(part) - self.lookahead
            for token in self.merge(part):
                if end + len(self.token_bytes[token]) > stable:
                    break
                end += len(self.token_bytes[token])
                yield token
            start += end
            window = self.window if end else 2 * window
        yield from self.merge(data[start:])

    def stretches(self, part: str) -> Iterator[str]:
        """``part`` in stretches which are cut into pieces as the whole would be."""
        start, size = 0, len(part)
        while size - start > STRETCH:
            found = None
            for m in SAFE.finditer(part, start + STRETCH):
                found = m.start() + 1
                break
            if found is None:
                break
            yield part[start:found]
            start = found
        yield part[start:] if start else part

    def tokens(self, text: str) -> Iterator[list[int]]:
        """The text's tokens, a list for each stretch."""
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                yield [self.special[part]]
                continue
            for stretch in self.stretches(part):
                yield self._pieces(stretch)

    def _pieces(self, stretch: str) -> list[int]:
        ids: list[int] = []
        known, get = self.known, self.known.get
        for piece in (self.latin if self.is_latin(stretch) else self.pieces).findall(stretch):
            found = get(piece)
            if found is None:
                data = piece.encode()
                if len(data) > self.window:
                    ids.extend(self.stream(data))
                    continue
                found = self.older.get(piece) or tuple(self.stream(data))
                if len(known) >= REMEMBERED:
                    self.older, known = known, {}
                    self.known, get = known, known.get
                known[piece] = found
            ids += found
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.tokens(text) for i in ids]

    def texts(self, ids: Iterable[list[int]], at_once: int = 4096) -> Iterator[str]:
        """Text of lists of tokens as it comes; special tokens are kept, ill-formed bytes become U+FFFD."""
        machine, of = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.token_bytes.__getitem__
        for some in ids:
            for start in range(0, len(some), at_once):
                yield machine.decode(b"".join(map(of, some[start : start + at_once])))
        yield machine.decode(b"", final=True)

    def decode(self, ids: list[int], at_once: int = 4096) -> str:
        return "".join(self.texts([ids], at_once))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the decimal ids with commas between, digest of the decoded text."""
        n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.tokens(text):
                if ids:
                    of_ids.update(("," if n else "").encode() + ",".join(map(str, ids)).encode())
                    n += len(ids)
                yield ids

        for part in self.texts(seen()):
            of_text.update(part.encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()


def transducer(content: str) -> Transducer:
    """The transducer for this file; a worker builds it once and keeps it for its later tasks."""
    kept = sys.modules.setdefault("_nestq_transducers", types.ModuleType("_nestq_transducers")).__dict__
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in kept:
        kept[key] = Transducer(content)
    return kept[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with the columns bpe_ids, bpe_decoded (or, with ``digest``, their count and digests).

    The vocabulary file is read on the driver and travels with the function; its size is that of the
    file and does not depend on the data.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    made = [("bpe_n_tokens", pa.int64()), ("bpe_ids_sha256", pa.string()), ("bpe_decoded_sha256", pa.string())] if digest else [("bpe_ids", pa.list_(pa.int32())), ("bpe_decoded", pa.string())]
    clash = {name for name, _ in made} & set(docs.columns)
    kept = docs.drop(*clash).withColumn("_bpe_text", F.col(f"`{text}`").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(content.value)
        for b in sliced(batches, rows=256):
            out: list[list] = [[] for _ in made]
            for s in as_texts(b.column(b.num_columns - 1)):
                if digest:
                    row = coder.digests(s or "")
                else:
                    ids = coder.encode(s or "")
                    row = (ids, coder.decode(ids))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            arrays = [*b.columns[:-1], *(pa.array(c, type=t) for c, (_, t) in zip(out, made, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], *(n for n, _ in made)])

    schema = kept.drop("_bpe_text").schema
    for name, kind in made:
        schema = schema.add(name, {"int64": T.LongType(), "string": T.StringType()}.get(str(kind), T.ArrayType(T.IntegerType())))
    return arrow_map(kept, run, schema)


def op8_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of tokens, digest of the ids, digest of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_decode(docs, digest=True)
    return found.select("doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))
