"""Secret scan with structural confirmation.

Base spans are pattern matches (assignments, access keys, long hex runs) and always reported.  The
method adds spans whose *structure* proves what they are:

* ``der``: base64 or hex that decodes to one ASN.1 DER value whose nested lengths fill their parents
  exactly and which has the versions, algorithm identifiers and fields of a private or public key or of
  a certificate;
* ``openssh``: base64 of an OpenSSH private key, whose length-prefixed fields, those of its public
  blocks included, are in bounds and name a key type;
* ``jwt``: three base64url parts, of which the first decodes to a JSON object with an ``alg``.

Positions are code points, ends exclusive.  Null and empty texts have no spans.  Texts are scanned
whole, in one pass per pattern, whatever their length.  Rows are independent, so repeated rows get equal
spans and ids of any type pass through like all other columns, but for ``secret_spans``, which is
replaced.  Ill-formed UTF-8 is read as U+FFFD.  An empty table gives an empty result.  Where several kinds
begin at one place, the kinds' order decides which is listed first.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.llm.common import arrow_map, as_texts, sliced, table

KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Where base64 of a DER sequence (0x30 is ``M``) or of an OpenSSH key can begin.
START = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=-----))(?:M[A-Za-z0-9+/_-]|b3Bl)")
#: The rest of a line in either alphabet; dashes of a PEM boundary belong to none.
ALPHABETS = (re.compile("[A-Za-z0-9+/]+"), re.compile("(?:[A-Za-z0-9_]|-(?!----))+"))
BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
PADDING = re.compile("={0,2}")
LEAST_BASE64 = 40
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
#: DER tags whose content is a sequence of DER values.
NESTING = {0x30, 0x31, 0xA0, 0xA1, 0xA2, 0xA3}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
OPENSSH = b"openssh-key-v1\x00"
MOST_DEPTH = 16


def der_values(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, or None if they don't."""
    found = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:  # DER asks for the short form
                return None
        if at + size > end:
            return None
        if tag in NESTING and (depth >= MOST_DEPTH or der_values(data, at, at + size, depth + 1) is None):
            return None
        found.append((tag, at, at + size))
        start = at + size
    return found


def _integer(data: bytes, value: tuple[int, int, int]) -> int | None:
    """A small INTEGER's number; None for other tags and for long ones."""
    tag, start, end = value
    return int.from_bytes(data[start:end], "big") if tag == 0x02 and 0 < end - start <= 2 else None


def _algorithm(data: bytes, value: tuple[int, int, int]) -> bool:
    """A SEQUENCE that begins with an OBJECT IDENTIFIER."""
    inner = der_values(data, value[1], value[2]) if value[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06 and 1 <= len(inner) <= 2


def is_der_key(data: bytes) -> bool:
    """Whether ``data`` is one DER sequence with the fields of a known key encoding or of a certificate.

    PKCS#1 private (version 0 or 1 and eight integers or more) and public (modulus and a smaller exponent), DSA
    (version 0 and five integers), PKCS#8 (version, algorithm, octets), SEC1 (version 1, octets, curve or
    point), encrypted PKCS#8 (algorithm, octets), SPKI (algorithm, bits), X.509 (body, algorithm, bits).
    A signature, which is two integers of like size, is none of them.
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_values(data, 0, len(data))
    if top is None or len(top) != 1:
        return False
    inner = der_values(data, top[0][1], top[0][2])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    sizes = [end - start for _, start, end in inner]
    if tags[0] == 0x02:
        version = _integer(data, inner[0])
        if all(t == 0x02 for t in tags) and len(tags) == 2:
            return sizes[0] >= 64 and sizes[1] <= 8  # modulus and exponent
        if set(tags[:9]) == {0x02} and len(tags) in (9, 10):
            return version in (0, 1) and sizes[1] >= 32
        if set(tags) == {0x02} and len(tags) == 6:
            return version == 0 and sizes[1] >= 64
        if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
            return version in (0, 1) and _algorithm(data, inner[1])
        return version == 1 and tags[1] == 0x04 and sizes[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 0x03] or tags == [0x30, 0x04]:
        return _algorithm(data, inner[0]) and sizes[1] >= 16
    if tags == [0x30, 0x30, 0x03]:
        return _algorithm(data, inner[1]) and sizes[2] >= 16 and len(der_values(data, inner[0][1], inner[0][2]) or []) >= 6
    return False


def _fields(data: bytes, at: int, end: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` length-prefixed fields from ``at`` on and where they end; None if they pass ``end``."""
    found = []
    for _ in range(n):
        if at + 4 > end:
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > end:
            return None
        found.append(data[at : at + size])
        at += size
    return found, at


def is_openssh_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: cipher names, public blocks whose first field names the
    key's type, and a private block of whole cipher blocks that, unless encrypted, repeats its check number."""
    if not data.startswith(OPENSSH):
        return False
    head = _fields(data, len(OPENSSH), len(data), 3)
    if head is None:
        return False
    (cipher, derivation, _), at = head
    n = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
    if not 1 <= n <= 64 or not cipher or not derivation or (cipher == b"none") != (derivation == b"none"):
        return False
    rest = _fields(data, at + 4, len(data), n + 1)
    if rest is None:
        return False
    *public, private = rest[0]
    for block in public:
        name = _fields(block, 0, len(block), 1)
        if name is None or not re.fullmatch(rb"[a-z0-9@.-]{5,64}", name[0][0]):
            return False
    if len(private) < 8 or len(private) % 8:
        return False
    return cipher != b"none" or private[:4] == private[4:8]


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes) -> int:
    """The length that a DER header states, with the header; 0 if there is none."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    if data[1] < 0x80:
        return 2 + data[1]
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 and len(data) >= 2 + n else 0


def base64_key(text: str, start: int) -> tuple[str, int] | None:
    """(kind, end) of the key whose base64 begins at ``start``; lines are added until its length is reached."""
    for alphabet in ALPHABETS:
        pieces, count, at, size, ends = [], 0, start, 0, []
        while m := alphabet.match(text, at):
            pieces.append(m[0])
            count, at = count + len(m[0]), m.end()
            ends.append((count, at))
            if not size and count >= 8 and text[start] == "M":
                head = unbase64("".join(pieces)[:8])
                size = der_length(head) if head else 0
                if not size:
                    break
            if size and count >= -(-size * 4 // 3):
                break
            if not (more := BREAK.match(text, at)):
                break
            at = more.end()
        whole = "".join(pieces)
        if text[start] == "M":
            if size and count == -(-size * 4 // 3) and count >= LEAST_BASE64 and (data := unbase64(whole)) is not None and is_der_key(data):
                return "der", PADDING.match(text, ends[-1][1]).end()
            continue
        if not (unbase64(whole[:20]) or b"").startswith(OPENSSH):
            continue
        for n, end in reversed(ends):
            if n >= LEAST_BASE64 and (data := unbase64(whole[:n])) is not None and is_openssh_key(data):
                return "openssh", PADDING.match(text, end).end()
    return None


def is_token_header(part: str) -> bool:
    data = unbase64(part)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    at = 0
    while m := START.search(text, at):
        at = m.end()
        if key := base64_key(text, m.start()):
            found.append((key[0], m.start(), key[1]))
            at = key[1]
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
            found.append(("der", m.start(), m.end()))
    found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_token_header(m[1])]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[1], order[s[0]], s[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column secret_spans: array of (kind, start, end)."""
    kept = docs.drop("secret_spans").withColumn("_secret_text", F.col(f"`{text}`").cast("string"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] if t else [] for t in as_texts(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, type=kind)], names=[*b.schema.names[:-1], "secret_spans"])

    return arrow_map(kept, run, kept.drop("_secret_text").schema.add("secret_spans", SPANS))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of base spans, a digest of them, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")

    def joined(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("secret_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
