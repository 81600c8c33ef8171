"""Ion documents: text and binary reading, text writing, graphs.

Files are read by Spark (so from any store) and parsed as they come, a value at a time; gzip and zstandard
are told by their magic bytes.  ``scan_ion`` gives a VARIANT per top-level value; ``read_ion`` gives typed columns
inferred from all values.
"""

from __future__ import annotations

import base64
import functools
import gzip
import io
import itertools
import json
import re
from collections.abc import Generator, Iterable, Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestq.ast import QueryError


class Symbol(str):
    """A symbol; a string otherwise."""


class Timestamp(str):
    """A timestamp in its text form."""


class SExp(list):
    """An s-expression."""


class Struct(list):
    """Field (name, value) pairs in order; names may repeat."""

    def get(self, name: str, default: Any = None) -> Any:
        return next((v for k, v in self if k == name), default)


class Annotated:
    """A value with annotations."""

    def __init__(self, names: list[str], value: Any):
        self.names, self.value = names, value


_TOKEN = re.compile(
    r"""(?P<space>(?:\s+|//[^\n]*|/\*.*?\*/)+)
      | (?P<long>'''(?:[^'\\]|\\.|'(?!''))*''')
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<symbol>'(?:[^'\\]|\\.)*')
      | (?P<time>\d{4}(?:T|-\d\d(?:T|-\d\d(?:T(?:\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d))?)?)))
      | (?P<number>[+-]inf\b|-?0[xX][0-9A-Fa-f_]+|-?0[bB][01_]+|-?\d[\d_]*(?:\.[\d_]*)?(?:[eEdD][+-]?\d+)?)
      | (?P<blob>\{\{.*?\}\})
      | (?P<annotate>::)
      | (?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
      | (?P<op>[\[\]{}(),:])
      | (?P<operator>[-!#%&*+./;<=>?@^`|~]+)
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": ""}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "xuU" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


#: What ends a token that goes on over lines, by what opens it.
_CLOSES = {"'''": r"(?:[^'\\]|\\.|'(?!''))*'''", '"': r'(?:[^"\\]|\\.)*"', "'": r"(?:[^'\\]|\\.)*'", "/*": r".*?\*/", "{{": r".*?\}\}"}
_CLOSES = {k: re.compile(x, re.DOTALL) for k, x in _CLOSES.items()}


def _tokens(lines: Iterable[str], closed: bool = False, offer: bool = False) -> Generator[tuple[str, str], Any, None]:
    """The tokens of a text that comes in lines; with ``closed`` one that its end leaves open is an error.

    With ``offer`` a line that begins like a collection comes first, as ("line", its text); its tokens only
    come if the caller does not send that it took the line.
    """
    held: list[str] = []  # an open token and what follows it, until the line that closes it
    end = None
    for line in lines:
        if end is not None:
            held.append(line)
            if not end.match(line):
                continue
            line, held, end = "".join(held), [], None
        elif offer and line.lstrip()[:1] in ("{", "[") and (yield "line", line):
            continue
        at = 0
        for m in _TOKEN.finditer(line):
            kind, t = m.lastgroup, m[0]
            if m.start() != at or (kind == "op" and line.startswith("{{", at)) or (kind == "symbol" and line.startswith("'''", at)) or (kind == "operator" and t.startswith("/*")):
                break
            at = m.end()
            if kind != "space":
                yield kind, t
        if at < len(line):
            opened = next((k for k in _CLOSES if line.startswith(k, at)), None)
            if opened is None:
                raise QueryError(f"Ion: unexpected {line[at]!r} at {at}")
            held, end = [line[at:]], _CLOSES[opened]
    if held and closed:
        raise QueryError("Ion: unexpected end")
    line, at = "".join(held), 0
    while at < len(line):
        m = _TOKEN.match(line, at)
        if not m:
            raise QueryError(f"Ion: unexpected {line[at]!r} at {at}")
        if m.lastgroup != "space":
            yield m.lastgroup, m[0]
        at = m.end()


def _starts(token: tuple[str, str]) -> bool:
    """Whether a token can only begin a value: it neither goes on with the one before nor ends it."""
    return token[0] not in ("annotate", "operator", "long") and (token[0] != "op" or token[1] in "[({")


def _values(lines: Iterable[str]) -> Iterator[Any]:
    """The top-level values of a text, parsed one by one."""
    held, depth = [], 0
    for t in _tokens(lines):
        if depth == 0 and held and _starts(t) and held[-1][0] not in ("annotate", "operator"):
            yield from _Text(held).values()
            held = []
        held.append(t)
        if t[0] == "op":
            depth += 1 if t[1] in "[({" else -1 if t[1] in "])}" else 0
    yield from _Text(held).values()


_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_SIMPLE = re.compile(r"\s*[\[{][\w\s\[\]{}:,.$+-]*")


def _whole(line: str) -> bool:
    """Whether a line holds whole values, which neither the line before nor the next one goes on with."""
    simple = _STRING.sub("0", line) if '"' in line else line
    if _SIMPLE.fullmatch(simple) and "::" not in simple and "{{" not in simple and simple.rstrip()[-1] in "]}":
        tokens = [("op", x) for x in re.findall(r"[\[\]{}]", simple)]
    else:
        try:
            tokens = list(_tokens([line], closed=True))
        except QueryError:
            return False
        if tokens and (not _starts(tokens[0]) or tokens[-1][0] in ("annotate", "operator")):
            return False
    depth = 0
    for kind, t in tokens:
        if kind == "op":
            depth += 1 if t in "[({" else -1 if t in "])}" else 0
            if depth < 0:
                return False
    return depth == 0


class _Text:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens = [*tokens, ("end", "")]
        self.at = 0

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def values(self) -> list:
        found = []
        while self.now[0] != "end":
            v = self.value()
            if not (isinstance(v, Symbol) and v == "$ion_1_0"):
                found.append(v)
        return found

    def value(self, inside_sexp: bool = False) -> Any:
        names = []
        while self.now[0] in ("word", "symbol") and self.tokens[self.at + 1][0] == "annotate":
            kind, t = self.next()
            names.append(_unescape(t[1:-1]) if kind == "symbol" else t)
            self.next()
        v = self.plain(inside_sexp)
        return Annotated(names, v) if names else v

    def plain(self, inside_sexp: bool) -> Any:
        kind, t = self.next()
        if kind == "string":
            return _unescape(t[1:-1])
        if kind == "long":
            parts = [_unescape(t[3:-3])]
            while self.now[0] == "long":
                parts.append(_unescape(self.next()[1][3:-3]))
            return "".join(parts)
        if kind == "symbol":
            return Symbol(_unescape(t[1:-1]))
        if kind == "time":
            return Timestamp(t)
        if kind == "number":
            return _number(t)
        if kind == "blob":
            inner = t[2:-2].strip()
            if inner.startswith('"'):
                return _unescape(inner[1:-1]).encode("latin-1")
            if inner.startswith("'''"):
                return _unescape(inner[3:-3]).encode("latin-1")
            return base64.b64decode(inner)
        if kind == "word":
            if t == "null":
                if self.now == ("operator", ".") and self.tokens[self.at + 1][0] == "word":
                    self.at += 2
                return None
            return {"true": True, "false": False, "nan": float("nan")}.get(t, Symbol(t))
        if kind == "op" and t == "[":
            return self.items("]")
        if kind == "op" and t == "(":
            found = SExp()
            while self.now != ("op", ")"):
                if self.now[0] == "end":
                    raise QueryError("Ion: unclosed s-expression")
                found.append(self.value(True))
            self.next()
            return found
        if kind == "op" and t == "{":
            found = Struct()
            while self.now != ("op", "}"):
                kind, key = self.next()
                if kind not in ("word", "symbol", "string", "long"):
                    raise QueryError(f"Ion: expected a field name, found {key!r}")
                key = key if kind == "word" else _unescape(key[3:-3] if kind == "long" else key[1:-1])
                if self.next() != ("op", ":"):
                    raise QueryError("Ion: expected ':'")
                found.append((key, self.value()))
                if self.now == ("op", ","):
                    self.next()
                elif self.now != ("op", "}"):
                    raise QueryError("Ion: expected ',' or '}'")
            self.next()
            return found
        if kind == "operator" and inside_sexp:
            return Symbol(t)
        raise QueryError(f"Ion: unexpected {t!r}" if kind != "end" else "Ion: unexpected end")

    def items(self, close: str) -> list:
        found = []
        while self.now != ("op", close):
            found.append(self.value())
            if self.now == ("op", ","):
                self.next()
            elif self.now != ("op", close):
                raise QueryError(f"Ion: expected ',' or {close!r}")
        self.next()
        return found


def _number(t: str) -> Any:
    t = t.replace("_", "")
    if t.endswith("inf"):
        return float(t)
    sign = -1 if t.startswith("-") else 1
    body = t.lstrip("-")
    if body[:2].lower() in ("0x", "0b"):
        return sign * int(body[2:], 16 if body[1] in "xX" else 2)
    if "e" in t or "E" in t:
        return float(t)
    if "." in t or "d" in t or "D" in t:
        return Decimal(t.lower().replace("d", "e"))
    return int(t)


def _symbols() -> list[str]:
    return ["", "$ion", "$ion_1_0", "$ion_symbol_table", "name", "version", "imports", "symbols", "max_id", "$ion_shared_symbol_table"]


class _Binary:
    """Values of Ion 1.0 binary data."""

    def __init__(self, data: bytes):
        self.data, self.at, self.symbols = data, 0, _symbols()

    def varuint(self) -> int:
        n = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n = n << 7 | b & 0x7F
            if b & 0x80:
                return n

    def varint(self) -> int:
        b = self.data[self.at]
        self.at += 1
        sign, n = -1 if b & 0x40 else 1, b & 0x3F
        while not b & 0x80:
            b = self.data[self.at]
            self.at += 1
            n = n << 7 | b & 0x7F
        return sign * n

    def values(self) -> list:
        found = []
        while self.at < len(self.data):
            if self.data[self.at : self.at + 4] == b"\xe0\x01\x00\xea":
                self.at, self.symbols = self.at + 4, _symbols()
                continue
            v = self.value()
            if isinstance(v, Annotated) and v.names[:1] == ["$ion_symbol_table"] and isinstance(v.value, Struct):
                if not isinstance(v.value.get("imports"), str):
                    self.symbols = _symbols()
                self.symbols += [s or "" for s in v.value.get("symbols") or []]
            elif v is not _PAD:
                found.append(v)
        return found

    def value(self) -> Any:
        if self.at >= len(self.data):
            raise QueryError("Ion: unexpected end")
        head = self.data[self.at]
        self.at += 1
        kind, size = head >> 4, head & 15
        if kind == 1:
            return None if size == 15 else bool(size)
        if size == 15 and kind != 14:
            return None
        if size == 14 or (kind == 13 and size == 1):
            size = self.varuint()
        end = self.at + size
        if end > len(self.data):
            raise QueryError("Ion: unexpected end")
        body = self.data[self.at : end]
        if kind == 0:
            self.at = end
            return _PAD
        if kind in (2, 3):
            found: Any = int.from_bytes(body, "big") * (1 if kind == 2 else -1)
        elif kind == 4:
            import struct

            found = struct.unpack(">d" if size == 8 else ">f", body)[0] if size else 0.0
        elif kind == 5:
            found = Decimal(0)
            if size:
                exponent = self.varint()
                rest = self.data[self.at : end]
                n = int.from_bytes(rest, "big")
                if rest and rest[0] & 0x80:
                    n = -(n & ((1 << 8 * len(rest) - 1) - 1))
                found = Decimal(n).scaleb(exponent)
        elif kind == 6:
            offset = self.varint() if size else 0
            parts = []
            while self.at < end and len(parts) < 6:
                parts.append(self.varuint())
            y, *more = parts
            found = Timestamp("-".join([f"{y:04d}", *(f"{x:02d}" for x in more[:2])]) + ("T" if len(parts) < 3 else "") + (f"T{more[2]:02d}:{more[3]:02d}" + (f":{more[4]:02d}" if len(more) > 4 else "") + ("Z" if not offset else f"{'+' if offset > 0 else '-'}{abs(offset) // 60:02d}:{abs(offset) % 60:02d}") if len(parts) > 3 else ""))
        elif kind == 7:
            found = Symbol(self.symbols[int.from_bytes(body, "big")])
        elif kind == 8:
            found = body.decode()
        elif kind in (9, 10):
            found = body
        elif kind in (11, 12, 13):
            found = Struct() if kind == 13 else SExp() if kind == 12 else []
            while self.at < end:
                key = self.symbols[self.varuint()] if kind == 13 else None
                v = self.value()
                if v is not _PAD:
                    found.append((key, v) if kind == 13 else v)
        elif kind == 14:
            length = self.varuint()
            stop, names = self.at + length, []
            while self.at < stop:
                names.append(self.symbols[self.varuint()])
            found = Annotated(names, self.value())
        else:
            raise QueryError("Ion: reserved type")
        self.at = end
        return found


_PAD = object()


class _Parts(io.RawIOBase):
    """Byte strings one after the other, as a file."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.rest = iter(parts), memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        done = 0
        while done < len(into):
            if not self.rest:
                part = next(self.parts, None)
                if part is None:
                    break
                self.rest = memoryview(part)
            n = min(len(into) - done, len(self.rest))
            into[done : done + n] = self.rest[:n]
            self.rest, done = self.rest[n:], done + n
        return done


def _binary_values(file: io.BufferedIOBase) -> Iterator[Any]:
    """The top-level values of binary data, read one by one."""
    state = _Binary(b"")
    while head := file.read(1):
        kind, size, more = head[0] >> 4, head[0] & 15, []
        if head == b"\xe0":
            size = 3
        elif kind == 1 or (size == 15 and kind != 14):
            size = 0
        elif size == 14 or (kind == 13 and size == 1):
            size = 0
            while not more or not more[-1][0] & 0x80:
                more.append(file.read(1))
                if not more[-1]:
                    raise QueryError("Ion: unexpected end")
                size = size << 7 | more[-1][0] & 0x7F
        head = b"".join([head, *more])
        body = []
        while size > 0 and (part := file.read(min(size, 1 << 20))):
            body.append(part)
            size -= len(part)
        if head == b"\n" and not body:  # a line's end that Spark's text reader left no trace of; no value is lost
            return
        state.data, state.at = b"".join([head, *body]), 0
        yield from state.values()


def stream(parts: Iterable[bytes], json_texts: bool = False) -> Iterator[Any]:
    """The top-level values (or their JSON texts) of Ion text or binary data that comes in parts; holds no more
    than a value, a line of text and buffers."""
    file: Any = io.BufferedReader(_Parts(parts), 1 << 16)
    head = file.peek(4)[:4]
    if head[:2] == b"\x1f\x8b":
        file = io.BufferedReader(gzip.GzipFile(fileobj=file), 1 << 16)
    elif head == b"\x28\xb5\x2f\xfd":
        import zstandard

        file = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True), 1 << 16)
    if file.peek(4)[:4] == b"\xe0\x01\x00\xea":
        return map(to_json, _binary_values(file)) if json_texts else _binary_values(file)
    return (_texts if json_texts else _values)(io.TextIOWrapper(file, encoding="utf-8", newline="\n"))


def loads(data: str | bytes) -> list:
    """All top-level values of Ion text or binary data."""
    return list(stream([data]) if isinstance(data, bytes) else _values([data]))


def plain(v: Any) -> Any:
    """A value as JSON has it: no annotations, symbols as strings; bags are lists, absent values are left out."""
    if isinstance(v, Annotated):
        return plain(v.value)
    if isinstance(v, Struct):
        return {k: plain(x) for k, x in reversed(v) if not (isinstance(x, Annotated) and "$missing" in x.names)}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, bytes):
        return base64.b64encode(v).decode()
    if isinstance(v, Decimal):
        return v
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return repr(v)
    return str(v) if isinstance(v, str) else v


def to_json(v: Any) -> str:
    """JSON text; decimals keep their digits."""
    v = plain(v)
    try:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except TypeError:  # a decimal
        pass

    def write(x: Any) -> str:
        if isinstance(x, Decimal):
            return format(x, "f")
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k)}:{write(y)}" for k, y in x.items()) + "}"
        if isinstance(x, list):
            return "[" + ",".join(map(write, x)) + "]"
        return json.dumps(x, ensure_ascii=False)

    return write(v)


def dumps(v: Any) -> str:
    """Ion text of Python values (rows are dicts)."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Decimal):
        s = format(v, "f")
        return s if "." in s else s + "."
    if isinstance(v, float):
        return "nan" if v != v else "+inf" if v == float("inf") else "-inf" if v == float("-inf") else f"{v!r}" if "e" in repr(v) else f"{v!r}e0"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return "{{" + base64.b64encode(bytes(v)).decode() + "}}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_name(k)}:{dumps(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(dumps, v)) + "]"
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s + "Z" if "T" in s and not re.search(r"[+-]\d\d:\d\d$", s) else s
    return json.dumps(str(v), ensure_ascii=False)


def _name(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", k) and k not in ("null", "true", "false", "nan") else "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Files of more bytes are read line by line.
LARGE = 4 << 20
#: Names by which Spark's text reader would unpack a file, for which not every machine has the library.
_PACKED = re.compile(r"\.(bz2|deflate|lz4|snappy|zst|zstd|xz|lzo)$", re.IGNORECASE)


def _unlike(pairs: list[tuple[str, Any]]) -> None:
    if len(dict(pairs)) < len(pairs):
        raise ValueError("a name repeats")


def _exact(number: str) -> None:
    if not number.replace(".", "").lstrip("-").isdigit():
        raise ValueError("a float")


_KEY = re.compile(r'"[^"\\]*"|([A-Za-z_$][A-Za-z0-9_$]*):(?!:)')
_CHECK = json.JSONDecoder(object_pairs_hook=_unlike, parse_float=_exact, parse_constant=_exact)


def _json_of(line: str) -> str | None:
    """The JSON text of a line that is JSON but for its names' quotes; None if it isn't."""
    if "\\" in line:
        return None
    made = _KEY.sub(lambda m: f'"{m[1]}":' if m[1] else m[0], line.strip())
    try:
        _CHECK.decode(made)
    except (ValueError, RecursionError):
        return None
    return made


def _texts(lines: Iterable[str]) -> Iterator[str]:
    """JSON texts of the top-level values of a text; simple lines are not parsed here, only checked."""
    held, depth, tokens, taken = [], 0, _tokens(lines, offer=True), None
    while True:
        try:
            t = tokens.send(taken)
        except StopIteration:
            break
        taken, free = None, depth == 0 and not (held and held[-1][0] in ("annotate", "operator"))
        made = _json_of(t[1]) if t[0] == "line" and free else None
        if held and free and (made is not None or (t[0] != "line" and _starts(t))):
            yield from map(to_json, _Text(held).values())
            held = []
        if made is not None:
            yield made
            taken = True
        elif t[0] != "line":
            held.append(t)
            if t[0] == "op":
                depth += 1 if t[1] in "[({" else -1 if t[1] in "])}" else 0
    yield from map(to_json, _Text(held).values())


def _json_batches(texts: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """JSON texts in batches of at most 10,000 and about 4 MB."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) == 10_000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["j"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["j"])


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of files, a row each: content."""
    for b in batches:
        for content in b.column(0):
            yield from _json_batches(stream([content.as_py()], json_texts=True))


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of lines that hold whole values: value."""
    for b in batches:
        yield from _json_batches(_texts(x.as_py().decode() + "\n" for x in b.column(0)))


def _broken_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The files of which a line holds a part of a value, or no text: value, file."""
    found: set[str] = set()
    for b in batches:
        for x, file in zip(b.column("value"), b.column("file").to_pylist(), strict=True):
            if file in found:
                continue
            try:
                good = _whole(x.as_py().decode())
            except UnicodeDecodeError:
                good = False
            if not good:
                found.add(file)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.string())], names=["file"])


def _ordered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of files from all their lines in order: value, file, size."""
    rows = ((x, file, size) for b in batches for x, file, size in zip(b.column("value"), b.column("file").to_pylist(), b.column("size").to_pylist(), strict=True))

    def parts(lines: Iterable[tuple]) -> Iterator[bytes]:
        done, first = 0, True
        for x, file, size in lines:
            part = x.as_py() if first else b"\n" + x.as_py()
            first, done = False, done + len(part)
            yield part
        if done < size or file.endswith(".gz"):  # the last line's end
            yield b"\n"

    for _, lines in itertools.groupby(rows, key=lambda r: r[1]):
        yield from _json_batches(stream(parts(lines), json_texts=True))


def _json_rows(session, path: str, lines: bool = False) -> DataFrame:
    """A JSON text for each top-level value.

    With ``lines`` every value is on a line of its own, as ``write_ion`` writes them; Spark then splits files
    of any size, and unpacks them by their extension.  Otherwise a value may span lines, and a file up to
    ``LARGE`` bytes is one row.  Of larger files Spark reads lines.  A first pass looks whether each line holds
    whole values: such files are split too.  The lines of the others (and of binary and packed data) are
    sorted by file and place, and a task parses a file as its lines come.  A line is held as a whole.  Files
    that only their name's codec unpacks (``_PACKED``) stay one row, of 2 GB at most as packed.
    """
    spark = session.spark
    if lines:
        texts = spark.read.text(path)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _json_batches(t for line in b.column(0) for t in _texts([line.as_py()]))

        return texts.mapInArrow(each, "j string")
    files = spark.read.format("binaryFile").load(path)
    sizes = [tuple(r) for r in files.select("path", "length").collect()]
    large = [p for p, n in sizes if n > LARGE and not _PACKED.search(p)]
    if not large:
        return files.select("content").mapInArrow(_whole_files, "j string")

    def named(paths: Iterable[str]) -> list[str]:
        return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]

    texts = spark.read.option("lineSep", "\n").text(named(large)).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start")
    )
    broken = [r["file"] for r in texts.select("value", "file").mapInArrow(_broken_lines, "file string").distinct().collect()]
    found = []
    if len(broken) < len(large):
        found.append(texts.where(~F.col("file").isin(broken)).select("value").mapInArrow(_whole_lines, "j string"))
    if broken:
        placed = texts.where(F.col("file").isin(broken)).withColumn("row", F.monotonically_increasing_id())
        found.append(placed.repartition(len(broken), "file").sortWithinPartitions("file", "start", "row").select("value", "file", "size").mapInArrow(_ordered_lines, "j string"))
    if small := set(p for p, _ in sizes) - set(large):
        found.append(spark.read.format("binaryFile").load(named(sorted(small))).select("content").mapInArrow(_whole_files, "j string"))
    return functools.reduce(DataFrame.union, found)


def scan_ion(session, path: str, lines: bool = False) -> DataFrame:
    """One VARIANT, ``v``, for each top-level value."""
    return _json_rows(session, path, lines).select(F.parse_json("j").alias("v"))


def read_ion(session, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Typed columns; the schema is that of all values together, which takes a pass of its own, or the one
    given (as in ``'a bigint, b string'``).  Values that aren't structs are in _1."""
    rows = _json_rows(session, path, lines)
    if schema is not None:
        typed = rows.select(F.expr(f"try_variant_get(parse_json(j), '$', 'struct<{schema}>')").alias("r"))
        return typed.select("r.*")
    kind = rows.select(F.schema_of_variant_agg(F.parse_json("j")).alias("s")).first()["s"]
    if kind is None:
        return session.spark.createDataFrame([], "_1 string")
    if kind.startswith("OBJECT<"):
        schema = kind.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
        typed = rows.select(F.expr(f"try_variant_get(parse_json(j), '$', '{schema}')").alias("r"))
        return typed.select("r.*")
    return rows.select(F.parse_json("j").alias("_1"))


def write_ion(df: DataFrame, path: str) -> None:
    """A text file of Ion structs for each partition."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([dumps(dict(zip(names, r.values(), strict=True))) for r in b.to_pylist()], pa.string())], names=["value"])

    df.mapInArrow(run, "value string").write.text(path)


def read_graph(session, name: str, text: str) -> None:
    """Register the graph in Ion text ``$graph::{nodes:[...], edges:[...]}``."""
    found = loads(text)
    value = found[0].value if found and isinstance(found[0], Annotated) else found[0] if found else None
    if not isinstance(value, Struct) or value.get("nodes") is None or value.get("edges") is None:
        raise QueryError("a graph needs nodes and edges")

    def bare(x: Any) -> Any:
        return x.value if isinstance(x, Annotated) else x

    def common(e: Struct) -> tuple:
        if not isinstance(e, Struct) or e.get("id") is None:
            raise QueryError("a graph's element needs an id")
        payload = e.get("payload")
        return str(e.get("id")), [str(x) for x in e.get("labels") or []], None if payload is None else to_json(payload)

    nodes = [common(bare(n)) for n in value.get("nodes")]
    known, edges = {n[0] for n in nodes}, []
    for e in map(bare, value.get("edges")):
        id_, labels, payload = common(e)
        ends = e.get("ends")
        if not isinstance(ends, SExp) or len(ends) != 3 or ends[1] not in ("->", "<-", "--"):
            raise QueryError(f"edge {id_} has no ends")
        a, way, b = map(str, ends)
        if a not in known or b not in known:
            raise QueryError(f"edge {id_} ends outside the graph")
        edges.append((id_, *((b, a) if way == "<-" else (a, b)), way != "--", labels, payload))
    spark = session.spark
    n = spark.createDataFrame(nodes, "id string, labels array<string>, p string").select("id", "labels", F.parse_json("p").alias("payload"))
    e = spark.createDataFrame(edges, "id string, src string, dst string, directed boolean, labels array<string>, p string").select("id", "src", "dst", "directed", "labels", F.parse_json("p").alias("payload"))
    session.register_graph(name, n, e)
