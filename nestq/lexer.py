"""Tokens of the query language."""

from __future__ import annotations

import re
from typing import NamedTuple

from nestq.ast import QueryError


class Token(NamedTuple):
    kind: str  # word, quoted, string, int, decimal, real, ion, op, end
    text: str
    at: int


_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<real>(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+)
      | (?P<decimal>\d+\.\d*|\.\d+)
      | (?P<int>\d+)
      | (?P<bits>[xXbB]'[0-9A-Fa-f]*')
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*")
      | (?P<ion>`[^`]*`)
      | (?P<word>@?[A-Za-z_$][A-Za-z0-9_$]*)
      | (?P<op><<|>>|<=|>=|<>|!=|\|\||[-+*/%^=<>(){}\[\],.:;?|&!~])
    """,
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "string":
            value = value[1:-1].replace("''", "'")
        elif kind == "quoted":
            value = value[1:-1].replace('""', '"')
        elif kind == "ion":
            value = value[1:-1]
        if kind != "space":
            found.append(Token(kind, value, at))
        at = m.end()
    found.append(Token("end", "", len(text)))
    return found
