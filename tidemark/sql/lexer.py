"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.errors import ParseError

_TOKEN = re.compile(
    r"""(?P<blank>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<text>'(?:[^'\\]|''|\\.)*')
      | (?P<bracket>\[[^\]\n]*\])
      | (?P<number>[0-9]+(?:\.[0-9]+)?)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<sign><=|>=|<>|!=|\|\||[(),.;*=<>+\-/%])""",
    re.S | re.X,
)
_ESCAPE = {"n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Token:
    kind: str  # text, bracket, number, word, sign, end
    value: str
    line: int
    column: int

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words


def _unquoted(raw: str) -> str:
    r"""A literal's value: '' is a quote, \n \r \t \\ are escapes, \x of others is x."""
    return re.sub(r"''|\\(.)", lambda m: _ESCAPE.get(m[1], m[1]) if m[1] else "'", raw[1:-1], flags=re.S)


def tokens(sql: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            what = "Unterminated string" if sql[at] == "'" else f"Unexpected character '{sql[at]}'"
            raise ParseError(what, line, at - start + 1)
        kind, raw = m.lastgroup, m[0]
        if kind != "blank":
            value = _unquoted(raw) if kind == "text" else raw[1:-1] if kind == "bracket" else raw
            out.append(Token(kind, value, line, at - start + 1))
        if "\n" in raw:
            line, start = line + raw.count("\n"), at + raw.rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", line, at - start + 1))
    return out
