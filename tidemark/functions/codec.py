r"""Escapes of stored texts: \\ \n \r \t."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_BACK = {"n": "\n", "r": "\r", "t": "\t"}


def encode(c: Column) -> Column:
    out = c
    for raw, escaped in _ESCAPES.items():  # the backslash first
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def decode(c: Column) -> Column:
    r"""The text of an encoded one; \x of another x is x. Cut at escaped backslashes, so that none of those begins another escape."""

    def rest(piece: Column) -> Column:
        out = piece
        for raw, escaped in list(_ESCAPES.items())[1:]:
            out = F.replace(out, F.lit(escaped), F.lit(raw))
        return F.regexp_replace(out, r"(?s)\\(.)", "$1")

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), rest), "\\")


def truncate(c: Column, width: int) -> Column:
    r"""The longest start of a text whose encoding fits; an escape counts as two and is never split."""
    cut = F.substring(encode(F.substring(c, 1, width)), 1, width)
    whole = F.regexp_replace(cut, r"(?<!\\)((?:\\\\)*)\\$", "$1")
    return F.when(F.length(encode(c)) <= width, c).otherwise(decode(whole))


def encode_text(s: str) -> str:
    return re.sub(r"[\\\n\r\t]", lambda m: _ESCAPES[m[0]], s)


def decode_text(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK.get(m[1], m[1]), s, flags=re.S)


def truncate_encoded(s: str, width: int) -> str:
    """At most width characters of an encoded text, without half an escape."""
    cut = s[:width]
    return cut[:-1] if len(s) > width and re.search(r"(?<!\\)(?:\\\\)*\\$", cut) else cut
