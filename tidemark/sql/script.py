"""Splitting scripts into statements."""

from __future__ import annotations

import re

_QUOTED_OR_COMMENT = re.compile(r"'(?:[^'\\]|''|\\.)*'|--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
#: A statement ends at a semicolon, a batch at a line that says GO, with an optional count.
_END = re.compile(r";|^[ \t]*(?P<go>GO)(?:[ \t]+\d+)?[ \t\r]*$", re.I | re.M)


def batches(script: str) -> list[list[str]]:
    """Statements of each batch, without comments; what a quoted text holds ends nothing."""
    bare = _QUOTED_OR_COMMENT.sub(lambda m: m[0] if m[0][0] == "'" else re.sub(r"[^\n]", " ", m[0]), script)
    masked = _QUOTED_OR_COMMENT.sub(lambda m: "x" * len(m[0]), bare)
    out: list[list[str]] = [[]]
    at = 0
    for end in [*_END.finditer(masked), None]:
        if statement := bare[at : end.start() if end else len(bare)].strip():
            out[-1].append(statement)
        if end:
            at = end.end()
            if end["go"]:
                out.append([])
    return [b for b in out if b]


def statements(script: str) -> list[str]:
    return [s for batch in batches(script) for s in batch]
