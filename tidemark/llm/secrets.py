"""Secret scans with linking of multipart credentials."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# What the parts look like. Letters are ASCII in the first; "in either case" holds there only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?:access_?key_?id|client_?id|user_?name|account_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{4,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}")
ENDPOINT = re.compile(r"""(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9._~:/?#@!$&*+;=%-]+|(?:endpoint|host(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?""", re.I | re.A)
SCOPE_END = re.compile(r"\n[\x20\x09\r]*\n")
LEAST = {"assign": 6, "access": 20}
ENTROPY = 3.5

KINDS = ("assign", "access", "hex", "link_id", "link_secret", "link_endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "link_id": "id", "link_secret": "secret", "link_endpoint": "endpoint"}
#: Parts that make a credential together.
MATES = {"id": ("secret",), "endpoint": ("secret",), "secret": ("id", "endpoint")}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Assignments, access identifiers and long hex runs: (start, end, kind), reported wherever they stand."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Parts that mean nothing alone: identifiers, opaque strings, endpoints; none overlaps a strong span or an earlier weak one."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "link_id") for m in IDENTIFIER.finditer(text)]
        found += [(*m.span(), "link_endpoint") for m in ENDPOINT.finditer(text)]
    found += [(*m.span(), "link_secret") for m in OPAQUE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and _entropy(m[0]) >= ENTROPY]
    starts = sorted(s[:2] for s in strong)
    furthest = list(accumulate((b for _, b in starts), max))
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))):
        # Of the strong spans that begin before this one ends, does any reach into it? Or the last weak one?
        k = bisect.bisect_left(starts, (s[1], 0))
        if not (k and furthest[k - 1] > s[0] or out and out[-1][1] > s[0]):
            out.append(s)
    return out


def link_parts(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """The weak spans with a complementary part, strong or weak, in the same scope, however far apart.

    An interval join by binary search: parts of each role are sorted by start
    with the furthest end so far, so one look tells whether any of those that
    begin before the scope's end reaches into it. A scope is what lies between
    blank lines.
    """
    scopes = [m.start() for m in SCOPE_END.finditer(text)]
    starts: dict[str, list[int]] = {"id": [], "secret": [], "endpoint": []}
    furthest: dict[str, list[int]] = {role: [] for role in starts}
    for a, b, kind in sorted(strong + weak):
        role = ROLE[kind]
        starts[role].append(a)
        furthest[role].append(max(b, furthest[role][-1] if furthest[role] else 0))
    out = []
    for a, b, kind in weak:
        k = bisect.bisect_right(scopes, a)
        low = scopes[k - 1] if k else 0
        high = scopes[k] if k < len(scopes) else len(text)
        before = {mate: bisect.bisect_left(starts[mate], high) for mate in MATES[ROLE[kind]]}
        if any(i and furthest[mate][i - 1] > low for mate, i in before.items()):
            out.append((a, b, kind))
    return out


def scan_text(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the linked weak ones, both by start and kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = base_spans(text)
    weak = weak_spans(text, base)
    linked = link_parts(text, base, weak) if weak else []
    return sorted(base, key=order), sorted(base + linked, key=order)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Spans of secrets in every document (doc_id, text): doc_id, base and spans, arrays of (start, end, kind).

    Base spans are always reported. A weak part (an identifier, an opaque
    string, an endpoint) is reported only where a complementary part lies in the
    same paragraph, which ends at a blank line or with the text. Each text is scanned whole in
    its own row, without any shuffle. Null and empty texts have no spans; repeated
    rows repeat their result; extra columns are ignored.
    """
    span = "array<struct<start:int,end:int,kind:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scan(batches):
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = [scan_text(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f[i]] for f in found], type=kind) for i in (0, 1))],
                    names=["doc_id", "base", "spans"],
                )

    texts = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(scan, f"doc_id long, base {span}, spans {span}")


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
