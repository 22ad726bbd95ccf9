"""Arrow batches of texts as byte arrays, and the words in them, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) <= n:
        full = np.full(max(n, STEP_BYTES) + 1, base, dtype=np.uint64)
        full[0] = 1
        have = _powers[name] = np.multiply.accumulate(full)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and where each begins, with the end of the last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n, (_, ends, data) = len(column), column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text is a range of its own."""
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of some texts: start and end byte of each, its text's index, and a 64-bit hash.

    ``is_word`` marks the bytes that words are made of. Hashes are polynomials
    over the (lower-cased) bytes, taken for all words from one running sum.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = is_word[data]
        border = np.zeros(n + 1, dtype=bool)
        border[at] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | border[:-1])) if n else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inside & (~after | border[1:])) + 1 if n else np.zeros(0, np.int64)
        self.text = np.searchsorted(at, self.start, side="right") - 1
        #: First word of each text, with the end of the last.
        self.first = np.searchsorted(self.start, at)
        power, back = _power("up", int(_BASE), n), _power("down", _inverse(int(_BASE)), n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_word(word: bytes) -> int:
    """The hash that Words gives to a word."""
    x, power = 0, 1
    for c in word:
        x, power = x + (c + 1) * power, power * int(_BASE)
    return int(mixed(np.array([(x + len(word) * 0xD6E8FEB86659FD93) % (1 << 64)], dtype=np.uint64))[0])


def byte_mask(*spans: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for a, b in spans:
        mask[a : b + 1] = True
    return mask


#: Bytes of [^\x20\x09-\x0D]+
NOT_SPACE = ~byte_mask((0x20, 0x20), (0x09, 0x0D))
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing, so capitals count too
LETTER_OR_DIGIT = byte_mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
