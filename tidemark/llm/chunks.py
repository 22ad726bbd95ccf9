"""Tokens of repeated pieces of text, each encoded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Collection
from itertools import chain, compress

import numpy as np

#: Distinct pieces after which a worker forgets what it has encoded, and those that are encoded at a time.
MOST_PIECES, AT_A_TIME = 400_000, 1 << 16


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class ChunkStore:
    """Maps pieces of text to runs of ids, asking ``encode`` only for pieces not seen before.

    ``encode`` gives the ids of some pieces one after another, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES, at_a_time: int = AT_A_TIME):
        self.encode, self.most, self.at_a_time = encode, most, at_a_time
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.number.new = []
        self.ids, self.ends, self.known = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64), 0
        self.again = np.zeros(1 << 12, dtype=bool)

    def _keep_repeated(self) -> None:
        """Forget the pieces that were asked for in one call only, or all if that leaves too many."""
        keep = self.again[: self.known]
        if 2 * keep.sum() > self.most:
            return self._forget()
        pieces, length = list(compress(self.number, keep)), np.diff(self.ends[: self.known + 1])
        ids = self.ids[: self.ends[self.known]][np.repeat(keep, length)]
        self._forget()
        for piece in pieces:
            self.number[piece]
        self.number.new = []
        self._add(ids, length[keep])

    @staticmethod
    def _room(have: np.ndarray, n: int) -> np.ndarray:
        return have if n <= len(have) else np.concatenate([have, np.zeros(max(n, 2 * len(have)) - len(have), dtype=have.dtype)])

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        old, n = self.ends[self.known], len(lengths)
        self.ids = self._room(self.ids, int(old + len(ids)))
        self.ids[old : old + len(ids)] = ids
        self.ends = self._room(self.ends, self.known + n + 1)
        self.ends[self.known + 1 : self.known + n + 1] = old + np.cumsum(lengths)
        self.again = self._room(self.again, self.known + n)
        self.again[self.known : self.known + n] = False
        self.known += n

    def runs_of(self, pieces: Collection[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each piece begin, and how many they are; both hold until the next call."""
        if self.known > self.most:
            self._keep_repeated()
        old = self.known
        which = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        new, self.number.new = self.number.new, []
        for low in range(0, len(new), self.at_a_time):
            self._add(*self.encode(new[low : low + self.at_a_time]))
        self.again[which[which < old]] = True
        begin = self.ends[which]
        return begin, self.ends[which + 1] - begin

    def ids_of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as lists of pieces, one after another, and how many each text has."""
        per_text = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin, length = self.runs_of(list(chain.from_iterable(texts)))
        ends = np.cumsum(length)
        out = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - length), length)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(upto)
