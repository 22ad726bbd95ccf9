"""Context-mixing range coder for token ids, many independent blocks in step."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, TABLE = b"TMC5", b"TMCT"
#: Most ids of a block; every block starts with an empty model and has its own checksum.
BLOCK = 2048
#: Blocks that a run of ids should have if that leaves them LEAST_BLOCK ids, as blocks advance together.
LANES, LEAST_BLOCK = 2048, 512
#: Bits of the places of a block's order-1 and order-2 tables.
PLACES = (9, 10)
ID_BITS = 17
#: Order 0 gives the ids of a run parts of 2 ** COUNT_BITS by how often each is there.
COUNT_BITS = 20
#: Weights of the orders are parts of 2 ** SCALE and move by 1 / 2 ** RATE of the way. Order 0 keeps LEAST less two TRACES at
#: least, which is above 2 ** COUNT_BITS, so that every id has a part.
SCALE, RATE = 27, 4
ONE, LEAST = 1 << SCALE, 1 << 21
#: The least weight of orders 1 and 2, from which they can rise again.
TRACE = 1 << 17
_U = np.uint64
_LOWEST, _HIGH, _FULL, _SHORT = 0xFFFFFFFF, 0xFFFF << 32, (1 << 48) - 1, 1 << 32
_SHIFTS = np.array([[32 - p] for p in PLACES], dtype=np.uint32)
_MIX = [np.uint32(x) for x in (2654435761, 0x85EBCA6B, 0x9E3779B1, 1)]


class _Counts:
    """Order 0 of a run of ids: its distinct ids in ascending order, by whose places all else names them, and the part of each."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        self.ids, self.parts = ids, parts.astype(np.int64)
        self.ends = np.cumsum(self.parts)
        #: Where the part of each begins, and above that where it ends.
        self.bounds = (self.ends - self.parts) | (self.ends << 32)

    @classmethod
    def of(cls, ids: np.ndarray) -> _Counts:
        seen = np.bincount(ids)
        distinct = np.flatnonzero(seen)
        parts = 1 + seen[distinct] * ((1 << COUNT_BITS) - len(distinct)) // len(ids)
        parts[parts.argmax()] += (1 << COUNT_BITS) - parts.sum()
        return cls(distinct, parts)

    def frame(self) -> bytes:
        """Steps between ids, and parts, byte by byte, as the higher bytes are mostly zero."""
        columns = np.concatenate([np.diff(self.ids, prepend=0), self.parts]).astype("<u4")
        code = zlib.compress(columns.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)
        return TABLE + struct.pack("<III", len(self.ids), len(code), zlib.crc32(code)) + code

    @classmethod
    def read(cls, n: int, code: bytes) -> _Counts:
        try:
            columns = np.frombuffer(zlib.decompress(code), dtype=np.uint8).reshape(4, 2 * n).T.copy().view("<u4").ravel().astype(np.int64)
        except zlib.error as e:
            raise ValueError("a table of counts is damaged") from e
        counts = cls(np.cumsum(columns[:n]), columns[n:])
        if not n or counts.ends[-1] != 1 << COUNT_BITS:
            raise ValueError("a table of counts is damaged")
        return counts


class _Model:
    """What orders 2, 1 and 0 predict as the next id of each block, and their mix.

    Orders 2 and 1 each name the id that last followed the last two ids or the
    last one, with a confidence of 0 to 3; order 0 has the counts of the run that
    the blocks are cut from. An id's probability is the weighted sum of those that
    the three orders give it. The part of it that each order gave is how far that order is to
    thank for the id, and the stored weights (one set for each of the 16 pairs of
    confidences) move towards these parts. Arrays of two rows hold order 1 and order 2.
    """

    def __init__(self, lanes: int):
        self.lanes = lanes
        first = np.arange(lanes, dtype=np.int64)
        self.base = np.stack([first << PLACES[0], (lanes << PLACES[0]) + (first << PLACES[1])])
        self.table = np.zeros(lanes * ((1 << PLACES[0]) + (1 << PLACES[1])), dtype=np.int32)
        self.context = np.stack([first << 4, (lanes + first) << 4])
        trust = np.array([1, 20, 45, 60], dtype=np.int32) * (ONE >> 7)
        self.weights = np.concatenate([np.tile(np.tile(trust, 4) >> 1, lanes), np.tile(np.repeat(trust, 4), lanes)])
        self.hashes = np.zeros((2, lanes), dtype=np.uint32)
        self.two = np.zeros(lanes, dtype=np.uint32)

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes only: the last block of a run may be shorter than the others."""
        for name in ("base", "context", "hashes", "two"):
            setattr(self, name, getattr(self, name)[..., :lanes].copy())
        self.lanes = lanes

    def predict(self) -> None:
        """The ids that orders 1 and 2 name, and the weights of the orders."""
        self.at = (self.hashes >> _SHIFTS) + self.base
        self.entry = self.table.take(self.at)
        self.guess, self.sure = self.entry >> 2, self.entry & 3
        sets = self.sure[1] << 2
        sets += self.sure[0]
        self.mix = self.context + sets
        self.now = self.weights.take(self.mix)
        rest = self.now[0] + self.now[1]
        self.rest = np.subtract(ONE, rest, dtype=np.int64)

    def count_bounds(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ids with these bounds begin, and how large they are, of order 0 with the weight that orders 1 and 2 leave to it."""
        low = part & _LOWEST
        low *= self.rest
        low >>= COUNT_BITS
        part = part >> 32
        part *= self.rest
        part >>= COUNT_BITS
        part -= low
        return low, part

    def bounds(self, ids: np.ndarray, of_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of ids begin in 0 .. ONE, and how large they are; ``of_counts`` has their bounds by the counts."""
        low, part = self.count_bounds(of_counts)
        off = self.guess - ids
        self.gave = self.now & ~_differ(off)
        part += self.gave[0] + self.gave[1]
        off >>= 31
        off &= self.now
        low += off[0] + off[1]
        return low, part

    def id_at(self, place: np.ndarray, counts: _Counts, holder: np.ndarray) -> np.ndarray:
        """The id whose part holds ``place``: one that an order names, else the holder of a count."""
        low, part = self.count_bounds(counts.bounds.take(self.guess.astype(np.int64)))
        part += self.now
        apart = self.guess[0] - self.guess[1]
        part += self.now[::-1] & ~_differ(apart)
        low[0] += self.now[1] & (-apart >> 31)
        low[1] += self.now[0] & (apart >> 31)
        off = place - low
        part -= off
        # part is 0 or less where the place lies past what a named id has, off is less than 0 where before it
        past = (part - 1) >> 63
        out = (past | (off >> 63)).astype(np.int32)
        past &= self.now
        left = place + 1
        left -= past[0]
        left -= past[1]
        left <<= COUNT_BITS
        left -= 1
        ids = holder.take((left / self.rest).astype(np.int64), mode="clip")
        for named, beyond in zip(self.guess, out, strict=True):
            ids = named ^ ((named ^ ids) & beyond)
        return ids

    def update(self, ids: np.ndarray, part: np.ndarray) -> None:
        """Weigh the orders by what each gave the id, and remember what followed."""
        thanks = (self.gave * ((ONE - LEAST) / part)).astype(np.int32)
        thanks -= self.now
        thanks >>= RATE
        thanks += self.now
        self.weights[self.mix] = np.maximum(thanks, TRACE, out=thanks)
        # a miss lowers the confidence, or from 1 and less puts the id there; a hit raises it up to 3
        fresh, sure = (ids << 2) | 1, self.sure
        new = self.entry - 1
        new ^= fresh
        new &= (1 - sure) >> 31
        new ^= fresh
        hit = self.entry - ((sure - 3) >> 31)
        new ^= hit
        new &= _differ(self.guess - ids)
        new ^= hit
        self.table[self.at] = new
        one = ids.view(np.uint32)
        np.multiply(one, _MIX[0], out=self.hashes[0])
        np.bitwise_xor(self.hashes[0], self.two, out=self.hashes[1])
        self.hashes[1] *= _MIX[1]
        self.two = (one + _MIX[3]) * _MIX[2]


def _differ(off: np.ndarray) -> np.ndarray:
    """-1 where a difference of ids isn't 0."""
    return (off | -off) >> 31


class _Encoder:
    """Range coders in step: 48-bit low and range, words of 16 bits, carries added to the word before."""

    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << 48) - 1, dtype=np.int64)
        self.out = np.zeros(lanes * words, dtype=np.int32)
        self.begin = np.arange(lanes, dtype=np.int64) * words
        self.at = self.begin.copy()

    def narrow(self, n: int, low: np.ndarray, part: np.ndarray) -> None:
        """Of the first n coders, keep the part low .. low + part of ONE."""
        unit = self.range[:n] >> SCALE
        low *= unit
        self.low[:n] += low
        np.multiply(unit, part, out=self.range[:n])

    def settle(self, n: int) -> None:
        """Carry, and write words until every range has room again."""
        low, span, at = self.low[:n], self.range[:n], self.at[:n]
        over = np.flatnonzero(low >> 48)
        if len(over):
            self.out[at[over] - 1] += 1
            low &= _FULL
        short = (span - _SHORT) >> 63
        while short.any():
            self.out[at] = low >> 32
            at -= short
            low &= ~(short & _HIGH)
            short &= 16
            low <<= short
            span <<= short
            short = (span - _SHORT) >> 63

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[self.at] = (self.low >> shift) & 0xFFFF
            self.at += 1
        over = np.flatnonzero(self.out > 0xFFFF)
        while len(over):
            self.out[over] &= 0xFFFF
            over -= 1
            self.out[over] += 1
            over = over[self.out[over] >> 16 > 0]
        words = self.out.astype("<u2")
        return [words[a:b].tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist(), strict=True)]


def encode_ids(ids: np.ndarray, block: int | None = None) -> bytes:
    """Frames of consecutive blocks: magic, ids, bytes and crc32 of the ids (little-endian 32-bit), then the code; after them one of the run's counts."""
    n = len(ids)
    block = block or min(BLOCK, max(LEAST_BLOCK, n // LANES))
    if n and (ids.min() < 0 or ids.max() >> ID_BITS):
        raise ValueError("an id is out of range")
    lanes = -(-n // block)
    if not lanes:
        return b""
    counts = _Counts.of(ids)
    place = np.zeros(1 << ID_BITS, dtype=np.int32)
    place[counts.ids] = np.arange(len(counts.ids))
    grid = np.zeros(lanes * block, dtype=np.int32)
    grid[:n] = ids
    grid = grid.reshape(lanes, block)
    columns, last = place[grid.T], n - (lanes - 1) * block
    model, coder = _Model(lanes), _Encoder(lanes, block * 7 // 4 + 8)
    for step in range(block if lanes > 1 else last):
        if step == last:
            model.shrink(lanes - 1)
        m = model.lanes
        now = columns[step, :m]
        model.predict()
        low, part = model.bounds(now, counts.bounds.take(now))
        coder.narrow(m, low, part)
        coder.settle(m)
        model.update(now, part)
    frames = []
    for k, code in enumerate(coder.finish()):
        row = grid[k, : block if k < lanes - 1 else last]
        frames.append(MAGIC + struct.pack("<III", len(row), len(code), zlib.crc32(row.astype("<u4").tobytes())) + code)
    return b"".join(frames) + counts.frame()


def read_frames(data: bytes) -> tuple[list[int], list[np.ndarray], list[int], _Counts]:
    """Lengths, code words and checksums of the frames in data, and the counts that end it; damage to their form raises ValueError."""
    lengths, codes, sums, at = [], [], [], 0
    while True:
        magic = data[at : at + 4]
        if magic not in (MAGIC, TABLE) or at + 16 > len(data):
            raise ValueError("not a block of ids")
        n, size, crc = struct.unpack_from("<III", data, at + 4)
        end = at + 16 + size
        if end > len(data) or (magic == TABLE) != (end == len(data)):
            raise ValueError("a block of ids is cut off")
        if magic == TABLE:
            if zlib.crc32(data[at + 16 :]) != crc:
                raise ValueError("a table of counts fails its checksum")
            return lengths, codes, sums, _Counts.read(n, data[at + 16 :])
        if size % 2:
            raise ValueError("a block of ids is cut off")
        lengths.append(n)
        codes.append(np.frombuffer(data, dtype="<u2", count=size // 2, offset=at + 16))
        sums.append(crc)
        at = end


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of some frames, of which the last holds the counts; a wrong magic, length or checksum raises ValueError."""
    if not data:
        return np.zeros(0, dtype=np.int32)
    lengths, codes, sums, counts = read_frames(data)
    if not lengths:
        return np.zeros(0, dtype=np.int32)
    holder = np.repeat(np.arange(len(counts.ids), dtype=np.int32), counts.parts)
    order = np.argsort(-np.array(lengths), kind="stable")
    length = np.array(lengths)[order]
    lanes, words = len(order), max(map(len, codes)) + 6
    code = np.zeros((lanes, words), dtype=np.int32)
    for row, k in enumerate(order):
        code[row, : len(codes[k])] = codes[k]
    value = (code[:, 0].astype(np.int64) << 32) | (code[:, 1].astype(np.int64) << 16) | code[:, 2]
    span, at = np.full(lanes, _FULL, dtype=np.int64), np.arange(lanes, dtype=np.int64) * words + 3
    code = code.ravel()
    model, columns = _Model(lanes), np.zeros((int(length[0]), lanes), dtype=np.int32)
    for step in range(int(length[0])):
        m = int((length > step).sum()) if step >= length[-1] else lanes
        if m < model.lanes:
            model.shrink(m)
            value, span, at = value[:m], span[:m], at[:m]
        model.predict()
        unit = span >> SCALE
        place = (value / unit).astype(np.int64)
        ids = model.id_at(np.minimum(place, ONE - 1, out=place), counts, holder)
        low, part = model.bounds(ids, counts.bounds.take(ids.astype(np.int64)))
        low *= unit
        value -= low
        np.multiply(unit, part, out=span)
        short = (span - _SHORT) >> 63
        while short.any():
            word = code.take(at, mode="clip") & short
            at -= short
            short &= 16
            value <<= short
            value |= word
            span <<= short
            short = (span - _SHORT) >> 63
        columns[step, :m] = ids
        model.update(ids, part)
    out: list = [None] * lanes
    grid = counts.ids.astype(np.int32)[columns.T]
    for row, k in enumerate(order):
        out[k] = grid[row, : lengths[k]]
        if zlib.crc32(out[k].astype("<u4").tobytes()) != sums[k]:
            raise ValueError("a block of ids fails its checksum")
    return np.concatenate(out)
