"""SentencePiece encoding and decoding by batched numpy Viterbi."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.chunks import ChunkStore

SPACE = "▁"
#: A piece of text between spaces, with the spaces before it, or a line break; no vocabulary piece crosses its ends.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")
#: Characters of words that advance together, and of texts that are encoded at a time.
STEP_CELLS, STEP_CHARS = 1 << 19, 1 << 21
_BASE, _TAG = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


class _Keys:
    """Sorted mixed 64-bit keys with a value each; a probe starts at the first key with its leading bits."""

    BITS = 18

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        keys = (keys ^ (keys >> np.uint64(32))) * _BASE
        return keys ^ (keys >> np.uint64(29))

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = self.mixed(keys)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        lead = (self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        crowd = np.bincount(lead, minlength=1 << self.BITS)
        self.first = np.where(crowd > 0, np.cumsum(crowd) - crowd, -1).astype(np.int32)
        self.steps = int(crowd.max()) - 1

    def find(self, keys: np.ndarray, none: int) -> np.ndarray:
        """Values of keys, ``none`` where there is none."""
        out, keys = np.full(len(keys), none, dtype=np.int64), self.mixed(keys)
        at = self.first.take((keys >> np.uint64(64 - self.BITS)).astype(np.int64))
        maybe = np.flatnonzero(at >= 0)
        at, some = at[maybe], keys[maybe]
        for _ in range(self.steps):
            at = np.minimum(at + (self.keys[at] < some), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == some)
        out[maybe[here]] = self.values[at[here]]
        return out


class PieceTable:
    """A vocabulary as sorted substring hashes, with what Viterbi needs to know about its pieces.

    kind "unigram": the path with the largest sum of scores is the encoding.
    kind "bpe": pieces come from merging neighbours, best score first and left
    before right. Such an encoding is the one path on which every piece encodes
    to itself and every two neighbours encode to themselves, so the recurrence
    is the same with pairs that would merge ruled out.
    """

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], kind: str, plain: list[bool]):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model: {kind}")
        self.pieces, self.kind, self.byte_ids = pieces, kind, byte_ids
        self.size = len(pieces)
        self.length = np.array([len(p) for p in pieces])
        self.score = np.array(scores, dtype=np.float64)
        ids = np.array([i for i, p in enumerate(plain) if p and pieces[i]], dtype=np.int64)
        if any(SPACE in pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece has a space inside; words can't be encoded apart")
        if any("\n" in pieces[i] for i in ids):
            raise ValueError("a piece has a line break inside; lines can't be encoded apart")
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        keys = np.zeros(len(ids), dtype=np.uint64)
        for n, which in self._by_length([pieces[i] for i in ids]).items():
            chars = np.array([pieces[ids[k]] for k in which], dtype=f"<U{n}").view(np.uint32).reshape(len(which), n)
            keys[which] = self._hashes(chars.astype(np.uint64))(0, n)
        self.lookup = _Keys(keys, ids)
        #: What a character without a piece scores.
        self.unknown = self.score[ids].min() - 10
        self.usable = np.ones(self.size, dtype=bool)
        if kind == "bpe":
            self._learn_merges(ids)

    @staticmethod
    def from_file(path: str, kind: str) -> PieceTable:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte_of = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        return PieceTable([m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)], [byte_of[f"<0x{b:02X}>"] for b in range(256)], kind, plain)

    @staticmethod
    def _by_length(words: list[str]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            out.setdefault(len(w), []).append(k)
        return out

    @staticmethod
    def _hashes(chars: np.ndarray):
        """A function for the hash of characters i to j of every row."""
        n = chars.shape[1]
        upto = np.zeros((len(chars), n + 1), dtype=np.uint64)
        for k in range(n):
            upto[:, k + 1] = upto[:, k] * _BASE + chars[:, k] + np.uint64(1)
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))

        tag = np.arange(n + 1, dtype=np.uint64) * _TAG

        def between(i, j, rows=slice(None)):
            return upto[rows, j] - upto[rows, i] * power[j - i] + tag[j - i]

        return between

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        return self.lookup.find(keys, -1)

    def _learn_merges(self, ids: np.ndarray) -> None:
        """Which pieces merging reaches, the two parts of each one's last merge, and the rank of that merge (0: a character)."""
        self.parts = np.zeros((2, self.size), dtype=np.int64)
        self.rank = np.zeros(self.size, dtype=np.int64)
        for which, between, n, cut in self._merge([self.pieces[i] for i in ids]):
            own = ids[which]
            self.usable[own] = cut >= 0
            done = np.flatnonzero(cut > 0)
            for side, (i, j) in enumerate(((np.zeros_like(cut), cut), (cut, np.full_like(cut, n)))):
                parts = self.probe(between(i[done], j[done], done))
                if (parts < 0).any():
                    raise ValueError("a piece is made of characters without a piece")
                self.parts[side, own[done]] = parts
        merged = ids[self.usable[ids] & (self.length[ids] > 1)]
        self.rank[merged] = np.unique(-self.score[merged], return_inverse=True)[1] + 1
        codes = self.parts[0, merged] * self.size + self.parts[1, merged]
        self.merges = _Keys(codes.astype(np.uint64), self.rank[merged]) if len(merged) else None

    def _merge(self, words: list[str]):
        """Merge words of one length together: for each length the words' places, a hash function, the length, and where the last merge joined each.

        That is 0 for a single character and -1 for a word that stays in parts.
        """
        for n, which in self._by_length(words).items():
            chars = np.array([words[k] for k in which], dtype=f"<U{n}").view(np.uint32).reshape(len(which), n)
            between = self._hashes(chars.astype(np.uint64))
            rows = np.arange(len(which))
            start = np.tile(np.arange(n + 1), (len(which), 1))
            count, cut = np.full(len(which), n), np.full(len(which), -1 if n > 1 else 0)
            score = np.full((len(which), max(n, 2) - 1), -np.inf)
            for k in range(n - 1):
                ids = self.probe(between(k, k + 2))
                score[:, k] = np.where(ids >= 0, self.score[ids], -np.inf)
            while True:
                best = score.argmax(axis=1)
                live = rows[score[rows, best] > -np.inf]
                if not len(live):
                    break
                b = best[live]
                final = live[count[live] == 2]
                cut[final] = start[final, 1]
                shift = np.arange(n + 1)[None, :] > b[:, None]
                start[live] = np.where(shift, np.concatenate([start[live][:, 1:], np.full((len(live), 1), n)], axis=1), start[live])
                gone = np.arange(score.shape[1])[None, :] >= b[:, None]
                score[live] = np.where(gone, np.concatenate([score[live][:, 1:], np.full((len(live), 1), -np.inf)], axis=1), score[live])
                count[live] -= 1
                for side in (-1, 0):
                    k = b + side
                    ok = (k >= 0) & (k + 1 < count[live])
                    r, k = live[ok], k[ok]
                    i, j = start[r, k], start[r, k + 2]
                    ids = self.probe(between(i, j, r))
                    score[r, k] = np.where(ids >= 0, self.score[ids], -np.inf)
            yield np.array(which), between, n, cut

    def fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For each two neighbours: do they stay apart? Negative ids are characters of their own, which never merge.

        The last merges of the two are undone from the later one on. At each step
        the parts that face each other must not make a piece that comes before the
        merge just undone; two single characters that don't are the end.
        """
        out = np.ones(len(piece), dtype=bool)
        if self.kind == "unigram":
            return out
        which = np.flatnonzero((before >= 0) & (piece >= 0))
        a, b = before[which], piece[which]
        limit = np.full(len(which), self.size + 2)
        while len(which):
            apart = self.merged_rank(a, b) >= limit
            out[which[~apart]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = np.flatnonzero(apart & ((ra > 0) | (rb > 0)))
            which, a, b, ra, rb = which[on], a[on], b[on], ra[on], rb[on]
            left = ra > rb
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.parts[1][a], a), np.where(left, b, self.parts[0][b])
        return out

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces whose last merge joins a and b; beyond all ranks where there is none."""
        none = self.size + 2
        return np.full(len(a), none) if self.merges is None else self.merges.find((a * self.size + b).astype(np.uint64), none)

    def _matches(self, chars: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Pieces that stand in words: start and end place of each, and its id; a character without a piece is -1 - code.

        Hashes of the substrings that begin at a place grow by a character at a
        time, over all places whose word goes on.
        """
        value = chars.astype(np.uint64) + np.uint64(1)
        at = np.arange(len(chars))
        left = np.repeat(end, end - first) - at
        hashes, tags = np.zeros(len(chars), dtype=np.uint64), np.arange(self.longest + 1, dtype=np.uint64) * _TAG
        found = []
        for n in range(1, self.longest + 1):
            if n > 1:
                go = left >= n
                at, left, hashes = at[go], left[go], hashes[go]
            hashes = hashes * _BASE + value[at + (n - 1)]
            ids = self.probe(hashes + tags[n])
            if n == 1:
                alone = np.flatnonzero(ids < 0)
                found.append((at[alone], at[alone], -1 - chars[alone].astype(np.int64)))
            on = np.flatnonzero(ids >= 0)
            on = on[self.usable[ids[on]]]
            found.append((at[on], at[on] + (n - 1), ids[on]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after another, and how many each has; words advance together by one character at a time.

        ``best`` is the score of the best way to each place, ``last`` the piece
        that ends there, ``back`` where it begins.
        """
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(lengths)
        first = end - lengths
        start, stop, piece = self._matches(chars, first, end)
        step = stop - np.repeat(first, lengths)[stop]
        order = np.argsort(step.astype(np.uint16) if lengths.max() <= 1 << 16 else step, kind="stable")
        start, stop, piece = start[order], stop[order], piece[order]
        opens = start == np.repeat(first, lengths)[start]
        score = np.where(piece >= 0, self.score[np.maximum(piece, 0)], self.unknown)
        best, last = np.full(len(chars), -np.inf), np.full(len(chars), -1)
        back, count = np.zeros(len(chars), dtype=np.int64), np.zeros(len(chars), dtype=np.int64)
        bound = np.searchsorted(step[order], np.arange(int(lengths.max()) + 1)).tolist()
        for low, high in zip(bound, bound[1:], strict=False):
            s, e, p, new = start[low:high], stop[low:high], piece[low:high], opens[low:high]
            ok = self.fits(np.where(new, -1, last[s - 1]), p) & (new | (best[s - 1] > -np.inf))
            s, e, p, new = s[ok], e[ok], p[ok], new[ok]
            total = np.where(new, 0.0, best[s - 1]) + score[low:high][ok]
            np.maximum.at(best, e, total)
            # Longer pieces come later in order, so of equal totals the shortest stays.
            top = np.flatnonzero(total == best[e])[::-1]
            s, e, p, new = s[top], e[top], p[top], new[top]
            last[e], back[e], count[e] = p, s, np.where(new, 0, count[s - 1]) + 1
        n = count[end - 1]
        place, at, open_ = np.cumsum(n) - 1, end - 1, np.arange(len(words))
        out = np.empty(int(n.sum()), dtype=np.int64)
        while len(open_):
            out[place] = last[at]
            go = back[at] > first[open_]
            at, place, open_ = back[at][go] - 1, place[go] - 1, open_[go]
        return self._as_bytes(out, n)

    def _as_bytes(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        alone = np.flatnonzero(ids < 0)
        if not len(alone):
            return ids, n
        code = -1 - ids[alone]
        wide = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        width = np.ones(len(ids), dtype=np.int64)
        width[alone] = wide
        out, ends = np.repeat(ids, width), np.cumsum(width)
        raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
        out[np.repeat(ends[alone] - np.cumsum(wide), wide) + np.arange(len(raw))] = np.array(self.byte_ids)[raw]
        per_word = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return out, np.diff(per_word)

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has.

        Chunks are taken by length, so equally long ones advance together.
        """
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        order = np.argsort(size, kind="stable")
        upto, words = np.cumsum(size[order]), [chunks[k] for k in order.tolist()]
        runs, counts, low = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        while low < len(words):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + STEP_CELLS, side="right")))
            run, n = self._viterbi(words[low:high])
            runs.append(run)
            counts.append(n)
            low = high
        flat, n = np.concatenate(runs), np.concatenate(counts)
        lengths = np.zeros(len(chunks), dtype=np.int64)
        lengths[order] = n
        ends, from_ = np.cumsum(lengths), np.zeros(len(chunks), dtype=np.int64)
        from_[order] = np.cumsum(n) - n
        return flat[np.arange(len(flat)) + np.repeat(from_ - (ends - lengths), lengths)], lengths

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes and pieces joined, without the space that encoding puts first."""
        if not hasattr(self, "raw"):
            as_byte = {p: bytes([b]) for b, p in enumerate(self.byte_ids)}
            self.raw = [as_byte.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        return b"".join([self.raw[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]

    def store(self) -> ChunkStore:
        """What this worker has encoded so far."""
        if not hasattr(self, "kept"):
            self.kept = ChunkStore(self.encode_chunks)
        return self.kept


def chunks_of(text: str) -> list[str]:
    if not text:
        return []
    if text[0] == " " or "  " in text or SPACE in text or "\0" in text:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE))
    # No runs of spaces: plain splits do.
    marked = (SPACE + text.replace(" ", "\0" + SPACE)).replace("\n", "\0\n\0")
    return list(filter(None, marked.split("\0")))


def encode_pieces(documents: DataFrame, model: str, kind: str = "bpe", carry=("doc_id",)) -> DataFrame:
    """Encode every whole text of documents, and decode the ids again.

    ``model`` names a vocabulary file, read once by the driver; its pieces go to
    the tasks as a broadcast whose size the vocabulary bounds. The text is cut
    before runs of spaces; equally long pieces of text advance together through
    Viterbi: hashes of the substrings that end at a character probe the sorted
    keys of the vocabulary, vectorised maxima keep the best way there and a
    backpointer. Each distinct piece of text is encoded once per worker.

    Returns the columns in ``carry``, ids (array of int), n_tokens, ids_crc32 (of
    the ids as little-endian 32-bit integers) and decoded.
    Null and empty texts have no ids and decode to ''. Characters without a
    piece become byte ids. Repeated rows repeat their result; an empty table
    gives an empty result.
    """
    table = PieceTable.from_file(model, kind)
    shared = documents.sparkSession.sparkContext.broadcast(table)
    fields = documents.select(*carry).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, n_tokens long, ids_crc32 long, decoded string"

    def encode(batches):
        pieces = shared.value
        store = pieces.store()
        for batch in batches:
            texts = [t or "" for t in batch.column("pieces_text").to_pylist()]
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and (high == low or chars + len(texts[high]) <= STEP_CHARS):
                    chars += len(texts[high])
                    high += 1
                ids, n = store.ids_of([chunks_of(t) for t in texts[low:high]])
                ends = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                decoded = [pieces.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in carry), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(n), pa.array(crc, type=pa.int64()), pa.array(decoded, type=pa.string())],
                    names=[*carry, "ids", "n_tokens", "ids_crc32", "decoded"],
                )
                low = high

    return documents.select(*carry, F.col("text").alias("pieces_text")).mapInArrow(encode, schema)

