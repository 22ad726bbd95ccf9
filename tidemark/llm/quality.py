"""Compression classifier: zstandard dictionaries of good and bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled documents of each class from which the dictionaries and the calibration are made, by smallest hash of the id.
SAMPLE_PER_CLASS = 3000
#: Longer documents are left out of that sample, to bound it in bytes.
SAMPLE_BYTES = 1 << 14
DICTIONARY_BYTES = 1 << 17
#: Texts are compressed in blocks of this many bytes, so that a long text can't become its own dictionary.
BLOCK_BYTES = 512
LEVEL = 6


def held_out(doc_id) -> Column:
    """crc32(doc_id as text) mod 3 = 1; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


@dataclass(frozen=True)
class CompressionClassifier:
    """Two dictionaries and a logistic curve over the normalised size difference."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: list[str]) -> np.ndarray:
        """(compressed bytes with the bad dictionary - those with the good one) / bytes of the text, 0 for empty texts."""
        kinds = []
        for d in (self.good, self.bad):
            trained = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            kinds.append(zstandard.ZstdCompressor(dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = text.encode()
            blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
            good, bad = (sum(len(c(b)) for b in blocks) for c in kinds)
            out[i] = (bad - good) / max(1, len(raw))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -500, 500)))


def _dictionary(texts: list[str], size: int) -> bytes:
    """Parts of the texts, equally long and evenly spread over all of them, up to size bytes."""
    share = max(64, size // max(1, len(texts)))
    return b"\n".join(t.encode()[:share] if len(t) < 2 * share else t.encode()[len(t) // 3 : len(t) // 3 + share] for t in texts)[-size:]


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a small ridge, by Newton steps."""
    wide = max(float(np.std(x)), 1e-9)
    a = np.column_stack([x / wide, np.ones_like(x)])
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-3]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / wide), float(w[1])


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> CompressionClassifier:
    """Fit on labelled documents that aren't held out, at most ``sample`` of each class.

    One half of the sample, by hash, fills the dictionaries; the other half,
    which they don't hold, calibrates the curve, each class weighed as it occurs
    among all labelled ids through the sample's share of it. Null labels, null
    texts and texts over SAMPLE_BYTES take no part; of several texts with one id, that with the least hash does. Without labels of both
    classes every text scores the smoothed share of good ones.
    """
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), F.col("quality").alias("y")).distinct()
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("labelled"), "labelled").limit(sample) for y in (0, 1)]
    # At most 2 * sample ids: small enough to send everywhere, so that the texts needn't be shuffled.
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).join(F.broadcast(drawn[0].union(drawn[1])), F.col("doc_id") == F.col("labelled"))
    # One text of each id, however many rows repeat it, so that the sample is bounded.
    one = rows.groupBy("labelled", "y").agg(F.min(F.struct(F.xxhash64("doc_id", "text").alias("h"), "text")).alias("least")).select("y", "least.*")
    found = sorted(one.collect(), key=lambda r: (r["h"], r["text"]))
    picked = {y: [r for r in found if r["y"] == y] for y in (0, 1)}
    n = {y: n.get(y, 0) for y in (0, 1)}
    base = float(np.log((n[1] + 1) / (n[0] + 1)))
    if len(picked[0]) < 4 or len(picked[1]) < 4:
        return CompressionClassifier(b"", b"", 0.0, base)
    texts = {y: [r["text"] for r in picked[y]] for y in (0, 1)}
    model = CompressionClassifier(_dictionary(texts[1][::2], DICTIONARY_BYTES), _dictionary(texts[0][::2], DICTIONARY_BYTES), 1.0, 0.0)
    x = model.differences(texts[0][1::2] + texts[1][1::2])
    y = np.array([0.0] * len(texts[0][1::2]) + [1.0] * len(texts[1][1::2]))
    slope, offset = _calibrated(x, y)
    prior = base - float(np.log(y.sum() / (len(y) - y.sum())))
    return CompressionClassifier(model.good, model.bad, slope, offset + prior)


def score_quality(documents: DataFrame, model: CompressionClassifier, carry=("doc_id",)) -> DataFrame:
    """The columns in ``carry`` with score (0 to 1, higher: label 1 likelier) of every whole text.

    The two dictionaries go to the tasks with the code; they are bounded by
    DICTIONARY_BYTES. Null and empty texts score what the offset alone gives.
    """
    fields = documents.select(*carry).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def score(batches):
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                scores = model.scores([t or "" for t in part.column("scored_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(scores, type=pa.float64())], names=[*carry, "score"])

    return documents.select(*carry, F.col("text").alias("scored_text")).mapInArrow(score, schema)
