"""License scans by a positional index of licence words."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import LETTER_OR_DIGIT, Words, hash_word, steps, text_bytes

#: Words by which an alignment may drift, and distinct words that must agree on it.
DRIFT, LEAST_ANCHORS = 3, 4

# Phrases whose places are always counted, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Sentences of public licence notices, with the phrases that must be there for the label.
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted free of charge", "without limitation the rights"]),
    "apache": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", ["you may not use this file except in compliance with the license"]),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["you can redistribute it and or modify it under the terms of the gnu", "as published by the free software foundation"]),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license", "as published by the free software foundation"]),
    "agpl": ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license", "as published by the free software foundation"]),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", ["subject to the terms of the mozilla public license"]),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ["free and unencumbered software released into the public domain"]),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License", ["creative commons attribution"]),
}


def words_of(text: str) -> list[bytes]:
    """Words of a template, as they are taken from documents."""
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


@dataclass
class PositionalIndex:
    """Positions of every licence word in each template, and the phrases to verify, with their words' numbers."""

    labels: list[str]
    lengths: list[int]
    vocabulary: list[bytes]
    hashes: np.ndarray
    places: list[dict[int, list[int]]]
    required: list[list[tuple[np.ndarray, list[int]]]]
    base: list[tuple[str, np.ndarray, list[int]]] = field(default_factory=list)

    @staticmethod
    def build(templates=TEMPLATES, base=BASE_PHRASES) -> PositionalIndex:
        texts = [words_of(t) for t, _ in templates.values()]
        phrases = [[words_of(p) for p in ps] for _, ps in templates.values()]
        fixed = [(label, words_of(p)) for p, label in base.items()]
        vocabulary = sorted({w for t in texts for w in t} | {w for ps in phrases for p in ps for w in p} | {w for _, p in fixed for w in p})
        number = {w: i for i, w in enumerate(vocabulary)}
        places: list[dict[int, list[int]]] = [{} for _ in texts]
        for k, t in enumerate(texts):
            for at, w in enumerate(t):
                places[k].setdefault(number[w], []).append(at)
        code = lambda p: np.array([hash_word(w) for w in p], dtype=np.uint64)
        return PositionalIndex(
            list(templates), [len(t) for t in texts], vocabulary, code(vocabulary), places, [[(code(p), [number[w] for w in p]) for p in ps] for ps in phrases],
            [(label, code(p), [number[w] for w in p]) for label, p in fixed],
        )

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places among all words of a step where a licence word stands, and which word it is."""
        order = np.argsort(self.hashes)
        ranked = self.hashes[order]
        place = np.minimum(np.searchsorted(ranked, words.hash), len(ranked) - 1)
        at = np.flatnonzero(ranked[place] == words.hash)
        return at, order[place[at]]


def _stands(hashes: np.ndarray, phrase: np.ndarray, at: int) -> bool:
    return 0 <= at and at + len(phrase) <= len(hashes) and bool((hashes[at : at + len(phrase)] == phrase).all())


def _places(idf: np.ndarray, hashes: np.ndarray, at: np.ndarray, which: np.ndarray, phrase: np.ndarray, numbers: list[int]) -> list[int]:
    """Where a phrase stands, in order; looked for at the places of its rarest word."""
    k = max(range(len(numbers)), key=lambda i: (idf[numbers[i]], -i))
    return [a - k for a in at[which == numbers[k]].tolist() if _stands(hashes, phrase, a - k)]


def match_document(index: PositionalIndex, idf: np.ndarray, hashes: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Base places, their smallest and largest start, base labels, all labels, score.

    ``hashes`` are the document's words; ``at`` and ``which`` its licence words
    in order. A phrase is looked for at the places of its rarest word. For the
    templates all of whose mandatory phrases stand somewhere, every place of each
    of the template's words votes for where the template would begin; alignments
    with enough distinct words are kept if the mandatory phrases stand there.
    """
    present = set(which.tolist())
    starts: list[int] = []
    base_labels: set[str] = set()
    for label, phrase, numbers in index.base:
        if not present.issuperset(numbers):
            continue
        if found := _places(idf, hashes, at, which, phrase, numbers):
            base_labels.add(label)
            starts += found
    labels, best = set(base_labels), 1.0 if starts else 0.0
    for template, required in enumerate(index.required):
        if not all(present.issuperset(numbers) for _, numbers in required):
            continue
        phrases = [(_places(idf, hashes, at, which, p, numbers), len(p)) for p, numbers in required]
        if not all(stands for stands, _ in phrases):
            continue
        known = present.intersection(index.places[template])
        cast = sorted((a - place, w) for w in known for a in at[which == w].tolist() for place in index.places[template][w])
        low, agreed = 0, Counter()
        for high, (begin, word) in enumerate(cast):
            agreed[word] += 1
            while begin - cast[low][0] > DRIFT:
                agreed[cast[low][1]] -= 1
                if not agreed[cast[low][1]]:
                    del agreed[cast[low][1]]
                low += 1
            if len(agreed) < LEAST_ANCHORS or (index.labels[template] in labels and len(agreed) <= best * len(known)):
                continue
            first, last = max(0, cast[low][0] - DRIFT), begin + index.lengths[template] + DRIFT
            if all((k := bisect.bisect_left(stands, first)) < len(stands) and stands[k] + n <= last for stands, n in phrases):
                labels.add(index.labels[template])
                best = max(best, len(agreed) / len(known))
    return len(starts), min(starts, default=None), max(starts, default=None), base_labels, labels, best


def _words(batches, columns=()):
    """Steps of the texts of Arrow batches: the words, and the step's rows of the other columns."""
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        for a, b in steps(at):
            yield Words(data[at[a] : at[b]], at[a : b + 1] - at[a], LETTER_OR_DIGIT), [batch.column(c).slice(a, b - a) for c in columns]


def word_idf(documents: DataFrame, index: PositionalIndex) -> np.ndarray:
    """Inverse document frequency of every licence word over all documents; the driver gets one row for each word."""

    def count(batches):
        total, seen = 0, np.zeros(len(index.vocabulary), dtype=np.int64)
        for words, _ in _words(batches):
            at, which = index.hits(words)
            pairs = np.unique(words.text[at] * len(index.vocabulary) + which)
            seen += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
            total += len(words.first) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(seen))), pa.array(np.concatenate([[total], seen]))], names=["word", "n"])

    sums = documents.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in sums.collect()}
    return np.array([np.log((n.get(-1, 0) + 1) / (n.get(w, 0) + 1)) for w in range(len(index.vocabulary))])


def scan_licenses(documents: DataFrame, index: PositionalIndex | None = None) -> DataFrame:
    """License phrases and notices in every whole text of documents (doc_id, text).

    Two passes: document frequencies of the licence words over all documents,
    then the scan. Neither shuffles texts; a document is matched on its own.
    Words are compared by 64-bit hash.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (1 with a base phrase, else the share of a template's words in the file
    that agree on the best alignment, else 0). Null and empty texts have no words, no labels
    ('') and score 0; repeated rows repeat their result; an empty table gives an
    empty result; extra columns are ignored.
    """
    index = index or PositionalIndex.build()
    idf = word_idf(documents, index)

    def scan(batches):
        for words, (ids,) in _words(batches, ["doc_id"]):
            at, which = index.hits(words)
            bound = np.searchsorted(at, words.first)
            rows = []
            for i in range(len(ids)):
                a, b, first = bound[i], bound[i + 1], words.first[i]
                r = match_document(index, idf, words.hash[first : words.first[i + 1]], at[a:b] - first, which[a:b]) if b > a else (0, None, None, (), (), 0.0)
                rows.append((*r[:3], ",".join(sorted(r[3])), ",".join(sorted(r[4])), float(r[5])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(words.first)), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
