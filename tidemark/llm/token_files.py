"""Token ids of documents as files of range-coded blocks."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.batches import steps
from tidemark.llm.chunks import ChunkStore
from tidemark.llm.token_coder import decode_ids, encode_ids
from tidemark.plans.scratch import Scratch

#: Ids after which a segment of whole documents is closed; its blocks are coded in step.
SEGMENT_IDS = 1 << 22
#: Bytes of text that one task tokenizes, and at a time.
TASK_BYTES, STEP_BYTES = 1 << 25, 1 << 22
#: Distinct pieces that the library gets at a time, as it holds far more than the ids of each, those that it gets as one text, and those a worker remembers.
AT_A_TIME, AS_ONE, MOST_PIECES = 1 << 13, 64, 600_000
END_ID = 2

#: Where a text may be cut before tokenizing: before spaces that follow a character that isn't white space.
#: The vocabulary's own splitting pattern always begins anew there.
CUT = re.compile(r"(?<=\S)(?= )")
#: The same cuts where no other white space stands before a space.
RUN = re.compile(r" *[^ ]+| +")
OTHER_SPACE = re.compile(r"[^\S ] ")
#: White space, in Arrow's notation; texts with it before a space, or with the separator of cuts, are cut by themselves.
SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEPARATOR = "\0"
ODD = rf"[{SPACE}] |\x00"
#: Further cuts that the pattern always has: before a mark of punctuation after a letter or digit, and around one line end between visible characters.
MARKS = ((r"([0-9A-Za-zÀ-ÖØ-öø-ɏ])([.,;:!?)])", "\\1\0\\2"), (r"([!-~À-ÖØ-öø-ɏ])\n([!-~À-ÖØ-öø-ɏ])", "\\1\0\n\0\\2"))
#: Pieces that keep their ids when they follow each other in a text, and of whose ids only the first begins with a space.
JOINS = rf"\A [^{SPACE}]+\z"

SEGMENT = "part int, seq long, n_ids long, doc_ids array<long>, lengths array<int>, frames binary"


def pieces_of(text: str) -> list[str]:
    """A special token has no space in it, so that no cut falls inside one."""
    if OTHER_SPACE.search(text):
        return CUT.split(text)
    return RUN.findall(text)


class Tokens:
    """The tokenizer of a file, opened once per worker, and used as the library does by itself: the text of a special token gives its id."""

    opened: dict[str, ChunkStore] = {}

    @classmethod
    def store(cls, path: str) -> ChunkStore:
        if path not in cls.opened:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab()
            begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            begins[[i for piece, i in vocabulary.items() if piece[0] == "Ġ"]] = True

            def each(texts):
                runs = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                lengths = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
                return np.fromiter(chain.from_iterable(runs), dtype=np.int32, count=int(lengths.sum())), lengths

            def encode(pieces):
                """Most pieces go to the library many in one text, in which each id that begins with a space begins a piece."""
                joins = pc.match_substring_regex(pa.array(pieces, pa.large_string()), JOINS).to_numpy(zero_copy_only=False)
                words = list(compress(pieces, joins))
                ids, _ = each(["".join(words[k : k + AS_ONE]) for k in range(0, len(words), AS_ONE)])
                first = np.flatnonzero(begins[ids])
                if len(first) != len(words) or len(words) and first[0]:
                    return each(pieces)
                others, lengths_of_others = each(list(compress(pieces, ~joins)))
                lengths = np.empty(len(pieces), dtype=np.int64)
                lengths[joins], lengths[~joins] = np.diff(first, append=len(ids)), lengths_of_others
                out, joined = np.empty(len(ids) + len(others), dtype=np.int32), np.repeat(joins, lengths)
                out[joined], out[~joined] = ids, others
                return out, lengths

            cls.opened[path] = ChunkStore(encode, MOST_PIECES, AT_A_TIME)
        return cls.opened[path]


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    out = np.repeat(begin - (np.cumsum(length) - length), length)
    out += np.arange(len(out))
    return out


def encode_texts(store: ChunkStore, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts without nulls, one after another, and how many each text has.

    Texts are cut at spaces, their distinct words numbered, and these cut on, by
    Arrow; only the distinct pieces of words are looked up. An odd text is a word.
    """
    if not len(texts):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    odd = pc.match_substring_regex(texts, ODD)
    lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    first = lists.offsets.to_numpy().astype(np.int64)[:-1]
    words = lists.values.dictionary_encode()
    which, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
    # no space stands before the first word
    leading, which_of_first = np.unique(which[first], return_inverse=True)
    which[first] = len(distinct) + which_of_first
    cut = pa.concat_arrays([pc.binary_join_element_wise(" ", distinct, ""), distinct.take(pa.array(leading))])
    for pattern, by in MARKS:
        cut = pc.replace_substring_regex(cut, pattern, by)
    cut = pc.split_pattern(cut, SEPARATOR)
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    which[first[at]] = len(cut) + np.arange(len(at))
    alone = [pieces_of(text) for text in texts.take(pa.array(at)).to_pylist()]
    pieces = pa.concat_arrays([cut.values, pa.array(chain.from_iterable(alone), cut.values.type)]).dictionary_encode()
    begin, length = (x[pieces.indices.to_numpy()] for x in store.runs_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
    ids = store.ids[spread(begin, length)]
    upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([cut.offsets.to_numpy(), len(cut.values) + np.cumsum(list(map(len, alone)), dtype=np.int64)])]
    length = np.diff(upto)[which]
    return ids[spread(upto[which], length)], np.add.reduceat(length, first)


def give_back() -> None:
    """Return freed memory to the system, which else stays with the worker and counts against its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of GNU has it
        ctypes.CDLL(None).malloc_trim(0)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents (doc_id, text) in ascending doc_id order to ``path``.

    Texts are sorted by ranges of doc_id, so a task holds a run of documents; it
    tokenizes them, appends ``end_id`` to each, and closes a segment of whole
    documents every SEGMENT_IDS ids. A segment is a row of a Parquet file: its
    place, the documents and their lengths, and the ids as frames of blocks that
    share the segment's counts. ``tokenizer`` must be readable by every worker. Null text is empty, so
    its document is the end id alone. Null doc_ids come first; repeated doc_ids
    follow each other by a hash of the text, so even one id on a third of all
    rows is spread over tasks.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    tie = F.xxhash64("text")

    def write(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        store = Tokens.store(tokenizer)
        docs, counts, runs, held = [], [], [], 0

        def segment():
            nonlocal docs, counts, runs, held, seq
            ids, runs = np.concatenate(runs), []
            give_back()
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq]), "n_ids": pa.array([len(ids)]), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                 "lengths": pa.array([counts], pa.list_(pa.int32())), "frames": pa.array([encode_ids(ids)], pa.binary())}
            )
            docs, counts, held, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            texts, ids_of_docs = batch.column("text"), batch.column("doc_id").to_pylist()
            at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
            for low, high in steps(at, STEP_BYTES):
                ids, n = encode_texts(store, texts[low:high])
                docs += ids_of_docs[low:high]
                counts += (n + 1).tolist()
                runs.append(np.insert(ids, np.cumsum(n), np.int32(end_id)))
                held += len(runs[-1])
                if held >= SEGMENT_IDS:
                    yield segment()
        if docs:
            yield segment()

    ordered = texts.repartitionByRange(tasks, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(write, SEGMENT).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and if asked for ids (array of int).

    Starts come from the segments' counts: summed by task, then by segment
    within the task. Every block's checksum is verified.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    counts = files.select("part", "seq", "n_ids")
    tasks = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = tasks.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lengths = decode_ids(batch.column("frames")[i].as_py()), batch.column("lengths")[i].values.to_numpy()
                give_back()
                ends = np.concatenate([[0], np.cumsum(lengths)])
                n = len(lengths)
                columns = {
                    "doc_id": batch.column("doc_ids")[i].values, "part": pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)), "seq": pa.array(np.full(n, batch.column("seq")[i].as_py())), "at": pa.array(ends[:-1]),
                    "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    shape, names = "doc_id long, part int, seq long, at long, n_tokens long, ids_crc32 long", ("n_tokens", "ids_crc32")
    if with_ids:
        shape, names = f"{shape}, ids array<int>", (*names, "ids")
    docs = files.select("part", "seq", "doc_ids", "lengths", "frames").mapInArrow(read, shape)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), *names)


def round_trip(documents: DataFrame, scratch: Scratch, tokenizer: str) -> DataFrame:
    """Write the documents' ids to a file of the shared folder, and read it back: doc_id, start, n_tokens, ids_crc32.

    An empty table gives an empty file and an empty result; extra columns are ignored.
    """
    path = f"{scratch.path}/tokens"
    write_tokens(documents, path, tokenizer)
    return scratch.table(read_tokens(scratch.spark, path, with_ids=False), "read")
