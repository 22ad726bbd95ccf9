import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_coder
from tidemark.llm.chunks import ChunkStore
from tidemark.llm.pieces import PieceTable, chunks_of, encode_pieces
from tidemark.llm.token_coder import BLOCK, decode_ids, encode_ids
from tidemark.llm.token_files import Tokens, encode_texts, pieces_of, read_tokens, round_trip, write_tokens

BYTE_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, (1 << 17) - 2)), max_size=300), st.integers(1, 70))
def test_coder_round_trip(ids, block):
    assert decode_ids(encode_ids(np.array(ids, dtype=np.int64), block)).tolist() == ids


def test_coder_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(0, 50_000, 60), 200), rng.integers(0, 50_000, 2 * BLOCK + 7), np.full(BLOCK, 9)])
    data = encode_ids(ids, BLOCK)
    assert (decode_ids(data) == ids).all() and (decode_ids(encode_ids(ids)) == ids).all() and len(encode_ids(ids[:12_000], BLOCK)) < 4000
    n, size, _ = struct.unpack_from("<III", data, 4)
    assert n == BLOCK and (decode_ids(data[16 + size :]) == ids[BLOCK:]).all()
    for bad in (b"x" + data[1:], data[:-1], data[:40] + bytes([data[40] ^ 255]) + data[41:]):
        with pytest.raises(ValueError):
            decode_ids(bad)
    with pytest.raises(ValueError):
        encode_ids(np.array([-1]))


def entropy(ids):
    p = np.bincount(ids) / len(ids)
    return -(p[p > 0] * np.log2(p[p > 0])).sum()


def test_coder_mixes_the_orders():
    """Skewed ids cost near their order-0 entropy, and ids of which half follow from the last one less than the same ids in any order."""
    rng = np.random.default_rng(3)
    n = 64 * BLOCK
    skewed = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.int32)
    cost = lambda ids: len(encode_ids(ids, BLOCK)) * 8 / len(ids)
    assert cost(skewed) < entropy(skewed) + 0.9
    after = rng.permutation(50_001).astype(np.int32)
    chained = skewed.copy()
    for i in np.flatnonzero(rng.random(n - 1) < 0.5) + 1:
        chained[i] = after[chained[i - 1]]
    assert cost(chained) < cost(rng.permutation(chained)) - 0.5
    assert (decode_ids(encode_ids(chained)) == chained).all()


def test_counts_of_a_run_serve_all_its_blocks():
    """Short blocks needn't learn how frequent ids are; the counts have a checksum, and frames without them are refused."""
    ids = np.random.default_rng(4).choice(50_000 - np.arange(400) * 7, 1 << 16, p=(w := 1 / np.arange(1, 401)) / w.sum()).astype(np.int32)
    data = encode_ids(ids, 128)
    blocks = len(ids) // 128
    assert (decode_ids(data) == ids).all() and (len(data) - 22 * blocks) * 8 / len(ids) < entropy(ids) + 0.5
    table = data.rindex(b"TMCT")
    for bad in (data[:table], data[:-3] + bytes([data[-3] ^ 1]) + data[-2:], data + data[table:]):
        with pytest.raises(ValueError):
            decode_ids(bad)


LIBRARY = Tokenizer.from_file(BYTE_BPE)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_special_tokens_as_the_library_gives_them():
    for text in ("<|endoftext|> a", "a<|endoftext|>b", "a  <|endoftext|>  <|endoftext|> c", " <|endoftext|>", "<|endoftext|", "x <|endoftext|>\n y"):
        assert [i for p in pieces_of(text) for i in plain_ids(p)] == plain_ids(text)
    assert 50256 in plain_ids("a <|endoftext|> b")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab' \n\té1.— 　<|>", max_size=40))
def test_cuts_leave_the_ids_alone(text):
    assert [i for p in pieces_of(text) for i in plain_ids(p)] == plain_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab'9 \n\té1.,:)?— \x1c\u3000\u0301\0<|>", max_size=30) | st.sampled_from(["a<|endoftext|>, b", "é.\n<|endoftext|>.\nx y", "a.\n\nB, c", " x ", "  x"]), max_size=6))
def test_texts_get_the_library_s_ids(texts):
    """Words cut at marks and line ends and joined again for the library; texts with odd spaces or the separator of cuts."""
    ids, n = encode_texts(Tokens.store(BYTE_BPE), pa.array(["left out", *texts], pa.string())[1:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(texts)] == [plain_ids(t) for t in texts]


def test_a_word_is_asked_for_once():
    """However marks and line ends follow a word, the library gets it once; a call holds many words, and they keep their ids."""
    store = ChunkStore(lambda pieces: calls.append(pieces) or inner(pieces), 1000, 64)
    calls, inner = [], Tokens.store(BYTE_BPE).encode
    texts = ["a word, word. word; word) word!\nword", "b " + " ".join(f"w{'abcdefgh'[k % 8]}{k}" for k in range(200)), "c word"]
    ids, n = encode_texts(store, pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [plain_ids(t) for t in texts]
    asked = [p for call in calls for p in call]
    assert len(asked) == len(set(asked)) and [p for p in asked if "word" in p] == [" word", "word"] and max(map(len, calls)) <= 64


def test_a_full_store_keeps_what_was_asked_for_again():
    asked = []
    store = ChunkStore(lambda pieces: asked.extend(pieces) or (np.array([ord(p[0]) for p in pieces], np.int32), np.ones(len(pieces), np.int64)), 10)
    for pieces in (["a", "b"], ["a", *"cdefghijklm"], ["a", "n", "c"], ["b", "a"]):
        begin, length = store.runs_of(pieces)
        assert store.ids[begin].tolist() == [ord(p) for p in pieces] and (length == 1).all()
    assert asked == [*"abcdefghijklm", "n", "c", "b"] and store.known == 4


def test_a_run_advances_many_blocks_in_step(monkeypatch):
    """The cost of a step is shared by all blocks."""
    steps, predict = [], token_coder._Model.predict
    monkeypatch.setattr(token_coder._Model, "predict", lambda model: steps.append(model.lanes) or predict(model))
    ids = np.random.default_rng(5).integers(0, 300, 1 << 19).astype(np.int32)
    data = encode_ids(ids)
    assert len(steps) <= 512 and min(steps) >= 1000
    assert (decode_ids(data) == ids).all() and len(steps) <= 1024


def test_token_files(spark, edge, empty, documents, scratch):
    for df in (edge, documents):
        got = sorted(round_trip(df, scratch, BYTE_BPE).collect(), key=lambda r: r.start)
        rows = [(r.doc_id, plain_ids(r.text) + [2]) for r in df.collect()]
        assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(i if i is not None else -1 for i, _ in rows)
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in rows), key=repr)
    assert round_trip(empty, scratch, BYTE_BPE).count() == 0


def test_token_file_holds_the_ids(spark, documents, scratch):
    write_tokens(documents.limit(20), f"{scratch.path}/f", BYTE_BPE)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in read_tokens(spark, f"{scratch.path}/f").collect():
        assert r.ids == plain_ids(texts[r.doc_id]) + [2]


@pytest.fixture(scope="module")
def bpe():
    return PieceTable.from_file(PIECES, "bpe"), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def flat(encoded):
    return encoded[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdest ing\n.,é中𝒳12=▁", max_size=60))
def test_pieces_equal_the_library(bpe, text):
    table, library = bpe
    assert flat(table.encode_chunks(chunks_of(text))) == library.encode(text)
    if "▁" not in text:
        assert table.decode(np.array(library.encode(text), dtype=np.int64)) == text


def test_long_runs_equal_the_library(bpe):
    table, library = bpe
    for text in ("a" * 130, " " * 40 + "x", "=" * 64 + "-" * 33, "abab" * 60):
        assert flat(table.encode_chunks(chunks_of(text))) == library.encode(text)


def test_encode_pieces(spark, edge, empty, documents, bpe):
    for df in (edge, documents.limit(60)):
        texts = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
        got = sorted(((r.doc_id, r.decoded, r.n_tokens, list(r.ids)) for r in encode_pieces(df, PIECES).collect()), key=repr)
        assert [(i, t) for i, t, _, _ in got] == texts
        assert all(ids == bpe[1].encode(t) and n == len(ids) for _, t, n, ids in got)
    assert encode_pieces(empty, PIECES).count() == 0


def test_unigram_viterbi_against_brute_force():
    pieces, scores = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb"], [0, -2.1, -1.7, -1.9, -2.3, -2.2, -2.9, -3.05, -3.3, -2.05]
    table = PieceTable(pieces, scores, list(range(256)), "unigram", [False] + [True] * 9)
    rank = dict(zip(pieces[1:], scores[1:], strict=True))

    def best(word):
        ways = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            ways[j] = max((ways[i][0] + rank[word[i:j]], ways[i][1] + [pieces.index(word[i:j])]) for i in range(j) if word[i:j] in rank)
        return ways[len(word)][1]

    rng = np.random.default_rng(2)
    words = ["▁" + "".join(rng.choice(["a", "b"], size=rng.integers(1, 14))) for _ in range(300)]
    ids, n = table.encode_chunks(words)
    assert [r.tolist() for r in np.split(ids, np.cumsum(n)[:-1])] == [best(w) for w in words]
