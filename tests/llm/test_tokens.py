"""Token output, token counts and byte-level BPE against their libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from threadloom.llm import bpe, token_counts, token_output

JSON, MODEL, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


def noise(n, seed=3):
    r = random.Random(seed)
    parts = ["a", "the", "ing", " ", " ", "\n", "  ", "é", "日", "!", "'s", "12", " ", "\x1c", "▁", "\t", "<|endoftext|>", "😀", "tion"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["small", "large", "escaped", "zeros", "empty"])
def test_simple8b_round_trip(kind):
    r = np.random.default_rng(1)
    ids = {"small": r.integers(0, 4, 5000), "large": r.integers(0, 1 << 17, 5001), "escaped": r.integers(0, 1 << 63, 3000), "zeros": np.zeros(4097), "empty": np.zeros(0)}[kind].astype(np.uint64)
    if kind == "escaped":
        ids[::3] |= np.uint64(1) << np.uint64(63)
        ids[1::3] %= np.uint64(50)
    words, escapes = token_output.pack(ids)
    assert np.array_equal(token_output.unpack(words, escapes), ids)
    if kind == "zeros":
        assert len(words) < 4097 / 30


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_chunk_coder_equals_library(hard):
    texts = hard + noise(3000)
    coder = token_output.LibraryCoder(JSON)()
    for memo in (500_000, 50):  # a full memo changes nothing
        coder.memo.entries = memo
        ids, counts = coder(pa.array(texts))
        want = library_ids(texts)
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_ids_in_files(spark, documents):
    got = sorted(map(tuple, token_output.encoded(documents, JSON).collect()), key=lambda r: r[1])
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    want = {}
    for (d, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        want.setdefault(d, []).append((len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
    assert [r[0] for r in got] == sorted(d for d, _ in rows)
    at = 0
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n


def test_long_document_spans_its_own_block(spark):
    df = spark.createDataFrame([(1, "x"), (2, "word thing " * 60_000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_output.encoded(df, JSON).collect()}
    ids = library_ids(["word thing " * 60_000])[0]
    assert got[2].n_tokens == len(ids) + 1 and got[3].start == got[2].start + len(ids) + 1 and got[3].n_tokens == 1


def test_counts_equal_library(spark, documents, hard):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = hard + noise(3000, 5)
    assert token_counts.counter(MODEL).divisible
    assert token_counts.counter(MODEL)(pa.array(texts)).tolist() == [len(m.encode(t)) for t in texts]
    assert token_counts.counter(JSON)(pa.array(texts)).tolist() == [len(x) for x in library_ids(texts)]
    got = token_counts.count_tokens(documents, MODEL, 100).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(m.encode(r.text or ""))) for r in documents.collect())
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, documents, hard):
    library = tiktoken_encoding()
    vocabulary, coder = bpe.coder(RANKS, P.PATTERN)
    texts = hard + noise(4000, 7)
    ids, counts = coder(pa.array(texts))
    want = [library.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    for t, w in zip(texts, want, strict=True):
        assert vocabulary.encode(t) == w and vocabulary.decode(w) == t.encode()
    for r in bpe.round_trip(documents, RANKS, P.PATTERN).join(documents.select("doc_id", "text").distinct(), "doc_id").collect():
        own = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_backtracking_equals_merging():
    vocabulary, _ = bpe.coder(RANKS, P.PATTERN)
    r = random.Random(2)
    for _ in range(1500):
        piece = bytes(r.randrange(256) for _ in range(r.randint(1, 10))) if r.random() < 0.5 else bytes(r.choice(b"aehnrstio") for _ in range(r.randint(1, 40)))
        assert vocabulary.encode_piece(piece) == vocabulary.merged(piece)
    ids = sorted(vocabulary.bytes_of)
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        assert vocabulary._apart(a, b) == vocabulary._merge_apart(a, b)


def test_bpe_of_a_vocabulary_with_an_unreachable_token():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    v = bpe.Vocabulary(ranks, r"\S+|\s+")
    r = random.Random(4)
    for _ in range(500):
        piece = bytes(r.choice(b"abcxyz") for _ in range(r.randint(1, 12)))
        assert v.encode_piece(piece) == v.merged(piece)
    assert v.encode_piece(b"xyz") == [259] and 259 not in v.encode_piece(b"xyzx")


def test_empty_tables(nothing):
    assert token_output.encoded(nothing, JSON).count() == 0
    assert token_counts.count_tokens(nothing, MODEL).count() == 0
    assert bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
