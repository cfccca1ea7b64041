"""Byte-level BPE against the library on whole texts, and the round trip."""

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from moodgrid.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = [
    "a", "b", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "'", "''", "1", "23", "!", ".", ",", "é", "日", "　", " ",
    "\x1c", "\x85", "İ", "\U00010940", "\U000323b0", "😀", "<|endoftext|>", "'S", "'re", "'ve", "'ll", "'d", " '", "\r\n", "ß", "́",
]


def strings(seed, many):
    rnd = random.Random(seed)
    for _ in range(many):
        if rnd.random() < 0.3:
            points = (rnd.choice([rnd.randrange(1, 0x3000), rnd.randrange(0xE000, 0x34000)]) for _ in range(20))
            yield "".join(chr(c) for c in points)
        else:
            yield "".join(rnd.choice(PIECES) for _ in range(rnd.choice([0, 1, 2, 3, 8, 40])))


def test_encoding_is_the_library_s(spark, library):
    texts = [*strings(1, 10_000), "x" * 5_000, " " * 3_000, "ab " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == library.encode_ordinary(text), repr(text)


def test_decoding_gives_the_bytes_back(spark):
    texts = [*strings(2, 500), "", "é" * 1_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}


def test_blocks_do_not_matter(library):
    """Pre-tokens of several texts at once are those of each alone."""
    texts = list(strings(3, 300))
    offsets, codes, words = bpe.pretokens(pa.array(texts))
    words = words.to_pylist()
    for i, text in enumerate(texts):
        assert b"".join(words[c] for c in codes[offsets[i] : offsets[i + 1]]).decode() == text
        alone = bpe.pretokens(pa.array([text]))
        assert [words[c] for c in codes[offsets[i] : offsets[i + 1]]] == [alone[2][int(c)].as_py() for c in alone[1]]


def test_packing_round_trip():
    import numpy as np

    a, b, c = np.array([1, 70_000, 3], np.uint32), b"bytes", np.array([], np.int64)
    x, y, z = bpe.opened(bpe.squeezed(a, b, c), np.uint32, bytes, np.int64)
    assert x.tolist() == a.tolist() and y == b and len(z) == 0


def test_odd_rows(spark, odd, library):
    rows = bpe.encode(odd, RANKS).collect()
    want = sorted((repr(r.doc_id), library.encode_ordinary(r.text or "")) for r in odd.select("doc_id", "text").collect())
    assert sorted((repr(r.doc_id), r.ids) for r in rows) == want
    empty = bpe.decode(bpe.encode(odd.limit(0), RANKS), RANKS)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


def test_null_ids_and_unknown_ids(spark):
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()} == {b""}
    bad = spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, RANKS).collect()


def test_query(spark, small, library):
    import hashlib

    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_decoding_in_the_same_task(spark):
    texts = [*strings(9, 200), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r.doc_id: bytes(r.decoded) for r in bpe.encode(docs, RANKS, decoded=True).collect()}
    assert one == {i: (t or "").encode() for i, t in enumerate(texts)}
