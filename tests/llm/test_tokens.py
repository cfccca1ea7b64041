"""Packing and records: exact round trips against the tokenizer itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from moodgrid.llm import packing, records, tokens
from moodgrid.llm.common import new_folder

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, "  a  b ", "x \n y", "foo\n bar", "'s it's", "<|endoftext|> a", "\x01 a \x01", "a b  c", "é́ é x", " lead",
    "tail ", "a\tb", "##a #b", "\n\n", "日本 語", "a.b,c", "x.,y", "É.\n\nB", "q.\nZ,", "\x02 a.\x02b.", "A.\n B", "don't I'LL",
]


def expected(path, kind, texts):
    model = tokens.Encoder(path, kind).model
    return [e.ids + [2] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path, kind", [(WORD_FILE, "words"), (BYTE_FILE, "spaces")])
def test_encoder_is_the_tokenizer(spark, small, path, kind):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    offsets, ids = tokens.Encoder(path, kind).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in tokens.each_document(offsets)] == expected(path, kind, texts)


def check_pieces(rows, docs):
    sequences, per_doc = defaultdict(list), defaultdict(Counter)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    bodies = expected(WORD_FILE, "words", [t for _, t in docs])
    by_key = defaultdict(list)
    for (key, _), ids in zip(docs, bodies, strict=True):
        by_key[key].append(ids)
    assert set(by_key) == set(per_doc)
    for key, lists in by_key.items():
        pieces = per_doc[key]
        assert sum(n * c for (_, n, _, _), c in pieces.items()) == sum(map(len, lists))
        for start, n, check, whole in pieces:
            assert any(len(ids) == whole and crc(ids[start : start + n]) == check for ids in lists)
    return [sum(n for _, n in p) for p in sequences.values()]


def test_packing_holds_every_id_once(spark, small, odd):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd):
        sizes = check_pieces(packing.pack(docs, WORD_FILE).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
        assert all(s & (s - 1) == 0 for s in sizes)  # no padding


def test_packing_with_many_small_shards(spark, small, monkeypatch):
    monkeypatch.setattr(packing, "TASK_TOKENS", 20_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs, WORD_FILE, with_ids=True).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in rows)


def test_retrieval_prefers_what_is_like_the_seed():
    rng = np.random.default_rng(1)
    own, other = (rng.integers(a, a + 400, (6, 300)) for a in (10, 1000))
    docs = [d.astype(np.uint32) for pair in zip(own, other, strict=True) for d in pair]
    shard = packing.Shard(docs, np.ones(2000), 300.0)
    packing_order = [int(d) for d in shard.ranked(0)[:6]]
    assert set(packing_order) == {0, 2, 4, 6, 8, 10}


def test_records_round_trip(spark, odd):
    folder = new_folder(spark, "records")
    records.write_records(odd, folder, BYTE_FILE, file_bytes=60_000)
    index = records.positions(records.write_index(spark, folder)).collect()
    index.sort(key=lambda r: r["start"])
    order = [r["key"] for r in index]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in index:
        assert r["start"] == at
        at += r["n_tokens"]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    ids = expected(BYTE_FILE, "spaces", [t for _, t in docs])
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in index) == Counter(
        (k, len(i), crc(i)) for (k, _), i in zip(docs, ids, strict=True)
    )
    read = records.read_shuffled(spark, folder, seed=3).collect()
    assert Counter((r["key"], tuple(r["ids"])) for r in read) == Counter((k, tuple(i)) for (k, _), i in zip(docs, ids, strict=True))


def test_damage_is_seen():
    data = bytearray(records.frame(5, np.arange(4, dtype=np.uint16)) + records.END)
    assert records.unframe(memoryview(data), 0)[:2] == (len(data), 5)
    for at in (0, 9, 15, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bad), 0)


def test_empty_tables(spark, odd):
    assert packing.pack(odd.limit(0), WORD_FILE).count() == 0
    folder = new_folder(spark, "records")
    records.write_records(odd.limit(0), folder, BYTE_FILE)
    assert records.positions(records.write_index(spark, folder)).count() == 0
    assert records.read_shuffled(spark, folder).count() == 0


def test_letters_that_fold_into_two_characters():
    """U+0130 is a letter and a combining mark in lower case."""
    rnd = np.random.default_rng(6)
    parts = ["İ", ".", ",", " ", "a", "TEDAVİ.", "é", "\n", "ı", "K", "1", "'s"]
    texts = ["".join(rnd.choice(parts, rnd.integers(0, 12))) for _ in range(3_000)] + ["TEDAVİ.", "İ,İ."]
    for path, kind in ((WORD_FILE, "words"), (BYTE_FILE, "spaces")):
        offsets, ids = tokens.Encoder(path, kind).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in tokens.each_document(offsets)] == expected(path, kind, texts)
