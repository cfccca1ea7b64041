"""Packing by lexical retrieval: an inverted index with BM25 in every shard of the corpus.

Texts are encoded once into a written table. Document frequencies of all token
ids are counted over the whole corpus (the vocabulary bounds that table). Shards
are runs of documents in the order of a sketch, so that documents that share
much lie in one shard; a shard is bounded by tokens, never by a key. Within a
shard each window starts with a seed document; the index returns the unused
documents in the order of their BM25 score for the seed's terms, and they fill
the window. The document that no longer fits is cut, and its rest seeds the next
window, so windows are full. What is left of a shard at the end goes into
sequences whose lengths are powers of two, which need no padding either.

Nulls: a null text is an empty document (the end id alone); a null key stays
null. Rows that repeat are packed each. A text longer than a window fills windows
of its own. An empty table gives no pieces. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm import tokens
from moodgrid.llm.common import parts_for, ranges, slices, spread, staged, text_or_empty

WINDOW = 4096
SHARD_TOKENS = 1 << 20
TASK_TOKENS = 8 << 20
K1, B = 1.2, 0.75
# Terms in more than this share of a shard's documents have a cell for each document; it bounds these cells by the postings.
COMMON = 1 / 8
# Documents of a shard up to which the common terms are scored for all seeds at once, and seeds of a product.
MATRIX, SEEDS = 2_048, 256
# Weights are whole multiples of this, so scores are exact in whichever order they are added up.
GRAIN = 2.0**-28

ENCODED = "key long, ids binary, n_tokens long, sketch long"
PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoded(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path, kind)
        for batch in batches:
            for part in slices(batch, "text", tokens.TEXT_BYTES):
                offsets, ids = coder.encode(part.column("text"))
                blobs = [ids[a:b].tobytes() for a, b in tokens.each_document(offsets)]
                columns = [
                    part.column("key"),
                    pa.array(blobs, pa.binary()),
                    pa.array(np.diff(offsets)),
                    pa.array(_sketch(ids, offsets)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "n_tokens", "sketch"])

    return run


def _sketch(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash of a document's id pairs: equal for most documents that share most pairs."""
    if not len(ids):
        return np.empty(0, np.int64)
    pairs = ids.astype(np.uint64) << np.uint64(32)
    pairs[:-1] |= ids[1:].astype(np.uint64)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(32)
    return np.minimum.reduceat(pairs, offsets[:-1]).view(np.int64)


def _unpacked(blob: bytes, width: str) -> np.ndarray:
    return np.frombuffer(blob, width)


def _frequencies(width: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column("ids").to_pylist():
                counts[np.unique(_unpacked(blob, width))] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return run


class Shard:
    """The documents of one shard, their index, and the greedy filling of windows."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_tokens: float):
        self.docs = docs
        length = np.array([len(d) for d in docs], np.int64)
        self.start = length - length % WINDOW  # what stands before fills windows of its own
        self.left = length - self.start
        ids = np.concatenate([np.sort(d, kind="stable") for d in docs])
        new = np.empty(len(ids), bool)
        new[:1], new[1:] = True, ids[1:] != ids[:-1]
        new[np.cumsum(length[:-1])] = True  # every document has its end id at least
        begin = np.flatnonzero(new)
        term, tf = ids[begin], np.diff(np.append(begin, len(ids))).astype(np.float64)
        many = np.add.reduceat(new, np.cumsum(length) - length, dtype=np.int64)
        owner = np.repeat(np.arange(len(docs)), many)
        tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean_tokens, 1.0)))
        weight = np.rint(tf * idf[term] / GRAIN) * GRAIN
        order = np.argsort(term, kind="stable")
        self.owner, self.weight, by_term = owner[order], weight[order], term[order]
        self.first = np.flatnonzero(np.concatenate(([True], by_term[1:] != by_term[:-1])))
        self.df = np.diff(np.append(self.first, len(by_term)))
        place = np.empty(len(term), np.int64)
        place[order] = np.repeat(np.arange(len(self.first)), self.df)
        self.places = np.split(place, np.cumsum(many)[:-1])  # of each document's terms
        self._common()

    def _common(self) -> None:
        """Weights of the common terms, terms x documents; in small shards also their scores, seeds x documents."""
        size = len(self.docs)
        often = np.flatnonzero(self.df > max(2, COMMON * size))
        self.row = np.full(len(self.df), -1)
        self.row[often] = np.arange(len(often))
        at = ranges(self.first[often], self.df[often])
        self.cells = np.zeros((len(often), size))
        self.cells[np.repeat(np.arange(len(often)), self.df[often]), self.owner[at]] = self.weight[at]
        self.scores = None
        if size > MATRIX:
            return
        self.scores = np.empty((size, size))
        for low in range(0, size, SEEDS):
            asked = (self.cells[:, low : low + SEEDS] != 0).T.astype(float)
            self.scores[low : low + SEEDS] = asked @ self.cells

    def ranked(self, seed: int) -> np.ndarray:
        """Documents with something left, by BM25 score for all terms of the seed, then by place."""
        at, rows = self.places[seed], self.row[self.places[seed]]
        score = self.cells[rows[rows >= 0]].sum(axis=0) if self.scores is None else self.scores[seed].copy()
        at = at[rows < 0]
        found = ranges(self.first[at], self.df[at])
        score += np.bincount(self.owner[found], self.weight[found], minlength=len(self.docs))
        free = np.flatnonzero(self.left)
        return free[np.argsort(-score[free], kind="stable")]

    def pieces(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Document, start, length, sequence and offset of every piece."""
        sequence = 0
        for doc, end in enumerate(self.start.tolist()):
            for at in range(0, end, WINDOW):
                yield doc, at, WINDOW, sequence, 0
                sequence += 1
        cut, after = -1, 0
        while True:
            while after < len(self.docs) and not self.left[after]:
                after += 1
            seed = cut if cut >= 0 else after
            if seed >= len(self.docs):
                return
            cut, window = -1, [self._take(seed, WINDOW)]
            room = WINDOW - window[0][2]
            if room:
                for doc in self.ranked(seed).tolist():
                    window.append(self._take(doc, room))
                    room -= window[-1][2]
                    if self.left[doc]:
                        cut = doc
                    if not room:
                        break
            for size in [WINDOW] if not room else [1 << b for b in range(12, -1, -1) if (WINDOW - room) >> b & 1]:
                yield from self._fill(window, size, sequence)
                sequence += 1

    def _take(self, doc: int, room: int) -> tuple[int, int, int]:
        size = min(int(self.left[doc]), room)
        start = int(self.start[doc])
        self.start[doc] += size
        self.left[doc] -= size
        return doc, start, size

    @staticmethod
    def _fill(window: list, size: int, sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Takes ``size`` tokens off the front of the window."""
        offset = 0
        while offset < size:
            doc, start, length = window.pop(0)
            used = min(length, size - offset)
            yield doc, start, used, sequence, offset
            if used < length:
                window.insert(0, (doc, start + used, length - used))
            offset += used


def _packed(width: str, idf: np.ndarray, mean_tokens: float, with_ids: bool):
    def flush(keys: list, blobs: list, base: int) -> tuple[pa.RecordBatch, int]:
        docs = [_unpacked(b, width) for b in blobs]
        columns: list[list] = [[] for _ in range(8)]
        last = base - 1
        for doc, start, length, sequence, offset in Shard(docs, idf, mean_tokens).pieces():
            ids = docs[doc][start : start + length].astype("<u4")
            last = base + sequence
            values = (keys[doc], start, length, zlib.crc32(ids), len(docs[doc]), last, offset, ids)
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names), last + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blobs, held = [], [], 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = zip(batch.column("key").to_pylist(), batch.column("ids"), batch.column("n_tokens").to_pylist(), strict=True)
            for key, blob, n in rows:
                keys.append(key)
                blobs.append(blob.as_py())
                held += n
                if held >= SHARD_TOKENS:
                    out, base = flush(keys, blobs, base)
                    yield out
                    keys, blobs, held = [], [], 0
        if keys:
            yield flush(keys, blobs, base)[0]

    return run


def pack(
    docs: DataFrame, tokenizer: str, kind: str = "words", key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    spark = docs.sparkSession
    coder = tokens.encoder(tokenizer, kind)
    width, size = np.dtype(coder.width).newbyteorder("<").str, coder.model.get_vocab_size()
    rows = spread(docs).select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    encoded = staged(rows.mapInArrow(_encoded(tokenizer, kind), ENCODED), "encoded")
    n_docs, n_tokens = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    counted = encoded.select("ids").mapInArrow(_frequencies(width, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    df = np.zeros(size, np.int64)
    for row in counted.collect():  # one row a token id at most: the vocabulary is the bound
        df[row["id"]] = row["n"]
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    order = ["sketch", "key", "n_tokens"]
    dealt = encoded.repartitionByRange(parts_for(spark, n_tokens, TASK_TOKENS), *order).sortWithinPartitions(*order, "ids")
    mean = n_tokens / max(n_docs, 1)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return dealt.select("key", "ids", "n_tokens").mapInArrow(_packed(width, idf, mean, with_ids), schema).withColumnRenamed("key", key)
