"""Benchmark decontamination by spaced-seed hashing.

A mask slides over the words of a text; the words under its marked positions are
hashed, the others are ignored, so one substituted word spoils some windows only.
Windows of the benchmark are filed by hash. Windows of the training texts first
pass a bit filter of fixed size (``FILTER_BITS``), built from the filed hashes;
those that pass join the filed ones by hash. A hit says which item stands where:
the words around it are then compared one by one along the same offset, and the
best stretch counts (a match scores one, a substitution costs ``MISS``). A text is
contaminated by an item if the stretch has ``LEAST`` matching words, or the whole
item if that is shorter.

Only candidates (document, item, offset) are joined to texts again, each document
once. Nulls: a null text or item has no words and never matches; a null key is
judged like any other through its text. Rows that repeat come back each. Items of
fewer words than a mask spans are found by their whole word sequence. An empty
benchmark or table gives no contamination. Further columns are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import row_hash, slices, spread, staged, words_of

# Marked positions of a window: one run and two spaced masks, of weight seven.
MASKS = ("1111111", "1101100111", "11010010111")
LEAST = 12
MISS = 2
FILTER_BITS = 1 << 23
MARKS = ".,;:!?\"'()[]{}<>|#*$%&-_/\\"
OVERLAPS = "key long, item long, place long, words long, matches long"
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and a hash of every word, lower-cased, marks around it dropped, bare marks left out."""
    offsets, codes, vocabulary = words_of(texts)
    bare = pc.utf8_trim(pc.utf8_lower(vocabulary), MARKS).to_pylist()
    digest = xxhash.xxh64_intdigest
    of_code = np.array([digest(w) if w else 0 for w in bare], np.uint64)
    keep = np.array([bool(w) for w in bare], bool)[codes] if len(bare) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    return np.concatenate(([0], np.cumsum(counts))), of_code[codes[keep]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SPREAD
    return x ^ (x >> np.uint64(29))


def windows(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and hash of every masked window that lies within one text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for number, mask in enumerate(MASKS):
        span = len(mask)
        n = len(words) - span + 1
        if n <= 0:
            continue
        value = np.full(n, number + 1, np.uint64)
        for at, mark in enumerate(mask):
            if mark == "1":
                value = _mixed(value ^ words[at : at + n])
        inside = np.flatnonzero(owner[:n] == owner[span - 1 :])
        yield inside, value[inside]
    # Texts too short for any mask: their whole sequence.
    sizes = np.diff(offsets)
    shortest = min(map(len, MASKS))
    for size in range(1, shortest):
        for first in offsets[:-1][sizes == size]:
            value = np.full(1, size + 1000, np.uint64)
            for word in words[first : first + size]:
                value = _mixed(value ^ word)
            yield np.array([first]), value


def _short_windows(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of ``size`` words, hashed as a short item of that size is."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = np.full(n, size + 1000, np.uint64)
    for at in range(size):
        value = _mixed(value ^ words[at : at + n])
    inside = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return inside, value[inside]


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, words = hashed_words(pc.fill_null(batch.column("text"), ""))
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for at, value in windows(words, offsets):
            item = np.searchsorted(offsets, at, "right") - 1
            columns = (keys[item], value.view(np.int64), at - offsets[item], np.diff(offsets)[item])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "hash", "at", "words"])


def _bits(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = value & np.uint64(FILTER_BITS - 1)
    high = (value >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)
    return low, high


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        for bit in _bits(batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)):
            np.bitwise_or.at(held, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], ["word", "bits"])


def _hits(bits: np.ndarray, short: list[int]):
    def known(value: np.ndarray) -> np.ndarray:
        found = np.ones(len(value), bool)
        for bit in _bits(value):
            found &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, words = hashed_words(pc.fill_null(part.column("text"), ""))
                groups = [*windows(words, offsets), *(_short_windows(words, offsets, s) for s in short)]
                for at, value in groups:
                    found = known(value)
                    at, value = at[found], value[found]
                    doc = np.searchsorted(offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(doc)), pa.array(value.view(np.int64)), pa.array(at - offsets[doc])],
                        ["id", "hash", "place"],
                    )

    return run


def stretch(same: np.ndarray) -> tuple[int, int, int]:
    """Start, end and matches of the best stretch: a match scores one, a miss costs ``MISS``."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -MISS))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OVERLAPS.split(", ")]
    for batch in batches:
        for part in slices(batch, "text"):
            offsets, words = hashed_words(pc.fill_null(part.column("text"), ""))
            lists = part.column("found").to_pylist()
            texts = sorted({f["text"] for found in lists for f in found})
            item_offsets, item_words = hashed_words(pa.array(texts, pa.string()))
            at = {t: item_words[a:b] for t, a, b in zip(texts, item_offsets, item_offsets[1:], strict=False)}
            out = []
            for row, (key, found) in enumerate(zip(part.column("key").to_pylist(), lists, strict=True)):
                doc, best = words[offsets[row] : offsets[row + 1]], {}
                for f in found:
                    item, shift = at[f["text"]], f["shift"]
                    first = max(0, -shift)
                    size = min(len(item), len(doc) - shift) - first
                    if size <= 0:
                        continue
                    start, end, matches = stretch(doc[first + shift : first + shift + size] == item[first : first + size])
                    if matches >= min(LEAST, len(item)):
                        best.setdefault(f["item"], []).append((-matches, first + shift + start, end - start))
                out.extend((key, item, place, n, -less) for item, ((less, place, n), *_) in ((i, sorted(b)) for i, b in best.items()))
            if out:
                arrays = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__leak_id`` stands for key and text together, so that null and repeated keys do no harm."""
    return docs.withColumn("__leak_id", row_hash(key, text))


def _candidates(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``__leak_id`` with the list of items, texts and offsets that some window suggests."""
    filed = staged(items.mapInArrow(_filed, "item long, hash long, at long, words long"), "filed")
    words = filed.select("hash").distinct().mapInArrow(_filter_words, "word long, bits long")
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for row in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():  # the filter's size is fixed
        bits[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    shortest = min(map(len, MASKS))
    short = [r["words"] for r in filed.where(F.col("words") < shortest).select("words").distinct().collect()]
    hits = rows.select(F.col("__leak_id").alias("id"), "text").mapInArrow(_hits(bits, short), "id long, hash long, place long")
    suggested = hits.join(filed, "hash").select("id", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    with_text = suggested.join(items.select(F.col("key").alias("item"), "text"), "item")
    # A document's list is bounded by its own words.
    return with_text.groupBy(F.col("id").alias("__leak_id")).agg(F.collect_list(F.struct("item", "shift", "text")).alias("found"))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it holds: ``key, item, place, words, matches`` (places count words from 0)."""
    rows = _identified(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "key", "text")
    rows = spread(rows)
    items = benchmark.select(F.col(item).cast("long").alias("key"), F.col(item_text).alias("text")).where(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    found = _candidates(rows, items)
    checked = rows.join(found, "__leak_id").select("key", "text", "found").mapInArrow(_verified, OVERLAPS)
    return checked.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    found = overlaps(_identified(docs, key, text).drop(key).withColumnRenamed("__leak_id", key), benchmark, key, text)
    bad = found.select(F.col(key).alias("__leak_id")).distinct()
    return _identified(docs, key, text).join(bad, "__leak_id", "left_anti").drop("__leak_id")
