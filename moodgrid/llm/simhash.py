"""Near duplicates by SimHash, with a pigeonring filter before the Hamming check.

A fingerprint has 64 bits in five segments. If two fingerprints differ in at most
``k`` bits, then going around the ring of segments from some start, the first
``l`` segments differ in at most ``l * k / 5`` bits in sum, for every ``l``: a
chain of proportional budgets. The budgets of the first two segments of a chain
(none, then one bit for ``k = 4``) become the key two fingerprints have to share:
every fingerprint is filed under its own two segments for every start, and looks
under the keys whose second segment differs from its own in one bit. What meets
under a key has to keep the remaining budgets before all 64 bits are compared.

Fingerprints are compared once each, however many documents carry them. Under a
key, pairs are compared in blocks and only a spanning forest of the links leaves
the task; components are then joined by star operations over all links.

Nulls: a null text has no words and gets the zero fingerprint like any empty
text; null keys are kept, and a component of null keys only has a null id. Rows
that repeat come back each. An empty table gives an empty result. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm import graph
from moodgrid.llm.common import parts_for, ranges, row_hash, slices, spread, staged

# Widths of the segments, lowest bits first.
SEGMENTS = (13, 13, 13, 13, 12)
SEED = 42
BLOCK = 1 << 21
KEYS_A_TASK = 4 << 20


def fingerprint(words: list[bytes], size: int) -> int:
    """The bits set in over half of the hashes of the shingles of ``size`` words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(size, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - span].tolist(), ends[span:].tolist(), strict=True)
    hashes = np.array([digest(text[a:b], SEED) for a, b in pairs], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lowered = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
                marks = [fingerprint(t.as_buffer().to_pybytes().split(), size) for t in lowered]
                marks = pa.array(np.array(marks, np.uint64).view(np.int64))
                columns = [part.column("key"), part.column("row"), marks]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "mark"])

    return run


def _segments(marks: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in SEGMENTS:
        out.append((marks >> np.uint64(at)) & np.uint64((1 << width) - 1))
        at += width
    return out


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its own keys (seeks false) and under those one bit off."""
    n = len(SEGMENTS)
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            marks = batch.column("mark").slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = _segments(marks)
            for start in range(n):
                first, second = parts[start], parts[(start + 1) % n]
                head = np.uint64(start << 26) | first << np.uint64(13)
                flips = [0, *(1 << b for b in range(SEGMENTS[(start + 1) % n]))]
                keys = np.concatenate([head | (second ^ np.uint64(f)) for f in flips]).view(np.int64)
                seeks = np.repeat([f > 0 for f in flips], len(marks))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(seeks), pa.array(np.tile(marks.view(np.int64), len(flips)))],
                    ["chain", "seeks", "mark"],
                )


def _linked(left: np.ndarray, right: np.ndarray, start: int, used: np.ndarray, distance: int) -> np.ndarray:
    """Whether each pair keeps its chain's budgets and the distance; ``used`` is spent on the first two segments."""
    n = len(SEGMENTS)
    parts = _segments(left ^ right)
    spent, good = used.copy(), used <= 2 * distance // n
    for step in range(2, n):
        spent += np.bitwise_count(parts[(start + step) % n])
        good &= spent <= (step + 1) * distance // n
    return good


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the least node of its part."""
    nodes, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(left)], at[len(left) :]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, root[side], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links(distance: int):
    def links_of(chain: np.ndarray, seeks: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of whole keys; under a key those filed come first."""
        edges = np.flatnonzero(np.diff(chain)) + 1
        first = np.concatenate(([0], edges))
        size = np.diff(np.concatenate((first, [len(chain)])))
        filed = np.add.reduceat((~seeks).astype(np.int64), first)
        # A filed one meets those filed behind it and all seekers of its key.
        rows = np.flatnonzero(~seeks)
        key_of = np.repeat(np.arange(len(first)), filed)
        partners = (first + size)[key_of] - rows - 1
        ends = np.cumsum(partners)
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
            some = rows[at:stop]
            a = np.repeat(some, partners[at:stop])
            b = ranges(some + 1, partners[at:stop])
            at = stop
            if not len(a):
                continue
            found = np.zeros(len(a), bool)
            for start in range(len(SEGMENTS)):
                own = (chain[a] >> 26) == start
                if own.any():
                    found[own] = _linked(marks[a[own]], marks[b[own]], start, seeks[b[own]].astype(np.int64), distance)
            if found.any():
                yield _forest(marks[a[found]], marks[b[found]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            chain = batch.column("chain").to_numpy(zero_copy_only=False)
            seeks = batch.column("seeks").to_numpy(zero_copy_only=False)
            marks = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
            if held and not len(chain):
                continue
            # The last key of a batch may go on in the next one.
            last = int(np.searchsorted(chain, chain[-1])) if len(chain) else 0
            if last:
                held.append((chain[:last], seeks[:last], marks[:last]))
                yield from out(held)
                held = []
            held.append((chain[last:], seeks[last:], marks[last:]))
        if held:
            yield from out(held)

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        chain, seeks, marks = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(chain):
            return
        for a, b in links_of(chain, seeks, marks):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    return run


def links(marks: DataFrame, distance: int) -> DataFrame:
    """Links ``(u, v)`` that connect all pairs of the distinct ``mark`` values within the distance."""
    spark = marks.sparkSession
    if not 0 <= distance < len(SEGMENTS):
        raise ValueError("the chains of five segments serve distances from 0 to 4")
    n = marks.count()
    copies = sum(1 + w for w in SEGMENTS)
    filed = marks.repartition(parts_for(spark, n, 50_000)).mapInArrow(_filed, "chain long, seeks boolean, mark long")
    parts = parts_for(spark, n * copies, KEYS_A_TASK)
    dealt = filed.repartition(parts, "chain").sortWithinPartitions("chain", "seeks")
    return dealt.mapInArrow(_links(distance), "u long, v long").distinct()


def _marked(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``key, row, mark`` of every document, written; ``row`` stands for key and text together."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("row", row_hash("key", "text"))
    return staged(spread(rows).mapInArrow(_fingerprints(shingle), "key long, row long, mark long"), "marks")


def _rooted(marked: DataFrame, distance: int) -> DataFrame:
    """Each distinct fingerprint with its component's root, its least key, and its first row (null keys last)."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")
    classes = staged(marked.groupBy("mark").agg(F.min("key").alias("least"), first), "classes")
    roots = graph.components(links(classes.select("mark"), distance))
    joined = classes.join(roots, F.col("mark") == F.col("node"), "left")
    return joined.select("mark", "least", "first", F.coalesce("root", "mark").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``key, mark`` (the fingerprint as a signed long), ``component_id`` (the least key)."""
    marked = _marked(docs, shingle, key, text)
    rooted = _rooted(marked, distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = rooted.join(least, "root").select("mark", "component_id")
    # A fingerprint of many copies is a hot key on this side only, where adaptive execution splits it.
    return marked.join(by_mark, "mark").select(F.col("key").alias(key), "mark", "component_id")


def representatives(
    docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component with all its columns: the least key, a null key only if there is no other."""
    rooted = _rooted(_marked(docs, shingle, key, text), distance)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__near_row"))
    rows = docs.withColumn("__near_row", row_hash(key, text))
    # Rows that are equal in key and text are one document.
    return rows.join(kept, "__near_row", "left_semi").dropDuplicates(["__near_row"]).drop("__near_row")
