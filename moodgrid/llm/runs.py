"""Periodic runs of words, found in tiles for each octave of periods and stitched by document and period.

Words are the maximal strings without ASCII white space. A run is a stretch whose
smallest period is q (words q apart are identical), at least ``LEAST`` words and
``FOLDS`` periods long, that cannot be made longer with period q.

For the periods q in [A, 2A), A a power of two, a document is cut into tiles: the
words from A before to 5A behind each multiple a of A. A run of such a period holds
at least 3q equal pairs (i, i + q), so from some boundary a on the next 2A pairs are
equal. The Z-function of the words behind the boundary gives how far the pairs reach
for every q, the one of the words before it, read backwards, how far back. Of all q
of the octave only the least that reaches 2A can be the smallest period of a run
there: with another one, q', the 2A + q words would also have the period gcd(q, q').
For the same reason a tile whose head has a period below A is left out. What a tile
finds is an interval of equal pairs, cut at the tile's borders; neighbouring tiles
overlap, so the intervals of one document and period, shuffled together, join into
the whole ones.

Tiles are made and solved where their document is read: as rows of their own they
would take six times its words for each octave. The work is n log n words for any
text. A tile is solved only if the first pairs of some period agree.

Nulls: a null text has no words; a null key is kept. Rows that repeat are judged
each. Empty tables give empty results. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodgrid.llm.common import slices, spread, staged, words_of

LEAST = 6
FOLDS = 4
# Pairs that must agree before a tile is solved; compared for all tiles at once.
PROBED = 16
CELLS = 1 << 20
RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def z_function(s: list) -> list[int]:
    """For each place the length of the longest common prefix of ``s`` and what starts there."""
    n, left, right = len(s), 0, 0
    z = [n] + [0] * (n - 1)
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def boundaries(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiples of ``step`` in each document behind which some period of the octave may run, and their documents.

    ``words`` holds all documents, a sign of its own behind each, so no pair
    beyond the end of a document is equal.
    """
    many = np.where(lengths >= max(LEAST, FOLDS * step), (lengths - 3 * step) // step + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), many)
    at = starts[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    spans = np.lib.stride_tricks.sliding_window_view(words, step) if len(words) >= step else None
    kept = []
    rows = max(1, CELLS // step)
    for low in range(0, len(at), rows):
        some = at[low : low + rows]
        place, q = np.nonzero(spans[some + step] == words[some][:, None])
        a, q = some[place], q + step
        for j in range(1, min(2 * step, PROBED)):
            agree = words[a + j] == words[a + q + j]
            place, a, q = place[agree], a[agree], q[agree]
            if not len(a):
                break
        kept.append(low + np.unique(place))
    chosen = np.concatenate(kept) if kept else np.empty(0, np.int64)
    return at[chosen], owner[chosen]


def solve_tile(tile: list[int], edge: int, step: int) -> tuple[int, int, int] | None:
    """(period, first, stop) of the equal pairs around ``tile[edge]``, or nothing; places count from the tile's start."""
    ahead = z_function(tile[edge:])
    period = next((q for q in range(step, min(2 * step, len(ahead))) if ahead[q] >= 2 * step), None)
    if period is None or any(ahead[p] >= 2 * step + period - p for p in range(1, step)):
        return None
    behind = tile[:edge][::-1]
    back = z_function([*behind, None, *tile[: edge + period][::-1]])[edge + 1] if edge else 0
    first, stop = edge - back, edge + ahead[period]
    whole = back < edge and stop + period < len(tile)
    if whole and stop - first + period < max(LEAST, FOLDS * period):
        return None
    return period, first, stop


def fragments(offsets: np.ndarray, codes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document (period, first, stop) of the equal pairs that its tiles hold."""
    lengths = np.diff(offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    longest = int(lengths.max()) if len(lengths) else 0
    # A sign of its own behind each document, and room behind the last.
    starts = offsets[:-1] + np.arange(len(lengths))
    words = -1 - np.arange(len(codes) + len(lengths) + max(longest, LEAST), dtype=np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    words[np.arange(len(codes)) + owner] = codes
    step = 1
    while FOLDS * step <= longest:
        for a, doc in zip(*boundaries(words, starts, lengths, step), strict=True):
            base, end = int(starts[doc]), int(starts[doc] + lengths[doc])
            low = max(base, int(a) - step)
            found = solve_tile(words[low : min(end, int(a) + 5 * step)].tolist(), int(a) - low, step)
            if found:
                period, first, stop = found
                out[doc].append((period, low - base + first, low - base + stop))
        step *= 2
    return out


def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())


def _tiled(digest: bool, schema: pa.Schema):
    frag = schema.field("fragments").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, codes, vocabulary = words_of(part.column("text"))
                found = fragments(offsets, codes)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(vocabulary, pa.array(codes)))
                joined = pc.binary_join(lists, pa.scalar(" ", vocabulary.type))
                some = pa.array([bool(f) for f in found])
                rows = [[{"period": p, "first": s, "stop": e} for p, s, e in f] for f in found]
                columns = [
                    part.column("row"),
                    part.column("key"),
                    pa.array(np.diff(offsets), pa.int64()),
                    _digest(joined) if digest else joined.cast(pa.string()),
                    pc.if_else(some, joined, pa.scalar(None, joined.type)).cast(pa.string()),
                    pa.array(rows, frag),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _collapsed(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("joined"), batch.column("runs").to_pylist(), strict=True):
                words = text.as_py().split(" ")
                keep = np.ones(len(words), bool)
                for r in runs:
                    keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                texts.append(" ".join(words[i] for i in np.flatnonzero(keep)))
            out = pa.array(texts, pa.large_string())
            columns = [batch.column("row"), _digest(out) if digest else out.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "shorter"])

    return run


def stitched(parts: DataFrame) -> DataFrame:
    """Whole runs by ``row`` (start, period, length) from fragments ``row, period, first, stop``."""
    order = Window.partitionBy("row", "period").orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= reach, 0).otherwise(1)
    islands = parts.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order))
    whole = islands.groupBy("row", "period", "island").agg(F.min("first").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    long_enough = whole.withColumn("length", length).filter(F.col("length") >= F.greatest(F.lit(LEAST), FOLDS * F.col("period")))
    # The same stretch with several periods: its smallest one counts.
    return long_enough.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: key, n_words, ``runs`` by start and period, and ``collapsed``.

    ``collapsed`` is the text without the repetitions: its words, joined by one
    space, less those that some run contains after its first period. With
    ``digest`` it is that text's SHA-256 instead.
    """
    docs = spread(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    kind = dict(docs.dtypes)["key"]
    schema = (
        f"row bigint, key {kind}, n_words bigint, collapsed string, joined string, "
        "fragments array<struct<period: bigint, first: bigint, stop: bigint>>"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    # Written once: the row numbers hold from here on, and texts stay only where something was found.
    tiles = staged(rows.mapInArrow(_tiled(digest, arrow), schema), "run-tiles")
    parts = tiles.select("row", F.explode("fragments").alias("f")).select("row", "f.*")
    found = stitched(parts).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    found = staged(found, "runs")
    held = tiles.filter("joined IS NOT NULL").select("row", "joined").join(found, "row")
    shorter = held.mapInArrow(_collapsed(digest), "row bigint, shorter string")
    touched = tiles.filter("joined IS NOT NULL").drop("joined", "fragments").join(found, "row", "left").join(shorter, "row", "left")
    touched = touched.withColumn("collapsed", F.coalesce("shorter", "collapsed"))
    plain = tiles.filter("joined IS NULL").withColumn("runs", F.lit(None).cast(RUNS))
    columns = ("key", "n_words", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "collapsed")
    return plain.select(*columns).unionByName(touched.select(*columns)).withColumnRenamed("key", key)
