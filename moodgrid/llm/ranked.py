"""Ranked lexical search over a sharded block-max index by MaxScore.

Terms are the maximal strings of ASCII letters, digits and non-ASCII characters,
A-Z lower-cased. With N documents that hold a term and L terms in all, a document
of n terms has the length part

    m = 75 + (25 * n * N) div L

a term that occurs tf times in it scores (10^9 * tf) div (1000 * tf + 12 * m), its
impact, times the term's weight floor(1000 * ln((2 N + 2) / (2 df + 1))). Whole
numbers throughout, so sums do not depend on their order.

N and L are counted first. The index holds for each shard (a few MB of consecutive
documents) and term the postings in blocks of ``BLOCK``: place of the document in
the shard and tf, each as steps or numbers of the least width, with each block's
first and last place and its greatest impact. It is a written table.

A query meets a shard like this. Its terms are ordered by their global bounds, the
greatest impact of any block of any shard times weight and occurrences in the
query, greatest first. Lists are read whole, as essential ones, until the bounds
of the rest add up to less than the score of the k-th best document so far: then no
document outside can still enter. From each further, non-essential list only the
blocks are unpacked that hold a candidate which could reach the k-th score with the
block's maximum and the bounds of the lists behind it. The threshold rises list by
list. What is left are the shard's k best; shards are merged by rank. A bound
equal to the threshold never rejects, as ties go to the lower key.

Queries are dealt into blocks of ``QUERIES``; a task holds one shard's lists for
the terms of one such block.

Nulls: a null text has no terms, so neither a document without terms nor a query
without any is in the result. A null key ranks behind other keys of equal score, a
null item is kept. Rows that repeat are documents, or queries, of their own. Empty
tables give empty results. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodgrid.llm.common import new_folder, ranges, slices, spread, staged, text_or_empty
from moodgrid.llm.tokens import give_back

SHARD_BYTES = 8 << 20
BLOCK = 64
QUERIES = 512
WIDTHS = (1, 2, 4)
# What each byte of a text becomes: ASCII signs part terms, A-Z are lower-cased.
FOLD = bytes(
    b if b > 127 or chr(b).islower() or chr(b).isdigit() else b + 32 if chr(b).isupper() else 32 for b in range(256)
)

INDEX = (
    "shard bigint, term string, df bigint, first array<int>, last array<int>, most array<bigint>, "
    "at array<bigint>, widths array<int>, data binary"
)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets by text, term codes, vocabulary."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(t.as_buffer().to_pybytes() for t in texts).translate(FOLD)
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    ends = np.cumsum(sizes)
    starts = ends - sizes
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    borders = starts[(sizes > 0) & (starts > 0)]
    new[borders] = inside[borders]
    first = np.flatnonzero(new)
    over = inside.copy()
    over[:-1] &= ~inside[1:]
    inner = borders - 1
    over[inner] = inside[inner]
    stop = np.flatnonzero(over) + 1
    # Terms and what parts them alternate: every second of these pieces is a term.
    bounds = np.empty(2 * len(first) + 1, np.int64)
    bounds[:-1:2], bounds[1::2], bounds[-1] = first, stop, len(data)
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    words = pieces.take(pa.array(np.arange(0, 2 * len(first), 2))).cast(pa.large_string())
    coded = words.dictionary_encode()
    offsets = np.concatenate((np.searchsorted(first, starts), [len(first)]))
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def impact(tf, n, documents: int, terms: int):
    """Score of a term in a document before its weight."""
    m = 75 + (25 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = terms = 0
    for batch in batches:
        for part in slices(batch, "text"):
            many = np.diff(terms_of(part.column("text"))[0])
            documents, terms = documents + int((many > 0).sum()), terms + int(many.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], ["documents", "terms"])


def width_of(values: np.ndarray) -> np.ndarray:
    """Bytes that each number takes."""
    return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))


def packed(groups: np.ndarray, places: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings sorted by group and place, in blocks.

    Gives each block's group, first posting and size, its two widths, its place in
    the bytes, and the bytes: steps from the block's first place, then the counts.
    """
    n = len(groups)
    begin = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(begin, n))
    blocks = -(-sizes // BLOCK)
    heads = np.repeat(begin, blocks) + BLOCK * ranges(np.zeros(len(blocks), np.int64), blocks)
    count = np.diff(np.append(heads, n))
    owner = np.repeat(np.arange(len(heads)), count)
    inner = np.arange(n) - heads[owner]
    steps = places - places[heads][owner]
    wide_step = np.maximum.reduceat(width_of(steps), heads) if n else np.empty(0, np.int64)
    wide_tf = np.maximum.reduceat(width_of(tf), heads) if n else np.empty(0, np.int64)
    bytes_of = count * (wide_step + wide_tf)
    at = np.cumsum(bytes_of) - bytes_of
    data = np.zeros(int(bytes_of.sum()), np.uint8)
    for values, width, base in ((steps, wide_step, at), (tf, wide_tf, at + count * wide_step)):
        for w in WIDTHS:
            mine = width[owner] == w
            place, value = base[owner[mine]] + inner[mine] * w, values[mine]
            for byte in range(w):
                data[place + byte] = (value >> (8 * byte)) & 255
    return groups[heads] if n else groups, heads, count, wide_step, wide_tf, at, data


def unpacked(data, first: int, size: int, wide_step: int, wide_tf: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of one block."""
    middle = at + size * wide_step
    steps = np.frombuffer(data, f"<u{wide_step}", size, at).astype(np.int64)
    return steps + first, np.frombuffer(data, f"<u{wide_tf}", size, middle).astype(np.int64)


def _indexed(documents: int, terms: int, shard_bytes: int, schema: pa.Schema):
    def shard(number: int, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, codes, vocabulary = terms_of(part.column("text"))
        lengths = np.diff(offsets)
        keys = part.column("key")
        place_of = np.repeat(np.arange(len(lengths)), lengths)
        pairs, tf = np.unique(codes * max(len(lengths), 1) + place_of, return_counts=True)
        group, place = pairs // max(len(lengths), 1), pairs % max(len(lengths), 1)
        best = impact(tf, lengths[place], documents, terms)
        owner, heads, count, wide_step, wide_tf, at, data = packed(group, place, tf)
        values = {
            "shard": pa.array([number]),
            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_arrays([values.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
        if not len(heads):
            return
        most = np.maximum.reduceat(best, heads)
        last = place[heads + count - 1]
        # Blocks of a term, then its bytes.
        term_at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        reach = np.append(term_at, len(owner)).astype(np.int32)
        byte_at = np.append(at[term_at], len(data))
        inside = at - np.repeat(at[term_at], np.diff(reach))
        df = np.add.reduceat(count, term_at)
        listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(reach), pa.array(x, kind))
        values = {
            "shard": pa.array(np.full(len(term_at), number)),
            "term": pc.take(vocabulary, pa.array(owner[term_at])).cast(pa.string()),
            "df": pa.array(df, pa.int64()),
            "first": listed(place[heads], pa.int32()),
            "last": listed(last, pa.int32()),
            "most": listed(most, pa.int64()),
            "at": listed(inside, pa.int64()),
            "widths": listed(count * 100 + wide_step * 10 + wide_tf, pa.int32()),
            "data": pa.Array.from_buffers(
                pa.large_binary(), len(term_at), [None, pa.py_buffer(byte_at.astype(np.int64)), pa.py_buffer(data)]
            ).cast(pa.binary()),
        }
        out = pa.RecordBatch.from_arrays(
            [values.get(f.name, pa.nulls(len(term_at), f.type)) for f in schema], schema=schema
        )
        for low in range(0, len(out), 1 << 14):
            yield out.slice(low, 1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                yield from shard(part.column("row")[0].as_py(), part)
            give_back()

    return run


class Index:
    """A written index: its table, the counts N and L it was built with, and the name of the key."""

    def __init__(self, table: DataFrame, documents: int, terms: int, key: str):
        self.table, self.documents, self.terms, self.key = table, documents, terms, key


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Counts, then one row a shard with keys and lengths, and one a shard and term with the postings."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    rows = spread(docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")))
    counts = rows.select("text").mapInArrow(_counted, "documents bigint, terms bigint")
    documents, terms = counts.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    schema = f"{INDEX}, keys array<{dict(rows.dtypes)['key']}>, lengths array<bigint>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    folder = new_folder(spark, "index")
    numbered.mapInArrow(_indexed(documents, terms, shard_bytes, arrow), schema).write.option("compression", "zstd").parquet(folder)
    return Index(spark.read.schema(schema).parquet(folder), documents, terms, key)


class Lists:
    """The lists of one shard, unpacked as far as they were asked for."""

    def __init__(self, rows: list[tuple]):
        self.rows = {term: row for term, *row in rows}
        self.whole: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, term: str, b: int) -> tuple[np.ndarray, np.ndarray]:
        first, _, _, at, widths, data = self.rows[term]
        size, wide = divmod(int(widths[b]), 100)
        return unpacked(data, int(first[b]), size, wide // 10, wide % 10, int(at[b]))

    def all(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.whole:
            parts = [self.block(term, b) for b in range(len(self.rows[term][0]))]
            self.whole[term] = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
        return self.whole[term]


def best_of_shard(
    lists: Lists, lengths: np.ndarray, query: list[tuple[str, int, int]], k: int, documents: int, terms: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a shard that may be among its k best.

    ``query`` holds term, weight (times its occurrences) and global bound. Ties at
    the k-th score are all kept: the keys decide later.
    """
    here = sorted((q for q in query if q[0] in lists.rows), key=lambda q: -q[2])
    behind = np.append(np.cumsum([q[2] for q in here][::-1])[::-1], 0)
    score = np.zeros(len(lengths), np.int64)
    floor, at = 1, 0

    def kth(values: np.ndarray) -> int:
        return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0

    while at < len(here) and behind[at] >= floor:
        term, weight, _ = here[at]
        place, tf = lists.all(term)
        score[place] += weight * impact(tf, lengths[place], documents, terms)
        at += 1
        floor = max(floor, kth(score))
    seen = np.flatnonzero(score + behind[at] >= floor)
    seen = seen[score[seen] > 0]
    for term, weight, _ in here[at:]:
        first, last, most, *_ = lists.rows[term]
        block = np.searchsorted(last, seen)
        inside = block < len(last)
        inside[inside] = first[block[inside]] <= seen[inside]
        bound = np.zeros(len(seen), np.int64)
        bound[inside] = weight * most[block[inside]]
        able = score[seen] + bound + behind[at + 1] >= floor
        seen, block, inside = seen[able], block[able], inside[able]
        for b in np.unique(block[inside]):
            place, tf = lists.block(term, int(b))
            mine = seen[inside & (block == b)]
            found = np.searchsorted(place, mine)
            hit = place[np.minimum(found, len(place) - 1)] == mine
            to = mine[hit]
            score[to] += weight * impact(tf[found[hit]], lengths[to], documents, terms)
        at += 1
        floor = max(floor, kth(score[seen]))
    seen = seen[score[seen] >= floor]
    return seen, score[seen]


def _searched(k: int, documents: int, terms: int, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_valid(table["lengths"]))
        if not len(head):
            return schema.empty_table()
        lengths = np.array(head["lengths"][0].values.to_numpy(), np.int64)
        keys = pa.array(head["keys"][0].values)
        queries = head["queries"][0].as_py()
        rows = []
        body = table.filter(pc.is_valid(table["term"]))
        listed = {c: body[c].combine_chunks() for c in ("term", "first", "last", "most", "at", "widths", "data")}
        for i in range(len(body)):
            arrays = [np.array(listed[c][i].values.to_numpy(), np.int64) for c in ("first", "last", "most", "at", "widths")]
            rows.append((listed["term"][i].as_py(), *arrays, listed["data"][i].as_buffer()))
        lists = Lists(rows)
        number, places, scores = [], [], []
        for q in queries:
            wanted = [(t["term"], t["weight"], t["bound"]) for t in q["terms"]]
            place, score = best_of_shard(lists, lengths, wanted, k, documents, terms)
            number.append(np.full(len(place), q["query"]))
            places.append(place)
            scores.append(score)
        if not number:
            return schema.empty_table()
        at = pa.array(np.concatenate(places))
        columns = [pa.array(np.concatenate(number)), keys.take(at), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def query_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Per row of the query table a number, its item, and its terms with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, vocabulary = terms_of(batch.column("text"))
            words = vocabulary.to_pylist()
            rows = [Counter(words[c] for c in codes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            numbers = batch.column("query").to_pylist()
            flat = [(q, t, n) for q, row in zip(numbers, rows, strict=True) for t, n in row.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in flat], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))],
                ["query", "term", "times"],
            )

    return items.select("query", F.col(text).alias("text")).mapInArrow(run, "query bigint, term string, times bigint")


def search(index: Index, items: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """Per query row its k documents of highest score: item, rank, key, score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    table, documents, terms = index.table, index.documents, index.terms
    spark = table.sparkSession
    # Numbers of the query rows hold from here on.
    numbered = items.select(F.col(item).alias("item"), text_or_empty(text).alias("text"))
    numbered = staged(numbered.withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = query_terms(numbered, "item", "text")
    # Blocks of queries by the order of their numbers.
    order = Window.orderBy("query")
    dealt = numbered.select("query", F.floor((F.row_number().over(order) - 1) / QUERIES).cast("int").alias("block"))
    asked = staged(asked.join(dealt, "query"), "query-terms")
    lists = table.filter("term IS NOT NULL")
    wanted = lists.join(asked.select("term").distinct(), "term")
    known = wanted.groupBy("term").agg(F.sum("df").alias("df"), F.max(F.array_max("most")).alias("most"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("bigint")
    weighed = asked.join(known, "term").withColumn("weight", weight * F.col("times"))
    weighed = weighed.withColumn("bound", F.col("weight") * F.col("most"))
    one = weighed.groupBy("block", "query").agg(F.collect_list(F.struct("term", "weight", "bound")).alias("terms"))
    bundles = one.groupBy("block").agg(F.collect_list(F.struct("query", "terms")).alias("queries"))
    bundles = staged(bundles, "bundles")
    # Every shard meets every block of queries, each pair in a task of its own.
    blocks = asked.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    heads = table.filter("lengths IS NOT NULL").select("shard", "keys", "lengths")
    heads = heads.withColumn("block", F.explode(F.array(*(F.lit(b) for b in range(blocks))).cast("array<int>")))
    heads = heads.join(bundles, "block")
    body = lists.drop("keys", "lengths", "df").join(asked.select("block", "term").distinct(), "term")
    units = body.unionByName(heads, allowMissingColumns=True)
    kind = dict(table.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    schema = f"query bigint, key {kind}, score bigint"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    found = units.groupBy("block", "shard").applyInArrow(_searched(k, documents, terms, arrow), schema)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    best = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    named = best.join(numbered.select("query", "item"), "query")
    return named.select(F.col("item").alias(item), "rank", F.col("key").alias(index.key), "score")
