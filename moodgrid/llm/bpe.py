"""Byte-level BPE by the ranks of a vocabulary file: encoding and decoding.

A text falls into pre-tokens, the matches of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

which cover it without gaps. They are found for a block of documents at once from
the classes of its characters: a change of class starts a pre-token; the last of
some white space before other characters stands alone, or, a plain space, belongs
to them; an apostrophe that starts a pre-token takes the letters of a contraction.

Pre-tokens are many, different ones few. A block (a few MB of consecutive documents)
keeps the positions as numbers into its own list of different pre-tokens. These
lists are dealt by a checksum of the pre-token, so that a task has all that are
equal in the whole corpus: it encodes each different one once and gives back the ids
in the order of each list. The lists return to their blocks, and the ids are put in
the places of the numbers. Numbers, lists and ids travel packed and compressed, one
row for each block and share, not for each occurrence; so no word is a hot key.
Decoding joins each id with its bytes: that table has as many rows as the
vocabulary, whatever the corpus, so it stands in every task and is joined by position.

Nulls: a null text is empty, a null key is kept; decoding null ids gives empty
bytes. Rows that repeat are encoded each. Empty tables give empty results. Further
columns are not read. An id outside the vocabulary stops the decoding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import TASK_BYTES, parts_for, ranges, slices, spread, staged, text_or_empty
from moodgrid.llm.tokens import give_back

BLOCK_BYTES = 32 << 20
# Text that is cut into pre-tokens at once: that takes some thirty times its bytes.
PART_BYTES = 1 << 20
LEVEL = 6
# Pre-tokens of a block that are numbered by frequency.
OFTEN = 4096
# Pre-tokens whose ids are put in place at once.
PLACED = 1 << 19
LETTER, NUMBER, OTHER, SPACE = range(4)
# What may follow an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of every token of a rank file (lines of base64 and a number)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _merger(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"\s+|\S+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, as the library's patterns see it (Unicode versions differ)."""
    import tiktoken

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for number, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matcher = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        found = matcher.decode_bytes(matcher.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = number
    return table


def pretoken_starts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; ``fresh`` marks the first of each text."""
    kind = character_classes()[points]
    n = len(points)
    starts = fresh.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else, within a text.
    ahead = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:]) if n else np.empty(0, np.int64)
    starts[ahead] = True
    starts[ahead[points[ahead] == ord(" ")] + 1] = False
    marks = np.flatnonzero((points == ord("'")) & starts)
    for tail in CONTRACTIONS:
        size = len(tail)
        fits = marks[marks + size < n]
        for i, letter in enumerate(tail, 1):
            fits = fits[(points[fits + i] == ord(letter)) & ~fresh[fits + i]]
        starts[fits + 1] = False
        after = fits + size + 1
        starts[after[after < n]] = True
    return starts


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets by text, numbers of the pre-tokens, and the different pre-tokens (binary)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    data = b"".join(t.as_buffer().to_pybytes() for t in texts)
    points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.cumsum(width, dtype=np.int64) - width
    fresh = np.zeros(len(points), bool)
    firsts = (ends - sizes)[sizes > 0]
    fresh[np.searchsorted(at, firsts)] = True
    cuts = at[pretoken_starts(points, fresh)]
    offsets = np.concatenate((np.searchsorted(cuts, ends - sizes), [len(cuts)]))
    bounds = pa.py_buffer(np.append(cuts, len(data)))
    words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, bounds, pa.py_buffer(data)])
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def squeezed(*arrays) -> bytes:
    """Arrays as one compressed string, with the size of each in front; numbers byte by byte, which compresses better."""
    parts = []
    for a in arrays:
        if not isinstance(a, bytes):
            a = np.ascontiguousarray(a)
            a = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
        parts.append(pa.Codec("zstd", compression_level=LEVEL).compress(a, asbytes=True) if a else b"")
    sizes = [[len(p), len(a) if isinstance(a, bytes) else a.nbytes] for p, a in zip(parts, arrays, strict=True)]
    return np.array(sizes, np.int64).tobytes() + b"".join(parts)


def opened(data: bytes, *kinds) -> list:
    """The parts of a ``squeezed`` string: numbers of a kind, or bytes."""
    sizes, at, out = np.frombuffer(data[: 16 * len(kinds)], np.int64).reshape(-1, 2), 16 * len(kinds), []
    for (small, full), kind in zip(sizes.tolist(), kinds, strict=True):
        raw = pa.decompress(data[at : at + small], decompressed_size=full, codec="zstd", asbytes=True) if full else b""
        at += small
        if kind is not bytes:
            raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        out.append(raw)
    return out


class Block:
    """Consecutive documents, and the numbers of their pre-tokens in a list of different ones."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.keys: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        offsets, codes, words = pretokens(part.column("text"))
        known = self.known
        number = np.array([known.setdefault(w, len(known)) for w in words.to_pylist()], np.uint32)
        self.keys.append(part.column("key"))
        self.counts.append(np.diff(offsets))
        self.codes.append(number[codes])
        self.size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0

    def rows(self, block: int, shares: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row for the block, one for each share with some of its pre-tokens."""
        words = list(self.known)
        share = np.array([zlib.crc32(w) % shares for w in words], np.int64)
        times = np.zeros(len(words), np.int64)
        for codes in self.codes:
            times += np.bincount(codes, minlength=len(words))
        order = np.argsort(-times, kind="stable")
        # Frequent pre-tokens get low numbers in order of frequency, the others numbers by share and bytes.
        often = order[:OFTEN]
        rare = np.array(sorted(order[OFTEN:].tolist(), key=words.__getitem__), np.int64)
        order = np.concatenate((often, rare[np.argsort(share[rare], kind="stable")]))
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words))
        keys = pa.concat_arrays(self.keys)
        values = {
            "block": pa.array([block]),
            "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            "counts": pa.array([np.concatenate(self.counts)], pa.list_(pa.int32())),
            "codes": pa.array([[squeezed(place[codes]) for codes in self.codes]], pa.list_(pa.binary())),
            "words": pa.array([squeezed(share[often].astype(np.uint32), np.bincount(share[order[OFTEN:]], minlength=shares))], pa.binary()),
        }
        yield _row(schema, values)
        first = _by_share(share[often], shares)
        bounds = OFTEN + np.concatenate(([0], np.cumsum(np.bincount(share[order[OFTEN:]], minlength=shares))))
        for number in range(shares):
            mine = [words[order[i]] for i in first[number]] + [words[i] for i in order[bounds[number] : bounds[number + 1]].tolist()]
            if mine:
                lengths = np.array([len(w) for w in mine], np.uint32)
                listed = pa.array([squeezed(lengths, b"".join(mine))], pa.binary())
                yield _row(schema, {"block": pa.array([block]), "share": pa.array([number], pa.int32()), "listed": listed})


def _by_share(share: np.ndarray, shares: int) -> list[np.ndarray]:
    """Places of the frequent pre-tokens in the list of each share."""
    order = np.argsort(share, kind="stable")
    return np.split(order, np.searchsorted(share[order], np.arange(1, shares)))


def _row(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else pa.nulls(1, f.type) for f in schema], schema=schema)


def _split(shares: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), None
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                number = part.column("row")[0].as_py() if number is None else number
                block.add(part)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows(number, shares, schema)
                    block, number = Block(), None
            give_back()
        if number is not None:
            yield from block.rows(number, shares, schema)
        give_back()

    return run


def _encoded_lists(path: str):
    """Lists in, ids out; lists come by share, and what a share's lists have in common is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core = _merger(path)._core_bpe
        at, known = None, {}
        for batch in batches:
            for i in range(len(batch)):
                share = batch.column("share")[i].as_py()
                if share != at:
                    at, known = share, {}
                lengths, data = opened(batch.column("listed")[i].as_py(), np.uint32, bytes)
                ids, start = [], 0
                for end in np.cumsum(lengths, dtype=np.int64).tolist():
                    word = data[start:end]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(core.encode_single_piece(word), np.uint32).tobytes()
                    ids.append(found)
                    start = end
                many = np.array([len(i) // 4 for i in ids], np.uint32)
                out = squeezed(many, np.frombuffer(b"".join(ids), np.uint32))
                columns = [batch.column("block").slice(i, 1), batch.column("share").slice(i, 1), pa.array([out], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "share", "ids"])
            give_back()

    return run


def _placed(schema: pa.Schema, table: Callable[[], tuple[pa.Array, np.ndarray]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = batch.column("keys").slice(i, 1).flatten()
                counts = batch.column("counts").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                codes = np.concatenate([opened(c, np.uint32)[0] for c in batch.column("codes")[i].as_py()])
                often, sizes = opened(batch.column("words")[i].as_py(), np.uint32, np.int64)
                words = len(often) + int(sizes.sum())
                first = _by_share(often, len(sizes))
                bounds = len(often) + np.concatenate(([0], np.cumsum(sizes)))
                length, start, flats, base = np.zeros(words, np.int64), np.zeros(words, np.int64), [], 0
                for entry in batch.column("entries")[i].as_py():
                    many, flat = opened(entry["ids"], np.uint32, np.uint32)
                    at = entry["share"]
                    mine = np.concatenate((first[at], np.arange(bounds[at], bounds[at + 1])))
                    length[mine] = many
                    start[mine] = base + np.cumsum(many, dtype=np.int64) - many
                    flats.append(flat.astype(np.int32))
                    base += len(flat)
                flat = np.concatenate(flats) if flats else np.empty(0, np.int32)
                ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                # Some documents at a time: the ids of a block take far more room than its numbers.
                low = 0
                while low < len(keys):
                    high = max(low + 1, min(int(np.searchsorted(ends, ends[low] + PLACED, "right")) - 1, low + 2_000))
                    some = codes[ends[low] : ends[high]]
                    many = length[some]
                    reach = np.concatenate(([0], np.cumsum(many)))
                    ids = pa.array(flat[ranges(start[some], many)])
                    lists = pa.ListArray.from_arrays(pa.array(reach[ends[low : high + 1] - ends[low]], pa.int32()), ids)
                    columns = [keys.slice(low, high - low), lists]
                    if table is not None:
                        columns.append(bytes_of(lists, *table()))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    low = high
            give_back()

    return run


def encode(
    docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """Per row the key and ``ids``, those of the whole text.

    With ``decoded`` also what ``decode`` makes of them, joined in the same task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    rows = spread(docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shares = parts_for(spark, total, TASK_BYTES)
    kind = dict(rows.dtypes)["key"]
    schema = f"block bigint, keys array<{kind}>, counts array<int>, codes array<binary>, words binary, share int, listed binary"
    # Written once, so that the numbers of blocks hold from here on.
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    split = numbered.mapInArrow(_split(shares, to_arrow_schema(_parse_datatype_string(schema))), schema)
    held = staged(split, "pretokens")
    lists = held.filter("share IS NOT NULL").select("block", "share", "listed")
    dealt = lists.repartition(shares, "share").sortWithinPartitions("share")
    known = dealt.mapInArrow(_encoded_lists(rank_file), "block bigint, share int, ids binary")
    # A task places few blocks, since a batch holds all that a task was given.
    tasks = 2 * shares
    entries = known.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("share", "ids")).alias("entries"))
    blocks = held.filter("share IS NULL").select("block", "keys", "counts", "codes", "words")
    empty = F.array().cast("array<struct<share: int, ids: binary>>")
    full = blocks.repartition(tasks, "block").join(entries, "block", "left").withColumn("entries", F.coalesce("entries", empty))
    result = f"key {kind}, ids array<int>" + (", decoded binary" if decoded else "")
    arrow = to_arrow_schema(_parse_datatype_string(result))
    table = partial(token_table, rank_file) if decoded else None
    return full.mapInArrow(_placed(arrow, table), result).withColumnRenamed("key", key)


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each id, and which ids there are."""
    table = ranks(path)
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    known = np.zeros(len(tokens), bool)
    known[list(table.values())] = True
    return pa.array(tokens, pa.large_binary()), known


def bytes_of(lists: pa.Array, tokens: pa.Array, known: np.ndarray) -> pa.Array:
    """Lists of ids joined with their bytes."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    numbers = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
    outside = (numbers < 0) | (numbers >= len(tokens))
    if outside.any() or not known[numbers].all():
        raise ValueError("an id is not in the vocabulary")
    pieces = pc.take(tokens, flat.cast(pa.int64()))
    reach = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))))
    ends = reach[np.concatenate(([0], np.cumsum(counts)))].astype(np.int64)
    # The pieces lie one behind another: a text is a stretch of their bytes.
    data = pieces.buffers()[2] or pa.py_buffer(b"")
    out = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), data])
    return out.cast(pa.binary())


def _decoded(path: str, ids: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*batch.columns, bytes_of(batch.column(ids), *token_table(path))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def decode(encoded: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with one more column: the bytes that its ids stand for."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [f for f in encoded.schema.fields if f.name != out]
    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])
    kept = encoded.select(*(f"`{f.name}`" for f in fields))
    return kept.mapInArrow(_decoded(rank_file, ids, to_arrow_schema(schema)), schema)
