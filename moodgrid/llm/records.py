"""Token sequences as length-delimited binary records with a separate offset index.

One file holds the frames of consecutive keys. A frame is

    length   uint64, bytes of the payload
    check    uint32, masked CRC-32 of the eight length bytes
    payload  int64 key, uint8 key is there, uint8 bytes an id, the ids
    check    uint32, masked CRC-32 of the payload
    end      one byte, a line feed

all little-endian. The mask (rotate by 15, add a constant) keeps a checksum of
data that holds checksums meaningful. Spark's text writer puts one frame a line,
so its commit protocol holds: a lost executor leaves no half file behind, and any
file system Spark knows will do. The index is a Parquet table of one row a frame:
file, offset, length, key, ids and their checksum.

Nulls: a null text is an empty one, a null key sorts first and is written as
such. Rows that repeat are written each. An empty table gives no frames. Further
columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodgrid.llm import tokens
from moodgrid.llm.common import TASK_BYTES, arrow_rows, parts_for, slices, text_or_empty

# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<qBB")
CHECK = struct.Struct("<I")
END = b"\n"

INDEX = "part int, file string, offset long, length long, key long, n_tokens long, ids_crc32 long, start_in_file long"
SEQUENCES = "file string, offset long, key long, ids array<int>"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """A frame without its end byte, which the writer of lines adds."""
    payload = KEY.pack(key or 0, key is not None, ids.itemsize) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[int, int | None, np.ndarray]:
    """The frame at an offset: where the next one starts, its key and its ids as uint32."""
    length, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at byte {at}")
    start = at + HEAD.size
    payload = bytes(data[start : start + length])
    (check,) = CHECK.unpack_from(data, start + length)
    if len(payload) != length or masked(payload) != check:
        raise ValueError(f"damaged record at byte {at}")
    key, there, width = KEY.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=KEY.size).astype("<u4")
    return start + length + CHECK.size + len(END), key if there else None, ids


def _framed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path, "spaces")
        for batch in batches:
            for part in slices(batch, "text", tokens.TEXT_BYTES):
                offsets, ids = coder.encode(part.column("text"))
                keys = part.column("key").to_pylist()
                frames = [frame(k, ids[a:b]) for k, (a, b) in zip(keys, tokens.each_document(offsets), strict=True)]
                out = pa.RecordBatch.from_arrays([pa.array(frames, pa.large_binary())], ["frame"])
                del offsets, ids, keys, frames
                yield out
                tokens.give_back()

    return run


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", file_bytes: int = TASK_BYTES
) -> None:
    """Encodes every text and writes the frames in ascending key order, files in the same order."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # The checksum spreads keys that repeat.
    order = [F.col("key").asc_nulls_first(), F.crc32(F.col("text").cast("binary")).asc()]
    dealt = rows.repartitionByRange(parts_for(spark, total, file_bytes), *order).sortWithinPartitions(*order, "text")
    frames = dealt.mapInArrow(_framed(tokenizer), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/records", lineSep="\n")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            data, at, seen, rows = memoryview(content.as_buffer()), 0, 0, []
            part = int(file.split("-")[1])
            while at < len(data):
                after, key, ids = unframe(data, at)
                rows.append((part, file, at, after - at, key, len(ids), zlib.crc32(ids), seen))
                at, seen = after, seen + len(ids)
            if rows:
                kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)
        tokens.give_back()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The record files, each a row: the writer bounds their size."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def write_index(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the record files, checks every frame, and writes one row for each."""
    _files(spark, folder).mapInArrow(_scanned, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def positions(index: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all frames before one. Files are few, so their totals are summed in one task."""
    totals = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("file", before.alias("_before"))
    return index.join(starts, "file").withColumn("start", F.col("_before") + F.col("start_in_file")).drop("_before")


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = (batch.column("file").to_pylist(), batch.column("content"), batch.column("offsets").to_pylist())
        for file, content, offsets in zip(*columns, strict=True):
            data = memoryview(content.as_buffer())
            for at in offsets:
                _, key, ids = unframe(data, at)
                out.append((file, at, key, ids))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        if out:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "key", "ids"])


def read_shuffled(spark: SparkSession, folder: str, seed: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """The sequences of the index rows in ``wanted`` (all if none), in an order the seed decides."""
    index = wanted if wanted is not None else spark.read.schema(INDEX).parquet(f"{folder}/index")
    per_file = index.groupBy("file").agg(F.collect_list("offset").alias("offsets"))  # a file's frames are bounded
    read = _files(spark, folder).join(per_file, "file").mapInArrow(_fetched, SEQUENCES)
    return read.orderBy(F.xxhash64(F.lit(seed), "file", "offset"))
