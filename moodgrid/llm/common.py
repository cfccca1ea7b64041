"""What the operators share: written intermediate tables and slices of Arrow batches.

An intermediate table lives in the folder that ``spark.checkpoint.dir`` names,
so that it outlives the executor that wrote it; whoever owns that folder clears
it. Without the setting only a local session gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
TASK_BYTES = 32 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that is not there yet, where every executor can reach it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="moodgrid-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: computed once, lineage cut."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """How many partitions hold ``total`` at about ``each``, one per core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-int(total) // each))


def arrow_rows(spark: SparkSession, rows: int = 2_000) -> None:
    """Bounds the texts that go to a Python worker at once; a lower setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """A source of few splits over all cores (a small table is one split, and one task)."""
    arrow_rows(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = len(df.inputFiles())
    return df.repartition(2 * cores) if splits < cores else df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Views of a batch whose texts take about ``limit`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text between ASCII white space: offsets by text, word codes, vocabulary.

    A null text counts as an empty one.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # Leading and trailing white space leaves empty pieces.
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
    if empty >= 0:
        keep = codes != empty
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        codes = codes[keep]
    return np.concatenate(([0], np.cumsum(counts))), codes, vocabulary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def table_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_hash(key: str, text: str):
    """A number for key and text together; an absent one differs from any text."""
    number = F.col(key).cast("long").cast("string")
    parts = [x for c in (number, F.col(text)) for x in (c.isNull(), F.coalesce(c, F.lit("")))]
    return F.xxhash64(*parts)
