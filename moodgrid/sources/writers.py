"""Writers: partitioned, chunked and merged outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], spread: Sequence[str] | None = None, files: int = 1, mode: str = "overwrite"
) -> None:
    """One folder per key value.

    Rows of one value meet in at most ``files`` tasks; ``spread`` names the
    columns that divide a value holding a large share of the rows.
    """
    keys = [F.col(c) for c in by]
    if spread and files > 1:
        keys.append(F.pmod(F.xxhash64(*spread), F.lit(files)))
    df.repartition(*keys).write.mode(mode).option("maxRecordsPerFile", CHUNK_ROWS).partitionBy(*by).parquet(path)


def split_into_chunks(df: DataFrame, path: str, rows: int = CHUNK_ROWS, fmt: str = "parquet") -> None:
    """Files of at most ``rows`` rows, without moving rows between tasks."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).format(fmt).save(path)


def merge_csv_headers(spark: SparkSession, folder: str, out: str, schema: T.StructType | str) -> None:
    """All CSV files of a folder as one table; each header is read, not copied."""
    from moodgrid.sources.readers import read_csv_set

    read_csv_set(spark, folder, schema).write.mode("overwrite").option("escape", '"').csv(out, header=True)
