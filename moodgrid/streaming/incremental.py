"""Score only new files: a file stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def score_incremental(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    fmt: str = "json",
    max_files: int | None = None,
) -> None:
    """Apply ``score`` to the files not seen before and add their results.

    The checkpoint remembers the files. Each batch writes its own folder and
    overwrites it when retried, so a lost driver neither loses nor repeats rows.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        reader.load(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
