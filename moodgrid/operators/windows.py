"""Group totals, shifts, running means, first-per-key: hot groups are split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodgrid.operators.joins import lookup_join

BLOCK_DAYS = 512


def attach_group(df: DataFrame, keys: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Group aggregates on every row; null where a key is null.

    Aggregates and joins back instead of a window, so that a group of any size
    is folded where its rows are and never gathered in one task.
    """
    folded = df.groupBy(*keys).agg(*(agg.alias(name) for name, agg in totals.items()))
    return lookup_join(df, folded, keys, "left")


def group_total(df: DataFrame, key: str, totals: Mapping[str, str]) -> DataFrame:
    """Sums over the group attached to each row; ``totals`` maps output to input."""
    return attach_group(df, [key], {out: F.sum(col) for out, col in totals.items()})


def baseline_shift(df: DataFrame, keys: Sequence[str], x: str, value: str, at: float) -> DataFrame:
    """Subtract the group's value at the reference point ``x == at``."""
    base = df.filter(F.col(x) == F.lit(at)).groupBy(*keys).agg(F.max(value).alias("__base"))
    return (
        lookup_join(df, base, keys, "left")
        .withColumn(value, F.col(value) - F.col("__base"))
        .select(*df.columns)
    )


def rolling_mean(df: DataFrame, key: str, day: str, cols: Sequence[str], k: int = 30, suffix: str = "30") -> DataFrame:
    """Right-aligned k-day means on a dense daily grid.

    Null until k days exist; absent days inside the frame are skipped. Each
    key's days are cut into blocks that repeat the k-1 days before them, so one
    key with a very long history is spread over tasks.
    """
    block_days = max(BLOCK_DAYS, 4 * k)
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    first = df.groupBy(key).agg(F.min(day).alias("__first"))
    blocks = F.array_distinct(
        F.array(F.floor(F.col("__num") / block_days), F.floor((F.col("__num") + (k - 1)) / block_days))
    )
    spread = (
        lookup_join(df, first, [key], "left")
        .withColumn("__num", number)
        .withColumn("__block", F.explode(blocks))
    )
    frame = Window.partitionBy(key, "__block").orderBy("__num").rowsBetween(-(k - 1), 0)
    ready = F.col("__num") - F.datediff(F.col("__first"), F.lit("1970-01-01").cast("date")) >= k - 1
    means = {f"{c}{suffix}": F.when(ready, F.avg(c).over(frame)) for c in cols}
    own = F.col("__block") == F.floor(F.col("__num") / block_days)
    return spread.withColumns(means).filter(own).drop("__first", "__num", "__block")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the other columns.

    A minimum over row structs combines on the map side, so a key repeated in
    a third of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = [*(c for c in order if c not in keys), *rest]
    if not ranked:
        return df.dropDuplicates(list(keys))
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("__row"))
    return best.select(*(c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
