"""Repeatable samples and bootstrap weights, keyed on row ids.

Randomness is arithmetic on a digest of the ids, so that any engine with md5 and
64-bit integers draws the same: two 32-bit seeds a row, mixed with the number of
the replicate. Numpy and column expressions give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 2**32
GRAIN = 2**52
# Fixed values of the mixing: odd numbers below 2^31, so that products stay below 2^63.
STEP, FIRST, SECOND = 1_640_531_527, 2_146_121_005, 1_994_318_123


def _digits(keys: Sequence[Column | str], start: int, count: int) -> Column:
    """Hexadecimal digits of the keys' md5 as a number."""
    text = F.concat_ws("|", *(k if isinstance(k, Column) else F.col(k) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), start, count), 16, 10).cast("bigint")


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return _digits([k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys], 1, 13) / F.lit(float(GRAIN))


def seeds(ids: Sequence[str], seed: int) -> tuple[Column, Column]:
    """The two seeds of a row."""
    keys = [*(F.col(c).cast("string") for c in ids), F.lit(str(seed))]
    return _digits(keys, 1, 8), _digits(keys, 9, 8)


def mixed(one, two, number, shift, both):
    """32 bits from two seeds and a number; ``shift`` and ``both`` are the engine's right shift and exclusive or."""
    x = both((one + number * STEP) % WORD, two)
    x = (both(x, shift(x, 16)) * FIRST) % WORD
    x = (both(x, shift(x, 15)) * SECOND) % WORD
    return both(x, shift(x, 16))


def replicate_uniform(one: Column, two: Column, number: Column) -> Column:
    """The uniform number of a row in a replicate."""
    bits = mixed(one, two, number.cast("bigint"), F.shiftright, lambda a, b: a.bitwiseXOR(b))
    return bits / F.lit(float(WORD))


def poisson_edges() -> list[float]:
    """The cumulative distribution of Poisson(1) at 0, 1, ..., 15."""
    edges, mass, total = [], math.exp(-1), 0.0
    for n in range(1, 17):
        total += mass
        edges.append(total)
        mass /= n
    return edges


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by its cumulative distribution."""
    edges = poisson_edges()
    weight = F.lit(len(edges))
    for n in range(len(edges) - 1, -1, -1):
        weight = F.when(u < F.lit(edges[n]), F.lit(n)).otherwise(weight)
    return weight


def draws(columns: Sequence[np.ndarray], first: int, replicates: int) -> np.ndarray:
    """Rows by replicates: the counts of ``with_replicates``, from the two seed columns."""
    # Numbers of 32 bits wrap around by themselves.
    one, two = (np.asarray(c, np.int64).astype(np.uint32)[:, None] for c in columns)
    x = (one + (np.arange(first, first + replicates, dtype=np.int64) * STEP % WORD).astype(np.uint32)[None, :]) ^ two
    for shift, factor in ((16, FIRST), (15, SECOND)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    counts = np.zeros(x.shape, np.uint8)
    for edge in poisson_edges():
        reached = math.ceil(edge * WORD)
        if reached < WORD:
            counts += x >= np.uint32(reached)
    return counts.astype(float)


def sample_fraction(df: DataFrame, fraction: float, ids: Sequence[str], seed: int = 1) -> DataFrame:
    """A fraction of the rows; the same rows on every run and partitioning."""
    return df.filter(uniform(*(F.col(c) for c in ids), F.lit(seed)) < F.lit(fraction))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by its cumulative distribution."""
    edges, mass, total = [], math.exp(-1), 0.0
    for n in range(1, 17):
        total += mass
        edges.append(total)
        mass /= n
    weight = F.lit(len(edges))
    for n in range(len(edges) - 1, -1, -1):
        weight = F.when(u < F.lit(edges[n]), F.lit(n)).otherwise(weight)
    return weight


def with_replicates(df: DataFrame, ids: Sequence[str], replicates: int, seed: int = 1, first: int = 1) -> DataFrame:
    """Every row once per replicate it is drawn in, with its count ``weight``.

    Poisson(1) counts are the large-sample form of drawing n of n with
    replacement; rows drawn zero times are not produced.
    """
    numbers = F.array(*(F.lit(b) for b in range(first, first + replicates)))
    one, two = seeds(ids, seed)
    drawn = df.withColumns({"__one": one, "__two": two}).withColumn("replicate", F.explode(numbers))
    u = replicate_uniform(F.col("__one"), F.col("__two"), F.col("replicate"))
    return drawn.withColumn("weight", poisson_weight(u)).drop("__one", "__two").filter(F.col("weight") > 0)


def bootstrap_mean_diff(
    df: DataFrame, group: str, value: str, pair: tuple[str, str], ids: Sequence[str], replicates: int = 100, seed: int = 1
) -> DataFrame:
    """Resampled differences of two group means: 2.5, 50, 97.5 percentiles.

    Rows are folded to one (sum, count) per group and replicate inside each
    task, so only ``2 * replicates`` rows are shuffled per task.
    """
    first, second = pair
    drawn = with_replicates(
        df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()), ids, replicates, seed
    )
    means = drawn.groupBy("replicate", group).agg(
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("m")
    )
    diffs = means.groupBy("replicate").agg(
        (F.max(F.when(F.col(group) == first, F.col("m"))) - F.max(F.when(F.col(group) == second, F.col("m")))).alias("diff")
    )
    ends = diffs.agg(F.percentile("diff", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p"))
    return ends.select(F.col("p")[0].alias("low"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("high"))


def event_window(
    df: DataFrame, region: str, regions: Sequence[str], day: str, event: str, days: int = 7, compat: bool = False
) -> DataFrame:
    """Label rows of the listed regions before / after an event.

    Keeps ``days`` on each side; ``compat`` keeps all dates, as published.
    """
    at = F.lit(event).cast("date")
    chosen = df.filter(F.col(region).isin(*regions))
    if not compat:
        chosen = chosen.filter((F.col(day) >= F.date_sub(at, days)) & (F.col(day) < F.date_add(at, days)))
    return chosen.withColumn("side", F.when(F.col(day) >= at, F.lit("after")).otherwise(F.lit("before")))

