"""Sharding by a keyed permutation of the global row numbers.

Rows are numbered in the order of (key, checksum, size). A Feistel network on
``Z_a x Z_b`` with ``a * b >= n`` permutes the numbers; a value outside ``n`` is
sent through the network again until it falls inside (cycle walking), which keeps
the map one to one. The place ``p`` of a row gives ``shard = p % shards`` and
``slot = p // shards``: shard sizes differ by one row at most, slots have no gaps,
and anyone who knows the row number, ``n`` and the seed can compute both.

Nulls: a null key sorts first, a null text has size 1 and the checksum of the
empty string. Rows that repeat get numbers of their own. An empty table gives an
empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.llm.common import staged, text_or_empty

ROUNDS = 4
# Copies of one row that stay together while rows are numbered.
RUN = 65_536


def _mix(half: Column, round_no: int, seed: int, modulus: int) -> Column:
    """The round function: 52 bits of a digest, which any SQL engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{round_no}"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % modulus


def _round(i: int, seed: int, modulus: int):
    return lambda s: F.struct(s.y.alias("x"), ((s.x + _mix(s.y, i, seed, modulus)) % modulus).alias("y"))


def _once(value: Column, step) -> Column:
    """``step(value)`` with the value computed once, however often the step names it."""
    return F.element_at(F.transform(F.array(value), step), 1)


def _network(value: Column, a: int, b: int, seed: int) -> Column:
    """One pass: the halves swap roles and radices, so that an even number of rounds restores them."""
    state = F.struct(((value - value % b) / b).cast("long").alias("x"), (value % b).alias("y"))
    for i in range(ROUNDS):
        state = _once(state, _round(i, seed, a if i % 2 == 0 else b))
    return _once(state, lambda s: s.x * b + s.y)


def permuted(number: Column, n: int, seed: int) -> Column:
    """The place of row ``number`` among ``n`` rows."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    first = _network(number, a, b, seed)
    # At most a * b - n < a places lie outside, so a walk ends within that many steps;
    # only the few rows that fall outside evaluate it.
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n + 1)),
        first,
        lambda at, _: F.when(at < n, at).otherwise(_network(at, a, b, seed)),
    )
    return F.when(first < n, first).otherwise(walk)


def numbered(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (from 0, in the order of ``by``) and returns the count too.

    Equal rows are counted before the shuffle and dealt in runs, so that no key,
    however often it repeats, lands in one task. ``by`` has to tell all rows apart
    that are not interchangeable.
    """
    runs = (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / RUN).cast("int"))))
        .withColumn("_length", F.least(F.lit(RUN).cast("long"), F.col("_copies") - F.col("_run").cast("long") * RUN))
    )
    order = [*(F.col(c).asc_nulls_first() for c in by), F.col("_run").asc()]
    # The place within a partition is stored with the row: nothing later depends
    # on the sampled bounds of the range partitions.
    at = F.monotonically_increasing_id()
    dealt = staged(
        runs.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_length"))))
        .select(*by, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")),
        "numbered",
    )
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).collect()  # one row a partition
    before, total = {}, 0
    for part, n in sorted((r["_part"], r["_rows"]) for r in sizes):
        before[part], total = total, total + n
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    result = dealt.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_before") + F.col("_place"))
    return result.drop("_part", "_place", "_before"), total


def shard(
    docs: DataFrame, shards: int = 16, seed: int = 20240, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``key, size, text_crc32, row_number, place, shard, slot``."""
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed, total = numbered(rows, [key, "text_crc32", "size"])
    return placed.withColumn("place", permuted(F.col("row_number"), total, seed)).withColumns(
        {
            "shard": (F.col("place") % shards).cast("int"),
            "slot": F.floor(F.col("place") / shards).cast("long"),
        }
    )
