"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgrid.queries import fixtures
from moodgrid.session import ship_package

Build = Callable[["Tables"], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None
    needs: tuple[str, ...]


CATALOGUE: dict[str, Entry] = {}


class Tables:
    """Lazily read tables and derived frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in fixtures.TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in fixtures.DERIVED:
            return fixtures.derive(self, name)
        raise AttributeError(name)

    def fresh_folder(self, name: str) -> str:
        """A new folder every executor can reach; a local session may use /tmp."""
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            base = "/tmp"
        return f"{base}/moodgrid-{name}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, name: str = "panel", shuffled: bool = False) -> DataFrame:
        """The frame as a written table, which the model steps scan repeatedly.

        A source of few files is spread over the cores first. A ``shuffled`` frame is
        dealt out without looking: counting its partitions would run its shuffles once more.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if shuffled:
            df = df.repartition(max(cores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        elif df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
        folder = self.fresh_folder(name)
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Build], Build]:
    """Register a query; ``needs`` names the derived frames its SQL refers to."""

    def register(build: Build) -> Build:
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Entry(build, sql, needs)
        return build

    return register


def runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return entry.build(Tables(spark, folder))

    return run


def full_sql(entry: Entry) -> str:
    """The check's SQL with the derived frames as leading expressions."""
    ctes = fixtures.duckdb_ctes(entry.needs)
    body = entry.sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as the SQL side does."""
    return df.select(
        *((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes)
    )


def r(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def drawn_sql(source: str, ids: str, seed: int, first: int, last: int) -> str:
    """``draw`` with r (replicate) and k (count) for every row of ``source``: two md5 seeds, mixed, and Poisson(1)."""
    edges, mass, total = [], math.exp(-1), 0.0
    for n in range(16):
        total += mass
        edges.append(total)
        mass /= n + 1
    when = " ".join(f"WHEN u < {e!r}::DOUBLE THEN {n}" for n, e in enumerate(edges))
    digits = lambda at: f"('0x' || substr(md5(concat_ws('|', {ids}, '{seed}')), {at}, 8))::BIGINT"
    return f"""seeded AS (SELECT *, {digits(1)} AS s1, {digits(9)} AS s2 FROM {source}),
      m1 AS (SELECT p.*, r, xor((s1 + r * 1640531527) % 4294967296, s2) AS x FROM seeded p, range({first}, {last + 1}) t(r)),
      m2 AS (SELECT *, (xor(x, x >> 16) * 2146121005) % 4294967296 AS x2 FROM m1),
      m3 AS (SELECT *, (xor(x2, x2 >> 15) * 1994318123) % 4294967296 AS x3 FROM m2),
      m4 AS (SELECT *, xor(x3, x3 >> 16) / 4294967296.0::DOUBLE AS u FROM m3),
      draw AS (SELECT *, CASE {when} ELSE 16 END AS k FROM m4)"""
