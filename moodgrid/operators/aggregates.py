"""Grouped summaries, distributed quantiles, bins and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodgrid.operators.joins import lookup_join
from moodgrid.session import cut_lineage

SORTED_ROWS = 1_000_000  # rows of one interval that a task may sort
QUANTILE_BINS = 4096


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in cols), F.count(F.lit(1)).alias(n))


def count_if_by(df: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count_if(test).alias(name) for name, test in tests.items()))


def sum_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sums that treat absent values, also whole groups of them, as 0."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols))


def extreme_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with the highest and lowest group mean; ties take the smaller key."""
    means = df.groupBy(key).agg(F.avg(value).alias("mean"))
    ends = means.agg(
        F.max(F.struct(F.col("mean"))).getField("mean").alias("top"),
        F.min(F.struct(F.col("mean"))).getField("mean").alias("bottom"),
        F.min(F.struct((-F.col("mean")).alias("m"), F.col(key).alias("k"))).getField("k").alias("top_key"),
        F.min(F.struct(F.col("mean").alias("m"), F.col(key).alias("k"))).getField("k").alias("bottom_key"),
    )
    return ends.select(
        F.explode(
            F.array(
                F.struct(F.lit("highest").alias("which"), F.col("top_key").alias(key), F.col("top").alias("mean")),
                F.struct(F.lit("lowest").alias("which"), F.col("bottom_key").alias(key), F.col("bottom").alias("mean")),
            )
        ).alias("e")
    ).select("e.*")


def weighted_mean_by(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str = "mean") -> DataFrame:
    """Weighted mean and row count per group, null keys forming their own group.

    Rows of zero weight are ignored; an absent value with weight voids the group.
    """
    used = F.col(weight) > 0
    total = F.sum(F.when(used, F.col(weight)))
    product = F.sum(F.when(used, F.col(value) * F.col(weight)))
    void = F.count_if(F.col(weight).isNull() | (used & F.col(value).isNull())) > 0
    return df.groupBy(*keys).agg(
        F.when(~void, product / total).alias(out), F.count(F.lit(1)).alias("n")
    )


def quantiles(
    df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (), limit: int = SORTED_ROWS
) -> DataFrame:
    """Exact quantiles with linear interpolation, however large the groups are.

    Each wanted rank has an interval of values that holds it, at first the whole
    range. While more than ``limit`` rows lie in one, its rows are counted in equal
    bins, and the bin with the rank, from its least to its greatest value, is the
    next interval: a value that holds most rows soon stands alone. Only the last
    intervals are sorted, each in a task. Returns ``keys``, ``prob``, ``value``.
    """
    listed, v = list(keys), F.col("v")
    rows = df.select(*listed, F.col(col).cast("double").alias("v")).filter(v.isNotNull())
    if not listed:
        listed, rows = ["__all"], rows.withColumn("__all", F.lit(0))
    ends = rows.groupBy(*listed).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranked = (
        ends.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs))))
        .withColumn("at", (F.col("held") - 1) * F.col("prob"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
        .withColumn("before", F.lit(0).cast("long"))
    )
    columns = [*listed, "prob", "at", "rank", "before", "held", "lo", "hi"]
    wanted, last = cut_lineage(ranked.select(*columns)), None
    wide = F.col("lo") < F.col("hi")
    crowded = wide & (F.col("held") > limit)

    def inside(which: Column) -> DataFrame:
        """Rows with the open interval they lie in; a key has two intervals for each probability at most."""
        spans = wanted.filter(which).groupBy(*listed).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        met = lookup_join(rows, spans, listed, "inner", ["v"], small=None if keys else True)
        own = F.filter("spans", lambda s: (v >= s.lo) & (v <= s.hi))
        return met.select(*listed, "v", F.explode(own).alias("s")).select(*listed, "v", "s.lo", "s.hi")

    holds = (F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n"))
    while True:
        most = wanted.filter(crowded).agg(F.max("held")).first()[0]
        if most is None or most == last:
            break
        last = most
        place = F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * QUANTILE_BINS)
        bins = inside(crowded).groupBy(*listed, "lo", F.least(place, F.lit(QUANTILE_BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        # At most QUANTILE_BINS rows for each interval.
        upto = F.sum("n").over(Window.partitionBy(*listed, "lo").orderBy("bin"))
        moved = wanted.filter(crowded).drop("held", "hi").join(bins.withColumn("upto", upto), [*listed, "lo"]).filter(holds)
        moved = moved.select(
            *listed, "prob", "at", "rank", (F.col("before") + F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("held"),
            F.col("low").alias("lo"), F.col("high").alias("hi"),
        )
        wanted = cut_lineage(wanted.filter(~crowded).unionByName(moved))
    counted = inside(wide).groupBy(*listed, "lo", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*listed, "lo").orderBy("v"))
    sorted_out = wanted.filter(wide).join(counted.withColumn("upto", upto), [*listed, "lo"]).filter(holds)
    found = wanted.filter(~wide).select(*listed, "prob", "at", F.col("lo").alias("v")).unionByName(
        sorted_out.select(*listed, "prob", "at", "v")
    )
    low, high = F.min("v"), F.max("v")
    return found.groupBy(*listed, "prob").agg(
        (low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("value")
    ).drop("__all")


def quantile_cuts(df: DataFrame, col: str, probs: Sequence[float]) -> Column:
    """The quantiles as a one-row array column (ascending)."""
    return quantiles(df, col, probs).agg(F.sort_array(F.collect_list("value")).alias("cuts")).scalar()


def quantile_bins(df: DataFrame, col: str, labels: Sequence[str], out: str) -> DataFrame:
    """Near-equal groups by value: equal values always share a group."""
    g = len(labels)
    cuts = quantile_cuts(df, col, [i / g for i in range(1, g)])
    label = F.lit(labels[0])
    for i, name in enumerate(labels[1:]):
        label = F.when(F.col(col) >= F.element_at(F.col("__cuts"), i + 1), F.lit(name)).otherwise(label)
    return df.withColumn("__cuts", cuts).withColumn(out, F.when(F.col(col).isNotNull(), label)).drop("__cuts")


def conditional_median(df: DataFrame, value: str, near: str, targets: Sequence[float], tolerance: float) -> DataFrame:
    """Median of ``value`` over rows whose ``near`` lies around each target."""
    listed = F.array(*(F.lit(float(t)) for t in targets))
    hits = F.filter(listed, lambda t: F.abs(F.col(near) - t) < F.lit(tolerance))
    around = df.select(F.explode(hits).alias("target"), F.col(value))
    return quantiles(around, value, [0.5], ["target"]).select("target", F.col("value").alias("median"))


def histogram(df: DataFrame, col: str, width: float, scale: int = 1) -> DataFrame:
    """Counts per bin of fixed width; ``scale`` undoes a sampling fraction."""
    start = (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).cast("double")
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(start.alias("bin"))
        .agg((F.count(F.lit(1)) * F.lit(scale)).alias("n"))
    )


def hex_density(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Points per pointy-top hexagon of the given width, with log10 counts."""
    size = width / 3**0.5
    q = (F.lit(3**0.5 / 3) * F.col(x) - F.col(y) / F.lit(3.0)) / F.lit(size)
    r = F.lit(2.0 / 3) * F.col(y) / F.lit(size)
    s = -q - r
    # Cube rounding: the coordinate furthest from its integer gives way.
    frac = df.select(q.alias("q"), r.alias("r"), s.alias("s")).filter(F.col("q").isNotNull() & F.col("r").isNotNull())
    near = {c: F.floor(F.col(c) + F.lit(0.5)) for c in "qrs"}
    away = {c: F.abs(F.col(c) - near[c]) for c in "qrs"}
    hex_q = F.when((away["q"] > away["r"]) & (away["q"] > away["s"]), -near["r"] - near["s"]).otherwise(near["q"])
    hex_r = F.when(
        ~((away["q"] > away["r"]) & (away["q"] > away["s"])) & (away["r"] > away["s"]), -near["q"] - near["s"]
    ).otherwise(near["r"])
    return (
        frac.groupBy(hex_q.alias("hex_q"), hex_r.alias("hex_r"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("log_n", F.log10("n"))
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def covers_all(df: DataFrame, key: str, item: str, required: DataFrame) -> DataFrame:
    """Rows of the keys that hold every required item (relational division)."""
    needed = required.select(item).distinct()
    held = df.select(key, item).distinct().join(needed, [item], "left_semi")
    size = needed.agg(F.count(F.lit(1)).alias("k")).scalar()
    complete = held.groupBy(key).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") == size)
    return df.join(complete.select(key), [key], "left_semi")


def widen(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Long to wide for a declared list of names (first value per cell)."""
    return df.groupBy(*keys).agg(
        *(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names)
    )


def lengthen(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def rescale01(df: DataFrame, cols: Sequence[str], flip: Sequence[str] = ()) -> DataFrame:
    """Min-max to 0..1 over the whole frame; flipped columns become 1 - x."""
    ends = df.agg(
        F.struct(
            *(F.min(c).cast("double").alias(f"{c}_lo") for c in cols),
            *(F.max(c).cast("double").alias(f"{c}_hi") for c in cols),
        ).alias("ends")
    ).scalar()

    def scaled(c: str) -> Column:
        low, high = ends.getField(f"{c}_lo"), ends.getField(f"{c}_hi")
        x = F.when(high > low, (F.col(c) - low) / (high - low))
        return F.lit(1.0) - x if c in flip else x

    return df.select(*(scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns))
