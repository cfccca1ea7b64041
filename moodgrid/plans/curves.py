"""Predictions, bands and contrasts from coefficient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.functions.recode import inverse_logit
from moodgrid.operators.aggregates import lengthen, widen
from moodgrid.operators.windows import baseline_shift

PERCENTILES = (0.025, 0.5, 0.975)


def predict_curve(
    coefs: DataFrame, grid: DataFrame, terms: dict[str, Column], points: Sequence[str], replicate: Sequence[str] = ("replicate",)
) -> DataFrame:
    """Linear combination of each replicate's coefficients on a grid.

    ``grid`` is small and has the ``points`` columns; ``terms`` are evaluated
    on it. Terms absent from a replicate are skipped.
    """
    points = list(points)
    wide = grid.select(*points, *(c.cast("double").alias(f"t{i}") for i, c in enumerate(terms.values())))
    long = lengthen(wide, points, [f"t{i}" for i in range(len(terms))], "slot", "x")
    names = F.create_map(*(F.lit(v) for i, t in enumerate(terms) for v in (f"t{i}", t)))
    design = long.withColumn("term", names[F.col("slot")])
    return (
        coefs.select(*replicate, "term", "estimate")
        .join(design, ["term"], "inner")
        .groupBy(*replicate, *points)
        .agg(F.sum(F.col("x") * F.col("estimate")).alias("value"))
    )


def confidence_band(pred: DataFrame, points: Sequence[str], value: str = "value") -> DataFrame:
    """2.5, 50 and 97.5 percentiles over the replicates of each grid point.

    A group holds one number per replicate, so it is small by construction.
    """
    p = F.percentile(value, F.array(*(F.lit(q) for q in PERCENTILES)))
    return pred.groupBy(*points).agg(p.alias("p")).select(
        *points, F.col("p")[0].alias("ymin"), F.col("p")[1].alias("pred"), F.col("p")[2].alias("ymax")
    )


def shifted_band(
    pred: DataFrame, x: str, at: float, groups: Sequence[str] = (), replicate: Sequence[str] = ("replicate",)
) -> DataFrame:
    """Bands of the difference to the value at the reference point."""
    shifted = baseline_shift(pred, [*replicate, *groups], x, "value", at)
    return confidence_band(shifted, [x, *groups])


def probability_curve(pred: DataFrame, x: str, at: float | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Inverse logit of a curve as difference to its minimum or to ``at``."""
    p = pred.withColumn("prob", inverse_logit(F.col("value")))
    reference = (
        F.min("prob") if at is None else F.max(F.when(F.col(x) == F.lit(at), F.col("prob")))
    ).alias("__ref")
    if not groups:
        ref = p.agg(reference).scalar()
        return p.withColumn("pred", F.col("prob") - ref).drop("prob")
    refs = p.groupBy(*groups).agg(reference)
    return p.join(refs, list(groups), "left").withColumn("pred", F.col("prob") - F.col("__ref")).drop("prob", "__ref")


def slope_gap(
    coefs: DataFrame, key: str, by: str, low: float | Column, high: float | Column, start: float = 5.0, stop: float = 30.0
) -> DataFrame:
    """Change from ``start`` to ``stop`` at a low and a high value of ``by``.

    ``by`` quantiles and coefficients must be on the same scale.
    """
    wide = widen(coefs, [key], "term", "estimate", ["wbgt", f"wbgt:{by}"])
    step = F.lit(stop - start)
    at = lambda q: step * (F.col("wbgt") + F.col(f"wbgt:{by}") * (q if isinstance(q, Column) else F.lit(q)))
    return wide.select(key, at(low).alias("change_low"), at(high).alias("change_high")).withColumn(
        "gap", F.col("change_high") - F.col("change_low")
    )


def scaled_effect(coefs: DataFrame, key: str, term: str, scale: float | Column) -> DataFrame:
    """An effect times ``scale`` with its 95 percent normal interval."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    half = F.lit(1.959963984540054) * F.col("std_error") * F.abs(s)
    mid = F.col("estimate") * s
    return coefs.filter(F.col("term") == term).select(
        key, mid.alias("effect"), (mid - half).alias("low"), (mid + half).alias("high")
    )


def simple_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """One-variable least squares: slope, intercept, correlation, n."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(x, y).alias("corr"),
        F.count(F.lit(1)).alias("n"),
    )
