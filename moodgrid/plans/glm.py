"""Poisson and logit models with absorbed factors, by reweighted least squares.

One step folds the rows once and solves as least squares does, by whichever way the
number of levels asks for. The rows are packed into blocks of numbers once, which meet
the last step's solution (``blocks``); designs with two wide factors bring the level
effects back to the rows through size-checked lookups. Models that share a form
(replicates, regions, outcome-predictor pairs) run together as keys of one
aggregation, each with its own convergence.

A Poisson model needs no more of equal rows than their sums: with ``collapse`` rows of
equal key, terms and levels become one, which bounds resampled models by the number of
different rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from moodgrid.operators.joins import SMALL_ROWS, is_small, lookup_join
from moodgrid.plans.blocks import SENT_LEVELS, Working, block_states, packed_rows
from moodgrid.plans.estimation import (
    COEF,
    LEVEL,
    MAX_LEVELS,
    REST_LEVELS,
    TOTALS,
    Design,
    Shape,
    design,
    plain_plans,
    plan_of,
    shape_of,
    solution_of,
    solve,
)
from moodgrid.session import cut_lineage

BOUND = 30.0
MAX_HALVINGS = 30
# Columns of a block before the terms, and further ones of collapsed rows.
LEAD, CELL_LEAD = 2, 3
LOG_FACTORIALS = np.log([float(math.factorial(n)) for n in range(21)])


def _mean(family: str, eta: Column) -> Column:
    eta = F.least(F.greatest(eta, F.lit(-BOUND)), F.lit(BOUND))
    return F.exp(eta) if family == "poisson" else F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def log_factorial(y: Column) -> Column:
    """log(y!) of a count: exact up to 20, Stirling's series beyond."""
    series = (
        y * F.log(y)
        - y
        + F.lit(0.5) * F.log(F.lit(2 * math.pi) * y)
        + F.lit(1.0) / (F.lit(12.0) * y)
        - F.lit(1.0) / (F.lit(360.0) * y * y * y)
    )
    return F.when(y > 20, series).otherwise(F.log(F.factorial(F.least(y, F.lit(20.0)).cast("int")).cast("double")))


def _working(family: str, rows: DataFrame) -> DataFrame:
    """Working response, weight and deviance from the linear predictor."""
    y, w, eta = F.col("y"), F.col("w"), F.col("eta")
    rows = rows.withColumn("mu", _mean(family, eta))
    mu = F.col("mu")
    slope = mu if family == "poisson" else mu * (F.lit(1.0) - mu)
    log_ratio = F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0))
    if family == "poisson":
        deviance = log_ratio - (y - mu)
        likelihood = y * F.log(mu) - mu - log_factorial(y)
    else:
        deviance = log_ratio + F.when(
            y < 1, (F.lit(1.0) - y) * F.log((F.lit(1.0) - y) / (F.lit(1.0) - mu))
        ).otherwise(F.lit(0.0))
        likelihood = y * F.log(mu) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - mu)
    return rows.select(
        "*",
        (eta + (y - mu) / slope).alias("z"),
        (w * slope).alias("v"),
        (F.lit(2.0) * w * deviance).alias("dev"),
        (w * likelihood).alias("ll"),
    )


def collapsed_rows(d: Design) -> Design:
    """Rows of equal keys, terms and levels as one: summed weight, mean outcome, and what the deviance needs besides.

    Rows without weight say nothing and are left out.
    """
    cell = [*d.keys, *(f"x{i}" for i in range(len(d.terms))), *(f"f{i}" for i in range(len(d.factors)))]
    y, w = F.col("y"), F.col("w")
    cells = d.rows.filter("w > 0").groupBy(*cell).agg(
        F.sum("w").alias("w"),
        (F.sum(w * y) / F.sum("w")).alias("y"),
        F.sum(F.when(y > 0, w * y * F.log(y)).otherwise(F.lit(0.0))).alias("own"),
        F.sum(w * log_factorial(y)).alias("factorials"),
        F.count(F.lit(1)).cast("double").alias("count"),
    )
    return Design(cells, d.keys, d.terms, d.factors)


def _working_cells(rows: DataFrame) -> DataFrame:
    """``_working`` of Poisson models on collapsed rows."""
    y, w, eta = F.col("y"), F.col("w"), F.col("eta")
    rows = rows.withColumn("mu", _mean("poisson", eta))
    mu = F.col("mu")
    return rows.select(
        "*",
        (eta + (y - mu) / mu).alias("z"),
        (w * mu).alias("v"),
        (F.lit(2.0) * (F.col("own") - w * y * F.log(mu) - w * (y - mu))).alias("dev"),
        (w * y * F.log(mu) - w * mu - F.col("factorials")).alias("ll"),
    )


def _blocks(d: Design, shape: Shape, collapse: bool) -> DataFrame:
    """The rows as packed blocks: outcome, weight, of collapsed rows their sums, terms."""
    columns = ["y", "w", *(("own", "factorials", "count") if collapse else ()), *d.numbers]
    return packed_rows(d.rows, d.keys, columns, [f"f{i}" for i in range(len(d.factors))], shape.wide, max(shape.buckets, 1), d.layout)


def _log_factorials(y: np.ndarray) -> np.ndarray:
    """``log_factorial`` of numbers."""
    out = LOG_FACTORIALS[np.clip(y, 0, 20).astype(int)]
    many = np.flatnonzero(y > 20)
    if len(many):
        b = y[many]
        out[many] = b * np.log(b) - b + 0.5 * np.log(2 * math.pi * b) + 1 / (12 * b) - 1 / (360 * b**3)
    return out


def _working_block(family: str, collapse: bool, centre: float) -> Working:
    """``_working`` and ``_working_cells`` on the numbers of a block."""

    def made(values: np.ndarray, eta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, w = values[0], values[1]
        if eta is None:
            first = (y + centre) / 2
            eta = np.log(first) if family == "poisson" else np.log(first / (1 - first))
        bounded = np.clip(eta, -BOUND, BOUND)
        mu = np.exp(bounded) if family == "poisson" else 1 / (1 + np.exp(-bounded))
        slope = mu if family == "poisson" else mu * (1 - mu)
        z, v, log_mu = eta + (y - mu) / slope, w * slope, np.log(mu)
        if collapse:
            own, factorials, count = values[2:5]
            return z, v, np.stack((2 * (own - w * y * log_mu - w * (y - mu)), w * y * log_mu - w * mu - factorials, count))
        with np.errstate(divide="ignore", invalid="ignore"):
            log_ratio = np.where(y > 0, y * np.log(y / mu), 0.0)
            if family == "poisson":
                dev, ll = log_ratio - (y - mu), y * log_mu - mu - _log_factorials(y)
            else:
                dev = log_ratio + np.where(y < 1, (1 - y) * np.log((1 - y) / (1 - mu)), 0.0)
                ll = y * log_mu + (1 - y) * np.log(1 - mu)
        return z, v, np.stack((2 * w * dev, w * ll))

    return made


def scanned(rows: DataFrame) -> bool:
    """Whether the rows come from a table by way of expressions and filters alone."""
    nodes = [rows._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        name, below = node.nodeName(), node.children()
        if not (name in ("Project", "Filter", "Generate") or name.startswith(("Relation", "LogicalRelation"))):
            return False
        nodes += [below.apply(i) for i in range(below.size())]
    return True


def drop_separated(d: Design, family: str) -> Design:
    """Remove factor levels without any event, whose effect has no finite value.

    One pass finds such levels of all factors; mostly there are none. Passes go on
    until a pass finds none.
    """
    m, keys = len(d.factors), list(d.keys)
    f = [f"f{i}" for i in range(m)]
    unusable = "hi <= 0" if family == "poisson" else "hi <= 0 OR lo >= 1"
    rows = d.rows
    while True:
        # Dropping a level of one factor may leave another one without events.
        ends = rows.groupingSets([[*keys, c] for c in f], *keys, *f).agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
        bad = cut_lineage(ends.filter(unusable).select(*keys, *f))
        if bad.isEmpty():
            break
        small = is_small(bad)
        for c in f:
            level = [*keys, c]
            rows = lookup_join(rows, bad.filter(F.col(c).isNotNull()).select(*level), level, "left_anti", small=small)
    return Design(rows, d.keys, d.terms, d.factors, d.layout, d.parts)


def fe_glm(
    df: DataFrame,
    y: str | Column,
    terms: dict[str, Column],
    factors: Sequence[str] = (),
    family: str = "poisson",
    weight: str | Column | None = None,
    keys: Sequence[str] = (),
    tolerance: float = 1e-8,
    max_steps: int = 50,
    separated: bool = True,
    max_levels: int = MAX_LEVELS,
    rest_levels: int = REST_LEVELS,
    collapse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fit one model per key; returns (coefficients, fit figures).

    Coefficients: keys, term, estimate, std_error, statistic. Figures: keys,
    n, deviance, log_lik, parameters, aic. A model that does not settle within
    ``max_steps`` steps raises; going back half way does not count as a step.
    """
    if family not in ("poisson", "binomial"):
        raise ValueError("family is poisson or binomial")
    if collapse and family != "poisson":
        raise ValueError("only Poisson rows collapse")
    with plain_plans(df):
        d = design(df, y, terms, factors, weight, keys, compact=True)
        solution = _settled_glm(d, bool(factors) and separated, family, tolerance, max_steps, max_levels, rest_levels, collapse)
    coefs = solution.filter(F.col("kind") == COEF)
    # Unit dispersion: the inverse information alone gives the errors.
    position = F.array_position(F.array(*(F.lit(t) for t in d.terms)), F.col("term")).cast("int")
    error = F.sqrt(F.element_at("vec", position))
    tidy = coefs.select(
        *keys, "term", "estimate", error.alias("std_error"), (F.col("estimate") / error).alias("statistic")
    )
    pick = lambda kind, term: F.max(F.when((F.col("kind") == kind) & (F.col("term") == term), F.col("estimate")))
    figures = (
        solution.groupBy(*keys)
        .agg(
            (pick(TOTALS, "2") if collapse else pick("fit", "n")).alias("n"),
            pick(TOTALS, "0").alias("deviance"),
            pick(TOTALS, "1").alias("log_lik"),
            (pick("fit", "absorbed") + pick("fit", "n_terms")).alias("parameters"),
        )
        .withColumn("aic", F.lit(-2.0) * F.col("log_lik") + F.lit(2.0) * F.col("parameters"))
    )
    return tidy, figures


def _settled_glm(
    d: Design, separated: bool, family: str, tolerance: float, max_steps: int, max_levels: int, rest_levels: int,
    collapse: bool = False,
) -> DataFrame:
    """The solution rows of the last step."""
    if collapse:
        d = collapsed_rows(d.whole())
    # Kept before anything filters on it; rows that are only scanned are scanned again, which takes neither memory nor disk.
    held = d.rows if scanned(d.rows) else d.rows.persist()
    d = Design(held, d.keys, d.terms, d.factors, d.layout, d.parts)
    if separated:
        d = drop_separated(d, family)
    *counts, mean = d.rows.agg(*(F.approx_count_distinct(f"f{i}") for i in range(len(d.factors))), F.avg("y")).first()
    shape = shape_of(d, max_levels, rest_levels, counts=[int(n) for n in counts])
    keys, k = list(d.keys), len(d.terms)
    in_blocks = not shape.iterate
    if not in_blocks:
        held = held.persist()
        d = d.whole()

    # Halfway between each value and the overall mean, away from the borders.
    middle = 0.5 if family == "binomial" or mean is None else max(mean, 1e-6)
    centre = F.lit(middle)
    first = (F.col("y") + centre) / F.lit(2.0)
    rows = d.rows.withColumn("eta", F.log(first) if family == "poisson" else F.log(first / (F.lit(1.0) - first)))
    sums = {"dev": F.col("dev"), "ll": F.col("ll"), **({"rows": F.col("count")} if collapse else {})}
    previous: dict[tuple, float] = {}
    # Blocks are passed over whole in each step, so memory would hold the few that are met last.
    blocks = _blocks(d, shape, collapse).persist(StorageLevel.DISK_ONLY) if in_blocks else None
    older, solution, small = None, None, None
    steps = halvings = 0
    try:
        while True:
            if steps == max_steps or halvings > MAX_HALVINGS:
                raise RuntimeError(f"the {family} model did not settle in {steps} steps")
            # A step's solution (terms and levels per key) is needed by every
            # later step, so it is written out once.
            if in_blocks:
                plan = plan_of(d, tuple(sums), "z", "v", shape)
                found = block_states(blocks, solution, plan, d.terms, LEAD + CELL_LEAD * collapse, _working_block(family, collapse, middle), bool(small))
                following = cut_lineage(solve(d, found, shape))
            else:
                working = _working_cells(rows) if collapse else _working(family, rows)
                step = Design(working, d.keys, d.terms, d.factors)
                following = cut_lineage(solution_of(step, shape, sums, z="z", w="v"))
            deviance = {
                tuple(r[c] for c in keys): r["estimate"]
                for r in following.filter((F.col("kind") == TOTALS) & (F.col("term") == "0")).collect()
            }
            worse = [g for g in deviance if older is not None and not deviance[g] <= previous[g] * (1 + 1e-6) + 1e-6]
            if worse:
                # The last step went too far for these models: go back half way.
                solution = cut_lineage(_halfway(solution, older, keys, worse))
                rows = rows if in_blocks else _predictor(d, solution, keys, k, small)
                halvings += 1
                continue
            steps, halvings = steps + 1, 0
            settled = solution is not None and all(
                abs(deviance[g] - previous[g]) <= tolerance * (abs(deviance[g]) + 0.1) for g in deviance
            )
            older, solution, previous = solution, following, deviance
            if settled:
                break
            if small is None:
                # The tables keep their size from step to step.
                small = is_small(solution.filter(F.col("kind") == LEVEL), SENT_LEVELS if in_blocks else SMALL_ROWS)
            if in_blocks:
                held.unpersist()
                continue
            rows = _predictor(d, solution, keys, k, small)
    finally:
        held.unpersist()
        if blocks is not None:
            blocks.unpersist()
    return solution


def _halfway(solution: DataFrame, older: DataFrame, keys: list[str], worse: list[tuple]) -> DataFrame:
    """Mean of two solutions for the listed models, the newer one for the rest."""
    on = [*keys, "kind", "term", "at"]
    listed = F.lit(not keys)
    for group in worse if keys else []:
        same = F.lit(True)
        for key, value in zip(keys, group, strict=True):
            same = same & (F.col(key) == F.lit(value))
        listed = listed | same
    before = older.select(*keys, "kind", "term", F.coalesce("level", F.lit("")).alias("at"), F.col("estimate").alias("old"))
    joined = solution.withColumn("at", F.coalesce("level", F.lit(""))).join(before, on, "left")
    blend = F.when(
        listed & F.col("kind").isin(COEF, LEVEL), (F.col("estimate") + F.coalesce("old", "estimate")) / F.lit(2.0)
    ).otherwise(F.col("estimate"))
    return joined.withColumn("estimate", blend).select(*solution.columns)


def _predictor(d: Design, solution: DataFrame, keys: list[str], k: int, small: bool) -> DataFrame:
    """Rows with the linear predictor of a solution."""
    slot = F.array_position(F.array(*(F.lit(t) for t in d.terms)), F.col("term"))
    found = solution.filter(F.col("kind") == COEF).select(*keys, "estimate", slot.alias("slot"))
    betas = found.groupBy(*keys).agg(
        *(F.expr(f"coalesce(max(CASE WHEN slot = {i + 1} THEN estimate END), 0D)").alias(f"b{i}") for i in range(k))
    )
    if keys:
        rows = lookup_join(d.rows, betas, keys, "left", small=small)
    else:
        one = betas.select(F.struct(*betas.columns).alias("b")).scalar()
        rows = d.rows.withColumn("__b", one).select("*", "__b.*")
    for i in range(len(d.factors)):
        effects = solution.filter(f"kind = '{LEVEL}' AND term = '{i}'").selectExpr(
            *(f"`{c}`" for c in keys), f"level AS f{i}", f"estimate AS a{i}"
        )
        rows = lookup_join(rows, effects, [*keys, f"f{i}"], "inner", small=small)
    parts = [f"coalesce(b{i}, 0D) * x{i}" for i in range(k)] + [f"a{i}" for i in range(len(d.factors))]
    return rows.select(*d.rows.columns, F.expr(" + ".join(parts)).alias("eta"))
