"""The named model forms, as basis columns over the panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.functions.basis import Terms, crossed, cyclic_tents, dummies, piecewise, product
from moodgrid.functions.clock import tod_continuous
from moodgrid.operators.aggregates import quantile_bins
from moodgrid.functions.recode import majority_class
from moodgrid.operators.sampling import with_replicates
from moodgrid.plans.estimation import bootstrap_ols, fe_ols, figures, nested_fits, tidy
from moodgrid.plans.glm import fe_glm

# The absorbed factors, race classes and income thirds.
ABSORBED = ("dow", "doy", "tod", "fips", "year", "statemonth")
ABSORBED_BY_GROUP = ("dow", "doy", "tod", "fips", "year", "month")
RACES = ("race_white", "race_black", "race_other", "race_hisp")
THIRDS = ("low", "mid", "high")
# What the named forms read of the panel, besides the outcome.
PANEL = ("weather_term", "wbgt", "prcp", "srad", "income_percap", *RACES, *ABSORBED)


@dataclass(frozen=True)
class Spec:
    """Numeric terms by name, absorbed factors, outcome family."""

    name: str
    terms: dict[str, Column]
    absorb: tuple[str, ...] = ABSORBED
    family: str = "gaussian"


def analysis_rows(panel: DataFrame) -> DataFrame:
    """Panel rows without weather words, with the derived model columns."""
    kept = panel.filter(F.col("weather_term") == 0)
    return kept.withColumns(
        {
            "raining": (F.col("prcp") > 0).cast("double"),
            "income": F.log("income_percap"),
            "month": F.substring("statemonth", 4, 2),
            "state": F.substring("fips", 1, 2),
        }
    )


def _one(name: str) -> dict[str, Column]:
    return {name: F.col(name).cast("double")}


def _factor_form(name: str, part: dict[str, Column]) -> dict[str, Column]:
    base, weather = piecewise("wbgt"), {**_one("raining"), **_one("srad")}
    return Terms(part, base, product(part, base), weather, product(part, weather))


def spec(name: str, race: str = "race_white", classes: Sequence[str] = RACES) -> Spec:
    """A form by its name; ``race`` is the share used by the continuous ones."""
    base, weather = piecewise("wbgt"), {**_one("raining"), **_one("srad")}
    if name == "plain":
        return Spec(name, {**base, **weather})
    if name in ("income", "race"):
        share = "income" if name == "income" else race
        part = _one(share)
        rest = Terms(crossed(part, _one("raining")), crossed(part, _one("srad")))
        return Spec(name, Terms(base, piecewise("wbgt", by=share), rest))
    if name == "income_race":
        rest = Terms(crossed(_one(race), _one("income"), _one("raining")), crossed(_one(race), _one("income"), _one("srad")))
        both = Terms(piecewise("wbgt", by="income"), piecewise("wbgt", by=race))
        return Spec(name, Terms(base, both, rest))
    if name == "income_q":
        return Spec(name, _factor_form(name, dummies("income_third", THIRDS, THIRDS[0])))
    if name == "race_q":
        return Spec(name, _factor_form(name, dummies("race_majority", classes, classes[0])))
    if name == "income_race_q":
        pairs = [f"{t}/{c}" for t in THIRDS for c in classes]
        return Spec(name, _factor_form(name, dummies("income_race_class", pairs, pairs[0])))
    if name == "time_of_day":
        tents = cyclic_tents(tod_continuous(F.col("tod")))
        return Spec(name, {**product(_one("wbgt"), tents), **weather})
    raise ValueError(f"no form called {name}")


def linear_spec(by: str | None = None, x: str = "wbgt") -> Spec:
    """x + raining + srad, each also times ``by``; used per region."""
    weather = {**_one(x), **_one("raining"), **_one("srad")}
    terms = weather if by is None else Terms(weather, _one(by), product(weather, _one(by)))
    return Spec(f"linear_{by or 'plain'}", terms, ABSORBED_BY_GROUP)


def with_classes(rows: DataFrame, wanted: str) -> DataFrame:
    """Add the class columns the factor forms refer to."""
    if wanted in ("income_q", "income_race_q"):
        rows = quantile_bins(rows, "income_percap", THIRDS, "income_third")
    if wanted in ("race_q", "income_race_q") and "race_majority" not in rows.columns:
        rows = rows.withColumn("race_majority", majority_class(RACES))
    if wanted == "income_race_q":
        rows = rows.withColumn("income_race_class", F.concat_ws("/", "income_third", "race_majority"))
    if wanted == "time_of_day":
        rows = rows.filter(F.col("wbgt") > 5)
    return rows


def fit(rows: DataFrame, outcome: str, form: Spec, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Coefficient table of a form, one model per key."""
    if form.family == "gaussian":
        return tidy(fe_ols(rows, outcome, form.terms, form.absorb, weight, keys), keys)
    return fe_glm(rows, outcome, form.terms, form.absorb, form.family, weight, keys)[0]


def bootstrap_fit(
    rows: DataFrame, outcome: str, form: Spec, ids: Sequence[str], replicates: int = 80, seed: int = 1, first: int = 1
) -> DataFrame:
    """replicate, term, estimate. ``first`` restarts an interrupted series.

    Gaussian replicates are columns of one weight matrix in a single pass over the
    rows. For other families the replicate number is a key of the model.
    """
    if form.family == "gaussian":
        return bootstrap_ols(rows, outcome, form.terms, form.absorb, ids, replicates, seed, first)
    drawn = with_replicates(rows, ids, replicates, seed, first)
    if form.family == "poisson":
        coefs, _ = fe_glm(drawn, outcome, form.terms, form.absorb, "poisson", "weight", ["replicate"], collapse=True)
        return coefs.select("replicate", "term", "estimate")
    return fit(drawn, outcome, form, ["replicate"], "weight").select("replicate", "term", "estimate")


def compare(rows: DataFrame, outcome: str, forms: Sequence[Spec]) -> DataFrame:
    """AIC of several Gaussian forms on the same rows."""
    out = None
    if len({form.absorb for form in forms}) == 1:
        fits = nested_fits(rows, outcome, [form.terms for form in forms], forms[0].absorb)
    else:
        fits = [fe_ols(rows, outcome, form.terms, form.absorb) for form in forms]
    for form, found in zip(forms, fits, strict=True):
        one = figures(found).select(
            F.lit(form.name).alias("form"), "n", "n_terms", "absorbed", "rss", "aic"
        )
        out = one if out is None else out.unionByName(one)
    return out


def model_grid(
    df: DataFrame,
    outcomes: Sequence[str],
    predictors: Sequence[str],
    controls: dict[str, Column],
    absorb: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """A Poisson model for every outcome-predictor pair.

    The pairs become a key of the rows, so all models advance together through
    the same aggregations instead of one after another.
    """
    pairs = F.array(
        *(
            F.struct(
                F.lit(o).alias("outcome"),
                F.lit(p).alias("predictor"),
                F.col(o).cast("double").alias("y"),
                F.col(p).cast("double").alias("x"),
            )
            for o in outcomes
            for p in predictors
        )
    )
    rows = df.withColumn("__m", F.explode(pairs)).select("*", "__m.*").drop("__m")
    keys = ["outcome", "predictor"]
    coefs, fits = fe_glm(rows, "y", {"predictor": F.col("x"), **controls}, absorb, "poisson", weight, keys)
    return coefs.filter(F.col("term") == "predictor").drop("term").join(fits, keys, "inner")
