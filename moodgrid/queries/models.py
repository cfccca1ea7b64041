"""Estimation queries (inventory E1 to E13 and the named forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.functions import basis
from moodgrid.operators.aggregates import quantile_cuts
from moodgrid.plans import curves, specs
from moodgrid.plans.estimation import clustered, demeaned, design, fe_ols, nested_fits, normal_sums, solve, tidy
from moodgrid.plans.glm import fe_glm
from moodgrid.plans.penalised import elastic_net_predict
from moodgrid.queries.registry import drawn_sql, query, r, rounded


# Replicates of the published bands.
REPLICATES = 80


def col(name):
    return {name: F.col(name)}


WITHIN = """d AS (SELECT fips, vader - avg(vader) OVER (PARTITION BY fips) AS y, wbgt - avg(wbgt) OVER (PARTITION BY fips) AS a,
                   srad - avg(srad) OVER (PARTITION BY fips) AS b FROM panel),
   s AS (SELECT count(*) AS n, count(DISTINCT fips) AS g, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab,
                sum(a * y) AS ay, sum(b * y) AS byy, sum(y * y) AS yy FROM d),
   e AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS ba, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS bs FROM s),
   f AS (SELECT *, (yy - ba * ay - bs * byy) / (n - g - 2) AS s2 FROM e)"""


@query(
    "E1_fe_ols_one_factor",
    f"""WITH {WITHIN} SELECT 'wbgt' AS term, {r('ba', 9)} AS estimate, {r('sqrt(s2 * bb / (aa * bb - ab * ab))', 9)} AS std_error FROM f
        UNION ALL SELECT 'srad', {r('bs', 9)}, {r('sqrt(s2 * aa / (aa * bb - ab * ab))', 9)} FROM f""",
    ("panel",),
)
def _(t):
    fit = fe_ols(t.stored(t.panel), "vader", {**col("wbgt"), **col("srad")}, ["fips"])
    return rounded(tidy(fit).select("term", "estimate", "std_error"), 9)


@query(
    "E1_fe_ols_weighted",
    f"""WITH w AS (SELECT fips, 1 + weather_term AS w, vader AS y, wbgt AS a FROM panel),
        d AS (SELECT w, y - sum(w * y) OVER (PARTITION BY fips) / sum(w) OVER (PARTITION BY fips) AS y,
                     a - sum(w * a) OVER (PARTITION BY fips) / sum(w) OVER (PARTITION BY fips) AS a FROM w)
        SELECT 'wbgt' AS term, {r('sum(w * a * y) / sum(w * a * a)', 9)} AS estimate FROM d""",
    ("panel",),
)
def _(t):
    fit = fe_ols(t.stored(t.panel), "vader", col("wbgt"), ["fips"], weight=F.col("weather_term") + 1)
    return rounded(tidy(fit).select("term", "estimate"), 9)


@query("E1_fe_ols_six_factors")
def _(t):
    form = specs.spec("plain")
    rows = specs.analysis_rows(t.stored(t.panel))
    return rounded(tidy(fe_ols(rows, "vader", form.terms, form.absorb)), 9)


@query("E1_fe_ols_demeaned")
def _(t):
    d = demeaned(design(t.stored(t.panel), "vader", {**col("wbgt"), **col("srad")}, ["fips", "dow", "tod"]))
    return rounded(tidy(solve(d, normal_sums(d))).select("term", "estimate"), 8)


@query("E1_fe_ols_clustered")
def _(t):
    return rounded(clustered(t.stored(t.panel), "vader", {**col("wbgt"), **col("srad")}, ["fips", "dow"], "fips"), 9)


@query("E2_fe_glm_poisson")
def _(t):
    counts = t.panel.groupBy("state", "dow", "year", F.substring("statemonth", 4, 2).alias("month")).agg(
        F.sum("depress_term").alias("events"), F.avg("wbgt").alias("wbgt"), F.count("*").alias("n")
    )
    coefs, _ = fe_glm(counts, "events", {"wbgt": F.col("wbgt"), "log_n": F.log("n")}, ["state", "dow", "year", "month"])
    return rounded(coefs, 7)


@query("E2_fe_glm_logit")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel))
    form = specs.spec("plain")
    coefs, _ = fe_glm(rows, "depress_term", form.terms, form.absorb, "binomial")
    return rounded(coefs, 6)


@query("E3_bootstrap_fit")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel))
    return rounded(specs.bootstrap_fit(rows, "vader", specs.spec("plain"), ["id"], REPLICATES), 9)


@query(
    "E3_bootstrap_one_factor",
    f"""WITH {drawn_sql("panel", "id", 1, 1, 8)},
        d AS (SELECT r, k, vader - sum(k * vader) OVER g / sum(k) OVER g AS y, wbgt - sum(k * wbgt) OVER g / sum(k) OVER g AS a
              FROM draw WHERE k > 0 WINDOW g AS (PARTITION BY r, fips))
        SELECT r::INT AS replicate, 'wbgt' AS term, {r('sum(k * a * y) / sum(k * a * a)', 9)} AS estimate FROM d GROUP BY r""",
    ("panel",),
)
def _(t):
    form = specs.Spec("one", col("wbgt"), ("fips",))
    return rounded(specs.bootstrap_fit(t.stored(t.panel), "vader", form, ["id"], 8), 9)


@query("E3_bootstrap_poisson")
def _(t):
    from moodgrid.operators.sampling import with_replicates

    # Equal rows meet before they are drawn, so the drawn rows fold where they arise.
    rows = t.panel.select("id", "depress_term", "wbgt", "state", "year").hint("rebalance", "wbgt", "state", "year")
    drawn = with_replicates(rows, ["id"], 20)
    coefs, _ = fe_glm(drawn, "depress_term", col("wbgt"), ["state", "year"], "poisson", "weight", ["replicate"], collapse=True)
    return rounded(coefs.select("replicate", "term", "estimate"), 7)


@query(
    "E4_fit_by_group",
    f"""WITH d AS (SELECT state, vader - avg(vader) OVER (PARTITION BY state, dow) AS y, wbgt - avg(wbgt) OVER (PARTITION BY state, dow) AS a, dow FROM panel),
        s AS (SELECT state, count(*) AS n, count(DISTINCT dow) AS g, sum(a * y) / sum(a * a) AS b, sum(a * a) AS aa, sum(y * y) AS yy, sum(a * y) AS ay
              FROM d GROUP BY state)
        SELECT state, 'wbgt' AS term, {r('b', 9)} AS estimate, {r('sqrt((yy - b * ay) / (n - g - 1) / aa)', 9)} AS std_error FROM s""",
    ("panel",),
)
def _(t):
    fit = tidy(fe_ols(t.stored(t.panel), "vader", col("wbgt"), ["dow"], keys=["state"]), ["state"])
    return rounded(fit.select("state", "term", "estimate", "std_error"), 9)


@query(
    "E5_interactions",
    f"""SELECT id, race_white, {r('ln(income_percap)')} AS income, cast(prcp > 0 AS double) AS raining,
               {r('race_white * ln(income_percap)')} AS race_white_income, {r('race_white * cast(prcp > 0 AS double)')} AS race_white_raining,
               {r('ln(income_percap) * cast(prcp > 0 AS double)')} AS income_raining,
               {r('race_white * ln(income_percap) * cast(prcp > 0 AS double)')} AS race_white_income_raining,
               cast(dow = 'Friday' AS double) AS dow_friday FROM panel""",
    ("panel",),
)
def _(t):
    rows = t.panel.withColumns({"income": F.log("income_percap"), "raining": (F.col("prcp") > 0).cast("double")})
    terms = basis.crossed(col("race_white"), col("income"), col("raining"))
    terms |= {"dow_friday": basis.dummies("dow", ["Monday", "Friday"], "Monday")["dow=Friday"]}
    return rounded(rows.select("id", *(c.alias(n.replace(":", "_")) for n, c in terms.items())))


def aic_sql(x: str) -> str:
    return f"""(SELECT n, n * (ln(2 * pi()) + ln((yy - xy * xy / xx) / n) + 1) + 2 * (g + 1) AS aic FROM (
        SELECT count(*) AS n, count(DISTINCT fips) AS g, sum(y * y) AS yy, sum(x * y) AS xy, sum(x * x) AS xx FROM (
          SELECT fips, vader - avg(vader) OVER (PARTITION BY fips) AS y, {x} - avg({x}) OVER (PARTITION BY fips) AS x FROM panel) d) s)"""


@query(
    "E6_aic",
    f"""SELECT 'wbgt' AS form, n, {r('aic', 4)} AS aic FROM {aic_sql('wbgt')} a
        UNION ALL SELECT 'srad', n, {r('aic', 4)} FROM {aic_sql('srad')} b""",
    ("panel",),
)
def _(t):
    forms = [specs.Spec(x, col(x), ("fips",)) for x in ("wbgt", "srad")]
    fits = specs.compare(t.stored(t.panel), "vader", forms).select("form", F.col("n").cast("long").alias("n"), "aic")
    return rounded(fits, 4)


@query("E6_compare_income_race")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel))
    forms = [specs.spec(n, "race_black") for n in ("plain", "income", "race", "income_race")]
    return rounded(specs.compare(rows, "vader", forms).select("form", "n_terms", "aic"), 4)


GRID = "SELECT DISTINCT cast(floor(wbgt) AS int) AS wbgt FROM panel"
CURVE_SQL = f"""p AS (SELECT replicate, g.wbgt, q.income, sum(estimate * CASE term WHEN 'wbgt' THEN g.wbgt
      WHEN 'wbgt_10' THEN greatest(g.wbgt - 10, 0) ELSE q.income * g.wbgt END) AS value
    FROM coefs, ({GRID}) g, (VALUES (9), (10), (11)) q(income) GROUP BY 1, 2, 3)"""


def curve(t):
    grid = t.panel.select(F.floor("wbgt").cast("int").alias("wbgt")).distinct()
    grid = grid.withColumn("income", F.explode(F.array(F.lit(9), F.lit(10), F.lit(11))))
    terms = {
        "wbgt": F.col("wbgt"),
        "wbgt_10": F.greatest(F.col("wbgt") - 10, F.lit(0)),
        "income:wbgt": F.col("income") * F.col("wbgt"),
    }
    return curves.predict_curve(t.coefs, grid, terms, ["wbgt", "income"])


@query(
    "E7_predict_curve",
    f"WITH {CURVE_SQL} SELECT replicate, wbgt, income, {r('value')} AS value FROM p",
    ("panel", "coefs"),
)
def _(t):
    return rounded(curve(t))


@query(
    "E8_confidence_band",
    f"""WITH {CURVE_SQL}, z AS (SELECT *, value - max(CASE WHEN wbgt = 5 THEN value END) OVER (PARTITION BY replicate, income) AS v FROM p)
        SELECT wbgt, income, {r('quantile_cont(v, 25e-3)')} AS ymin, {r('quantile_cont(v, 5e-1)')} AS pred, {r('quantile_cont(v, 975e-3)')} AS ymax
        FROM z GROUP BY wbgt, income""",
    ("panel", "coefs"),
)
def _(t):
    return rounded(curves.shifted_band(curve(t), "wbgt", 5, ["income"]))


@query(
    "E9_prob_curve",
    f"""WITH {CURVE_SQL}, z AS (SELECT replicate, wbgt, 1 / (1 + exp(-value)) AS pr FROM p WHERE income = 10)
        SELECT replicate, wbgt, {r('pr - min(pr) OVER (PARTITION BY replicate)')} AS pred FROM z""",
    ("panel", "coefs"),
)
def _(t):
    ours = curve(t).filter("income = 10")
    return rounded(curves.probability_curve(ours, "wbgt", groups=["replicate"]).select("replicate", "wbgt", "pred"))


@query(
    "E9_prob_curve_at_15",
    f"""WITH {CURVE_SQL}, z AS (SELECT replicate, wbgt, 1 / (1 + exp(-value)) AS pr FROM p WHERE income = 10)
        SELECT replicate, wbgt, {r('pr - max(CASE WHEN wbgt = 15 THEN pr END) OVER (PARTITION BY replicate)')} AS pred FROM z""",
    ("panel", "coefs"),
)
def _(t):
    ours = curve(t).filter("income = 10")
    return rounded(curves.probability_curve(ours, "wbgt", 15, ["replicate"]).select("replicate", "wbgt", "pred"))


GAP_COEFS = """(SELECT state, regr_slope(vader, wbgt) AS b, regr_slope(vader, srad) / 10 AS c FROM panel GROUP BY state)"""


@query(
    "E10_slope_gap",
    f"""WITH q AS (SELECT quantile_cont(ln(income_percap), 5e-2) AS lo, quantile_cont(ln(income_percap), 95e-2) AS hi FROM panel)
        SELECT state, {r('25 * (b + c * lo)')} AS change_low, {r('25 * (b + c * hi)')} AS change_high, {r('25 * c * (hi - lo)')} AS gap
        FROM {GAP_COEFS} g, q""",
    ("panel",),
)
def _(t):
    by_state = t.panel.groupBy("state").agg(
        F.regr_slope("vader", "wbgt").alias("wbgt"), (F.regr_slope("vader", "srad") / 10).alias("wbgt:income")
    )
    coefs = by_state.unpivot(["state"], ["wbgt", "wbgt:income"], "term", "estimate")
    cuts = quantile_cuts(t.panel.select(F.log("income_percap").alias("income")), "income", [0.05, 0.95])
    return rounded(curves.slope_gap(coefs, "state", "income", F.element_at(cuts, 1), F.element_at(cuts, 2)))


@query(
    "E10_scaled_effect",
    f"""WITH q AS (SELECT 25 * (quantile_cont(race_black, 95e-2) - quantile_cont(race_black, 5e-2)) AS s FROM panel),
        e AS (SELECT state, regr_slope(vader, wbgt) AS b, stddev_samp(vader) / sqrt(count(*)) AS se FROM panel GROUP BY state)
        SELECT state, {r('b * s')} AS effect, {r('b * s - 1.959963984540054e0 * se * abs(s)')} AS low,
               {r('b * s + 1.959963984540054e0 * se * abs(s)')} AS high FROM e, q""",
    ("panel",),
)
def _(t):
    coefs = t.panel.groupBy("state").agg(
        F.lit("wbgt").alias("term"),
        F.regr_slope("vader", "wbgt").alias("estimate"),
        (F.stddev_samp("vader") / F.sqrt(F.count("*"))).alias("std_error"),
    )
    cuts = quantile_cuts(t.panel, "race_black", [0.05, 0.95])
    scale = F.lit(25.0) * (F.element_at(cuts, 2) - F.element_at(cuts, 1))
    return rounded(curves.scaled_effect(coefs, "state", "wbgt", scale))


@query(
    "E11_simple_line",
    f"""SELECT state, {r('regr_slope(vader, wbgt)')} AS slope, {r('regr_intercept(vader, wbgt)')} AS intercept, {r('corr(wbgt, vader)')} AS corr, count(*) AS n
        FROM panel GROUP BY state""",
    ("panel",),
)
def _(t):
    return rounded(curves.simple_line(t.panel, "wbgt", "vader", ["state"]))


@query("E11_ols_dummy")
def _(t):
    fit = fe_ols(t.stored(t.panel), "vader", {"wbgt": F.col("wbgt")}, ["year", "state"])
    return rounded(tidy(fit), 9)


@query("E12_elastic_net_predict")
def _(t):
    rows = t.panel.select("wbgt", "srad", "dow", "state", "vader")
    grid = t.panel.groupBy("dow", "state").agg(F.avg("wbgt").alias("wbgt"), F.avg("srad").alias("srad"))
    return rounded(elastic_net_predict(rows, grid, "vader", ["wbgt", "srad"], ["dow", "state"], 0.001), 4)


@query("E13_model_grid")
def _(t):
    month = F.substring("statemonth", 4, 2).alias("month")
    counts = t.panel.groupBy("state", "dow", "doy", "year", month).agg(
        F.sum("depress_term").alias("homicides"),
        F.sum("weather_term").alias("assault"),
        F.sum(F.col("depress_term") + F.col("weather_term")).alias("violent"),
        *(F.avg(c).alias(c) for c in ("vader", "afinn", "hedono")),
        F.count("*").alias("n"),
    )
    fits = specs.model_grid(
        t.stored(counts, "counts", shuffled=True), ["violent", "assault", "homicides"], ["vader", "afinn", "hedono"], {"log_n": F.log("n")},
        ["dow", "doy", "year", "month", "state"], "n",
    )
    return rounded(fits.select("outcome", "predictor", "estimate", "statistic", "aic"), 4)


def form_rows(t, name: str, *more: str):
    """The rows of a form, from a written panel of the columns that forms read and some ``more``."""
    return specs.with_classes(specs.analysis_rows(t.stored(t.panel.select(*specs.PANEL, *more))), name)


def form_query(name: str, outcome: str, race: str):
    """One fit of a named form with all six absorbed factors."""

    @query(f"form_{name}_{outcome}")
    def _(t):
        rows = form_rows(t, name, outcome)
        form = specs.spec(name, race)
        return rounded(specs.fit(rows, outcome, form).select("term", "estimate", "std_error"), 8)


WHITE, BLACK = "race_white", "race_black"
for _name, _outcome, _race in (
    ("plain", "hedono", WHITE),
    ("plain", "afinn", WHITE),
    ("income", "vader", WHITE),
    ("income", "hedono", WHITE),
    ("income", "afinn", WHITE),
    ("income_q", "vader", WHITE),
    ("income_q", "hedono", WHITE),
    ("race_q", "vader", WHITE),
    ("race_q", "hedono", WHITE),
    ("race_q", "afinn", WHITE),
    ("race", "vader", WHITE),
    ("race", "hedono", WHITE),
    ("income_race", "vader", BLACK),
    ("income_race", "hedono", WHITE),
    ("income_race_q", "vader", WHITE),
    ("income_race_q", "hedono", WHITE),
    ("time_of_day", "vader", WHITE),
):
    form_query(_name, _outcome, _race)


def depress_query(name: str):
    """Logit of the depressive flag with the terms of a form and all six factors."""

    @query(f"form_depress_{name}")
    def _(t):
        rows = form_rows(t, name, "depress_term")
        form = specs.spec(name)
        coefs, _ = fe_glm(rows, "depress_term", form.terms, form.absorb, "binomial")
        return rounded(coefs.select("term", "estimate"), 5)


for _name in ("plain", "income", "race_q"):
    depress_query(_name)


def linear_forms(rows, key, absorb, x="wbgt"):
    """The four linear forms for each value of a key."""
    out = None
    forms = [specs.linear_spec(by, x) for by in (None, "income", "race_white", "race_black")]
    for form, fit in zip(forms, nested_fits(rows, "vader", [form.terms for form in forms], absorb, [key]), strict=True):
        one = tidy(fit, [key]).withColumn("form", F.lit(form.name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("form", key, "term", "estimate", "std_error"), 8)


@query("form_linear_by_state")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel)).filter("wbgt > 5")
    return linear_forms(rows, "state", specs.ABSORBED_BY_GROUP)


@query("form_linear_temp_by_state")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel)).filter("temp > 5")
    return linear_forms(rows, "state", specs.ABSORBED_BY_GROUP, "temp")


@query("form_linear_by_region")
def _(t):
    # City regions: counties by the last digit of their number.
    rows = specs.analysis_rows(t.stored(t.panel)).filter("wbgt > 5").withColumn("region", F.substring("fips", 5, 1))
    return linear_forms(rows, "region", specs.ABSORBED_BY_GROUP)


@query("form_linear_by_hour")
def _(t):
    rows = specs.analysis_rows(t.stored(t.panel)).filter("wbgt > 5").withColumn("hour", F.split("tod", ":")[0].cast("int"))
    return linear_forms(rows, "hour", ("dow", "doy", "tod", "fips", "year", "statemonth"))


# The grid of the published curves: temperatures, and the 5, 50 and 95 percent points of the shares.
CURVE_WBGT = (-22, 33)
CURVE_POINTS = (0.05, 0.5, 0.95)


def curve_grid(rows, x, by, classes):
    """Values of ``x`` at each combination of the ``by`` columns; other weather columns are zero."""
    base = {"wbgt": F.lit(0.0), "raining": F.lit(0.0), "srad": F.lit(0.0)}
    values = {
        "wbgt": F.sequence(*(F.lit(v) for v in CURVE_WBGT)),
        "raining": F.array(F.lit(0), F.lit(1)),
        "srad": F.sequence(F.lit(0), F.lit(1000), F.lit(50)),
        "tod": F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.format_string("%02d:%d", F.floor(i / 6), i % 6)),
    }
    cuts = rows.agg(*(F.percentile(c, F.array(*(F.lit(p) for p in CURVE_POINTS))).alias(c) for c in by if c not in classes), F.count("*").alias("n"))
    grid = cuts.withColumns({c: F.explode(c) for c in by[:1] if c not in classes})
    for c in by[1:]:
        grid = grid.withColumn(c, F.explode(c))
    for c, listed in classes.items():
        grid = grid.withColumn(c, F.explode(F.array(*(F.lit(v) for v in listed))))
    return grid.withColumns(base).withColumn(x, F.explode(values[x])).drop("n")


def band_query(name, outcome, x="wbgt", at=5, race=WHITE):
    """Bootstrap band of a form's curve: difference to ``x = at``, 2.5, 50 and 97.5 percent of the replicates."""
    by = {"income": ["income"], "race": [race], "income_race": ["income", race]}.get(name, [])
    classes = {"income_q": {"income_third": specs.THIRDS}, "race_q": {"race_majority": specs.RACES}}.get(name, {})
    groups = [*by, *classes]

    @query(f"curve_{name}_{outcome}" + ("" if x == "wbgt" else f"_{x}"))
    def _(t):
        rows = form_rows(t, name, "id", outcome)
        form = specs.spec(name, race)
        coefs = specs.bootstrap_fit(rows, outcome, form, ["id"], REPLICATES)
        pred = curves.predict_curve(coefs, curve_grid(rows, x, by, classes), form.terms, [x, *groups])
        return rounded(curves.shifted_band(pred, x, at, groups), 7)


for _form, _outcome, _race in (
    ("plain", "vader", WHITE),
    ("plain", "hedono", WHITE),
    ("plain", "afinn", WHITE),
    ("income", "vader", WHITE),
    ("income", "hedono", WHITE),
    ("income", "afinn", WHITE),
    ("income_q", "vader", WHITE),
    ("income_q", "hedono", WHITE),
    ("race_q", "vader", WHITE),
    ("race_q", "hedono", WHITE),
    ("race_q", "afinn", WHITE),
    ("race", "vader", WHITE),
    ("race", "hedono", WHITE),
    ("income_race", "vader", BLACK),
    ("income_race", "hedono", WHITE),
):
    band_query(_form, _outcome, race=_race)
for _form in ("income", "race_q"):
    band_query(_form, "vader", "raining", 0)
    band_query(_form, "vader", "srad", 0)


@query("curve_time_of_day_vader")
def _(t):
    rows = form_rows(t, "time_of_day", "id", "vader")
    form = specs.spec("time_of_day")
    coefs = specs.bootstrap_fit(rows, "vader", form, ["id"], REPLICATES)
    grid = curve_grid(rows, "tod", [], {}).withColumn("wbgt", F.lit(1.0))
    return rounded(curves.confidence_band(curves.predict_curve(coefs, grid, form.terms, ["tod"]), ["tod"]), 7)
