"""Estimators against dense numpy on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moodgrid.plans.estimation import clustered, demeaned, design, fe_ols, figures, normal_sums, solve, tidy
from moodgrid.plans.glm import fe_glm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 1500
    pdf = pd.DataFrame(
        {
            "a": rng.normal(size=n), "b": rng.normal(size=n), "f": rng.integers(0, 9, n).astype(str),
            "g": rng.integers(0, 5, n).astype(str), "w": rng.integers(1, 4, n).astype(float),
        }
    )
    eta = 0.4 * pdf.a - 0.2 * pdf.b + pdf.f.astype(int) / 10 - pdf.g.astype(int) / 8
    pdf["y"] = eta + rng.normal(size=n)
    pdf["c"] = rng.poisson(np.exp(eta)).astype(float)
    pdf["z"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    return pdf, spark.createDataFrame(pdf)


def dense(pdf):
    dummies = [pd.get_dummies(pdf[c], dtype=float).to_numpy()[:, i:] for i, c in enumerate(["f", "g"])]
    return np.column_stack([pdf[["a", "b"]].to_numpy(), *dummies])


def terms():
    return {"a": F.col("a"), "b": F.col("b")}


def test_weighted_least_squares(data):
    pdf, df = data
    x, w = dense(pdf), np.sqrt(pdf.w.to_numpy())
    want = np.linalg.lstsq(x * w[:, None], pdf.y.to_numpy() * w, rcond=None)[0]
    got = {r.term: r.estimate for r in tidy(fe_ols(df, "y", terms(), ["f", "g"], "w")).collect()}
    assert abs(got["a"] - want[0]) < 1e-10 and abs(got["b"] - want[1]) < 1e-10


def test_demeaning_agrees(data):
    _, df = data
    d = demeaned(design(df, "y", terms(), ["f", "g"]))
    one = {r.term: r.estimate for r in tidy(solve(d, normal_sums(d))).collect()}
    two = {r.term: r.estimate for r in tidy(fe_ols(df, "y", terms(), ["f", "g"])).collect()}
    assert all(abs(one[t] - two[t]) < 1e-7 for t in two)


@pytest.mark.parametrize("keys", [(), ("h",)])
def test_both_paths_give_the_same_model(data, keys):
    _, df = data
    df = df.withColumn("h", F.pmod(F.hash("a"), F.lit(2))).withColumn("fg", F.concat("f", F.lit("-"), "g"))
    for factors in (["f"], ["f", "g"], ["f", "g", "fg"]):
        one, two = (fe_ols(df, "y", terms(), factors, "w", keys, max_levels=n).persist() for n in (1, 6000))
        for table in (tidy, figures):
            a, b = (table(s, keys).toPandas().sort_values([*keys, *(["term"] if table is tidy else [])]) for s in (one, two))
            assert list(a.columns) == list(b.columns)
            numbers = [c for c in a.columns if c not in ("term", *keys)]
            assert np.allclose(a[numbers].to_numpy(float), b[numbers].to_numpy(float), rtol=1e-6, atol=1e-7)
        sums = []
        for s in (one, two):
            level = s.filter("kind = 'level'") if s.filter("kind = 'level'").count() else s.filter("level IS NOT NULL")
            named = {(*(r[k] for k in keys), r.term, r.level): r.estimate for r in level.collect()}
            at = [c for c in [*keys, *factors]]
            sums.append([sum(named[(*r[: len(keys)], str(i), v)] for i, v in enumerate(r[len(keys) :])) for r in sorted(map(tuple, df.select(*at).distinct().collect()))])
        assert np.allclose(*sums, atol=1e-6)


def test_clustered_errors_beyond_the_dense_size(data):
    _, df = data
    one, two = (
        {r.term: r.std_error for r in clustered(df, "y", terms(), ["f", "g"], "f", max_levels=n).collect()} for n in (1, 6000)
    )
    assert all(abs(one[t] - two[t]) < 1e-7 for t in two)


def test_glm_that_does_not_settle_says_so(data):
    _, df = data
    with pytest.raises(RuntimeError):
        fe_glm(df, "c", terms(), ["f"], max_steps=2)


def test_collinear_term_is_left_out(data):
    _, df = data
    three = {**terms(), "twice": F.col("a") * 2}
    assert {r.term for r in tidy(fe_ols(df, "y", three, ["f"])).collect()} == {"a", "b"}


def test_clustered_errors(data):
    pdf, df = data
    x, y = dense(pdf), pdf.y.to_numpy()
    bread = np.linalg.inv(x.T @ x)
    e = y - x @ (bread @ x.T @ y)
    scores = np.vstack([(x * e[:, None])[pdf.f == level].sum(axis=0) for level in sorted(set(pdf.f))])
    n, k, g = len(y), x.shape[1], len(scores)
    cov = bread @ scores.T @ scores @ bread * g / (g - 1) * (n - 1) / (n - k)
    got = {r.term: r.std_error for r in clustered(df, "y", terms(), ["f", "g"], "f").collect()}
    assert abs(got["a"] - cov[0, 0] ** 0.5) < 1e-8 and abs(got["b"] - cov[1, 1] ** 0.5) < 1e-8


@pytest.mark.parametrize(("family", "outcome"), [("poisson", "c"), ("binomial", "z")])
def test_glm(data, family, outcome):
    pdf, df = data
    x, y = dense(pdf), pdf[outcome].to_numpy()
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        mu = np.exp(x @ beta) if family == "poisson" else 1 / (1 + np.exp(-x @ beta))
        v = mu if family == "poisson" else mu * (1 - mu)
        beta = beta + np.linalg.solve(x.T @ (x * v[:, None]), x.T @ (y - mu))
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * v[:, None]))))
    coefs, _ = fe_glm(df, outcome, terms(), ["f", "g"], family)
    got = {r.term: (r.estimate, r.std_error) for r in coefs.collect()}
    for i, t in enumerate("ab"):
        assert abs(got[t][0] - beta[i]) < 1e-6 and abs(got[t][1] - errors[i]) < 1e-5


def test_nested_factors(data):
    _, df = data
    nested = df.withColumn("fg", F.concat("f", F.lit("-"), "g"))
    one, _ = fe_glm(nested, "c", terms(), ["f", "g", "fg"])
    two, _ = fe_glm(nested, "c", terms(), ["fg"])
    a, b = ({r.term: r.estimate for r in c.collect()} for c in (one, two))
    assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-7 for t in b)
