"""Designs whose products and class columns are formed where the rows are folded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodgrid.functions.basis import Terms, crossed, dummies, piecewise, product
from moodgrid.plans import estimation, specs
from moodgrid.plans.estimation import bootstrap_ols, design, fe_ols, tidy
from moodgrid.plans.glm import fe_glm


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3_000
    pick = lambda names: [names[i] for i in rng.integers(0, len(names), n)]
    rows = zip(
        (f"r{i}" for i in range(n)), rng.normal(8, 12, n).tolist(), rng.uniform(0, 1, n).tolist(), rng.uniform(9, 11, n).tolist(),
        rng.integers(0, 2, n).astype(float).tolist(), rng.uniform(0, 9, n).tolist(), rng.normal(size=n).tolist(),
        pick(["a", "b", "c", None]), pick(["p", "q", "r", "s"]), pick([f"t{i}" for i in range(40)]), rng.integers(0, 2, n).tolist(),
        strict=True,
    )
    schema = "id string, wbgt double, race double, income double, raining double, srad double, y double, class string, f string, g string, flag int"
    made = spark.createDataFrame(list(rows), schema)
    return made.withColumn("srad", F.when(F.col("id") != "r7", F.col("srad"))).cache()


def factor_form() -> Terms:
    return specs._factor_form("q", dummies("class", ("a", "b", "c"), "a"))


def share_form() -> Terms:
    one = lambda name: {name: F.col(name).cast("double")}
    return Terms(piecewise("wbgt"), piecewise("wbgt", by="income"), crossed(one("race"), one("income"), one("raining")))


def rows_of(found, *more):
    return {tuple(r[c] for c in (*more, "term")): r["estimate"] for r in found.collect()}


@pytest.mark.parametrize("form", [factor_form, share_form])
def test_products_are_formed_in_the_fold(frame, form):
    terms = form()
    d = design(frame, "y", terms, ["f", "g"], compact=True)
    assert len(d.rows.columns) < len(terms) and d.terms == tuple(terms)
    assert d.rows.count() == design(frame, "y", dict(terms), ["f", "g"]).rows.count()
    assert d.whole().rows.columns.__len__() == len(terms) + 4
    one, two = (rows_of(tidy(fe_ols(frame, "y", t, ["f", "g"]))) for t in (terms, dict(terms)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-8 * (1 + abs(two[k])) for k in two)


def test_logit_of_a_factor_form(frame):
    one, two = (rows_of(fe_glm(frame, "flag", t, ["f", "g"], "binomial")[0]) for t in (factor_form(), dict(factor_form())))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 * (1 + abs(two[k])) for k in two)


def test_rows_of_replicates_are_dealt_before_the_terms(frame, monkeypatch):
    plans, states = [], estimation.states

    def seen(rows, plan):
        plans.append(rows._jdf.queryExecution().optimizedPlan())
        return states(rows, plan)

    monkeypatch.setattr(estimation, "states", seen)
    one, two = (rows_of(bootstrap_ols(frame, "y", t, ["f", "g"], ["id"], 5), "replicate") for t in (share_form(), dict(share_form())))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-7 * (1 + abs(two[k])) for k in two)
    node = plans[0]
    while node.nodeName() != "RebalancePartitions":
        node = node.children().head()
    # id's two seeds, outcome, two factors and the four columns that the terms are made of.
    assert node.output().size() == 9


def test_rows_without_a_bound_are_incomplete_where_a_product_is(frame):
    """Zero times infinity is no number: such rows were always left out."""
    odd = frame.filter("class IS NOT NULL").withColumn("srad", F.when(F.col("id") == "r9", F.lit(float("inf"))).otherwise(F.col("srad")))
    terms = Terms(dummies("class", ("a", "b", "c"), "a"), {"srad": F.col("srad")})
    terms = Terms(terms, product(dummies("class", ("a", "b", "c"), "a"), {"srad": F.col("srad")}))
    one, two = (rows_of(tidy(fe_ols(odd, "y", t, ["f"]))) for t in (terms, dict(terms)))
    assert all(abs(one[k] - two[k]) < 1e-8 * (1 + abs(two[k])) for k in two)


def test_rows_of_a_table_are_not_held(spark, frame, tmp_path, monkeypatch):
    """Of a written table only the packed blocks are kept, on disk; what is costly to derive is held."""
    from moodgrid.plans.glm import scanned

    kept, kind = [], type(frame)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *level: kept.append(level) or persist(self, *level))
    frame.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert scanned(table.filter("y > 0").select("f")) and not scanned(table.groupBy("f").count())
    fe_glm(table, "flag", factor_form(), ["f", "g"], "binomial")[0].collect()
    assert len(kept) == 1 and not kept[0][0].useMemory
