"""Level effects of many factors: rank, errors and estimates against dense numpy, whichever way they are solved."""

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodgrid.operators.sampling import draws, poisson_edges, seeds, with_replicates
from moodgrid.plans import accumulate, blocks, estimation
from moodgrid.plans.accumulate import Plan, State, _folded, states
from moodgrid.plans.estimation import bootstrap_ols, demeaned, design, fe_ols, figures, normal_sums, solve, tidy
from moodgrid.plans.glm import collapsed_rows, fe_glm

SIX = ["dow", "doy", "tod", "fips", "year", "statemonth"]


@pytest.fixture(scope="module")
def six(spark):
    """Factors that share redundancies: months lie in doy and statemonth, states in fips and statemonth."""
    rng = np.random.default_rng(3)
    n = 3_000
    doy = rng.integers(0, 48, n)
    fips = rng.integers(0, 30, n)
    pdf = pd.DataFrame(
        {
            "id": np.arange(n).astype(str), "a": rng.normal(size=n), "b": rng.normal(size=n), "w": rng.integers(1, 4, n).astype(float),
            "dow": rng.integers(0, 7, n), "doy": doy, "tod": rng.integers(0, 12, n), "fips": fips, "year": rng.integers(0, 5, n),
            "statemonth": (fips // 5) * 100 + doy // 8, "h": rng.integers(0, 2, n).astype(str),
        }
    )
    for c in SIX:
        pdf[c] = pdf[c].astype(str)
    pdf["y"] = 0.5 * pdf.a - 0.3 * pdf.b + pdf.doy.astype(int) / 20 + pdf.fips.astype(int) / 9 + rng.normal(size=n)
    pdf["c"] = rng.poisson(np.exp(0.3 * pdf.a + pdf.tod.astype(int) / 10 - 0.5)).astype(float)
    return pdf, spark.createDataFrame(pdf)


def terms():
    return {"a": F.col("a"), "b": F.col("b")}


def dense(pdf, factors=SIX, weights=None):
    """Estimates, errors, rank, rss and AIC by plain least squares on all dummies."""
    d = np.column_stack([pd.get_dummies(pdf[c], dtype=float).to_numpy() for c in factors])
    w = np.ones(len(pdf)) if weights is None else weights
    s = np.sqrt(w)[:, None]
    rank = np.linalg.matrix_rank(d * s)
    q, _, _ = np.linalg.svd(d * s, full_matrices=False)
    q = q[:, :rank]
    out = lambda v: v - q @ (q.T @ v)
    x, y = out(pdf[["a", "b"]].to_numpy() * s), out(pdf.y.to_numpy() * s[:, 0])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    rss = ((y - x @ beta) ** 2).sum()
    df = len(pdf) - rank - 2
    n = len(pdf)
    aic = n * (np.log(2 * np.pi) + np.log(rss / n) + 1) + 2 * (rank + 2)
    return {"beta": beta, "error": np.sqrt(np.diag(bread) * rss / df), "absorbed": rank, "rss": rss, "df_resid": df, "aic": aic}


@pytest.mark.parametrize("way", [{}, {"max_levels": 1}, {"max_levels": 1, "rest_levels": 1}], ids=["one task", "buckets", "gradients"])
def test_six_factors(six, way):
    pdf, df = six
    want = dense(pdf, weights=pdf.w.to_numpy())
    solution = fe_ols(df, "y", terms(), SIX, "w", **way).persist()
    got = {r.term: r for r in tidy(solution).collect()}
    assert np.allclose([got[t].estimate for t in "ab"], want["beta"], atol=1e-8)
    assert np.allclose([got[t].std_error for t in "ab"], want["error"], rtol=1e-6)
    fit = figures(solution).first()
    for name in ("absorbed", "df_resid", "rss", "aic"):
        assert abs(fit[name] - want[name]) < 1e-5 * abs(want[name]), name
    effects = {(r.term, r.level): r.estimate for r in solution.filter("kind = 'level'").collect()}
    fitted = sum(pdf[c].map(lambda v, i=i: effects[str(i), v]) for i, c in enumerate(SIX)) + want["beta"][0] * pdf.a + want["beta"][1] * pdf.b
    assert abs((pdf.w * (pdf.y - fitted) ** 2).sum() - want["rss"]) < 1e-4


@pytest.mark.parametrize("way", [{}, {"max_levels": 1}, {"max_levels": 1, "rest_levels": 1}], ids=["one task", "buckets", "gradients"])
def test_models_by_key(six, way):
    pdf, df = six
    few = ["dow", "fips", "statemonth"]
    solution = fe_ols(df, "y", terms(), few, keys=["h"], **way).persist()
    fits = {r.h: r for r in figures(solution, ["h"]).collect()}
    got = {(r.h, r.term): r for r in tidy(solution, ["h"]).collect()}
    for h, part in pdf.groupby("h"):
        want = dense(part, few)
        assert np.allclose([got[h, t].estimate for t in "ab"], want["beta"], atol=1e-8)
        assert np.allclose([got[h, t].std_error for t in "ab"], want["error"], rtol=1e-6)
        assert fits[h]["absorbed"] == want["absorbed"]


def test_demeaned_rows(six):
    pdf, df = six
    want = dense(pdf)["beta"]
    for way in ({}, {"max_levels": 1, "rest_levels": 1}):
        d = demeaned(design(df, "y", terms(), ["dow", "fips", "doy"], keep=["id"]), **way)
        one = {r.term: r.estimate for r in tidy(solve(d, normal_sums(d))).collect()}
        assert np.allclose([one["a"], one["b"]], dense(pdf, ["dow", "fips", "doy"])["beta"], atol=1e-7)
    assert len(want) == 2


@pytest.mark.parametrize("way", [{"max_levels": 1}, {"max_levels": 1, "rest_levels": 1}], ids=["buckets", "gradients"])
def test_poisson_beyond_the_dense_size(six, way):
    pdf, df = six
    few = ["fips", "dow", "year"]
    x = np.column_stack([pdf[["a", "b"]].to_numpy(), *(pd.get_dummies(pdf[c], dtype=float).to_numpy()[:, i > 0 :] for i, c in enumerate(few))])
    y, beta = pdf.c.to_numpy(), np.zeros(x.shape[1])
    for _ in range(30):
        mu = np.exp(x @ beta)
        beta = beta + np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ (x * np.exp(x @ beta)[:, None]))))
    got = {r.term: r for r in fe_glm(df, "c", terms(), few, **way)[0].collect()}
    for i, t in enumerate("ab"):
        assert abs(got[t].estimate - beta[i]) < 1e-6 and abs(got[t].std_error - errors[i]) < 1e-5


def test_equal_poisson_rows_collapse(six):
    """The same model, figures and count of rows from one row for each different one."""
    pdf, df = six
    rows = df.select("c", "w", "h", "fips", "dow", F.round("a").alias("a"))
    d = design(rows, "c", {"a": F.col("a")}, ["fips", "dow"], "w", ["h"])
    assert collapsed_rows(d).rows.count() < len(pdf) * 0.9
    plain, full = (
        fe_glm(rows, "c", {"a": F.col("a")}, ["fips", "dow"], "poisson", "w", ["h"], collapse=c) for c in (False, True)
    )
    for one, two in zip(plain, full, strict=True):
        a, b = one.orderBy("h").toPandas(), two.orderBy("h").toPandas()
        assert len(a) == 2 and list(a.columns) == list(b.columns)
        numbers = a.select_dtypes("number").columns
        assert np.allclose(a[numbers], b[numbers], rtol=1e-7)


def test_replicates_in_one_pass(six):
    pdf, df = six
    got = {(r.replicate, r.term): r.estimate for r in bootstrap_ols(df, "y", terms(), SIX, ["id"], replicates=12, seed=4, first=3).collect()}
    one, two = (np.array([r[0] for r in df.select(s).collect()]) for s in seeds(["id"], 4))
    weights = draws((one, two), 3, 12)
    assert {b for b, _ in got} == set(range(3, 15))
    for b in range(12):
        there = weights[:, b] > 0
        want = dense(pdf[there], weights=weights[there, b])["beta"]
        assert np.allclose([got[b + 3, t] for t in "ab"], want, atol=1e-8)


@pytest.mark.parametrize("way", [{"max_levels": 1}, {"max_levels": 1, "rest_levels": 1}], ids=["buckets", "gradients"])
def test_replicates_beyond_the_dense_size(six, way, monkeypatch):
    """Many levels raised before; now they are dealt into buckets, or solved by gradients."""
    monkeypatch.setattr(estimation, "BUCKET_LEVELS", 20)
    pdf, df = six
    got = {(r.replicate, r.term): r.estimate for r in bootstrap_ols(df, "y", terms(), SIX, ["id"], replicates=7, seed=4, **way).collect()}
    one, two = (np.array([r[0] for r in df.select(s).collect()]) for s in seeds(["id"], 4))
    weights = draws((one, two), 1, 7)
    assert len(got) == 14
    for b in range(7):
        there = weights[:, b] > 0
        want = dense(pdf[there], weights=weights[there, b])["beta"]
        assert np.allclose([got[b + 1, t] for t in "ab"], want, atol=1e-8)


def test_joint_weights_stay_exact():
    """Counts take a byte while they fit; sums beyond it and fractions keep their value."""
    for w, kind in ((1.0, np.uint8), (200.0, np.uint16), (40_000.0, np.float64), (0.3, np.float64)):
        state = State(1, 2, 2)
        codes = [state.codes(0, ["a"]), state.codes(1, ["b"])]
        for _ in range(2):
            state.add(np.ones((1, 1)), np.full((1, 2), w), codes, np.zeros((1, 0)))
        state.compact()
        values = state.pair(0, 1)[2]
        assert values.dtype == kind and (values == 2 * w).all() and state.cross[1, 0, 0] == 2 * w


def test_states_are_handed_on_by_their_sorted_pairs(monkeypatch):
    monkeypatch.setattr(accumulate, "PAIR_BYTES", 2_000)

    def held(distinct):
        state = State(1, 2)
        for k in range(400):
            codes = [state.codes(0, [str(k % distinct)]), state.codes(1, ["b"])]
            state.add(np.ones((1, 1)), np.ones((1, 1)), codes, np.zeros((1, 0)))
        return {(): state}

    few, many = held(5), held(400)
    assert not accumulate._outgrown(few) and few[()].held == 5
    assert accumulate._outgrown(many)


def test_draws_are_the_column_s(six):
    _, df = six
    one, two = (np.array([r[0] for r in df.select(s).collect()]) for s in seeds(["id"], 1))
    want = draws((one, two), 1, 9)
    ids = [r[0] for r in df.select("id").collect()]
    got = {(r.id, r.replicate): r.weight for r in with_replicates(df.select("id"), ["id"], 9).collect()}
    for i, key in enumerate(ids):
        for b in range(9):
            assert got.get((key, b + 1), 0) == want[i, b]
    # Poisson(1): mean and variance near one, replicates unrelated.
    assert abs(want.mean() - 1) < 0.03 and abs(want.var() - 1) < 0.06
    assert np.abs(np.corrcoef(want.T) - np.eye(9)).max() < 0.08
    assert abs(poisson_edges()[-1] - 1) < 1e-12


def test_states_add_up():
    rng = np.random.default_rng(0)
    n, names = 500, [[f"f{k}" for k in range(9)], [f"g{k}" for k in range(5)]]
    z, w, extra = rng.normal(size=(n, 3)), rng.integers(0, 3, (n, 4)).astype(float), np.zeros((n, 0))
    codes = [rng.integers(0, 9, n), rng.integers(0, 5, n)]

    def fold(rows):
        s = State(3, 2, 4)
        own = []
        for i in range(2):
            met, mine = np.unique(codes[i][rows], return_inverse=True)
            own.append(s.codes(i, [names[i][k] for k in met])[mine])
        s.add(z[rows], w[rows], own, extra[rows])
        return State.unpacked(s.packed())

    whole = fold(np.arange(n))
    parts = [fold(p) for p in np.array_split(rng.permutation(n), 7)]
    total = parts[0]
    for p in parts[1:]:
        total.merge(p)
    total.compact()
    assert np.allclose(whole.cross, total.cross) and np.allclose(whole.totals, total.totals)
    for i in range(2):
        at = [total.levels[i][name] for name in whole.levels[i]]
        assert np.allclose(whole.sums[i], total.sums[i][at])
    table = lambda s: {
        (list(s.levels[0])[a], list(s.levels[1])[b]): tuple(v) for a, b, v in zip(*s.pair(0, 1), strict=True)
    }
    assert table(whole) == table(total)
    dealt = whole.dealt(0, 3)
    assert sum(len(p.levels[0]) for k, p in dealt.items() if k >= 0) == 9 and len(dealt[-1].levels[0]) == 0


def test_gradients_over_written_tables(six):
    """Beyond the pairs that a task may hold: the same model from joins."""
    pdf, df = six
    few = pdf[["id", "a", "b", "y", "h", "fips", "dow", "year"]]
    solution = fe_ols(df.select(*few.columns), "y", terms(), ["fips", "dow"], keys=["h"], max_levels=1, rest_levels=1, max_pairs=1).persist()
    got = {(r.h, r.term): r for r in tidy(solution, ["h"]).collect()}
    fits = {r.h: r for r in figures(solution, ["h"]).collect()}
    for h, part in few.groupby("h"):  # a key whose name the tables use too
        want = dense(part, ["fips", "dow"])
        assert np.allclose([got[h, t].estimate for t in "ab"], want["beta"], atol=1e-8)
        assert np.allclose([got[h, t].std_error for t in "ab"], want["error"], rtol=1e-6)
        assert fits[h]["absorbed"] == want["absorbed"] and abs(fits[h]["aic"] - want["aic"]) < 1e-5


@pytest.mark.parametrize("shape", [estimation.Shape(), estimation.Shape(3, 3)])
def test_packed_blocks_fold_as_rows_do(six, monkeypatch, shape):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    d = design(six[1], "c", terms(), SIX, "w", ["h"])
    packed = blocks.packed_rows(d.rows, d.keys, ["y", "w", "x0", "x1"], [f"f{i}" for i in range(6)], shape.wide, max(shape.buckets, 1))
    # Far fewer rows to read at each step than the model has, and no strings but the levels met.
    assert len(six[0]) / 40 <= packed.count() <= len(six[0]) / 5
    as_is = lambda values, eta: (values[0], values[1], np.zeros((0, values.shape[1])))
    found = blocks.block_states(packed, None, estimation.plan_of(d, shape=shape), d.terms, 2, as_is)
    got = {(r.h, r.term): r for r in tidy(solve(d, found, shape), ["h"]).collect()}
    for r in tidy(fe_ols(six[1], "c", terms(), SIX, "w", ["h"]), ["h"]).collect():
        assert got[r.h, r.term].estimate == pytest.approx(r.estimate, rel=1e-9)
        assert got[r.h, r.term].std_error == pytest.approx(r.std_error, rel=1e-9)


def test_long_methods_are_left_out_while_fits_run(six):
    """Terms in one method beyond what the JVM compiles cost a row ten times as much."""
    conf = six[1].sparkSession.conf
    before = conf.get("spark.sql.codegen.hugeMethodLimit")
    with estimation.plain_plans(six[1]):
        assert int(conf.get("spark.sql.codegen.hugeMethodLimit")) == 8_000
    assert conf.get("spark.sql.codegen.hugeMethodLimit") == before


@pytest.mark.parametrize("holes", [False, True])
@pytest.mark.parametrize("way", [{}, {"max_levels": 1}])
def test_forms_of_one_pass(six, way, holes, monkeypatch):
    """Forms share a pass over the rows unless one of them leaves out other rows."""
    df = six[1].withColumn("b", F.when(F.col("id") != "7", F.col("b"))) if holes else six[1]
    forms = [{"a": F.col("a")}, {"b": F.col("b"), "a": F.col("a")}]
    passes = []
    fold = estimation.normal_sums
    monkeypatch.setattr(estimation, "normal_sums", lambda *a, **k: passes.append(1) or fold(*a, **k))
    found = estimation.nested_fits(df, "y", forms, SIX, ["h"], **way)
    assert len(passes) == (2 if holes else 1)
    monkeypatch.undo()
    for terms_of, fit in zip(forms, found, strict=True):
        got = {(r.h, r.term): r for r in tidy(fit, ["h"]).collect()}
        for r in tidy(fe_ols(df, "y", terms_of, SIX, keys=["h"]), ["h"]).collect():
            assert got[r.h, r.term].estimate == pytest.approx(r.estimate, rel=1e-8)
            assert got[r.h, r.term].std_error == pytest.approx(r.std_error, rel=1e-8)


def test_parts_of_buckets_add_up():
    """Parts that meet before the last task have the levels of both."""
    one, two = estimation._empty([["a", "b"], []], 1), estimation._empty([["b", "c"], []], 1)
    one.matrix += 1
    two.matrix += 2
    both = estimation._combined(one, two)
    assert both.names[0] == ["a", "b", "c"]
    assert both.matrix.tolist() == [[1, 1, 0], [1, 3, 2], [0, 2, 2]]


def test_counts_are_folded_as_whole_numbers():
    rng = np.random.default_rng(5)
    length = np.concatenate((rng.integers(1, 4, 300), [16, 17, 40, 700]))
    starts, order = np.cumsum(length) - length, rng.permutation(length.sum())
    for values in (rng.integers(0, 255, (len(order), 7)).astype(np.uint8), rng.normal(size=(len(order), 7)), rng.normal(size=(len(order), 1))):
        found = accumulate._folded_values(values, order, starts)
        wanted = [values[order[a : a + n]].astype(float).sum(axis=0) for a, n in zip(starts, length, strict=True)]
        assert np.allclose(found, wanted, rtol=1e-12, atol=1e-12)
        # A count takes half the room of a number with a fraction.
        assert found.dtype == (np.uint32 if values.dtype == np.uint8 else np.float64)
    assert accumulate._tight(np.array([[3, 256]], np.uint32)).dtype == np.uint16
    assert accumulate._tight(np.array([[3, 1 << 20]], np.uint32)).dtype == np.float64
    assert len(accumulate._folded_values(np.zeros((0, 3), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def replicated(replicates=80):
    """The plan of three factors with all replicates, and its schema."""
    plan = Plan(
        (), ("y",), ("f0", "f1", "f2"), "w", draw=partial(draws, first=1, replicates=replicates), seeds=("one", "two"),
        replicates=replicates, group=5, wide=0, buckets=3,
    )
    schema = pa.schema([("__group", pa.int32()), ("__bucket", pa.int32()), ("__state", pa.binary())])
    return plan, schema


def test_replicates_are_folded_before_they_are_handed_on():
    """Pairs that fit a task left it many times over, each time nearly as many as there are."""
    plan, schema = replicated()
    rng = np.random.default_rng(5)

    def batches():
        for _ in range(40):
            n = 10_000
            columns = {"y": rng.normal(size=n), "w": np.ones(n), "one": rng.integers(0, 2**32, n), "two": rng.integers(0, 2**32, n)}
            columns |= {f"f{i}": rng.integers(0, 400, n).astype(str) for i in range(3)}
            yield pa.RecordBatch.from_pydict(columns)

    parts = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in _folded(plan, schema)(batches())]
    assert len(parts) == len(set(parts)) == 16 * 4


def test_buckets_of_replicates_are_tasks_of_their_own(six):
    """Hashed to as many tasks as there are cores, some task read a multiple of the others."""
    plan, _ = replicated()
    _, df = six
    one, two = seeds(["id"], 1)
    rows = df.select("y", F.lit(1.0).alias("w"), one.alias("one"), two.alias("two"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(SIX[:3])))
    found = states(rows, plan).select("__group", "__bucket", F.spark_partition_id().alias("task")).collect()
    assert len(found) == len({(r[0], r[1]) for r in found}) == len({r.task for r in found}) > 16
