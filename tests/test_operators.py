"""Operators against brute force on small frames."""

import random

import numpy as np
from pyspark.sql import functions as F

from moodgrid.operators import aggregates, joins, sampling, spatial, text, windows
from moodgrid.queries.registry import Tables


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in "ab" for v in rng.integers(0, 50, 700 if k == "a" else 31)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.prob): r.value for r in aggregates.quantiles(df, "v", [0, 0.025, 0.5, 0.9, 1], ["k"]).collect()}
    for (k, p), value in got.items():
        assert abs(value - np.quantile([v for kk, v in rows if kk == k], p)) < 1e-9
    assert len(got) == 10


def test_quantiles_refine_crowded_intervals(spark):
    """No interval of more than ``limit`` rows is sorted, also where one value holds most rows."""
    rng = np.random.default_rng(4)
    values = np.concatenate([np.full(4_000, 7.25), rng.normal(7.25, 1e-3, 900), rng.normal(0, 1e6, 90), [-1e300, 1e300]])
    rows = [(k, float(v)) for k in ("a", "b") for v in (values if k == "a" else values[::7])]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0, 0.01, 0.025, 0.1, 0.5, 0.93, 0.975, 1]
    for keys in ([], ["k"]):
        got = aggregates.quantiles(df, "v", probs, keys, limit=50).collect()
        assert len(got) == len(probs) * (2 if keys else 1)
        for r in got:
            own = [v for k, v in rows if not keys or k == r.k]
            assert np.isclose(r.value, np.quantile(own, r.prob), rtol=1e-12)
    assert aggregates.quantiles(df.limit(0), "v", probs).count() == 0


def test_segments_find_all_texts_within_the_band(spark):
    random.seed(8)
    base = ["".join(random.choice("01234567") for _ in range(random.randint(1, 14))) for _ in range(40)]

    def worn(s):
        for _ in range(random.randint(0, 5)):
            at = random.randint(0, len(s))
            s = random.choice([s[:at] + random.choice("01234567") + s[at:], s[: max(at - 1, 0)] + s[at:], s[:at] + "9" + s[at + 1 :]])
        return s

    left = spark.createDataFrame(sorted({(1, worn(random.choice(base))) for _ in range(120)}), "at int, id string")
    right = spark.createDataFrame(sorted({(1, b) for b in base}), "at int, __r string")
    every = left.join(right, "at").withColumn("d", F.levenshtein("id", "__r"))
    for k in (2, 4):
        got = {(r.id, r["__r"], r["__d"]) for r in joins._within(left, right, ["at"], "id", k).collect()}
        assert got == {(r.id, r["__r"], r.d) for r in every.filter(F.col("d") <= k).collect()}


def test_salted_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 0.1)
    fact = spark.range(900).select("id", F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(700).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.salted_join(fact, dim, ["k"], "left", ["id"])
    assert sorted(map(tuple, got.select("id", "v").collect()), key=lambda x: x[0]) == sorted(
        map(tuple, fact.join(dim, ["k"], "left").select("id", "v").collect()), key=lambda x: x[0]
    )


def test_nearest_key_is_exact(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("0123") for _ in range(random.randint(1, 6)))
    a = sorted({(random.randint(0, 3), word()) for _ in range(80)})
    b = sorted({(random.randint(0, 2), word()) for _ in range(60)})

    def edit(s, t):
        row = list(range(len(t) + 1))
        for i, cs in enumerate(s, 1):
            row, last = [i, *[0] * len(t)], row
            for j, ct in enumerate(t, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (cs != ct))
        return row[-1]

    left = spark.createDataFrame(a, "at int, id string")
    right = spark.createDataFrame([(*x, i) for i, x in enumerate(b)], "at int, id string, v int")
    got = {(r.at, r.id): (r.edit_distance, r.m) for r in joins.nearest_key_join(left, right, ["at"], "id", "m").collect()}
    for at, s in a:
        best = min(((edit(s, t), t) for bt, t in b if bt == at), default=(None, None))
        assert got[(at, s)] == best


def test_bands_and_whole_groups_find_the_same(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("0123456") for _ in range(random.randint(5, 12)))
    left = spark.createDataFrame([(random.choice([0, 1, 2, None]), word()) for _ in range(60)], "at int, id string")
    right = spark.createDataFrame([(random.choice([0, 1, None]), word(), i) for i in range(70)], "at int, id string, v int")
    one, two = (
        sorted(map(repr, joins.nearest_key_join(left, right, ["at"], "id", "m", direct=n).collect())) for n in (0, joins.DIRECT)
    )
    assert len(one) == 60 and one == two


def test_exploded_texts_are_not_broadcast(spark):
    """Few short rows explode into many: their estimated size must not send them to the driver."""
    texts = spark.createDataFrame([(1, "0123456789")], "at int, id string")
    pairs = joins._within(texts, texts.withColumnRenamed("id", "__r"), ["at"], "id", 4)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pairs.collect()] == [(1, "0123456789", "0123456789", 0)]


def test_concave_polygon_and_left_join(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    shape = spark.createDataFrame([("u", ring)], "name string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 3.0), (3, 3.5, 2.0), (4, 9.0, 9.0)], "id int, lon double, lat double")
    got = spatial.point_in_polygon(points, shape, how="left", ids=["id"])
    assert {r.id: r.name for r in got.collect()} == {1: "u", 2: None, 3: "u", 4: None}


def test_copies_of_a_post_score_once(spark):
    lex = spark.createDataFrame([("good", 3.0), ("bad", -2.0)], "word string, score double")
    posts = spark.createDataFrame([("1", "good good bad!"), ("1", "good good bad!"), ("2", "nothing")], "id string, t string")
    got = {r.id: r.afinn for r in text.lexicon_sum_sqrt(posts, ["id"], "t", lex).collect()}
    assert abs(got["1"] - 4 / 2) < 1e-12 and got["2"] == 0


def test_polarity_rules(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, score double")
    boost = spark.createDataFrame([("very", 0.293)], "word string, step double")
    texts = ["good", "very good", "not good", "GOOD day", "good!!", "bad but good", "plain"]
    posts = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.vader for r in text.rule_polarity(posts, ["id"], "t", lex, boost, ["not"]).collect()}
    sums = [2, 2.293, 2 * -0.74, 2.733, 2.584, -1 + 3, 0]
    for i, s in enumerate(sums):
        assert abs(got[i] - s / (s * s + 15) ** 0.5) < 1e-9, texts[i]


def test_rolling_mean_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK_DAYS", 8)
    days = spark.range(60).select(
        F.lit("s").alias("k"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("d"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("v"),
    )
    got = {r.d: r.v3 for r in windows.rolling_mean(days, "k", "d", ["v"], 3, "3").collect()}
    series = [None if i % 7 == 0 else float(i) for i in range(60)]
    for i, day in enumerate(sorted(got)):
        frame = [v for v in series[max(i - 2, 0) : i + 1] if v is not None]
        want = None if i < 2 else sum(frame) / len(frame)
        assert (got[day] is None) == (want is None) and (want is None or abs(got[day] - want) < 1e-9)


def test_bootstrap_weights_repeat(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("id"))
    stats = lambda df: sampling.with_replicates(df, ["id"], 2).agg(F.sum("weight"), F.sum(F.col("weight") ** 2)).first()
    a, b = stats(ids), stats(ids.repartition(7))
    assert a == b and abs(a[0] / 40000 - 1) < 0.03 and abs(a[1] / 40000 - 2) < 0.1


def test_texts_are_dealt_by_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "TASK_TEXT", 1_000)
    rows = [(i, "word " * 20) for i in range(200)]
    spark.createDataFrame(rows, "id long, body string").coalesce(1).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    dealt = text.over_cores(read, "body")
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.count() == 200
    # Rows that are in no file stay where they are, empty tables too.
    assert text.over_cores(spark.range(3), "id").rdd.getNumPartitions() == spark.range(3).rdd.getNumPartitions()
    assert text.over_cores(read.filter("id < 0"), "body").count() == 0


def test_polarity_names_its_value_once_a_step(spark):
    docs = spark.createDataFrame([(1, "not very GOOD but never bad"), (2, None), (3, "Good")], "id long, body string")
    lexicon = spark.createDataFrame([("good", 2.0), ("bad", -3.0)], "word string, score double")
    boosters = spark.createDataFrame([("very", 0.293)], "word string, step double")
    scored = text.rule_polarity(docs, ["id"], "body", lexicon, boosters, ["not", "never"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-0.74") == 3
    good = ((2.0 + 0.733) + 0.293 * 1.0) * -0.74 * 0.5
    bad = (-3.0) * -0.74 * 1.5
    total = good + bad
    found = {r["id"]: r["vader"] for r in scored.collect()}
    assert set(found) == {1, 3}
    assert abs(found[1] - total / (total * total + 15.0) ** 0.5) < 1e-9
    assert abs(found[3] - 2.0 / (4.0 + 15.0) ** 0.5) < 1e-9


def test_shuffled_frames_are_stored_in_one_run(spark, tmp_path):
    """Counting the partitions of an aggregated frame ran its shuffle before it was written."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(1000).selectExpr("id", "id % 7 AS k").mapInArrow(counted, "id long, k long")
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    kept = Tables(spark, str(tmp_path)).stored(sums, "sums", shuffled=True)
    assert read.value == 1000
    want = {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert {r.k: r.s for r in kept.collect()} == want and read.value == 1000
