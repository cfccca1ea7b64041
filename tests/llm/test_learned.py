"""Quality and toxicity: exact counts, monotonic trees, held-out accuracy, odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from moodgrid.llm import quality, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, dup = set(), 0
    for line in (x for x in text.split("\n") if WORDS.search(x)):
        dup += line in seen
        seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(windows).items() if n > 1}
    inside = {i + s for i, g in enumerate(windows) if g in often for s in range(3)}
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside))
    return *counts, len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_base_counts_are_exact(spark, small, odd):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    extra = [(1, "a b c a b c d\n a b c\nx\nx\n\nx \n#%"), (2, "a\x0bb\x0cc\x1cd e")]
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd, spark.createDataFrame(extra, "doc_id long, text string")):
        want = Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())
        rows = quality.judge(docs, labels).collect()
        assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in rows) == want
        assert all(r["kept"] <= (not r["base_failed"]) for r in rows)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3) ^ (rng.random(3000) < 0.05)).astype(float)
    model = quality.fit(x, y, np.array([True, False, True]))
    assert ((model.score(x) >= 0.5) == (y > 0.5)).mean() > 0.9
    for j in (0, 2):
        grid = np.repeat(rng.random((50, 3)), 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(model.score(grid).reshape(50, 40), axis=1) <= 1e-12).all()


def test_scores_are_those_of_single_walks():
    rng = np.random.default_rng(4)
    x = rng.random((400, 2))
    model = quality.fit(x, (x[:, 0] > 0.6).astype(float), np.array([False, False]))
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        raw = model.base
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            raw += model.value[at]
        assert abs(1 / (1 + np.exp(-raw)) - score) < 1e-12


def test_quality_without_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], LABELS)
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 0, 1)], LABELS)
    for labels in (none, odd_labels):
        assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(odd, labels).collect())
        assert quality.judge(odd.limit(0), labels).count() == 0
        kept = quality.accepted(odd, labels)
        assert kept.columns == odd.columns
        assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in odd.collect() if not base(r["text"])[-1])


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = np.mean([r["predicted"] == r["toxic"] for r in held])
    always = 1 - np.mean([r["toxic"] for r in held])
    toxic, clean = ([r["score"] for r in held if r["toxic"] == y] for y in (1, 0))
    auc = np.mean([[(t > c) + (t == c) / 2 for c in clean] for t in toxic])
    assert right > max(always, 0.97) and auc > 0.95


def test_held_out_labels_are_never_used(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, x).collect()) for x in (labels, turned))
    assert first == second


def test_label_model_weighs_voters_by_accuracy():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.3).astype(float)
    good = np.where(rng.random(4000) < 0.9, np.where(y > 0.5, 1, 2), np.where(y > 0.5, 2, 1))
    bad = rng.integers(0, 3, 4000)
    votes = np.stack([good, bad, bad], axis=1).astype(np.int8)  # the last two repeat one another
    given = np.where(rng.random(4000) < 0.93, y, 1 - y)
    q = toxicity.label_model(votes, given)
    assert ((q > 0.5) == (y > 0.5)).mean() > 0.9


def test_toxicity_of_odd_rows(spark, odd):
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(None, 1, 1), (1, 1, 0), (2, 1, None)], LABELS)):
        rows = toxicity.score(odd, labels).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(odd.limit(0), labels).count() == 0


def test_features_count_a_word_once():
    owner, bucket = toxicity.features_of(pa.array(["Bad bad, BAD.", "", "bad badly-behaved"]))
    assert (owner == 0).sum() == 1 and (owner == 1).sum() == 0
    assert bucket[owner == 0][0] in bucket[owner == 2]
