import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moodgrid.llm import decontamination, pii, quality, simhash
from moodgrid.llm.common import new_folder, table_of


def stage_by_stage(spark, docs, folder):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, name)
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_take_effect(spark, small):
    docs, good, single, clean, masked, packed = stage_by_stage(spark, table_of(spark, small, "documents"), small)
    for table in (good, single, clean, masked):
        assert sorted(table.columns) == sorted(docs.columns)
    keys = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    verdict = quality.judge(docs, table_of(spark, small, "labels"))
    assert keys(good) == keys(verdict.where("kept"))
    near = simhash.near_duplicates(good)
    assert keys(single) == {r[0] for r in near.select("component_id").distinct().collect()}
    assert keys(clean) == keys(single) - keys(decontamination.overlaps(single, table_of(spark, small, "benchmark")))
    assert keys(masked) == keys(clean)
    assert masked.where(F.col("n_chars") != F.length("text")).count() == 0
    assert pii.find(masked).where(F.size("base_spans") > 0).count() == 0
    assert keys(packed) == keys(masked)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d"))
    assert whole.where("n <> d").count() == 0


def test_run_is_the_stages(spark, small):
    run = corpus_pipeline.run(spark, small).collect()
    again = stage_by_stage(spark, table_of(spark, small, "documents"), small)[-1].collect()
    assert sorted(map(repr, run)) == sorted(map(repr, again))


@pytest.mark.parametrize("size", [0, 10])
def test_odd_rows(spark, odd, small, size):
    docs = odd.limit(size).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"), "mark")
    *_, packed = stage_by_stage(spark, docs, small)
    assert packed.count() >= 0


def test_a_null_is_no_text(spark, small):
    """Rows that differ only in which of key and text is null keep their own fate."""
    rows = [(5, None, "en", "s", 0), (None, "5", "en", "s", 1), (6, "x y z", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in simhash.representatives(docs).collect()}
    assert (None, "5") in kept and (5, None) in kept
    clean = decontamination.clean(docs, table_of(spark, small, "benchmark"))
    assert clean.count() == 3
