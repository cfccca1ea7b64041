"""Readers and writers on files in a fresh folder."""

import json

from pyspark.sql import functions as F

from moodgrid.sources import readers, writers
from moodgrid.streaming.incremental import score_incremental


def post(i, text):
    return {
        "id": str(i), "tweet_created_at": f"{{'$date': {1300000000000 + i}}}", "geo": {"coordinates": [-80.5, 40.0]},
        "user": {"id": "u"}, "pure_text": text, "fastText_lang": "en",
    }


def test_glued_objects(spark, tmp_path):
    texts = ["plain", 'with }{"id" inside', "two\nlines", "last"]
    objects = [json.dumps(post(i, t), separators=(",", ":")) for i, t in enumerate(texts)]
    (tmp_path / "a.json").write_text("".join(objects))
    got = readers.read_concat_json(spark, str(tmp_path / "a.json"), readers.POST_SCHEMA)
    assert sorted(r.pure_text for r in got.collect()) == sorted(texts)
    (tmp_path / "b.json").write_text("[" + ", \n".join(objects) + "]")
    spaced = readers.read_spaced_json(spark, str(tmp_path / "b.json"), readers.POST_SCHEMA)
    assert sorted(r.pure_text for r in spaced.collect()) == sorted(texts)
    flat = readers.parse_epoch_ms(readers.flatten_geo(got)).first()
    assert (flat.lon, flat.lat, flat.yyyymmdd) == (-80.5, 40.0, "20110313")


def test_arrays_and_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([post(1, "x"), post(2, "y")]))
    (tmp_path / "b.json").write_text("")
    assert readers.read_json_array(spark, str(tmp_path), readers.POST_SCHEMA).count() == 2


def test_chunks_and_partitions(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("day"))
    writers.split_into_chunks(df.coalesce(1), str(tmp_path / "c"), 30)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4
    writers.write_partitioned(df, str(tmp_path / "p"), ["day"], ["id"], 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 100


def test_only_new_files_are_scored(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    df = spark.range(5).select("id")
    for _ in range(2):
        df.write.mode("append").json(source)
        score_incremental(spark, source, out, marks, df.schema, lambda b: b.withColumn("s", F.col("id") * 2))
    assert spark.read.parquet(out).count() == 10
