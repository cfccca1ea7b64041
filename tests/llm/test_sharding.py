import zlib
from collections import Counter

from pyspark.sql import functions as F

from moodgrid.llm import sharding


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 10, 97):
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
        assert sorted(places) == list(range(n))


def test_every_row_gets_a_place(odd):
    rows = sharding.shard(odd, 3).collect()
    texts = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    assert len(rows) == len(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    bodies = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    assert got == Counter((k, len(b) + 1, zlib.crc32(b)) for k, b in bodies)


def test_hot_row_is_dealt_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    docs = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["place"] for r in sharding.shard(docs).collect()) == list(range(100))


def test_reproducible_and_empty(odd):
    first, second = (sorted(map(repr, sharding.shard(d).collect())) for d in (odd, odd.repartition(5)))
    assert first == second
    assert sharding.shard(odd.limit(0)).count() == 0
