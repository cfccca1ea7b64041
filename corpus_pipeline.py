"""From raw documents to packed training sequences, stage by stage.

Every stage is written as Parquet and read again as the next one's documents. All
but the last return the columns of ``documents``; each works on all rows its
predecessor kept.

1. ``quality``: documents the learned rules reject go.
2. ``near_duplicates``: of each group of near copies the one with the least key stays.
3. ``decontamination``: documents that hold a benchmark passage go.
4. ``pii``: personal data in the texts is replaced, ``n_chars`` follows.
5. ``packing``: the texts become pieces of full token windows.

Nulls: a row with a null key is judged by its text like any other; rows equal in
key and text share their fate, and one of them is left after the second stage.
Empty tables give empty results at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgrid.llm import decontamination, packing, pii, quality, simhash
from moodgrid.llm.common import new_folder, spread, table_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(*COLUMNS), table_of(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs.select(*COLUMNS), table_of(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(spread(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_FILE)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("packing", pack_windows),
]

# Boosted trees, fingerprints and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
