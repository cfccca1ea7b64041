"""Source and sink queries (inventory S1 to S11, ST1).

Those that need files write them, from the given tables, to a fresh folder
below ``spark.checkpoint.dir`` and read them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.operators import text as text_ops
from moodgrid.queries.registry import query, r, rounded
from moodgrid.sources import readers, writers
from moodgrid.streaming.incremental import score_incremental


def raw_posts(t):
    """Posts as the nested objects they arrive in."""
    ms = F.unix_millis(F.col("tweet_created_at").cast("timestamp")).cast("string")
    return t.posts.select(
        "id",
        F.concat(F.lit("{'$date': "), ms, F.lit("}")).alias("tweet_created_at"),
        F.struct(F.array("lon", "lat").alias("coordinates")).alias("geo"),
        F.struct(F.col("id").alias("id")).alias("user"),
        F.concat(F.col("pure_text"), F.lit(' }{"id": "x')).alias("pure_text"),
        F.col("lang").alias("fastText_lang"),
    )


POST_TEXT = """SELECT id, pure_text || ' }{"id": "x' AS pure_text, lang, lon, lat FROM posts"""


@query("S1_read_concat_json", POST_TEXT, ("posts",))
def _(t):
    # A text writer always separates its values: one blank is the glue here.
    folder = t.fresh_folder("glued")
    raw_posts(t).select(F.to_json(F.struct("*")).alias("value")).write.option("lineSep", " ").text(folder)
    posts = readers.read_concat_json(t.spark, folder, readers.POST_SCHEMA, glue=" ")
    return readers.flatten_geo(posts).select("id", "pure_text", F.col("fastText_lang").alias("lang"), "lon", "lat")


@query("S2_read_json_array", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    folder = t.fresh_folder("arrays")
    # Files of about a hundred dialogues each, so their number grows and not
    # their size; the brackets of an array are lines of their own.
    file = F.concat_ws("-", F.floor(F.col("conv_id") / 100).cast("string"), F.floor(F.col("turn") / 1000).cast("string"))
    turns = t.conversations.select(
        file.alias("file"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")
    )
    ends = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("[").alias("value")),
        F.struct(F.lit(2).alias("place"), F.lit("{}]").alias("value")),
    )
    frames = turns.select("file").distinct().select("file", F.inline(ends))
    lines = turns.select("file", F.lit(1).alias("place"), F.concat("value", F.lit(",")).alias("value")).unionByName(frames)
    by_file = lines.repartition("file").sortWithinPartitions("file", "place")
    by_file.select("file", "value").write.partitionBy("file").text(folder)
    return readers.read_json_array(t.spark, f"{folder}/*/", t.conversations.schema).na.drop("all")


@query("S3_read_csv_set", "SELECT cast(doc_id AS string) AS id, text, lang FROM documents")
def _(t):
    folder = t.fresh_folder("csv")
    docs = t.documents.select(F.col("doc_id").cast("string").alias("id"), "text", "lang")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    return readers.read_csv_set(t.spark, folder, "id string, text string, lang string")


@query(
    "S4_read_union_by_name",
    """SELECT s_suppkey, s_name, s_acctbal, NULL::int AS s_nationkey FROM supplier WHERE s_acctbal > 5000
       UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier WHERE s_acctbal <= 5000""",
)
def _(t):
    new = t.supplier.filter("s_acctbal > 5000").selectExpr("s_suppkey AS S_SUPPKEY", "s_name AS S_NAME", "s_acctbal AS S_ACCTBAL")
    old = t.supplier.filter("s_acctbal <= 5000").select("s_name", "s_nationkey", "s_suppkey")
    return readers.union_by_name([new, old])


@query("S5_read_fixed_width", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    line = F.concat(
        F.lpad(F.col("o_orderkey").cast("string"), 12, " "),
        F.rpad("o_orderpriority", 20, " "),
        F.lpad(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), 16, " "),
    )
    folder = t.fresh_folder("fixed")
    t.orders.select(line.alias("value")).write.text(folder)
    fields = [("o_orderkey", 12, "long"), ("o_orderpriority", 20, "string"), ("o_totalprice", 16, "double")]
    return readers.read_fixed_width(t.spark, folder, fields)


@query("S6_read_tsv_footer", "SELECT fips, year, month, deaths FROM deaths WHERE deaths IS NOT NULL", ("deaths",))
def _(t):
    folder = t.fresh_folder("tsv")
    t.deaths.write.option("header", True).csv(folder, sep="\t")
    return readers.read_tsv_footer(t.spark, folder, "fips string, year int, month string, deaths long", "deaths")


@query("S7_merge_csv_headers", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(t):
    source, merged = t.fresh_folder("parts"), t.fresh_folder("merged")
    t.orders.select("o_orderkey", "o_orderpriority").repartition(4, "o_orderkey").write.option("header", True).csv(source)
    schema = "o_orderkey long, o_orderpriority string"
    writers.merge_csv_headers(t.spark, source, merged, schema)
    return readers.read_csv_set(t.spark, merged, schema)


@query("S8_write_partitioned", "SELECT event_id, value, cast(ts AS date) AS day FROM events")
def _(t):
    folder = t.fresh_folder("daily")
    daily = t.events.select("event_id", "value", F.col("ts").cast("date").alias("day"))
    writers.write_partitioned(daily, folder, ["day"], spread=["event_id"], files=4)
    return t.spark.read.schema("event_id long, value double, day date").parquet(folder)


@query("S9_split_into_chunks", "SELECT count(*) AS n, true AS within FROM lineitem")
def _(t):
    folder = t.fresh_folder("chunks")
    writers.split_into_chunks(t.lineitem.select("l_orderkey"), folder, 1000)
    per_file = t.spark.read.parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= 1000).alias("within"))


@query("S10_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return readers.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query(
    "S11_write_table",
    f"SELECT id, fips, {r('vader')} AS vader FROM panel",
    ("panel",),
)
def _(t):
    folder = t.fresh_folder("table")
    writers.write_table(t.panel.select("id", "fips", "vader"), folder)
    return rounded(t.spark.read.parquet(folder))


@query(
    "ST1_score_incremental",
    f"""SELECT doc_id, {r('coalesce(sum(afinn), 0) / sqrt(max(n))')} AS afinn
        FROM (SELECT doc_id, unnest(ws) AS word, len(ws) AS n FROM
              (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM documents) d) k
        LEFT JOIN lexicon USING (word) GROUP BY doc_id""",
    ("lexicon",),
)
def _(t):
    source, out, marks = (t.fresh_folder(n) for n in ("stream", "scored", "marks"))
    lex = t.lexicon.select("word", F.col("afinn").alias("score"))
    docs = t.documents.select("doc_id", "text")

    def score(batch):
        return text_ops.lexicon_sum_sqrt(batch, ["doc_id"], "text", lex)

    for part in ("lang = 'en'", "lang <> 'en'"):
        # The second run meets one file set it has done and one that is new.
        docs_part = t.documents.filter(part).select(*docs.columns)
        docs_part.write.mode("append").json(source)
        score_incremental(t.spark, source, out, marks, docs.schema, score)
    return rounded(t.spark.read.schema("doc_id long, afinn double").parquet(out).select("doc_id", "afinn"))
