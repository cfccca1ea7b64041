"""One query for each operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodgrid.llm import bpe, decontamination, extraction, licences, packing, pii, quality, ranked, records, runs, sharding, simhash, toxicity
from moodgrid.llm.common import new_folder, spread, table_of

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table_of(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table_of(spark, folder, "documents"), WORD_FILE)


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(spread(table_of(spark, folder, "documents").select("doc_id", "text")))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.overlaps(table_of(spark, folder, "documents"), table_of(spark, folder, "benchmark"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(spread(table_of(spark, folder, "documents").select("doc_id", "text")))
    counts = {f"n_{k.name}": F.size(F.filter("base_spans", pii.is_kind(k.name))).cast("long") for k in pii.BASE}
    return found.withColumns(counts).select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op6_records(spark: SparkSession, folder: str) -> DataFrame:
    out = new_folder(spark, "records")
    records.write_records(table_of(spark, folder, "documents"), out, BYTE_FILE)
    index = records.positions(records.write_index(spark, out))
    return index.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table_of(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op8_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table_of(spark, folder, "pages"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table_of(spark, folder, "documents"), table_of(spark, folder, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table_of(spark, folder, "documents"), table_of(spark, folder, "labels"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by checksum of its id becomes periodic from some word on, as the contract fixes."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size("words").cast("bigint")
    start = F.pmod(g, n)
    period = F.floor((n - start) / (F.pmod(g, F.lit(8)) + 3)).cast("bigint") + 1
    turned = F.expr("transform(words, (w, i) -> IF(i < a, w, words[cast(a + pmod(i - a, p) AS int)]))")
    chosen = docs.filter((h % 10 == 0) & F.col("text").isNotNull()).select("doc_id", words.alias("words"))
    chosen = chosen.withColumns({"a": F.when(n > 0, start), "p": F.when(n > 0, period)})
    planted = chosen.select("doc_id", F.array_join(turned, " ").alias("text"))
    rest = docs.filter(~F.coalesce((h % 10 == 0) & F.col("text").isNotNull(), F.lit(False)))
    return rest.select("doc_id", "text").unionByName(planted)


def op11_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_planted_runs(spread(table_of(spark, folder, "documents").select("doc_id", "text")))
    found = runs.periodic_runs(docs, digest=True)
    # Greatest length, then smallest start, then smallest period.
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r.length, r.start, r.period)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_b", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        (-F.col("_b.col1")).alias("length"),
        F.col("_b.period").alias("period"),
        F.expr("1000 * -_b.col1 div _b.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table_of(spark, folder, "documents"), RANK_FILE, decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    index = ranked.build_index(table_of(spark, folder, "documents"))
    return ranked.search(index, table_of(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_licences": op3_licences,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_records": op6_records,
    "op7_simhash": op7_simhash,
    "op8_extraction": op8_extraction,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_ranked_search": op13_ranked_search,
}


def _licence_sql() -> str:
    """The same comparison over lists."""
    rows = ", ".join(
        f"('{name}', [{', '.join(repr(g) for g in grams)}])" for name, grams in licences.sized()
    )
    return rf"""WITH t(licence, b) AS (VALUES {rows}),
    d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls,
                 regexp_split_to_array(text, '\n[ \t\r]*\n') AS ps FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(ls))) AS place, unnest(ls) AS s FROM d
          UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(ps))), unnest(ps) FROM d WHERE len(ps) > 1
          UNION ALL SELECT doc_id, 'text', 0, text FROM d WHERE len(ls) > 1),
    w AS (SELECT doc_id, unit, place, string_split(trim(regexp_replace(lower(s), '{licences.OTHER}', ' ', 'g')), ' ') AS ws FROM u),
    g AS (SELECT doc_id, unit, place,
                 list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS a FROM w WHERE len(ws) > 1),
    c AS (SELECT doc_id, unit, place, licence, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS s FROM g JOIN t
          ON len(a) BETWEEN len(b) / 1.5 AND len(b) * 1.5),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY s DESC, licence) AS k FROM c WHERE s >= 0.8)
    SELECT doc_id, unit, place::INT AS place, licence, round(s, 6) AS score FROM r WHERE k = 1"""


# CRC-32 bit by bit; words by index; pairs of equal five-word windows give every
# run, since a run holds five equal pairs in a row at least.
RUNS_SQL = r"""WITH s AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
         xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
             lambda crc, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)),
             4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents),
    p AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM s),
    d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i
            ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE ws END AS ws FROM p),
    w AS (SELECT r, n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS g FROM (SELECT r, n, ws, unnest(range(n - 4)) AS i FROM d WHERE n >= 6)),
    e AS (SELECT x.r, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND y.i - x.i <= x.n // 4),
    l AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
    f AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM l GROUP BY r, q, island),
    u AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM f WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
    best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, start, q) = 1),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM u GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(ws) AS word, unnest(range(n)) AS i FROM d) v
             WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = v.r AND gone.i = v.i) GROUP BY r)
    SELECT d.doc_id, coalesce(listed.n_runs, 0) AS n_runs, best.start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
           sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

RANKED_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents WHERE text IS NOT NULL),
    b AS (SELECT row_number() OVER () AS q, item_id,
            regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM benchmark WHERE text IS NOT NULL),
    c AS (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
    asked AS MATERIALIZED (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS term FROM b) GROUP BY q, item_id, term),
    post AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
            WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term),
    v AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM post GROUP BY term), c),
    s AS (SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
          FROM post JOIN asked USING (term) JOIN v USING (term), c GROUP BY q, item_id, r, doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20"""

SQL: dict[str, str] = {"op3_licences": _licence_sql(), "op11_runs": RUNS_SQL, "op13_ranked_search": RANKED_SQL}
