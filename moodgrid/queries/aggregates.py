"""Aggregation queries (inventory A1 to A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.functions import clock, recode
from moodgrid.operators import aggregates as ops
from moodgrid.operators import text as text_ops
from moodgrid.queries.registry import query, r, rounded
from moodgrid.queries.text import TOKENS

SCORES = ["afinn", "hedono", "vader"]
MEANS = ", ".join(f"{r(f'avg({c})')} AS {c}" for c in SCORES) + ", count(*) AS n"


@query(
    "mood_by_weekday_and_time",
    f"""WITH k AS (SELECT id, unnest(ws) AS word, len(ws) AS n FROM (SELECT id, {TOKENS.replace('text', 'pure_text')} AS ws FROM posts) d),
        s AS (SELECT id, coalesce(sum(afinn), 0) / sqrt(max(n)) AS afinn FROM k LEFT JOIN lexicon USING (word) GROUP BY id),
        l AS (SELECT id, (tweet_created_at AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN lon > -84 THEN 'America/New_York' WHEN lon > -102 THEN 'America/Chicago'
                 WHEN lon > -115 THEN 'America/Denver' ELSE 'America/Los_Angeles' END AS lt FROM posts)
        SELECT strftime(lt, '%A') AS dow, substr(strftime(lt, '%H:%M'), 1, 4) AS tod, {r('avg(afinn)')} AS afinn, count(*) AS n
        FROM s JOIN l USING (id) GROUP BY 1, 2""",
    ("posts", "lexicon"),
)
def _(t):
    zone = (
        F.when(F.col("lon") > -84, "America/New_York")
        .when(F.col("lon") > -102, "America/Chicago")
        .when(F.col("lon") > -115, "America/Denver")
        .otherwise("America/Los_Angeles")
    )
    local = clock.clock_columns(clock.to_local(F.col("tweet_created_at"), zone))
    posts = t.posts.select("id", local["dow"].alias("dow"), local["tod"].alias("tod"), "pure_text")
    lex = t.lexicon.select("word", F.col("afinn").alias("score"))
    scored = text_ops.lexicon_sum_sqrt(posts, ["id", "dow", "tod"], "pure_text", lex)
    return rounded(ops.mean_by(scored, ["dow", "tod"], ["afinn"]))


@query("A1_mean_by_state_date", f"SELECT state, date, {MEANS} FROM panel GROUP BY state, date", ("panel",))
def _(t):
    return rounded(ops.mean_by(t.panel, ["state", "date"], SCORES))


@query(
    "A1_mean_by_county_date_hour",
    f"SELECT fips, date, cast(substr(tod, 1, 2) AS int) AS hour, {MEANS} FROM panel GROUP BY 1, 2, 3",
    ("panel",),
)
def _(t):
    hourly = t.panel.withColumn("hour", F.substring("tod", 1, 2).cast("int"))
    return rounded(ops.mean_by(hourly, ["fips", "date", "hour"], SCORES))


@query(
    "A1_mean_by_county_month_weekday",
    f"SELECT fips, substr(statemonth, 4, 2) AS month, dow, year, {MEANS} FROM panel GROUP BY 1, 2, 3, 4",
    ("panel",),
)
def _(t):
    from moodgrid.plans.outcomes import county_month_mood

    return rounded(county_month_mood(t.panel))


@query(
    "A2_count_if_by",
    """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS homicides, count(*) FILTER (o_orderpriority = '1-URGENT') AS assault,
              count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS violent FROM orders GROUP BY o_custkey""",
)
def _(t):
    tests = {
        "homicides": F.col("o_orderstatus") == "F",
        "assault": F.col("o_orderpriority") == "1-URGENT",
        "violent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
    }
    return ops.count_if_by(t.orders, ["o_custkey"], tests)


@query(
    "A3_row_sum_skip_null",
    "SELECT o_orderkey, coalesce(menthlth, 0) + coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 2 END, 0) AS total FROM survey",
    ("survey",),
)
def _(t):
    two = t.survey.selectExpr("o_orderkey", "menthlth AS a", "CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS b")
    return two.select("o_orderkey", recode.row_sum(["a", "b"]).alias("total"))


@query(
    "A4_sum_by_weekday",
    "SELECT strftime(strptime(idate, '%m%d%Y'), '%A') AS dow, coalesce(cast(sum(menthlth) AS bigint), 0) AS menthlth FROM survey GROUP BY 1",
    ("survey",),
)
def _(t):
    dated = t.survey.select(F.date_format(recode.mdy_date(F.col("idate")), "EEEE").alias("dow"), "menthlth")
    return ops.sum_by(dated, ["dow"], ["menthlth"])


@query(
    "A5_extreme_by",
    f"""WITH m AS (SELECT doy, avg(hedono) AS mean FROM panel GROUP BY doy)
        (SELECT 'highest' AS which, doy, {r('mean')} AS mean FROM m ORDER BY m.mean DESC, doy LIMIT 1) UNION ALL
        (SELECT 'lowest', doy, {r('mean')} FROM m ORDER BY m.mean, doy LIMIT 1)""",
    ("panel",),
)
def _(t):
    return rounded(ops.extreme_by(t.panel, "doy", "hedono"))


@query(
    "A6_weighted_mean_by",
    f"""SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN true WHEN c_acctbal < -500 THEN false END AS poor,
               {r('sum((c_custkey % 100) / 100 * (c_custkey % 7)) / nullif(sum(c_custkey % 7), 0)')} AS blackness, count(*) AS n
        FROM customer GROUP BY 1, 2""",
)
def _(t):
    rows = t.customer.selectExpr(
        "c_mktsegment",
        "CASE WHEN c_acctbal > 0 THEN true WHEN c_acctbal < -500 THEN false END AS poor",
        "(c_custkey % 100) / 100 AS share",
        "c_custkey % 7 AS weight",
    )
    return rounded(ops.weighted_mean_by(rows, ["c_mktsegment", "poor"], "share", "weight", "blackness"))


PROBS = [i / 20 for i in range(21)]
PROB_ROWS = "(VALUES " + ", ".join(f"({p * 100:g}e-2)" for p in PROBS) + ") p(prob)"


@query(
    "A7_quantiles",
    f"""SELECT prob, {r('a[cast(floor((len(a) - 1) * prob) AS bigint) + 1] + (a[cast(ceil((len(a) - 1) * prob) AS bigint) + 1] - a[cast(floor((len(a) - 1) * prob) AS bigint) + 1]) * ((len(a) - 1) * prob - floor((len(a) - 1) * prob))')} AS value
        FROM (SELECT list(ln(l_extendedprice) ORDER BY l_extendedprice) AS a FROM lineitem) q, {PROB_ROWS}""",
)
def _(t):
    return rounded(ops.quantiles(t.lineitem.select(F.log("l_extendedprice").alias("x")), "x", PROBS))


@query(
    "A7_quantiles_by_group",
    f"""SELECT l_returnflag, 25e-3 AS prob, {r('quantile_cont(l_extendedprice, 25e-3)')} AS value FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 5e-1, {r('quantile_cont(l_extendedprice, 5e-1)')} FROM lineitem GROUP BY 1
        UNION ALL SELECT l_returnflag, 975e-3, {r('quantile_cont(l_extendedprice, 975e-3)')} FROM lineitem GROUP BY 1""",
)
def _(t):
    return rounded(ops.quantiles(t.lineitem, "l_extendedprice", [0.025, 0.5, 0.975], ["l_returnflag"]))


@query(
    "A8_quantile_bins",
    """SELECT id, income_percap, CASE WHEN income_percap >= (SELECT quantile_cont(income_percap, 2.0 / 3) FROM panel) THEN 'high'
              WHEN income_percap >= (SELECT quantile_cont(income_percap, 1.0 / 3) FROM panel) THEN 'mid' ELSE 'low' END AS third FROM panel""",
    ("panel",),
)
def _(t):
    return ops.quantile_bins(t.panel.select("id", "income_percap"), "income_percap", ("low", "mid", "high"), "third")


@query(
    "A9_conditional_median",
    f"""SELECT t.target, {r('median(temp)')} AS median FROM panel
        JOIN (VALUES (-2e1), (-1e1), (0e0), (1e1), (2e1), (3e1)) t(target) ON abs(wbgt - t.target) < 25e-2 GROUP BY t.target""",
    ("panel",),
)
def _(t):
    return rounded(ops.conditional_median(t.panel, "temp", "wbgt", range(-20, 31, 10), 0.25))


@query("A10_histogram", "SELECT cast(floor(wbgt / 1.0) AS double) AS bin, count(*) * 100 AS n FROM panel GROUP BY 1", ("panel",))
def _(t):
    return ops.histogram(t.panel, "wbgt", 1.0, scale=100)


HEX_SQL = """SELECT q, r, -q - r AS s, floor(q + 5e-1) AS nq, floor(r + 5e-1) AS nr, floor(-q - r + 5e-1) AS ns
   FROM (SELECT (sqrt(3e0) / 3 * lon - lat / 3) / (5e-1 / sqrt(3e0)) AS q, (2e0 / 3) * lat / (5e-1 / sqrt(3e0)) AS r FROM points) a"""


@query(
    "A11_hex_density",
    f"""SELECT cast(CASE WHEN abs(q - nq) > abs(r - nr) AND abs(q - nq) > abs(s - ns) THEN -nr - ns ELSE nq END AS bigint) AS hex_q,
               cast(CASE WHEN NOT (abs(q - nq) > abs(r - nr) AND abs(q - nq) > abs(s - ns)) AND abs(r - nr) > abs(s - ns) THEN -nq - ns ELSE nr END AS bigint) AS hex_r,
               count(*) AS n, {r('log10(count(*))')} AS log_n FROM ({HEX_SQL}) h GROUP BY 1, 2""",
    ("points",),
)
def _(t):
    return rounded(ops.hex_density(t.points, "lon", "lat", 0.5))


@query("A12_count_records", "SELECT coalesce(source, 'total') AS file, count(*) AS records FROM documents GROUP BY ROLLUP (source)")
def _(t):
    from moodgrid.sources.readers import count_records

    return count_records(t.documents, F.col("source"))


@query("A12_count_files", "SELECT coalesce(source, 'total') AS file, count(*) AS records FROM documents GROUP BY ROLLUP (source)")
def _(t):
    from moodgrid.sources.readers import count_records

    # One file for each source.
    folder = t.fresh_folder("by-source")
    t.documents.repartition("source").write.partitionBy("source").parquet(folder)
    counted = count_records(t.spark.read.schema(t.documents.schema).parquet(folder))
    named = F.regexp_extract("file", "source=([^/]*)/", 1)
    return counted.select(F.when(F.col("file") == "total", F.col("file")).otherwise(named).alias("file"), "records")


@query("A13_value_counts", "SELECT fips, count(*) AS n FROM panel GROUP BY fips ORDER BY n DESC, fips", ("panel",))
def _(t):
    return ops.value_counts(t.panel, "fips")


@query(
    "A14_covers_all",
    """WITH m AS (SELECT o_orderkey, o_custkey % 50 AS agency, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
       SELECT * FROM m WHERE agency IN (SELECT agency FROM m GROUP BY agency HAVING count(DISTINCT month) = (SELECT count(DISTINCT month) FROM m))""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("agency"), F.date_format("o_orderdate", "yyyy-MM").alias("month")
    )
    return ops.covers_all(rows, "agency", "month", rows)


@query(
    "A15_widen",
    f"""SELECT replicate, {r("max(estimate) FILTER (term = 'wbgt')")} AS wbgt, {r("max(estimate) FILTER (term = 'wbgt_10')")} AS wbgt_10
        FROM coefs GROUP BY replicate""",
    ("coefs",),
)
def _(t):
    return rounded(ops.widen(t.coefs, ["replicate"], "term", "estimate", ["wbgt", "wbgt_10"]))


@query(
    "A15_lengthen",
    f"""SELECT id, key, {r('value')} AS value FROM (
          SELECT id, 'afinn' AS key, afinn AS value FROM panel UNION ALL SELECT id, 'hedono', hedono FROM panel
          UNION ALL SELECT id, 'vader', vader FROM panel) u""",
    ("panel",),
)
def _(t):
    return rounded(ops.lengthen(t.panel, ["id"], SCORES))
