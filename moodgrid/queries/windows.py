"""Window, set, sort and sampling queries (inventory W1 to W4, U1, U2, O1, M1 to M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.operators import sampling
from moodgrid.operators import windows as ops
from moodgrid.operators.aggregates import mean_by
from moodgrid.operators.joins import densify
from moodgrid.queries.registry import drawn_sql, query, r, rounded
from moodgrid.sources.readers import union_by_name

SCORES = ["afinn", "hedono", "vader"]
FIRST, LAST = "1995-01-01", "2001-12-31"

DENSE_SQL = f"""g AS (SELECT state, cast(unnest(range(timestamp '{FIRST}', timestamp '2002-01-01', INTERVAL 1 DAY)) AS date) AS date
                      FROM (SELECT DISTINCT state FROM panel) u),
   d AS (SELECT state, date, afinn, hedono, vader FROM g LEFT JOIN
         (SELECT state, date, avg(afinn) AS afinn, avg(hedono) AS hedono, avg(vader) AS vader FROM panel GROUP BY 1, 2) m USING (state, date))"""
ROLL = ", ".join(
    f"{r(f'CASE WHEN count(*) OVER w = 30 THEN avg({c}) OVER w END')} AS {c}30" for c in SCORES
)


@query(
    "W1_rolling_mean",
    f"""WITH {DENSE_SQL} SELECT state, date, {ROLL} FROM d
        WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    ("panel",),
)
def _(t):
    daily = mean_by(t.panel, ["state", "date"], SCORES)
    grid = densify(daily, "state", "date", F.lit(FIRST), F.lit(LAST))
    rolled = ops.rolling_mean(grid, "state", "date", SCORES)
    return rounded(rolled.select("state", "date", *(f"{c}30" for c in SCORES)))


GROUPED = "c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS csa_id, c_acctbal"


@query(
    "W2_group_total",
    f"""SELECT c_custkey, csa_id, {r('CASE WHEN csa_id IS NOT NULL THEN sum(c_acctbal) OVER (PARTITION BY csa_id) END')} AS csa_total
        FROM (SELECT {GROUPED} FROM customer) c""",
)
def _(t):
    rows = t.customer.selectExpr("c_custkey", "CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS csa_id", "c_acctbal")
    return rounded(ops.group_total(rows, "csa_id", {"csa_total": "c_acctbal"}).drop("c_acctbal"))


@query(
    "W3_baseline_shift",
    f"""WITH m AS (SELECT dow, floor(wbgt) AS x, avg(vader) AS v FROM panel GROUP BY 1, 2)
        SELECT dow, cast(x AS int) AS x, {r('v - max(CASE WHEN x = 5 THEN v END) OVER (PARTITION BY dow)')} AS v FROM m""",
    ("panel",),
)
def _(t):
    curve = t.panel.groupBy("dow", F.floor("wbgt").cast("int").alias("x")).agg(F.avg("vader").alias("v"))
    return rounded(ops.baseline_shift(curve, ["dow"], "x", "v", 5))


@query(
    "W4_first_per_key",
    """SELECT user_id, event_type, event_id, ts, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) e WHERE k = 1""",
)
def _(t):
    return ops.first_per_key(t.events.drop("props"), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "U1_union_by_name",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""",
)
def _(t):
    new = t.customer.select(
        F.col("c_custkey").alias("KEY"), F.col("c_name").alias("NAME"), F.col("c_acctbal").alias("ACCTBAL"), F.col("c_mktsegment").alias("SEGMENT")
    )
    old = t.supplier.select(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return union_by_name([new, old])


@query("U2_distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()


@query("O1_sort", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query(
    "O1_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def _(t):
    return ops.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query(
    "M1_sample_fraction",
    """SELECT id, fips, date FROM panel
       WHERE ('0x' || substr(md5(concat_ws('|', id, '1')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 1e-2""",
    ("panel",),
)
def _(t):
    return sampling.sample_fraction(t.panel, 0.01, ["id"]).select("id", "fips", "date")


@query(
    "M2_bootstrap_weights",
    f"""WITH {drawn_sql('panel', 'id', 1, 1, 8)} SELECT r::INT AS replicate, count(*) AS drawn, sum(k)::BIGINT AS total,
        {r('avg(k)')} AS mean_when_drawn FROM draw WHERE k > 0 GROUP BY r""",
    ("panel",),
)
def _(t):
    drawn = sampling.with_replicates(t.panel.select("id"), ["id"], 8)
    return rounded(
        drawn.groupBy("replicate").agg(
            F.count("*").alias("drawn"), F.sum("weight").alias("total"), F.avg("weight").alias("mean_when_drawn")
        )
    )


DIFF_SQL = f"""m AS (SELECT r, sum(k * vader) FILTER (g = 1) / sum(k) FILTER (g = 1) - sum(k * vader) FILTER (g = 2) / sum(k) FILTER (g = 2) AS v
                     FROM draw WHERE k > 0 GROUP BY r)
       SELECT {r('quantile_cont(v, 25e-3)')} AS low, {r('quantile_cont(v, 5e-1)')} AS mid, {r('quantile_cont(v, 975e-3)')} AS high FROM m"""


@query(
    "M3_bootstrap_mean_diff",
    f"""WITH days AS (SELECT id, vader, CASE dow WHEN 'Monday' THEN 1 ELSE 2 END AS g FROM panel WHERE dow IN ('Monday', 'Saturday') AND vader IS NOT NULL),
        {drawn_sql('days', 'id', 1, 1, 100)}, {DIFF_SQL}""",
    ("panel",),
)
def _(t):
    return rounded(sampling.bootstrap_mean_diff(t.panel, "dow", "vader", ("Monday", "Saturday"), ["id"], 100))


EVENT_REGIONS = tuple(f"{1000 * s + 1:05d}" for s in range(1, 25))


@query(
    "M4_event_window",
    f"""SELECT side, {r('avg(vader)')} AS vader, count(*) AS n FROM (
          SELECT vader, CASE WHEN date >= date '1998-06-15' THEN 'after' ELSE 'before' END AS side FROM panel
          WHERE fips IN ({', '.join(f"'{f}'" for f in EVENT_REGIONS)})
            AND date >= date '1998-06-15' - 60 AND date < date '1998-06-15' + 60) e GROUP BY side""",
    ("panel",),
)
def _(t):
    around = sampling.event_window(t.panel, "fips", EVENT_REGIONS, "date", "1998-06-15", 60)
    return rounded(mean_by(around, ["side"], ["vader"]))


@query(
    "M4_event_window_all_dates",
    f"""SELECT CASE WHEN date >= date '1998-06-15' THEN 'after' ELSE 'before' END AS side, {r('avg(vader)')} AS vader, count(*) AS n
        FROM panel WHERE fips IN ({', '.join(f"'{f}'" for f in EVENT_REGIONS)}) GROUP BY 1""",
    ("panel",),
)
def _(t):
    around = sampling.event_window(t.panel, "fips", EVENT_REGIONS, "date", "1998-06-15", compat=True)
    return rounded(mean_by(around, ["side"], ["vader"]))


@query(
    "M4_event_window_compare",
    f"""WITH around AS (SELECT id, vader, CASE WHEN date >= date '1998-06-15' THEN 2 ELSE 1 END AS g FROM panel
            WHERE fips IN ({', '.join(f"'{f}'" for f in EVENT_REGIONS)}) AND vader IS NOT NULL
              AND date >= date '1998-06-15' - 60 AND date < date '1998-06-15' + 60),
        {drawn_sql('around', 'id', 1, 1, 100)}, {DIFF_SQL}""",
    ("panel",),
)
def _(t):
    around = sampling.event_window(t.panel, "fips", EVENT_REGIONS, "date", "1998-06-15", 60)
    return rounded(sampling.bootstrap_mean_diff(around, "side", "vader", ("before", "after"), ["id"], 100))
