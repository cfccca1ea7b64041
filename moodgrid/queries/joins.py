"""Join queries (inventory J1 to J14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.operators import joins as ops
from moodgrid.operators import spatial
from moodgrid.queries.fixtures import literal_rows
from moodgrid.queries.registry import query, r, rounded

POST_KEY = ["id", "tweet_created_at"]


@query(
    "J1_left_chain",
    f"""SELECT id, tweet_created_at, {r('temp')} AS temp, {r('vader')} AS vader, income_percap, depress_term
        FROM weather LEFT JOIN sentiment USING (id, tweet_created_at) LEFT JOIN census USING (id, tweet_created_at)
        LEFT JOIN (SELECT * FROM depressive WHERE depress_term = 1) d USING (id, tweet_created_at)""",
    ("weather", "sentiment", "census", "depressive"),
)
def _(t):
    flagged = t.depressive.filter("depress_term = 1")
    out = ops.left_chain(t.weather, [t.sentiment, t.census, flagged], POST_KEY)
    return rounded(out.select(*POST_KEY, "temp", "vader", "income_percap", "depress_term"))


@query(
    "J2_inner_join",
    """SELECT o_orderkey, l_linenumber, l_quantity, o_orderpriority, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    bought = lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), ["o_orderkey"])
    placed = bought.join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return placed.join(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"]).drop("n_nationkey", "c_custkey")


@query(
    "J2_inner_join_two_keys",
    "SELECT p.id, p.fips, p.year, p.dow, population FROM panel p JOIN population USING (fips, year)",
    ("panel", "population"),
)
def _(t):
    return t.panel.select("id", "fips", "year", "dow").join(t.population, ["fips", "year"], "inner")


@query(
    "J3_full_outer_join",
    """SELECT fips, date, nibrs, cod FROM
         (SELECT lpad(cast(fips AS string), 5, '0') AS fips, date, count(*) AS nibrs FROM nibrs GROUP BY 1, 2) a
         FULL JOIN (SELECT substr(census_block, 1, 5) AS fips, substr(date_single, 1, 10) AS date, count(*) AS cod FROM cod GROUP BY 1, 2) b
         USING (fips, date)""",
    ("nibrs", "cod"),
)
def _(t):
    one = t.nibrs.groupBy(F.lpad(F.col("fips").cast("string"), 5, "0").alias("fips"), "date").agg(F.count("*").alias("nibrs"))
    two = t.cod.groupBy(F.substring("census_block", 1, 5).alias("fips"), F.substring("date_single", 1, 10).alias("date")).agg(
        F.count("*").alias("cod")
    )
    return ops.merge_many([one, two], ["fips", "date"], "full_outer")


@query(
    "J4_merge_many",
    """SELECT nationkey, customers, suppliers, n_name FROM
         (SELECT c_nationkey AS nationkey, count(*) AS customers FROM customer GROUP BY 1) c
         JOIN (SELECT s_nationkey AS nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s USING (nationkey)
         JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation) n USING (nationkey)""",
)
def _(t):
    frames = [
        t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers")),
        t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers")),
        t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name"),
    ]
    return ops.merge_many(frames, ["nationkey"])


@query(
    "J5_semi_join",
    "SELECT event_id, user_id FROM points WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    ("points",),
)
def _(t):
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return ops.matching(t.points.select("event_id", "user_id"), toxic, ["user_id"])


@query("J5_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(t):
    active = t.events.select(F.col("user_id").alias("c_custkey"))
    return ops.missing(t.customer.select("c_custkey", "c_name"), active, ["c_custkey"])


@query(
    "J6_lookup_join",
    """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' WHEN 'error' THEN 'Error' END AS label
       FROM events""",
)
def _(t):
    names = literal_rows(t, [("click", "Click"), ("view", "View"), ("error", "Error")], "event_type string, label string")
    return ops.lookup_join(t.events.select("event_id", "event_type"), names, ["event_type"], "left")


@query(
    "J6_salted_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return ops.salted_join(lines, brands, ["l_partkey"], "left", ["l_orderkey", "l_linenumber"])


def tiles(t):
    """One-degree rectangles over the covered area, as rings."""
    corner = {"x0": "cast(-125 + id % 58 AS double)", "y0": "cast(25 + floor(id / 58) AS double)"}
    boxes = t.spark.range(24 * 58).selectExpr("1000 * (floor(id / 58) + 1) + id % 58 AS fips", *(f"{e} AS {n}" for n, e in corner.items()))
    ring = "array(struct(x0 AS x, y0 AS y), struct(x0 + 1 AS x, y0 AS y), struct(x0 + 1 AS x, y0 + 1 AS y), struct(x0 AS x, y0 + 1 AS y))"
    return boxes.selectExpr("fips", f"{ring} AS ring")


@query(
    "J7_point_in_polygon",
    """SELECT id, lon, lat, cast(1000 * (floor(lat) - 25 + 1) + (floor(lon) + 125) AS bigint) AS fips FROM points""",
    ("points",),
)
def _(t):
    return spatial.point_in_polygon(t.points.select("id", "lon", "lat"), tiles(t), ids=["id"])


@query(
    "J7_point_in_polygon_left",
    """SELECT id, lon, lat, CASE WHEN lat - floor(lat) + (lon - floor(lon)) * 9973e-4 < 9973e-4
              THEN cast(1000 * (floor(lat) - 25 + 1) + (floor(lon) + 125) AS bigint) END AS fips FROM points""",
    ("points",),
)
def _(t):
    # Lower-left triangles: half of every tile belongs to no polygon.
    corners = [F.col("ring")[0], F.col("ring")[1]]
    apex = F.struct(F.col("ring")[0]["x"].alias("x"), (F.col("ring")[0]["y"] + F.lit(0.9973)).alias("y"))
    triangles = tiles(t).select("fips", F.array(*corners, apex).alias("ring"))
    return spatial.point_in_polygon(t.points.select("id", "lon", "lat"), triangles, how="left", ids=["id"])


STORES = "-125 + (c_custkey * 37 % 5700) / 100 AS x0, 25 + (c_custkey * 53 % 2300) / 100 AS y0"


@query(
    "J8_centroid_within",
    f"""SELECT c_custkey, {r('x0 + 55e-3')} AS cx, {r('y0 + 35e-3')} AS cy, n_nationkey
        FROM (SELECT c_custkey, {STORES} FROM customer) c LEFT JOIN nation
        ON x0 + 55e-3 >= -125 + n_nationkey * 2 AND x0 + 55e-3 < -125 + n_nationkey * 2 + 2 AND y0 + 35e-3 < 40""",
)
def _(t):
    homes = t.customer.selectExpr("c_custkey", *STORES.split(", ")).selectExpr(
        "c_custkey",
        "array(struct(x0 AS x, y0 AS y), struct(x0 + 11e-2 AS x, y0 AS y), struct(x0 + 11e-2 AS x, y0 + 7e-2 AS y), struct(x0 AS x, y0 + 7e-2 AS y)) AS ring",
    )
    regions = t.nation.selectExpr("n_nationkey", "cast(-125 + n_nationkey * 2 AS double) AS x0").selectExpr(
        "n_nationkey",
        "array(struct(x0 AS x, 2e1 AS y), struct(x0 + 2 AS x, 2e1 AS y), struct(x0 + 2 AS x, 4e1 AS y), struct(x0 AS x, 4e1 AS y)) AS ring",
    )
    return rounded(spatial.centroid_within(homes, regions, ["c_custkey"]))


GRID_SQL = """SELECT date_trunc('hour', tweet_created_at + INTERVAL 1 HOUR) AS hour,
   cast(floor((lat - 25) / 125e-3) AS bigint) AS row, cast(floor((lon + 125) / 125e-3) AS bigint) AS col, max(value) AS temp
   FROM points GROUP BY 1, 2, 3"""


@query(
    "J9_grid_lookup",
    f"""SELECT p.id, g.temp FROM points p LEFT JOIN ({GRID_SQL}) g ON g.hour = date_trunc('hour', p.tweet_created_at)
        AND g.row = floor((p.lat - 25) / 125e-3) AND g.col = floor((p.lon + 125) / 125e-3)""",
    ("points",),
)
def _(t):
    later = t.points.withColumn("at", F.expr("tweet_created_at + INTERVAL 1 HOUR"))
    grid = (
        later.groupBy(
            F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour"),
            spatial.cell_of(F.col("lat") - 25, 0.125).alias("row"),
            spatial.cell_of(F.col("lon") + 125, 0.125).alias("col"),
        )
        .agg(F.max("value").alias("temp"))
    )
    return spatial.grid_lookup(t.points, grid, "tweet_created_at", 0.125, -125.0, 25.0).select("id", "temp")


@query(
    "J10_daily_grid_lookup",
    """WITH g AS (SELECT cast(tweet_created_at AS date) AS day, cast(floor((lat - 25) / 25e-2) AS bigint) AS row,
                         cast(floor((lon + 125) / 25e-2) AS bigint) AS col, max(value) / 7 AS ppt FROM points GROUP BY 1, 2, 3)
       SELECT p.id, (round(g.ppt, 2) + 0.0) AS ppt FROM points p LEFT JOIN g
       ON g.day = cast(CASE WHEN hour(tweet_created_at) < 12 THEN cast(tweet_created_at AS date) ELSE cast(tweet_created_at AS date) + 1 END AS date)
       AND g.row = floor((p.lat - 25) / 25e-2) AND g.col = floor((p.lon + 125) / 25e-2)""",
    ("points",),
)
def _(t):
    grid = (
        t.points.groupBy(
            F.col("tweet_created_at").cast("date").alias("day"),
            spatial.cell_of(F.col("lat") - 25, 0.25).alias("row"),
            spatial.cell_of(F.col("lon") + 125, 0.25).alias("col"),
        ).agg((F.max("value") / 7).alias("ppt"))
    )
    out = spatial.daily_grid_lookup(t.points, grid, "tweet_created_at", 0.25, -125.0, 25.0, ["ppt"])
    return rounded(out.select("id", "ppt"))


RASTER_SQL = """SELECT CASE WHEN user_id % 2 = 0 THEN 2011 ELSE 2016 END AS vintage, cast(trunc((lat * 1000 - 25000) / 30) AS bigint) AS row,
   cast(trunc((lon * 1000 + 125000) / 30) AS bigint) AS col, max(event_id % 95) AS landcover FROM points GROUP BY 1, 2, 3"""


@query(
    "J11_vintage_lookup",
    f"""SELECT p.id, q.landcover FROM points p LEFT JOIN ({RASTER_SQL}) q
        ON q.vintage = CASE WHEN 2009 + event_id % 10 < 2014 THEN 2011 ELSE 2016 END
        AND q.row = trunc((p.lat * 1000 - 25000) / 30) AND q.col = trunc((p.lon * 1000 + 125000) / 30)""",
    ("points",),
)
def _(t):
    projected = t.points.withColumns({"x": F.col("lon") * 1000, "y": F.col("lat") * 1000})
    raster = projected.groupBy(
        F.when(F.col("user_id") % 2 == 0, F.lit(2011)).otherwise(F.lit(2016)).alias("vintage"),
        ((F.col("y") - 25000) / 30).cast("long").alias("row"),
        ((F.col("x") + 125000) / 30).cast("long").alias("col"),
    ).agg(F.max(F.col("event_id") % 95).alias("landcover"))
    year = F.lit(2009) + F.col("event_id") % 10
    return spatial.vintage_lookup(projected, raster, year, -125000.0, 25000.0, 30.0, 30.0).select("id", "landcover")


NUDGE = "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 12345 END"


@query(
    "J12_fuzzy_key_join",
    f"""WITH a AS (SELECT date_trunc('hour', tweet_created_at) AS hour, cast(1000000000 + event_id * 7919 AS string) AS id FROM points),
             b AS (SELECT date_trunc('hour', tweet_created_at) AS hour, cast(1000000000 + event_id * 7919 + {NUDGE} AS string) AS bid, value FROM points),
             m AS (SELECT a.hour, a.id, b.bid, b.value, levenshtein(a.id, b.bid) AS d,
                          row_number() OVER (PARTITION BY a.hour, a.id ORDER BY levenshtein(a.id, b.bid), b.bid) AS k
                   FROM a LEFT JOIN b ON a.hour = b.hour)
        SELECT hour, id, bid AS matched_id, cast(d AS int) AS edit_distance, value FROM m WHERE k = 1""",
    ("points",),
)
def _(t):
    hour = F.date_trunc("hour", "tweet_created_at").cast("timestamp_ntz").alias("hour")
    left = t.points.select(hour, F.expr("cast(1000000000 + event_id * 7919 AS string) AS id"))
    right = t.points.select(hour, F.expr(f"cast(1000000000 + event_id * 7919 + {NUDGE} AS string) AS id"), "value")
    return ops.nearest_key_join(left, right, ["hour"], "id", "matched_id")


@query(
    "J13_densify",
    """WITH g AS (SELECT user_id, cast(unnest(range(timestamp '2024-01-01', timestamp '2024-02-01', INTERVAL 1 DAY)) AS date) AS day
                  FROM (SELECT DISTINCT user_id FROM events) u)
       SELECT user_id, day, n FROM g LEFT JOIN (SELECT user_id, cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1, 2) e
       USING (user_id, day)""",
)
def _(t):
    daily = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return ops.densify(daily, "user_id", "day", F.lit("2024-01-01"), F.lit("2024-01-31"))


@query(
    "J14_expand_grid",
    """SELECT c_custkey, w.w AS wbgt, o.o AS outcome FROM customer, (VALUES (-20), (5), (30)) w(w), (VALUES ('vader'), ('afinn')) o(o)""",
)
def _(t):
    return ops.expand_grid(t.customer.select("c_custkey"), {"wbgt": [-20, 5, 30], "outcome": ["vader", "afinn"]})
