"""Whole compositions (inventory Q1 to Q16), each one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.functions import recode
from moodgrid.plans import outcomes, panel, specs
from moodgrid.plans.curves import predict_curve
from moodgrid.functions.basis import piecewise
from moodgrid.queries.columns import (
    CPI_SQL,
    OTHER_SQL,
    RACE_COUNTS,
    RH_SQL,
    SUN_SQL,
    heat_index_sql,
    hourly_sql,
    race_counts,
    rh_vpd_sql,
    wbgt_sql,
)
from moodgrid.queries.fixtures import literal_rows
from moodgrid.queries.joins import tiles
from moodgrid.queries.registry import query, r, rounded
from moodgrid.queries.windows import DENSE_SQL, EVENT_REGIONS, FIRST, LAST, ROLL
from moodgrid.sources.readers import parse_epoch_ms
from moodgrid.sources.writers import write_partitioned


def repeated(df):
    """One to three copies of every row, by its id."""
    return df.withColumn("copy", F.explode(F.expr("sequence(0L, cast(id AS bigint) % 3)"))).drop("copy")


@query(
    "Q1_build_panel",
    f"""SELECT {r('temp')} AS temp, prcp, srad, weather_term, {r('afinn')} AS afinn, {r('hedono')} AS hedono, {r('vader')} AS vader,
               income_percap, race_white, race_black,
               CASE greatest(race_white, race_black, race_other, race_hisp) WHEN race_white THEN 'race_white' WHEN race_black THEN 'race_black'
                    WHEN race_other THEN 'race_other' ELSE 'race_hisp' END AS race_majority,
               fips, dow, doy, tod, year, depress_term, substr(fips, 1, 2) || '-' || substr(doy, 1, 2) AS statemonth
        FROM weather JOIN sentiment USING (id, tweet_created_at) JOIN census USING (id, tweet_created_at)
        JOIN localtime USING (id, tweet_created_at) JOIN depressive USING (id, tweet_created_at)
        WHERE hedono IS NOT NULL AND tod <> 'EST'""",
    ("weather", "sentiment", "census", "localtime", "depressive"),
)
def _(t):
    w = repeated(t.weather.select("id", "tweet_created_at", "temp", "prcp", "srad"))
    return rounded(panel.build_panel(w, repeated(t.sentiment), t.census, repeated(t.localtime), repeated(t.depressive)))


RH_PCT = f"(1e2 * {RH_SQL})"


@query(
    "Q2_weather_features",
    f"""SELECT id, tweet_created_at, {r('temp')} AS temp, prcp, srad, {r(wbgt_sql('rh'))} AS wbgt, {heat_index_sql('temp', 'rh', 0)} + 0.0 AS temp_hi
        FROM (SELECT *, {RH_PCT} AS rh FROM weather) w""",
    ("weather",),
)
def _(t):
    return rounded(panel.weather_features(repeated(t.weather)))


DAILY_HI = f"""(SELECT *, {heat_index_sql('tmax', rh_vpd_sql('tmax', 'vpdmax'), 2)} AS tmax_hi,
    {heat_index_sql('tmin', rh_vpd_sql('tmin', 'vpdmin'), 2)} AS tmin_hi FROM daily)"""


@query(
    "Q3_daily_weather_features",
    f"""SELECT d.id, tweet_created_at, ppt, {r(hourly_sql('hour(tweet_created_at)', 'tmax', 'tmin', 'rise', 'sunset'))} AS temp,
               {r(hourly_sql('hour(tweet_created_at)', 'tmax_hi', 'tmin_hi', 'rise', 'sunset'))} AS temp_hi, {r('tmax_hi')} AS tmax_hi
        FROM {DAILY_HI} d JOIN (SELECT id, floor(rise) AS rise, floor(sunset) AS sunset FROM ({SUN_SQL}) s) n USING (id)""",
    ("daily", "points"),
)
def _(t):
    # The daily table lost the last digit of its ids on the way.
    changed = t.daily.withColumn("id", F.concat(F.col("id"), F.lit("0"))).drop("lat", "lon")
    return rounded(panel.daily_weather_features(t.points, repeated(changed)))


def tile_survey(t):
    """Survey rows of every tile and vintage from the customers living there."""
    counts = race_counts(t).withColumn("geoid", F.expr("1000 * (1 + c_custkey % 24) + c_custkey * 7 % 58"))
    names = [c for c in RACE_COUNTS]
    grouped = counts.groupBy("geoid").agg(
        *(F.sum(c).alias(c) for c in names), F.avg(F.col("c_custkey") % 90 * 1000 + 5000).alias("income")
    )
    years = F.explode(F.array(*(F.lit(y) for y in sorted(recode.TO_2019))))
    return grouped.withColumn("survey_year", years)


TILE_SQL = f"""(SELECT 1000 * (1 + c_custkey % 24) + c_custkey * 7 % 58 AS geoid, avg(c_custkey % 90 * 1000 + 5000) AS income,
   {', '.join(f'sum({e}) AS {n}' for n, e in RACE_COUNTS.items())} FROM customer GROUP BY 1)"""


@query(
    "Q4_census_features",
    f"""WITH p AS (SELECT id, tweet_created_at - to_years(cast(event_id % 16 AS int)) AS tweet_created_at, lon, lat,
                         cast(1000 * (floor(lat) - 24) + floor(lon) + 125 AS bigint) AS geoid FROM points),
             y AS (SELECT *, CASE WHEN year(tweet_created_at) < 2017 THEN year(tweet_created_at) + 2 ELSE 2018 END AS survey_year FROM p)
        SELECT id, y.tweet_created_at, {r('lon')} AS lon, {r('lat')} AS lat, cast(y.survey_year AS int) AS survey_year, s.geoid, {r('white / nullif(race_total, 0)')} AS race_white,
               {r('black / nullif(race_total, 0)')} AS race_black, {r(OTHER_SQL + ' / nullif(race_total, 0)')} AS race_other,
               {r('hisp / nullif(race_total, 0)')} AS race_hisp, {r(f'income * {CPI_SQL}')} AS income_percap
        FROM y LEFT JOIN {TILE_SQL} s ON s.geoid = y.geoid AND y.survey_year BETWEEN 2011 AND 2018""",
    ("points",),
)
def _(t):
    earlier = t.points.selectExpr(
        "id", "tweet_created_at - make_ym_interval(cast(event_id % 16 AS int), 0) AS tweet_created_at", "lon", "lat"
    )
    years = F.explode(F.array(*(F.lit(y) for y in sorted(recode.TO_2019))))
    areas = tiles(t).withColumnRenamed("fips", "geoid").withColumn("survey_year", years)
    return rounded(panel.census_features(earlier, areas, tile_survey(t)))


@query(
    "Q5_local_time_features",
    """WITH z AS (SELECT lpad(cast(fips_state AS string), 2, '0') || lpad(cast(fips_county AS string), 3, '0') AS fips, id, tweet_created_at FROM county),
        l AS (SELECT z.*, (tweet_created_at AT TIME ZONE 'UTC') AT TIME ZONE tz AS lt FROM z LEFT JOIN zones USING (fips))
       SELECT fips, id, tweet_created_at, strftime(lt, '%A') AS dow, strftime(lt, '%m-%d') AS doy, substr(strftime(lt, '%H:%M'), 1, 4) AS tod,
              cast(date_diff('day', date '2009-01-01', cast(lt AS date)) AS int) AS daynum, cast(year(lt) AS int) AS year FROM l""",
    ("county", "zones"),
)
def _(t):
    return panel.local_time_features(t.county, t.zones)


COUNTY_ROWS = """SELECT c_custkey AS fips, c_acctbal + 1000 AS population, c_acctbal / 9 AS black,
   CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey END AS csa_id, CASE WHEN c_custkey % 5 <> 0 THEN 100 + c_custkey % 40 END AS msa_id FROM {customer}"""


@query(
    "Q6_city_regions",
    f"""WITH j AS (SELECT * FROM ({COUNTY_ROWS.replace('{customer}', 'customer')}) c WHERE csa_id IS NOT NULL OR msa_id IS NOT NULL),
        k AS (SELECT *, CASE WHEN csa_id IS NOT NULL THEN sum(population) OVER (PARTITION BY csa_id) END AS cp,
                     CASE WHEN csa_id IS NOT NULL THEN sum(black) OVER (PARTITION BY csa_id) END AS cb,
                     CASE WHEN msa_id IS NOT NULL THEN sum(population) OVER (PARTITION BY msa_id) END AS mp,
                     CASE WHEN msa_id IS NOT NULL THEN sum(black) OVER (PARTITION BY msa_id) END AS mb FROM j)
        SELECT fips, cast(coalesce(csa_id, msa_id) AS bigint) AS id, {r('coalesce(cp, mp)', 4)} AS pop, {r('coalesce(cb, mb) / coalesce(cp, mp)', 4)} AS black
        FROM k WHERE cp > 200000 OR mp > 200000""",
)
def _(t):
    counties = t.spark.sql(COUNTY_ROWS, customer=t.customer)
    return rounded(outcomes.city_regions(counties, 200_000), 4)


@query(
    "Q7_crime_incidents",
    """WITH a AS (SELECT 'A' || n_nationkey AS agency_id, 1000 + n_nationkey AS fips FROM nation WHERE n_regionkey < 3
                  UNION ALL SELECT 'A' || n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 18091 WHEN 1 THEN 27137 END FROM nation WHERE n_regionkey >= 3),
        i AS (SELECT cast(o_orderkey AS string) AS incident_id, 'A' || (o_custkey % 25) AS agency_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
                     cast(o_custkey % 24 AS int) AS hour, CASE WHEN o_orderstatus = 'F' THEN 'R' END AS report_date_flag FROM orders),
        o AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS offense_id, cast(l_orderkey AS string) AS incident_id,
                     cast(l_partkey % 10 AS int) AS offense_type_id, cast(l_suppkey % 5 AS int) AS location_id FROM lineitem),
        j AS (SELECT o.*, i.agency_id, date, hour, report_date_flag, a.fips, substr(date, 1, 7) AS month,
                     CASE location_id WHEN 0 THEN 'road' WHEN 1 THEN 'home' WHEN 2 THEN 'shop' END AS location_name,
                     CASE WHEN offense_type_id < 8 THEN 'type ' || offense_type_id END AS offense_name
              FROM o LEFT JOIN i USING (incident_id) LEFT JOIN a ON a.agency_id = i.agency_id)
       SELECT * FROM j WHERE agency_id IN (SELECT agency_id FROM j GROUP BY agency_id HAVING count(DISTINCT month) =
              (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders))""",
)
def _(t):
    nations = t.nation.withColumn("agency_id", F.concat(F.lit("A"), F.col("n_nationkey").cast("string")))
    old = nations.filter("n_regionkey < 3").select("agency_id", (F.lit(1000) + F.col("n_nationkey")).alias("fips"))
    # New-layout agencies name their county; half of them repeat old ones.
    new = nations.selectExpr(
        "agency_id",
        "CASE n_nationkey % 3 WHEN 0 THEN 'IN' WHEN 1 THEN 'MN' ELSE 'NB' END AS state_abbr",
        "concat('A; B; ', CASE n_nationkey % 3 WHEN 0 THEN 'LA PORTE' WHEN 1 THEN 'ST LOUIS' ELSE 'OTHER' END) AS county_name",
    )
    counties = literal_rows(t, [("IN", "LAPORTE", 18091), ("MN", "ST. LOUIS", 27137)], "state_abbr string, county_name string, fips int")
    agencies = outcomes.agency_counties(old, new, counties)
    incidents = t.orders.selectExpr(
        "cast(o_orderkey AS string) AS incident_id", "concat('A', o_custkey % 25) AS agency_id",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS date", "cast(o_custkey % 24 AS int) AS hour",
        "CASE WHEN o_orderstatus = 'F' THEN 'R' END AS report_date_flag",
    )
    offenses = t.lineitem.selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS offense_id", "cast(l_orderkey AS string) AS incident_id",
        "cast(l_partkey % 10 AS int) AS offense_type_id", "cast(l_suppkey % 5 AS int) AS location_id", "l_returnflag",
    )
    upper = lambda df: df.select(*(F.col(c).alias(c.upper()) for c in df.columns))
    tables = outcomes.incident_tables(
        {"inc": incidents.filter("report_date_flag IS NULL").drop("report_date_flag"), "off": offenses.filter("l_returnflag = 'A'").drop("l_returnflag")},
        {"inc": upper(incidents.filter("report_date_flag = 'R'")), "off": upper(offenses.filter("l_returnflag <> 'A'").drop("l_returnflag"))},
    )
    locations = literal_rows(t, [(0, "road"), (1, "home"), (2, "shop")], "location_id int, location_name string")
    types = literal_rows(t, [(i, f"type {i}") for i in range(8)], "offense_type_id int, offense_name string")
    months = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return outcomes.crime_incidents(agencies, [tables["inc"]], [tables["off"]], locations, types, months)


# Written out, so that the check does not lean on the code's own lists.
VIOLENT_ONE = """('Homicide Offenses', 'Animal Cruelty', 'Arson', 'Assault Offenses', 'Burglary/Breaking & Entering',
                'Destruction/Damage/Vandalism of Property', 'Kidnapping/Abduction', 'Robbery')"""
VIOLENT_TWO = """('arson', 'assault offenses', 'burglary/breaking & entering', 'destruction/damage/vandalism of property',
                'kidnapping/abduction', 'robbery', 'homicide offenses')"""
COUNTY_DAY_SQL = f"""n AS (SELECT lpad(cast(fips AS string), 5, '0') AS fips, date, count(*) FILTER (offense_category_name = 'Homicide Offenses') AS homicides_nibrs,
            count(*) FILTER (offense_category_name = 'Assault Offenses') AS assault_nibrs,
            count(*) FILTER (offense_category_name IN {VIOLENT_ONE}) AS violent_nibrs FROM nibrs WHERE fips IS NOT NULL GROUP BY 1, 2),
   c AS (SELECT substr(census_block, 1, 5) AS fips, substr(date_single, 1, 10) AS date, count(*) FILTER (offense_group = 'homicide offenses') AS homicides_cod,
            count(*) FILTER (offense_group = 'assault offenses') AS assault_cod,
            count(*) FILTER (offense_group IN {VIOLENT_TWO}) AS violent_cod FROM cod GROUP BY 1, 2),
   b AS (SELECT *, cast(substr(date, 1, 4) AS int) AS year FROM n FULL JOIN c USING (fips, date))"""


@query(
    "Q8_crime_county_day",
    f"WITH {COUNTY_DAY_SQL} SELECT b.*, population FROM b LEFT JOIN population p ON p.fips = b.fips AND p.year = b.year",
    ("nibrs", "cod", "population"),
)
def _(t):
    return outcomes.crime_county_day(t.nibrs, t.cod, t.population)


def state_mood(t):
    return t.panel.groupBy("state", F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        *(F.avg(c).alias(c) for c in outcomes.SCORES), F.count("*").alias("n")
    )


def dated(df):
    at = F.to_date("date")
    return df.withColumns(
        {"dow": F.dayofweek(at), "doy": F.date_format(at, "MM-dd"), "month": F.month(at), "state": F.substring("fips", 1, 2)}
    )


@query("Q9_crime_models_day")
def _(t):
    county_day = t.stored(dated(outcomes.crime_county_day(t.nibrs, t.cod, t.population)), "county_day", shuffled=True)
    out = outcomes.crime_models(county_day, state_mood(t), ["state", "date"], 1, ["dow", "doy", "year", "month", "state"])
    return rounded(out.select("outcome", "predictor", "statistic", "aic"), 3)


@query(
    "Q9_crime_county_hour",
    """SELECT lpad(cast(fips AS string), 5, '0') AS fips, date, hour, count(*) FILTER (offense_category_name = 'Homicide Offenses') AS homicides,
              count(*) FILTER (offense_category_name = 'Assault Offenses') AS assault,
              count(*) FILTER (offense_category_name IN ('Homicide Offenses', 'Animal Cruelty', 'Arson', 'Assault Offenses',
                'Burglary/Breaking & Entering', 'Destruction/Damage/Vandalism of Property', 'Kidnapping/Abduction', 'Robbery')) AS violent
       FROM nibrs WHERE fips IS NOT NULL AND hour IS NOT NULL AND report_date_flag IS NULL GROUP BY 1, 2, 3""",
    ("nibrs",),
)
def _(t):
    return outcomes.crime_county_hour(t.nibrs)


@query(
    "Q9_crime_undated",
    """SELECT lpad(cast(fips AS string), 5, '0') AS fips, date, count(*) AS reported FROM nibrs
       WHERE fips IS NOT NULL AND (hour IS NULL OR report_date_flag IS NOT NULL) GROUP BY 1, 2""",
    ("nibrs",),
)
def _(t):
    return outcomes.crime_without_hour(t.nibrs)


@query("Q9_crime_models_hour")
def _(t):
    hour = F.split("tod", ":")[0].cast("int").alias("hour")
    day = F.date_format("date", "yyyy-MM-dd").alias("date")
    mood = t.panel.groupBy("fips", day, hour).agg(*(F.avg(c).alias(c) for c in outcomes.SCORES))
    rows = t.stored(outcomes.hourly_crime_rows(outcomes.crime_county_hour(t.nibrs), mood, t.population), "county_hour", shuffled=True)
    fits = outcomes.hourly_crime_models(rows)
    return rounded(fits.select("outcome", "predictor", "statistic"), 3)


@query(
    "Q10_suicide_county_month",
    f"""SELECT d.fips AS county, d.year, d.month, deaths, population, {r('vader', 5)} AS vader FROM deaths d LEFT JOIN population p ON p.fips = d.fips AND p.year = d.year
        LEFT JOIN (SELECT fips, year, substr(statemonth, 4, 2) AS month, avg(vader) AS vader FROM panel GROUP BY 1, 2, 3) m
        ON m.fips = d.fips AND m.year = d.year AND m.month = d.month WHERE deaths IS NOT NULL""",
    ("deaths", "population", "panel"),
)
def _(t):
    deaths = outcomes.deaths_with_population(
        t.deaths.withColumnRenamed("fips", "county"), t.population.withColumnRenamed("fips", "county")
    )
    mood = outcomes.county_month_mood(t.panel, with_dow=False).select(F.col("fips").alias("county"), "month", "year", "vader")
    joined = deaths.join(mood, ["county", "month", "year"], "left")
    return rounded(joined.select("county", "year", "month", "deaths", "population", "vader"), 5)


@query("Q10_death_rate_line")
def _(t):
    deaths = outcomes.deaths_with_population(
        t.deaths.withColumnRenamed("fips", "county"), t.population.withColumnRenamed("fips", "county")
    ).withColumnRenamed("county", "fips")
    return rounded(outcomes.death_rate_line(deaths, outcomes.county_month_mood(t.panel, with_dow=False)), 8)


@query("Q10_death_count_models")
def _(t):
    mood = outcomes.county_month_mood(t.panel).join(t.population, ["fips", "year"], "inner")
    rows = t.stored(mood, "mood", shuffled=True)
    deaths = t.stored(t.deaths, "deaths", shuffled=True)
    # The second outcome's first model also absorbs the counties.
    absorb = outcomes.DEATH_FACTORS
    fits = outcomes.death_count_models(deaths, rows).withColumn("factors", F.lit("state"))
    fits = fits.unionByName(outcomes.death_count_models(deaths, rows, "mort", ["hedono", "afinn"]).withColumn("factors", F.lit("state")))
    county = outcomes.death_count_models(deaths, rows, "mort", ["vader"], ["fips", *absorb]).withColumn("factors", F.lit("county"))
    return rounded(fits.unionByName(county).select("outcome", "predictor", "factors", "estimate", "statistic"), 3)


@query(
    "Q11_survey_link",
    f"""WITH {DENSE_SQL}, k AS (SELECT state, date, {ROLL}, afinn, hedono, vader FROM d
              WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
        s AS (SELECT state, cast(CASE WHEN menthlth = 88 THEN 0 ELSE menthlth END AS int) AS mh, cast(strptime(idate, '%m%d%Y') AS date) AS date
              FROM survey WHERE menthlth IS NOT NULL AND menthlth NOT IN (77, 99))
        SELECT s.state, s.date, mh, cast(mh > 0 AS int) AS mh_any, strftime(s.date, '%Y-%m') AS yearmonth, vader30, afinn30, hedono30
        FROM s JOIN k ON k.state = s.state AND k.date = s.date WHERE vader IS NOT NULL AND vader30 IS NOT NULL""",
    ("panel", "survey"),
)
def _(t):
    linked = outcomes.survey_link(t.survey, t.panel, F.lit(FIRST), F.lit(LAST))
    return rounded(linked.select("state", "date", "mh", "mh_any", "yearmonth", "vader30", "afinn30", "hedono30"))


@query("Q11_survey_models")
def _(t):
    linked = outcomes.survey_link(t.survey, t.panel, F.lit(FIRST), F.lit(LAST), keep=["o_orderkey"])
    return rounded(outcomes.survey_models(t.stored(linked, "linked", shuffled=True), ["o_orderkey"], replicates=100), 6)


@query("Q12_effect_comparison")
def _(t):
    rows = t.stored(specs.analysis_rows(t.panel))
    form = specs.spec("plain")
    coefs = specs.bootstrap_fit(rows, "vader", form, ["id"], replicates=80)
    grid = t.spark.range(5, 26, 20).select(F.col("id").cast("double").alias("wbgt"))
    heat = predict_curve(coefs, grid, piecewise("wbgt"), ["wbgt"]).groupBy("replicate").agg(
        (F.max(F.when(F.col("wbgt") == 25, F.col("value"))) - F.max(F.when(F.col("wbgt") == 5, F.col("value")))).alias("v")
    )
    ends = heat.agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p"))
    bands = ends.select(F.lit("heat").alias("label"), F.col("p")[0].alias("low"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("high"))
    return rounded(outcomes.effect_comparison(rows, ["id"], EVENT_REGIONS, "1998-06-15", 60, 100, bands))


@query(
    "Q13_weekday_profile",
    f"""WITH s AS (SELECT dow, sum(afinn) AS afinn, sum(hedono) AS hedono, sum(vader) AS vader FROM panel GROUP BY dow)
        SELECT dow, 'afinn' AS key, {r('(afinn - min(afinn) OVER ()) / (max(afinn) OVER () - min(afinn) OVER ())')} AS value FROM s UNION ALL
        SELECT dow, 'hedono', {r('(hedono - min(hedono) OVER ()) / (max(hedono) OVER () - min(hedono) OVER ())')} FROM s UNION ALL
        SELECT dow, 'vader', {r('1 - (vader - min(vader) OVER ()) / (max(vader) OVER () - min(vader) OVER ())')} FROM s""",
    ("panel",),
)
def _(t):
    return rounded(outcomes.weekday_profile(t.panel, ["afinn", "hedono", "vader"], ["vader"]))


@query(
    "Q14_urban_poverty",
    f"""SELECT poor, urban, {r('sum(black * 1e0 / race_total * race_total) / sum(race_total)')} AS blackness, count(*) AS n FROM (
          SELECT geoid, income < 50000 AS poor, race_total, black,
                 cast(EXISTS (SELECT 1 FROM nation WHERE (geoid % 1000) * 1e0 - 125 + 5e-1 >= n_nationkey * 2 - 125
                      AND (geoid % 1000) * 1e0 - 125 + 5e-1 < n_nationkey * 2 - 124 AND floor(geoid / 1000) < 15) AS int) AS urban
          FROM {TILE_SQL} s WHERE race_total > 0) u GROUP BY 1, 2""",
)
def _(t):
    strips = t.nation.selectExpr("cast(-125 + n_nationkey * 2 AS double) AS x0").selectExpr(
        "array(struct(x0 AS x, 2e1 AS y), struct(x0 + 1 AS x, 2e1 AS y), struct(x0 + 1 AS x, 39e0 AS y), struct(x0 AS x, 39e0 AS y)) AS ring"
    )
    survey = tile_survey(t).filter("survey_year = 2014 AND race_total > 0").select(
        "geoid", "income", "race_total", (F.col("black") / F.col("race_total")).alias("race_black")
    )
    areas = tiles(t).withColumnRenamed("fips", "geoid")
    return rounded(outcomes.urban_poverty(areas, strips, survey, 50_000))


@query(
    "Q15_neighbourhood_extract",
    f"""SELECT user_id, strftime(tweet_created_at, '%A') AS dow, {r('avg(value)')} AS value, {r('avg(income * 1.0627546e0)')} AS income_percap, count(*) AS n
        FROM (SELECT *, 10000 + user_id * 7919 % 60000 AS income FROM points) p
        WHERE lon BETWEEN -100 AND -80 AND lat BETWEEN 30 AND 45 GROUP BY 1, 2""",
    ("points",),
)
def _(t):
    rows = t.points.withColumns(
        {"income": F.expr("10000 + user_id * 7919 % 60000"), "dow": F.date_format("tweet_created_at", "EEEE")}
    )
    return rounded(panel.neighbourhood_extract(rows, (-100, 30, -80, 45), 2014, ["user_id", "dow"], ["value"]))


@query(
    "Q16_daily_hour_files",
    """SELECT id, strftime(tweet_created_at, '%Y%m%d') AS yyyymmdd, cast(hour(tweet_created_at) AS int) AS hour,
              date_trunc('milliseconds', tweet_created_at) AS created_at FROM points""",
    ("points",),
)
def _(t):
    ms = F.unix_millis(F.col("tweet_created_at").cast("timestamp")).cast("string")
    raw = t.points.select("id", F.concat(F.lit("{'$date': "), ms, F.lit("}")).alias("tweet_created_at"))
    folder = t.fresh_folder("hours")
    write_partitioned(parse_epoch_ms(raw).drop("tweet_created_at"), folder, ["yyyymmdd"], ["id"], 4)
    schema = "id string, created_at timestamp_ntz, hour int, yyyymmdd string"
    return t.spark.read.schema(schema).parquet(folder)

