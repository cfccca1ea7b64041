"""Scalar-column queries (inventory P1 to P24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodgrid.functions import basis, clock, recode, weather
from moodgrid.operators.aggregates import rescale01
from moodgrid.queries.registry import query, r, rounded
from moodgrid.sources.readers import flatten_geo, parse_epoch_ms


@query(
    "P1_flatten_geo",
    """SELECT id, pure_text, CASE WHEN doc_id % 7 <> 0 THEN lon END AS lon,
              CASE WHEN doc_id % 7 <> 0 THEN lat END AS lat FROM posts""",
    ("posts",),
)
def _(t):
    spot = F.when(F.col("doc_id") % 7 != 0, F.struct(F.array("lon", "lat").alias("coordinates")))
    raw = t.posts.select("id", "pure_text", spot.alias("geo"), F.struct(F.col("id").alias("id")).alias("user"))
    return flatten_geo(raw)


@query(
    "P2_parse_epoch_ms",
    """SELECT id, date_trunc('milliseconds', tweet_created_at) AS created_at,
              strftime(tweet_created_at, '%Y%m%d') AS yyyymmdd, cast(hour(tweet_created_at) AS int) AS hour FROM points""",
    ("points",),
)
def _(t):
    ms = F.unix_millis(F.col("tweet_created_at").cast("timestamp")).cast("string")
    raw = t.points.select("id", F.concat(F.lit("{'$date': "), ms, F.lit("}")).alias("tweet_created_at"))
    return parse_epoch_ms(raw).drop("tweet_created_at")


@query("P3_drop_missing", "SELECT * FROM sentiment WHERE hedono IS NOT NULL", ("sentiment",))
def _(t):
    return t.sentiment.na.drop("any")


@query(
    "P4_recode_survey",
    """SELECT o_orderkey, state, CASE WHEN menthlth = 88 THEN 0 ELSE menthlth END AS mh,
              cast(strptime(idate, '%m%d%Y') AS date) AS date
       FROM survey WHERE menthlth IS NOT NULL AND menthlth NOT IN (77, 99)""",
    ("survey",),
)
def _(t):
    return t.survey.select(
        "o_orderkey",
        "state",
        recode.survey_days(F.col("menthlth")).alias("mh"),
        recode.mdy_date(F.col("idate")).alias("date"),
    ).na.drop("any")


@query(
    "P5_pad_fips",
    """SELECT DISTINCT fips_no, substr(cast(100000 + fips_no AS string), 2, 5) AS fips,
              substr(cast(100000 + fips_no AS string), 2, 2) AS state FROM ships""",
    ("ships",),
)
def _(t):
    fips = clock.pad_fips(F.col("fips_no"))
    return t.ships.select("fips_no", fips.alias("fips"), clock.state_of(fips).alias("state")).distinct()


@query(
    "P6_state_month",
    """SELECT id, substr(cast(100000 + fips_no AS string), 2, 2) || '-' || strftime(shipped, '%m') AS statemonth FROM ships""",
    ("ships",),
)
def _(t):
    doy = F.date_format("shipped", "MM-dd")
    return t.ships.select("id", clock.state_month(F.col("fips_no"), doy).alias("statemonth"))


@query(
    "P7_recode_names",
    """SELECT p_partkey, CASE WHEN string_split(p_name || '; ' || p_type, '; ')[-1] = 'ECONOMY' THEN 'BASIC'
              ELSE string_split(p_name || '; ' || p_type, '; ')[-1] END AS name FROM part""",
)
def _(t):
    last = recode.last_in_list(F.concat_ws("; ", "p_name", "p_type"))
    return t.part.select("p_partkey", recode.rename_values(last, {"ECONOMY": "BASIC"}).alias("name"))


@query(
    "P8_flags",
    f"SELECT id, prcp > 0 AS raining, {r('ln(income_percap)')} AS log_income, afinn > 0 AS mh_any FROM panel",
    ("panel",),
)
def _(t):
    return rounded(
        t.panel.select(
            "id",
            (F.col("prcp") > 0).alias("raining"),
            F.log("income_percap").alias("log_income"),
            (F.col("afinn") > 0).alias("mh_any"),
        )
    )


@query(
    "P9_exclude_terms",
    f"SELECT id, {r('wbgt')} AS wbgt, {r('vader')} AS vader FROM panel WHERE weather_term = 0 AND wbgt > 5",
    ("panel",),
)
def _(t):
    kept = t.panel.filter((F.col("weather_term") == 0) & (F.col("wbgt") > 5))
    return rounded(kept.select("id", "wbgt", "vader"))


CPI_SQL = """CASE survey_year WHEN 2011 THEN 1.134772e0 WHEN 2012 THEN 1.1161985e0 WHEN 2013 THEN 1.0969534e0
              WHEN 2014 THEN 1.0746823e0 WHEN 2015 THEN 1.0733538e0 WHEN 2016 THEN 1.0627546e0 WHEN 2017 THEN 1.0456737e0
              WHEN 2018 THEN 1.0164848e0 END"""


@query(
    "P10_income_to_2019",
    f"""SELECT id, survey_year, {r(f'income_percap * {CPI_SQL}')} AS income_2019 FROM (
          SELECT id, income_percap, CASE WHEN year + 14 < 2017 THEN year + 14 + 2 ELSE 2018 END AS survey_year FROM panel) s""",
    ("panel",),
)
def _(t):
    dated = t.panel.select("id", "income_percap", recode.survey_year(F.col("year") + 14).alias("survey_year"))
    money = recode.to_2019_money(F.col("income_percap"), F.col("survey_year"))
    return rounded(dated.select("id", "survey_year", money.alias("income_2019")))


RACE_COUNTS = {
    "race_total": "CASE WHEN c_custkey % 40 = 0 THEN 0 ELSE 100 + c_custkey % 900 END",
    "white": "c_custkey * 7 % 60",
    "black": "c_custkey * 5 % 40",
    "hisp": "c_custkey * 3 % 30",
    "indian": "c_custkey % 3",
    "asian": "c_custkey % 9",
    "other1": "c_custkey % 5",
    "other2": "c_custkey % 4",
    "other3": "c_custkey % 2",
    "other4": "c_custkey % 6",
    "other5": "c_custkey % 8",
}
RACE_SQL = "SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in RACE_COUNTS.items()) + " FROM customer"
OTHER_SQL = "(indian + asian + other1 + other2 + other3 + other4 + other5)"


def race_counts(t):
    return t.customer.selectExpr("c_custkey", *(f"{e} AS {n}" for n, e in RACE_COUNTS.items()))


@query(
    "P11_race_shares",
    f"""SELECT c_custkey, race_total, {r('white / nullif(race_total, 0)')} AS race_white,
               {r('black / nullif(race_total, 0)')} AS race_black, {r(OTHER_SQL + ' / nullif(race_total, 0)')} AS race_other,
               {r('hisp / nullif(race_total, 0)')} AS race_hisp FROM ({RACE_SQL}) c""",
)
def _(t):
    from moodgrid.plans.panel import race_shares

    return rounded(race_shares(race_counts(t)))


@query(
    "P12_majority_class",
    """SELECT id, CASE greatest(race_white, race_black, race_other, race_hisp)
                    WHEN race_white THEN 'race_white' WHEN race_black THEN 'race_black'
                    WHEN race_other THEN 'race_other' ELSE 'race_hisp' END AS race_majority FROM panel""",
    ("panel",),
)
def _(t):
    classes = ["race_white", "race_black", "race_other", "race_hisp"]
    return t.panel.select("id", recode.majority_class(classes).alias("race_majority"))


@query(
    "P13_local_time",
    """WITH z AS (SELECT c.id, zones.tz, (c.tweet_created_at AT TIME ZONE 'UTC') AT TIME ZONE zones.tz AS lt
                  FROM county c JOIN zones ON zones.fips = lpad(cast(c.fips_state AS string), 2, '0') || lpad(cast(c.fips_county AS string), 3, '0'))
       SELECT id, lt AS local, strftime(lt, '%A') AS dow, strftime(lt, '%m-%d') AS doy, substr(strftime(lt, '%H:%M'), 1, 4) AS tod,
              cast(date_diff('day', date '2009-01-01', cast(lt AS date)) AS int) AS daynum, cast(year(lt) AS int) AS year FROM z""",
    ("county", "zones"),
)
def _(t):
    fips = F.concat(clock.pad_fips(F.col("fips_state"), 2), clock.pad_fips(F.col("fips_county"), 3))
    local = t.county.withColumn("fips", fips).join(t.zones, ["fips"]).select(
        "id", clock.to_local(F.col("tweet_created_at"), F.col("tz")).alias("local")
    )
    return local.withColumns(clock.clock_columns(F.col("local")))


@query(
    "P14_tod_continuous",
    f"SELECT id, {r('cast(substr(tod, 1, 2) AS double) + cast(substr(tod, 4, 1) AS double) / 6')} AS hours FROM panel",
    ("panel",),
)
def _(t):
    return rounded(t.panel.select("id", clock.tod_continuous(F.col("tod")).alias("hours")))


RH_SQL = """least(greatest(speh * (pres * 1e-2) / (378e-3 * speh + 622e-3) /
            (6112e-3 * exp(1767e-2 * temp / (temp + 2435e-1))), 0), 1)"""


@query("P15_rh_from_specific", f"SELECT id, {r(RH_SQL)} AS rh FROM weather", ("weather",))
def _(t):
    rh = weather.rh_from_specific(F.col("speh"), F.col("temp"), F.col("pres"))
    return rounded(t.weather.select("id", rh.alias("rh")))


@query(
    "P15_rh_from_specific_kelvin",
    f"SELECT id, {r(RH_SQL.replace('temp', '(temp + 27315e-2)'))} AS rh FROM weather",
    ("weather",),
)
def _(t):
    rh = weather.rh_from_specific(F.col("speh"), F.col("temp"), F.col("pres"), compat=True)
    return rounded(t.weather.select("id", rh.alias("rh")))


def rh_vpd_sql(temp: str, vpd: str) -> str:
    return f"(1e2 - 1e2 * {vpd} / (611e-2 * exp((25e5 / 461) * (1e0 / 273 - 1e0 / (273e0 + {temp})))))"


@query("P16_rh_from_vpd", f"SELECT id, {r(rh_vpd_sql('tmax', 'vpdmax'))} AS rh FROM daily", ("daily",))
def _(t):
    return rounded(t.daily.select("id", weather.rh_from_vpd(F.col("tmax"), F.col("vpdmax")).alias("rh")))


def wbgt_sql(rh: str) -> str:
    return f"""(735e-3 * temp + 374e-4 * {rh} + 292e-5 * temp * {rh} + 7619e-3 * (srad / 1000)
            - 4557e-3 * (srad / 1000) * (srad / 1000) - 572e-4 * sqrt(wndu * wndu + wndv * wndv) - 4064e-3)"""


@query("P17_wbgt", f"SELECT id, {r(wbgt_sql('(1e2 * ' + RH_SQL + ')'))} AS wbgt FROM weather", ("weather",))
def _(t):
    rh = weather.rh_from_specific(F.col("speh"), F.col("temp"), F.col("pres")) * 100
    wind = weather.wind_speed(F.col("wndu"), F.col("wndv"))
    return rounded(t.weather.select("id", weather.wbgt(F.col("temp"), rh, F.col("srad") / 1000, wind).alias("wbgt")))


def heat_index_sql(temp: str, rh: str, digits: int) -> str:
    t, h = f"({temp} * 18e-1 + 32)", f"({rh})"
    poly = f"""(-42379e-3 + 204901523e-8 * {t} + 1014333127e-8 * {h} - 22475541e-8 * {t} * {h} - 683783e-8 * {t} * {t}
      - 5481717e-8 * {h} * {h} + 122874e-8 * {t} * {t} * {h} + 85282e-8 * {t} * {h} * {h} - 199e-8 * {t} * {t} * {h} * {h})"""
    simple = f"(5e-1 * ({t} + 61 + ({t} - 68) * 12e-1 + {h} * 94e-3))"
    return f"""CASE WHEN {h} BETWEEN 0 AND 100 THEN round_even((CASE WHEN {t} <= 40 THEN {t} WHEN {simple} > 79 THEN
      CASE WHEN {h} <= 13 AND {t} BETWEEN 80 AND 112 THEN {poly} - ((13 - {h}) / 4) * sqrt((17 - abs({t} - 95)) / 17)
           WHEN {h} > 85 AND {t} BETWEEN 80 AND 87 THEN {poly} + (({h} - 85) / 10) * ((87 - {t}) / 5)
           ELSE {poly} END ELSE {simple} END - 32) / 18e-1, {digits}) END"""


@query(
    "P18_heat_index",
    f"""SELECT id, {r(heat_index_sql('temp', 'rh', 2))} AS hi
        FROM (SELECT id, temp, 1e2 * {RH_SQL} AS rh FROM weather) w""",
    ("weather",),
)
def _(t):
    rh = weather.rh_from_specific(F.col("speh"), F.col("temp"), F.col("pres")) * 100
    return rounded(t.weather.select("id", weather.heat_index(F.col("temp"), rh, 2).alias("hi")))


@query("P19_wind_speed", f"SELECT id, {r('sqrt(wndu * wndu + wndv * wndv)')} AS wind FROM weather", ("weather",))
def _(t):
    return rounded(t.weather.select("id", weather.wind_speed(F.col("wndu"), F.col("wndv")).alias("wind")))


def hourly_sql(hour: str, tmax: str, tmin: str, rise: str, sunset: str) -> str:
    dl = f"(CASE WHEN {sunset} > {rise} THEN {sunset} - {rise} ELSE {sunset} - {rise} + 24 END)"

    def day(h: str) -> str:
        since = f"(CASE WHEN {h} >= {rise} THEN {h} - {rise} ELSE {h} - {rise} + 24 END)"
        return f"(({tmax} - {tmin}) * sin(pi() * {since} / ({dl} + 4)) + {tmin})"

    since = f"(CASE WHEN {hour} > {sunset} THEN {hour} - {sunset} ELSE {hour} - {sunset} + 24 END + 1)"
    night = f"({day(sunset)} - ({day(sunset)} - {tmin}) / ln(24 - {dl}) * ln({since}))"
    is_night = f"""(CASE WHEN {sunset} > {rise} THEN {hour} < {rise} OR {hour} > {sunset}
                    ELSE {hour} > {sunset} AND {hour} < {rise} END)"""
    return f"(CASE WHEN {is_night} THEN {night} ELSE {day(hour)} END)"


RISE_SET = "(event_id % 7) + 10 AS rise, (event_id % 9 + 20) % 24 AS sunset, hour(tweet_created_at) AS hour"


@query(
    "P20_hourly_from_minmax",
    f"""SELECT p.id, {r(hourly_sql('hour', 'tmax', 'tmin', 'rise', 'sunset'))} AS temp
        FROM (SELECT id, {RISE_SET} FROM points) p JOIN daily USING (id)""",
    ("points", "daily"),
)
def _(t):
    timed = t.points.selectExpr("id", *RISE_SET.split(", ")).join(t.daily, ["id"])
    temp = weather.hourly_from_minmax(*(F.col(c) for c in ("hour", "tmax", "tmin", "rise", "sunset")))
    return rounded(timed.select("id", temp.alias("temp")))


SUN_SQL = """
   SELECT id, lat, ((transit - half + 5e-1) - floor(transit - half + 5e-1)) * 24 AS rise,
          ((transit + half + 5e-1) - floor(transit + half + 5e-1)) * 24 AS sunset
   FROM (SELECT id, lat, j + 53e-4 * sin(m) - 69e-4 * sin(2 * l) AS transit,
                acos((sin(radians(-833e-3)) - sin(radians(lat)) * sin(l) * sin(radians(2344e-2)))
                     / (cos(radians(lat)) * sqrt(1 - power(sin(l) * sin(radians(2344e-2)), 2)))) / pi() / 2 AS half
         FROM (SELECT id, lat, j, m, radians((degrees(m) + 19148e-4 * sin(m) + 2e-2 * sin(2 * m) + 3e-4 * sin(3 * m)
                                      + 2829372e-4) % 360) AS l
               FROM (SELECT id, lat, j, radians((3575291e-4 + 98560028e-8 * j) % 360) AS m
                     FROM (SELECT id, lat, date_diff('day', date '2000-01-01', cast(tweet_created_at AS date)) + 8e-4 - lon / 360 AS j
                           FROM points) a) b) c) d"""


@query("P20_sun_hours", f"SELECT id, {r('rise', 4)} AS rise, {r('sunset', 4)} AS sunset FROM ({SUN_SQL}) s", ("points",))
def _(t):
    rise, sunset = weather.sun_hours(F.col("lat"), F.col("lon"), F.col("tweet_created_at").cast("date"))
    return rounded(t.points.select("id", rise.alias("rise"), sunset.alias("sunset")), 4)


KNOT_SQL = ", ".join(
    f"{r(f'greatest(wbgt - ({k}), 0)')} AS wbgt_{'m' if k < 0 else ''}{abs(k)}, "
    f"{r(f'race_white * greatest(wbgt - ({k}), 0)')} AS white_wbgt_{'m' if k < 0 else ''}{abs(k)}"
    for k in (-10, 0, 5, 10, 15, 20, 25)
)


@query(
    "P21_piecewise_basis",
    f"SELECT id, {r('wbgt')} AS wbgt, {r('race_white * wbgt')} AS white_wbgt, {KNOT_SQL} FROM panel",
    ("panel",),
)
def _(t):
    plain, by = basis.piecewise("wbgt"), basis.piecewise("wbgt", by="race_white")
    named = {n: c for n, c in plain.items()} | {"white_" + n.split(":")[1]: c for n, c in by.items()}
    return rounded(t.panel.select("id", *(c.alias(n) for n, c in named.items())))


@query(
    "P22_cyclic_tent_basis",
    "SELECT id, "
    + ", ".join(f"{r(f'greatest(1 - abs(h - {2 * i}) / 2, 0)')} AS s{i}" for i in range(1, 12))
    + f", {r('CASE WHEN h < 2 THEN 1 - h / 2 WHEN h > 22 THEN (h - 22) / 2 ELSE 0e0 END')} AS s0"
    + " FROM (SELECT id, cast(substr(tod, 1, 2) AS double) + cast(substr(tod, 4, 1) AS double) / 6 AS h FROM panel) p",
    ("panel",),
)
def _(t):
    tents = basis.cyclic_tents(clock.tod_continuous(F.col("tod")))
    return rounded(t.panel.select("id", *(c.alias(n) for n, c in tents.items())))


@query(
    "P23_rescale01",
    f"""SELECT id, {r('(vader - min(vader) OVER ()) / (max(vader) OVER () - min(vader) OVER ())')} AS vader,
               {r('1 - (hedono - min(hedono) OVER ()) / (max(hedono) OVER () - min(hedono) OVER ())')} AS hedono FROM panel""",
    ("panel",),
)
def _(t):
    return rounded(rescale01(t.panel.select("id", "vader", "hedono"), ["vader", "hedono"], ["hedono"]))


@query(
    "P24_log_axis",
    f"SELECT id, {r('ln(1 + 1000 * greatest(prcp, 0))')} AS rain, {r('ln(1 + greatest(srad, 0))')} AS sun FROM panel",
    ("panel",),
)
def _(t):
    return rounded(
        t.panel.select(
            "id",
            recode.log_amount(F.col("prcp"), 1000).alias("rain"),
            recode.log_amount(F.col("srad")).alias("sun"),
        )
    )
