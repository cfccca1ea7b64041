"""From posts and attribute tables to the analysis panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.functions import clock, recode, weather
from moodgrid.operators.joins import left_chain, lookup_join, nearest_key_join
from moodgrid.operators.sampling import sample_fraction
from moodgrid.operators.spatial import in_box, point_in_polygon
from moodgrid.operators.windows import first_per_key
from moodgrid.plans.specs import RACES

POST_KEY = ("id", "tweet_created_at")
# Zone names that stand in for a clock time in old tables.
ZONE_NAMES = ("CDT", "CST", "EDT", "EST", "MST", "MDT", "PDT", "PST")


def build_panel(
    weather_rows: DataFrame,
    sentiment: DataFrame,
    census: DataFrame,
    local_time: DataFrame,
    depressive: DataFrame,
    landcover: DataFrame | None = None,
    drop_zone_labels: bool = True,
) -> DataFrame:
    """One row per post with every attribute; incomplete rows are dropped.

    All inputs share the post key, so their de-duplication and the chain of
    joins are served by one partitioning on that key.
    """
    key = list(POST_KEY)
    labelled = census.withColumn("race_majority", recode.majority_class(RACES)).drop("race_other", "race_hisp")
    others = [sentiment, labelled, local_time, *([landcover] if landcover is not None else []), depressive]
    unique = [first_per_key(frame, key) for frame in (weather_rows, *others)]
    panel = left_chain(unique[0], unique[1:], key).na.drop("any")
    if drop_zone_labels:
        panel = panel.filter(~F.col("tod").isin(*ZONE_NAMES))
    return panel.withColumn("statemonth", clock.state_month(F.col("fips"), F.col("doy"))).drop(*key)


def panel_sample(panel: DataFrame, fraction: float, ids: Sequence[str]) -> DataFrame:
    return sample_fraction(panel, fraction, ids)


def weather_features(rows: DataFrame, keys: Sequence[str] = POST_KEY, compat: bool = False) -> DataFrame:
    """Duplicate and incomplete weather rows removed; heat measures added."""
    clean = rows.dropDuplicates().na.drop("any")
    rh = weather.rh_from_specific(F.col("speh"), F.col("temp"), F.col("pres"), compat) * F.lit(100.0)
    wind = weather.wind_speed(F.col("wndu"), F.col("wndv"))
    return clean.withColumn("__rh", rh).select(
        *keys,
        "temp",
        "prcp",
        "srad",
        weather.wbgt(F.col("temp"), F.col("__rh"), F.col("srad") / F.lit(1000.0), wind).alias("wbgt"),
        weather.heat_index(F.col("temp"), F.col("__rh")).alias("temp_hi"),
    )


def daily_weather_features(posts: DataFrame, daily: DataFrame) -> DataFrame:
    """Daily extremes matched by time and closest id, turned into hourly values."""
    values = daily.dropDuplicates().select("tweet_created_at", "id", "ppt", "tmax", "tmin", "vpdmax", "vpdmin")
    base = posts.select("id", "tweet_created_at", "lat", "lon").dropDuplicates()
    m = nearest_key_join(base, values, ["tweet_created_at"], "id", "matched_id").filter(F.col("matched_id").isNotNull())
    rise, sunset = weather.sun_hours(F.col("lat"), F.col("lon"), F.col("tweet_created_at").cast("date"))
    m = m.withColumns({"rise": F.floor(rise), "sunset": F.floor(sunset), "hour": F.hour("tweet_created_at")})
    m = m.withColumns(
        {
            "tmax_hi": weather.heat_index(F.col("tmax"), weather.rh_from_vpd(F.col("tmax"), F.col("vpdmax")), 2),
            "tmin_hi": weather.heat_index(F.col("tmin"), weather.rh_from_vpd(F.col("tmin"), F.col("vpdmin")), 2),
        }
    )

    def hourly(high: str, low: str) -> Column:
        return weather.hourly_from_minmax(F.col("hour"), F.col(high), F.col(low), F.col("rise"), F.col("sunset"))

    return m.select(
        "id",
        "tweet_created_at",
        "ppt",
        hourly("tmax", "tmin").alias("temp"),
        hourly("tmax_hi", "tmin_hi").alias("temp_hi"),
        "tmax_hi",
    )


def race_shares(counts: DataFrame, compat: bool = False) -> DataFrame:
    """Counts to shares of the total; 'other' gathers the remaining groups."""
    other = {c: F.col(c) for c in ("indian", "asian", "other1", "other2", "other3", "other4", "other5")}
    total = F.col("race_total")
    return counts.withColumns(
        {
            "race_white": recode.share(F.col("white"), total),
            "race_black": recode.share(F.col("black"), total),
            "race_other": recode.share(recode.other_count(other, "other4" if compat else None), total),
            "race_hisp": recode.share(F.col("hisp"), total),
        }
    ).drop("white", "black", "hisp", *other)


def census_features(posts: DataFrame, areas: DataFrame, survey: DataFrame, compat: bool = False) -> DataFrame:
    """Income and race shares of the area around each post.

    ``areas``: geoid, survey_year, ring; ``survey``: geoid, survey_year,
    income and counts. A post meets the vintage of its survey year.
    """
    values = race_shares(survey, compat).withColumn(
        "income_percap", recode.to_2019_money(F.col("income"), F.col("survey_year"))
    )
    shapes = areas.join(values.drop("income", "race_total"), ["geoid", "survey_year"], "inner")
    dated = posts.withColumn("survey_year", recode.survey_year(F.year("tweet_created_at")))
    return point_in_polygon(dated, shapes, how="left", ids=POST_KEY, match=["survey_year"])


def local_time_features(
    posts: DataFrame, zones: DataFrame, compat: bool = False, time: str = "tweet_created_at"
) -> DataFrame:
    """Clock columns of each post in the zone of its county."""
    coded = posts.withColumn(
        "fips", F.concat(clock.pad_fips(F.col("fips_state"), 2), clock.pad_fips(F.col("fips_county"), 3))
    )
    zoned = lookup_join(coded, zones, ["fips"], "left", salt_by=[*POST_KEY])
    local = clock.to_local(F.col(time), F.col("tz"))
    return zoned.withColumn("__local", local).select(
        "fips", *POST_KEY, *(c.alias(n) for n, c in clock.clock_columns(F.col("__local"), compat, F.col("tz")).items())
    )


def neighbourhood_extract(
    panel: DataFrame, box: tuple[float, float, float, float], year: int, keys: Sequence[str], means: Sequence[str]
) -> DataFrame:
    """Means inside a bounding box with incomes in 2019 money."""
    inside = panel.filter(in_box(F.col("lon"), F.col("lat"), *box))
    money = recode.to_2019_money(F.col("income"), recode.survey_year(F.lit(year)))
    return (
        inside.withColumn("income_percap", money)
        .groupBy(*keys)
        .agg(*(F.avg(c).alias(c) for c in means), F.avg("income_percap").alias("income_percap"), F.count(F.lit(1)).alias("n"))
    )
