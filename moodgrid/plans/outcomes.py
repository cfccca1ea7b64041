"""County, state and city tables that mood is related to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodgrid.functions import clock, recode
from moodgrid.operators.aggregates import (
    count_if_by,
    covers_all,
    lengthen,
    mean_by,
    rescale01,
    sum_by,
    weighted_mean_by,
)
from moodgrid.operators.joins import densify, lookup_join, missing
from moodgrid.operators.sampling import bootstrap_mean_diff, event_window
from moodgrid.operators.spatial import inside_flag
from moodgrid.operators.windows import group_total, rolling_mean
from moodgrid.plans.estimation import fe_ols, tidy
from moodgrid.plans.glm import fe_glm
from moodgrid.plans.specs import model_grid

SCORES = ("afinn", "hedono", "vader")
# Offense categories counted as violent, in both sources' spelling.
VIOLENT_NIBRS = (
    "Homicide Offenses",
    "Animal Cruelty",
    "Arson",
    "Assault Offenses",
    "Burglary/Breaking & Entering",
    "Destruction/Damage/Vandalism of Property",
    "Kidnapping/Abduction",
    "Robbery",
)
VIOLENT_COD = (
    "arson",
    "assault offenses",
    "burglary/breaking & entering",
    "destruction/damage/vandalism of property",
    "kidnapping/abduction",
    "robbery",
    "homicide offenses",
)
# Spelling of county names, by state.
COUNTY_FIXES = {
    ("LA PORTE", "IN"): "LAPORTE",
    ("ST JOSEPH", "IN"): "ST. JOSEPH",
    ("ST LOUIS", "MN"): "ST. LOUIS",
    ("ST CROIX", "WI"): "ST. CROIX",
}
STATE_FIXES = {"NB": "NE"}


def agency_counties(old: DataFrame, new: DataFrame, counties: DataFrame) -> DataFrame:
    """Agency to county code: the old table first, new agencies by county name.

    ``old``: agency_id, fips; ``new``: agency_id, state_abbr, county_name (a
    '; ' list whose last entry counts); ``counties``: state_abbr, county_name, fips.
    """
    named = missing(new, old, ["agency_id"]).filter(F.col("county_name") != "")
    named = named.withColumn("county_name", recode.last_in_list(F.col("county_name"))).withColumn(
        "state_abbr", recode.rename_values(F.col("state_abbr"), STATE_FIXES)
    )
    fixed = F.col("county_name")
    for (county, state), spelling in COUNTY_FIXES.items():
        fixed = F.when((F.col("county_name") == county) & (F.col("state_abbr") == state), F.lit(spelling)).otherwise(fixed)
    named = named.withColumn("county_name", fixed)
    coded = lookup_join(named, counties, ["state_abbr", "county_name"], "left", salt_by=["agency_id"])
    return old.select("agency_id", "fips").distinct().unionByName(coded.select("agency_id", "fips").distinct())


def crime_incidents(
    agencies: DataFrame,
    incidents: Sequence[DataFrame],
    offenses: Sequence[DataFrame],
    locations: DataFrame,
    offense_types: DataFrame,
    months: DataFrame,
) -> DataFrame:
    """Offenses with incident, agency and names, of gap-free agencies only.

    ``months`` lists the 'yyyy-MM' values an agency must report in.
    """
    stack = lambda frames: _union(frames)
    joined = stack(offenses).join(stack(incidents), ["incident_id"], "left")
    for side, on in ((agencies, "agency_id"), (locations, "location_id"), (offense_types, "offense_type_id")):
        joined = lookup_join(joined, side, [on], "left", salt_by=["offense_id"])
    return covers_all(joined.withColumn("month", F.substring("date", 1, 7)), "agency_id", "month", months)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def violent_counts(category: Column, violent: Sequence[str], homicide: str, assault: str, suffix: str) -> dict[str, Column]:
    return {
        f"homicides{suffix}": category == homicide,
        f"assault{suffix}": category == assault,
        f"violent{suffix}": category.isin(*violent),
    }


def crime_county_day(nibrs: DataFrame, cod: DataFrame, population: DataFrame) -> DataFrame:
    """Daily counts per county from two sources, with the year's population.

    ``nibrs``: fips number, date text, offense_category_name; ``cod``:
    census_block, date_single, offense_group; ``population``: fips, year, population.
    """
    one = count_if_by(
        nibrs.filter(F.col("fips").isNotNull()).withColumn("fips", clock.pad_fips(F.col("fips"))),
        ["fips", "date"],
        violent_counts(F.col("offense_category_name"), VIOLENT_NIBRS, "Homicide Offenses", "Assault Offenses", "_nibrs"),
    )
    two = count_if_by(
        cod.select(
            F.substring("census_block", 1, 5).alias("fips"), F.substring("date_single", 1, 10).alias("date"), "offense_group"
        ),
        ["fips", "date"],
        violent_counts(F.col("offense_group"), VIOLENT_COD, "homicide offenses", "assault offenses", "_cod"),
    )
    both = one.join(two, ["fips", "date"], "full_outer").withColumn("year", F.substring("date", 1, 4).cast("int"))
    people = population.withColumn("fips", clock.pad_fips(F.col("fips")))
    # Counties with people but without a dated count are dropped again, so the
    # outer join with the population is a left one.
    return both.filter(F.col("date").isNotNull()).join(people, ["year", "fips"], "left")


def _own_hour(nibrs: DataFrame) -> Column:
    """Incidents whose hour is known and their own: of some only the date of the report was recorded."""
    return F.col("hour").isNotNull() & F.col("report_date_flag").isNull()


def crime_county_hour(nibrs: DataFrame) -> DataFrame:
    """Counts per county, date and hour; rows dated by their report are set apart (``crime_without_hour``)."""
    rows = nibrs.filter(F.col("fips").isNotNull() & _own_hour(nibrs)).withColumn("fips", clock.pad_fips(F.col("fips")))
    return count_if_by(
        rows, ["fips", "date", "hour"],
        violent_counts(F.col("offense_category_name"), VIOLENT_NIBRS, "Homicide Offenses", "Assault Offenses", ""),
    )


def crime_without_hour(nibrs: DataFrame) -> DataFrame:
    """Incidents per county and day that no hour can be given."""
    rows = nibrs.filter(F.col("fips").isNotNull() & ~_own_hour(nibrs)).withColumn("fips", clock.pad_fips(F.col("fips")))
    return rows.groupBy("fips", "date").agg(F.count(F.lit(1)).alias("reported"))


def hourly_crime_rows(hours: DataFrame, mood: DataFrame, population: DataFrame) -> DataFrame:
    """Hours with a count and with mood, the year's population, and the factors of the models."""
    joined = hours.join(mood, ["fips", "date", "hour"]).withColumn("year", F.substring("date", 1, 4).cast("int"))
    joined = joined.join(population, ["year", "fips"], "left")
    at = F.to_date("date")
    return joined.withColumns(
        {
            "dow": F.dayofweek(at),
            "doy": F.substring("date", 6, 5),
            "statemonth": F.concat_ws("-", F.substring("fips", 1, 2), F.substring("date", 6, 2)),
            "millions": F.col("population") / 1e6,
        }
    )


def hourly_crime_models(rows: DataFrame) -> DataFrame:
    """Poisson models of the hourly counts on the mood of the same county and hour."""
    return model_grid(
        rows, ("violent", "assault", "homicides"), ("vader", "afinn", "hedono"), {"population": F.col("millions")},
        ["hour", "dow", "doy", "year", "statemonth"],
    )


def crime_models(county_day: DataFrame, mood: DataFrame, keys: Sequence[str], min_posts: int, absorb: Sequence[str]) -> DataFrame:
    """Poisson models of three crime counts on three mood scores.

    ``mood`` has the keys, the scores and ``n``; rows of few posts are left out.
    """
    rows = county_day.withColumns(
        {c: recode.row_sum([f"{c}_nibrs", f"{c}_cod"]) for c in ("violent", "assault", "homicides")}
    ).join(mood, list(keys), "left")
    rows = rows.filter(F.col("n") > min_posts)
    return model_grid(
        rows, ("violent", "assault", "homicides"), ("vader", "afinn", "hedono"),
        {"log_population": F.log("population")}, absorb, "n",
    )


def deaths_with_population(deaths: DataFrame, population: DataFrame) -> DataFrame:
    """County-month deaths (footer rows removed) with the year's population."""
    return deaths.filter(F.col("deaths").isNotNull()).join(population, ["county", "year"], "left")


def county_month_mood(panel: DataFrame, with_dow: bool = True) -> DataFrame:
    keys = ["fips", "month", *(["dow"] if with_dow else []), "year"]
    return mean_by(panel.withColumn("month", F.substring("statemonth", 4, 2)), keys, SCORES)


def death_rate_line(deaths: DataFrame, mood: DataFrame) -> DataFrame:
    """Death rate on mood with year, month and state dummies."""
    m = deaths.join(mood, ["fips", "month", "year"], "left").withColumn("state", F.substring("fips", 1, 2))
    return tidy(
        fe_ols(m.withColumn("rate", F.col("deaths") / F.col("population")), "rate", {"vader": F.col("vader")}, ["year", "month", "state"])
    )


DEATH_FACTORS = ("dow", "year", "state", "month", "statemonth")


def death_count_models(
    deaths: DataFrame, mood: DataFrame, outcome: str = "deaths", predictors: Sequence[str] = SCORES, absorb: Sequence[str] = DEATH_FACTORS
) -> DataFrame:
    """Poisson models of death counts; county-months without a record count 0."""
    m = mood.join(deaths, ["fips", "month", "year"], "left").withColumns(
        {outcome: F.coalesce(outcome, F.lit(0)), "state": F.substring("fips", 1, 2)}
    )
    m = m.filter(F.col("population") > 0).withColumn("statemonth", F.concat_ws("_", "state", "month"))
    return model_grid(m, [outcome], predictors, {"log_population": F.log("population")}, absorb)


def survey_link(
    survey: DataFrame, panel: DataFrame, first: Column, last: Column, k: int = 30, keep: Sequence[str] = ()
) -> DataFrame:
    """Survey answers joined with the state's running k-day mood.

    ``survey``: state, idate (MMddyyyy), menthlth. Incomplete rows are dropped.
    ``keep`` names further columns to carry along, such as the respondent.
    """
    daily = mean_by(panel, ["state", "date"], SCORES)
    grid = rolling_mean(densify(daily, "state", "date", first, last), "state", "date", SCORES, k)
    answers = survey.select(
        "state", recode.survey_days(F.col("menthlth")).alias("mh"), recode.mdy_date(F.col("idate")).alias("date"), *keep
    ).na.drop("any")
    m = lookup_join(answers, grid, ["state", "date"], "left").na.drop("any")
    return m.withColumns({"mh_any": (F.col("mh") > 0).cast("int"), "yearmonth": F.date_format("date", "yyyy-MM")})


def survey_models(linked: DataFrame, ids: Sequence[str], replicates: int = 100, k: int = 30) -> DataFrame:
    """Bootstrap coefficients of the Poisson model of bad days on running mood."""
    from moodgrid.operators.sampling import with_replicates

    mood, factors = f"vader{k}", ["state", "yearmonth"]
    # Equal answers meet before they are drawn, so the drawn rows fold where they arise.
    drawn = with_replicates(linked.hint("rebalance", mood, *factors), ids, replicates)
    coefs, _ = fe_glm(drawn, "mh", {mood: F.col(mood)}, factors, "poisson", "weight", ["replicate"], collapse=True)
    return coefs.select("replicate", "term", "estimate")


def effect_comparison(
    panel: DataFrame, ids: Sequence[str], regions: Sequence[str], event: str, days: int, replicates: int, bands: DataFrame | None = None
) -> DataFrame:
    """Weekday and event differences next to heat effects of given bands.

    ``panel`` has dow, date, fips and vader; ``bands``: label, low, mid, high.
    """
    weekday = bootstrap_mean_diff(panel, "dow", "vader", ("Monday", "Saturday"), ids, replicates)
    around = event_window(panel, "fips", regions, "date", event, days)
    happened = bootstrap_mean_diff(around, "side", "vader", ("before", "after"), ids, replicates)
    out = weekday.withColumn("label", F.lit("weekday")).unionByName(happened.withColumn("label", F.lit("event")))
    return out if bands is None else out.unionByName(bands)


def weekday_profile(df: DataFrame, sums: Sequence[str], flips: Sequence[str] = ()) -> DataFrame:
    """Weekday totals rescaled to 0..1, in long form."""
    return lengthen(rescale01(sum_by(df, ["dow"], sums), sums, flips), ["dow"], sums)


def city_regions(counties: DataFrame, minimum: float = 1_000_000) -> DataFrame:
    """Counties of large city regions: the combined area, else the metro area.

    ``counties``: fips, population, black, csa_id, msa_id.
    """
    placed = counties.filter(~(F.col("csa_id").isNull() & F.col("msa_id").isNull()))
    for kind in ("csa", "msa"):
        placed = group_total(placed, f"{kind}_id", {f"{kind}_pop": "population", f"{kind}_black": "black"})
    large = placed.filter((F.col("csa_pop") > minimum) | (F.col("msa_pop") > minimum))
    pop = F.coalesce("csa_pop", "msa_pop")
    return large.select(
        "fips", F.coalesce("csa_id", "msa_id").alias("id"), pop.alias("pop"), (F.coalesce("csa_black", "msa_black") / pop).alias("black")
    )


def urban_poverty(areas: DataFrame, urban: DataFrame, survey: DataFrame, poor_below: float = 15_000) -> DataFrame:
    """Population-weighted Black share by poverty and urban location.

    ``survey``: geoid, income, race_total, race_black (share).
    """
    placed = inside_flag(areas, urban, ["geoid"], "urban")
    rows = placed.join(survey, ["geoid"], "inner").withColumn("poor", F.col("income") < F.lit(poor_below))
    return weighted_mean_by(rows, ["poor", "urban"], "race_black", "race_total", "blackness")


def incident_tables(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Old and new table layouts under common lower-case names, stacked."""
    lower = lambda df: df.select(*(F.col(c).alias(c.lower()) for c in df.columns))
    return {name: _union([lower(old[name]), lower(new[name])]) for name in old}
