"""Hand-computed values and invariants of the column builders."""

import math

from pyspark.sql import functions as F

from moodgrid.functions import basis, clock, recode, weather
from moodgrid.functions import tokens as tk


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_heat_index_anchors(spark):
    row = one(
        spark,
        a=weather.heat_index(F.lit(4.5), F.lit(50.0)),
        b=weather.heat_index(F.lit(4.4), F.lit(50.0)),
        c=weather.heat_index(F.lit(35.0), F.lit(60.0)),
        d=weather.heat_index(F.lit(35.0), F.lit(140.0)),
    )
    assert (row.a, row.b, row.d) == (2.0, 4.0, None)
    assert 44 <= row.c <= 46


def test_humidity_and_wind(spark):
    row = one(
        spark,
        rh=weather.rh_from_specific(F.lit(0.0072), F.lit(20.0), F.lit(101325.0)),
        full=weather.rh_from_vpd(F.lit(20.0), F.lit(0.0)),
        absent=weather.rh_from_specific(F.lit(None).cast("double"), F.lit(20.0), F.lit(101325.0)),
        wind=weather.wind_speed(F.lit(3.0), F.lit(4.0)),
    )
    assert 0.48 < row.rh < 0.52 and row.full == 100.0 and row.absent is None and row.wind == 5.0


def test_hourly_temperature_starts_at_the_minimum(spark):
    args = [F.lit(v) for v in (30.0, 10.0, 12.0, 24.0 - 1e-9)]
    row = one(spark, rise=weather.hourly_from_minmax(F.lit(12.0), *args), noon=weather.hourly_from_minmax(F.lit(20.0), *args))
    assert math.isclose(row.rise, 10.0) and math.isclose(row.noon, 30.0, abs_tol=1e-6)


def test_tents_sum_to_one(spark):
    hours = spark.range(241).select((F.col("id") / 10).alias("h"))
    total = sum(basis.cyclic_tents(F.col("h")).values(), F.lit(0.0))
    assert hours.filter(F.abs(total - 1) > 1e-12).count() == 0


def test_midnight_and_majority(spark):
    at = F.lit("2012-03-04 00:00:00").cast("timestamp_ntz")
    row = one(
        spark,
        tod=clock.clock_columns(at)["tod"],
        quirk=clock.clock_columns(at, True, F.lit("EST"))["tod"],
        dow=clock.clock_columns(at)["dow"],
        day=clock.clock_columns(at)["daynum"],
    )
    assert (row.tod, row.quirk, row.dow, row.day) == ("00:0", "EST", "Sunday", 1158)
    ties = spark.createDataFrame([(1, 1, 0), (0, 2, 3)], "a int, b int, c int")
    assert [r[0] for r in ties.select(recode.majority_class(["a", "b", "c"])).collect()] == ["a", "c"]


def test_tokens_keep_accents_and_edges(spark):
    row = one(spark, t=tk.tokenize(F.lit("L'été, NAÏVE!")), d=tk.has_term(F.lit("so alone."), tk.DEPRESSIVE_TERMS))
    assert row.t == ["l", "été", "naïve", ""] and row.d == 1
