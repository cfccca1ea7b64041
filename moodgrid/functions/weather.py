"""Weather physics as column arithmetic (temperatures in Celsius)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rh_from_specific(speh: Column, temp: Column, pres_pa: Column, compat: bool = False) -> Column:
    """Relative humidity 0..1 from specific humidity, temperature and pressure.

    Saturation pressure follows Bolton (1980). ``compat`` feeds it Kelvin, as
    the published results did.
    """
    t = temp + F.lit(273.15) if compat else temp
    saturation = F.lit(6.112) * F.exp(F.lit(17.67) * t / (t + F.lit(243.5)))
    vapour = speh * (pres_pa * F.lit(0.01)) / (F.lit(0.378) * speh + F.lit(0.622))
    return _clamp(vapour / saturation, 0.0, 1.0)


def _clamp(x: Column, low: float, high: float) -> Column:
    # greatest/least skip nulls, so an absent input has to be kept absent.
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rh_from_vpd(temp: Column, vpd: Column) -> Column:
    """Relative humidity in percent from vapour pressure deficit (hPa)."""
    saturation = F.lit(6.11) * F.exp(F.lit(2.5e6 / 461) * (F.lit(1 / 273) - F.lit(1.0) / (F.lit(273.0) + temp)))
    return F.lit(100.0) - F.lit(100.0) * vpd / saturation


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wbgt(temp: Column, rh_pct: Column, srad_kw: Column, wind: Column) -> Column:
    """Wet bulb globe temperature (rh in percent, sun in kW/m2, wind in m/s)."""
    # Regression weights of the published formula.
    return (
        F.lit(0.735) * temp
        + F.lit(0.0374) * rh_pct
        + F.lit(0.00292) * temp * rh_pct
        + F.lit(7.619) * srad_kw
        - F.lit(4.557) * srad_kw * srad_kw
        - F.lit(0.0572) * wind
        - F.lit(4.064)
    )


def heat_index(temp: Column, rh_pct: Column, digits: int = 0) -> Column:
    """US National Weather Service heat index, Celsius in and out.

    Up to 40 F the temperature is returned; the simple mean formula holds while
    it stays at or below 79 F; above that the Rothfusz polynomial applies with
    its dry and humid corrections. Null outside 0..100 percent humidity.
    """
    t = temp * F.lit(1.8) + F.lit(32.0)
    r = rh_pct
    simple = F.lit(0.5) * (t + F.lit(61.0) + (t - F.lit(68.0)) * F.lit(1.2) + r * F.lit(0.094))
    # The weather service's polynomial, by powers of (t, r).
    terms = [
        (-42.379, 0, 0),
        (2.04901523, 1, 0),
        (10.14333127, 0, 1),
        (-0.22475541, 1, 1),
        (-6.83783e-3, 2, 0),
        (-5.481717e-2, 0, 2),
        (1.22874e-3, 2, 1),
        (8.5282e-4, 1, 2),
        (-1.99e-6, 2, 2),
    ]
    poly = F.lit(0.0)
    for weight, t_power, r_power in terms:
        term = F.lit(weight)
        for factor in [t] * t_power + [r] * r_power:
            term = term * factor
        poly = poly + term
    dry = ((F.lit(13.0) - r) / F.lit(4.0)) * F.sqrt((F.lit(17.0) - F.abs(t - F.lit(95.0))) / F.lit(17.0))
    humid = ((r - F.lit(85.0)) / F.lit(10.0)) * ((F.lit(87.0) - t) / F.lit(5.0))
    full = (
        F.when((r <= 13) & t.between(80, 112), poly - dry)
        .when((r > 85) & t.between(80, 87), poly + humid)
        .otherwise(poly)
    )
    fahrenheit = F.when(t <= 40, t).when(simple > 79, full).otherwise(simple)
    celsius = (fahrenheit - F.lit(32.0)) / F.lit(1.8)
    return F.when(r.between(0, 100), F.bround(celsius, digits))


def sun_hours(lat: Column, lon: Column, day: Column) -> tuple[Column, Column]:
    """UTC clock hours (0..24, fractional) of sunrise and sunset.

    The sunrise equation of the astronomical almanac; null in polar day/night.
    """
    rad = math.pi / 180
    n = F.datediff(day, F.lit("2000-01-01").cast("date")).cast("double") + F.lit(0.0008)
    mean_noon = n - lon / F.lit(360.0)
    anomaly = F.pmod(F.lit(357.5291) + F.lit(0.98560028) * mean_noon, F.lit(360.0)) * F.lit(rad)
    centre = (
        F.lit(1.9148) * F.sin(anomaly)
        + F.lit(0.02) * F.sin(F.lit(2.0) * anomaly)
        + F.lit(0.0003) * F.sin(F.lit(3.0) * anomaly)
    )
    ecliptic = F.pmod(anomaly / F.lit(rad) + centre + F.lit(180.0 + 102.9372), F.lit(360.0)) * F.lit(rad)
    transit = mean_noon + F.lit(0.0053) * F.sin(anomaly) - F.lit(0.0069) * F.sin(F.lit(2.0) * ecliptic)
    sin_decl = F.sin(ecliptic) * F.lit(math.sin(23.44 * rad))
    cos_decl = F.sqrt(F.lit(1.0) - sin_decl * sin_decl)
    phi = lat * F.lit(rad)
    cos_hour = (F.lit(math.sin(-0.833 * rad)) - F.sin(phi) * sin_decl) / (F.cos(phi) * cos_decl)
    half_day = F.when(F.abs(cos_hour) <= 1, F.acos(cos_hour)) / F.lit(rad) / F.lit(360.0)

    def clock(x: Column) -> Column:
        # day fractions count from noon
        return F.pmod(x + F.lit(0.5), F.lit(1.0)) * F.lit(24.0)

    return clock(transit - half_day), clock(transit + half_day)


def hourly_from_minmax(hour: Column, tmax: Column, tmin: Column, rise: Column, sunset: Column) -> Column:
    """Temperature at a UTC hour from the daily extremes (Linvill 1990).

    A sine from sunrise through the day, then logarithmic cooling from the
    sunset value. ``rise`` and ``sunset`` are whole UTC hours.
    """
    daylight = F.when(sunset > rise, sunset - rise).otherwise(sunset - rise + F.lit(24.0))
    span = tmax - tmin

    def by_day(h: Column) -> Column:
        since_rise = F.when(h >= rise, h - rise).otherwise(h - rise + F.lit(24.0))
        return span * F.sin(F.lit(math.pi) * since_rise / (daylight + F.lit(4.0))) + tmin

    at_sunset = by_day(sunset)
    since_set = F.when(hour > sunset, hour - sunset).otherwise(hour - sunset + F.lit(24.0)) + F.lit(1.0)
    by_night = at_sunset - (at_sunset - tmin) / F.log(F.lit(24.0) - daylight) * F.log(since_set)
    is_night = F.when(sunset > rise, (hour < rise) | (hour > sunset)).otherwise((hour > sunset) & (hour < rise))
    return F.when(is_night, by_night).otherwise(by_day(hour))
