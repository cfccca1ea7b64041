"""Geographic codes and local-clock columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DAY = "2009-01-01"  # day number 0


def pad_fips(code: Column, width: int = 5) -> Column:
    """County code as text with leading zeros."""
    return F.lpad(code.cast("long").cast("string"), width, "0")


def state_of(fips: Column) -> Column:
    return F.substring(fips, 1, 2)


def state_month(fips: Column, doy: Column) -> Column:
    """'SS-MM' from a county code and an 'MM-dd' day of year."""
    return F.concat_ws("-", state_of(pad_fips(fips)), F.substring(doy, 1, 2))


def to_local(utc: Column, zone: Column) -> Column:
    """Wall-clock time of a UTC instant; independent of the session zone."""
    return F.convert_timezone(F.lit("UTC"), zone, utc.cast("timestamp_ntz"))


def clock_columns(local: Column, midnight_quirk: bool = False, zone_label: Column | None = None) -> dict[str, Column]:
    """dow, doy, tod (10-minute bin), daynum and year of a wall-clock time.

    ``midnight_quirk`` reproduces clock text that loses its time part at
    exactly 00:00:00, which leaves ``zone_label`` in ``tod``.
    """
    tod = F.substring(F.date_format(local, "HH:mm"), 1, 4)
    if midnight_quirk:
        label = F.lit("UTC") if zone_label is None else zone_label
        tod = F.when(F.date_format(local, "HH:mm:ss") == "00:00:00", label).otherwise(tod)
    return {
        "dow": F.date_format(local, "EEEE"),
        "doy": F.date_format(local, "MM-dd"),
        "tod": tod,
        "daynum": F.datediff(local.cast("date"), F.lit(FIRST_DAY).cast("date")),
        "year": F.year(local),
    }


def tod_continuous(tod: Column) -> Column:
    """'HH:m' to hours: HH + m/6."""
    return F.substring(tod, 1, 2).cast("double") + F.substring(tod, 4, 1).cast("double") / 6


def day_after_noon(utc: Column) -> Column:
    """Day label of a daily grid whose day ends at 12 UTC."""
    return F.when(F.hour(utc) < 12, utc.cast("date")).otherwise(F.date_add(utc.cast("date"), 1))
