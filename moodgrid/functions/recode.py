"""Small recodes: survey answers, names, incomes, shares, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors to 2019 money by survey year.
TO_2019 = {
    2011: 1.134772,
    2012: 1.1161985,
    2013: 1.0969534,
    2014: 1.0746823,
    2015: 1.0733538,
    2016: 1.0627546,
    2017: 1.0456737,
    2018: 1.0164848,
}
# Survey answers meaning unknown / refused, and none.
SURVEY_MISSING = (77, 99)
SURVEY_NONE = 88


def survey_days(answer: Column) -> Column:
    """Days answered; null for unknown or refused, 0 for none."""
    return F.when(answer == SURVEY_NONE, F.lit(0)).when(~answer.isin(*SURVEY_MISSING), answer)


def mdy_date(text: Column) -> Column:
    return F.to_date(text, "MMddyyyy")


def survey_year(year: Column) -> Column:
    """Five-year survey whose middle is closest to a post's year."""
    return F.when(year < 2017, year + 2).otherwise(F.lit(2018))


def to_2019_money(amount: Column, year_of_survey: Column) -> Column:
    factor = F.lit(None).cast("double")
    for year, value in TO_2019.items():
        factor = F.when(year_of_survey == year, F.lit(value)).otherwise(factor)
    return amount * factor


def share(part: Column, total: Column) -> Column:
    """part/total, null for an empty total."""
    return F.when(total != 0, part / total)


def other_count(parts: Mapping[str, Column], compat_twice: str | None = None) -> Column:
    """Sum of the remaining groups; ``compat_twice`` names one counted double."""
    total = sum(parts.values(), F.lit(0))
    return total + parts[compat_twice] if compat_twice else total


def majority_class(cols: Sequence[str]) -> Column:
    """Name of the largest column; the first one wins a tie, null if all are."""
    best = F.greatest(*cols)
    position = F.array_position(F.array(*cols), best).cast("int")
    names = F.array(*(F.lit(c) for c in cols))
    return F.when(position > 0, F.element_at(names, position))


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns with absent values as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0))


def last_in_list(text: Column, separator: str = "; ") -> Column:
    return F.element_at(F.split(text, separator), -1)


def rename_values(value: Column, fixes: Mapping[str, str]) -> Column:
    """Replace listed literals, keep the rest."""
    out = value
    for old, new in fixes.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def log_amount(x: Column, scale: float = 1.0) -> Column:
    """log(1 + scale*x) of the non-negative part of x."""
    return F.when(x.isNotNull(), F.log1p(F.lit(scale) * F.greatest(x.cast("double"), F.lit(0.0))))


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
