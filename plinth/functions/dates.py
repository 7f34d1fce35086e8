"""Calendar functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: Column, strict: bool = True) -> Column:
    """YYYY-MM-DD as a date; other text or a day that does not exist raises, or is null if not strict."""
    day = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(text, "yyyy-MM-dd"))
    if not strict:
        return day
    return F.coalesce(day, F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(text, F.lit("null")))).cast("date"))


def add_year(day: Column) -> Column:
    """One calendar year later; 29 February becomes 28 February."""
    return F.add_months(day, 12)


def epoch_days(day: Column) -> Column:
    return F.unix_date(day)


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def is_leap_year(day: Column) -> Column:
    return F.day(F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))) == 29


def next_year(day: date) -> date:
    """add_year for one Python date."""
    try:
        return day.replace(year=day.year + 1)
    except ValueError:
        return day.replace(year=day.year + 1, day=28)
