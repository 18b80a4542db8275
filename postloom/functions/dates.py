"""Dates: posting dates, staleness, relative dates, free-text months.  The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ONGOING = ("present", "current", "now", "ongoing", "today", "to date")


def posted_at(raw: Column) -> Column:
    """Epoch seconds or ISO 8601 (no zone means UTC); anything else, RFC 822 included, is null."""
    number = F.when(raw.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.timestamp_seconds(raw.try_cast("double")))
    iso = F.when(raw.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(F.trim(raw), "Z$", "+00:00")))
    return F.coalesce(number, iso)


def is_stale(posted: Column, now: Column, max_days: int) -> Column:
    """More than max_days whole days old; unknown dates are fresh and 0 disables the test."""
    if max_days <= 0:
        return F.lit(False)
    return F.coalesce(F.timestamp_diff("DAY", posted, now) > max_days, F.lit(False))


def effective_date(posted: Column, fetched: Column) -> Column:
    return F.coalesce(posted, fetched)


def relative_date(said: Column, today: Column) -> Column:
    """today, yesterday, ``N days ago``; ``N+`` counts one day more."""
    low = F.lower(F.coalesce(said, F.lit("")))
    days = F.regexp_extract(low, r"(\d+)\s*(\+?)\s*day", 1).try_cast("int") + F.when(F.regexp_extract(low, r"(\d+)\s*(\+?)\s*day", 2) == "+", 1).otherwise(0)
    return F.when(low.contains("today"), today).when(low.contains("yesterday"), F.date_sub(today, 1)).otherwise(F.date_sub(today, days))


def month(said: Column, today: Column, is_end: bool = False) -> Column:
    """A free-text month as its first day, a bare year as 1 July; ongoing words mean today, a blank end too."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(said, F.lit(""))), ",", " "), r"\s+", " "))
    part = lambda pattern, k: F.regexp_extract(low, pattern, k).try_cast("int")
    first_of = lambda y, m: F.when(m.between(1, 12), F.make_date(y, F.greatest(F.least(m, F.lit(12)), F.lit(1)), F.lit(1)))
    named, dashed, slashed = rf"^({'|'.join(MONTHS)})\S* (\d{{1,4}})$", r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$"
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(low, named, 1)).cast("int")
    none = F.lit(None).cast("date")
    return (
        F.when(low.isin(*ONGOING) | low.contains("present"), today)
        .when(low == "", today if is_end else none)
        .when(low.rlike(named), F.when(part(named, 2).between(1900, 2200), first_of(part(named, 2), at)))
        .when(low.rlike(dashed), first_of(part(dashed, 1), part(dashed, 2)))
        .when(low.rlike(slashed), first_of(part(slashed, 2), part(slashed, 1)))
        .when(low.rlike(r"^\d{4}$"), F.when(low.try_cast("int").between(1900, 2200), F.make_date(low.try_cast("int"), F.lit(7), F.lit(1))))
    )


def entry_years(years: Column, start: Column, end: Column) -> Column:
    """Stated years win; otherwise days between the dates over 365.25, to one decimal (half up); null without a span."""
    return F.coalesce(years, F.when(end >= start, F.round(F.datediff(end, start) / 365.25, 1)))
