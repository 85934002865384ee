"""Clinical days, months, gestational weeks and ages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Panama"


def clinical_day(ts: Column | str) -> Column:
    """The calendar day in Panama of an instant, whatever the session's time zone; null for null."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(ZONE), ts.cast("timestamp_ntz")))


def local_micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp without time zone since 1970, whatever the session's time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def clinical_month(ts: Column | str) -> Column:
    """The first day of the clinical month."""
    return F.trunc(clinical_day(ts), "MM")


def month_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def gestational_week(day: Column, start: Column) -> Column:
    """Weeks begun since the start, from 1; days before the start floor downwards (0, -1, ...)."""
    return (F.floor(F.datediff(day, start) / F.lit(7)) + 1).cast("int")


def own_day(iso: Column) -> Column:
    """The day of an ISO instant in the zone it is written in, which no timestamp keeps; null for any other text."""
    return F.when(F.try_to_timestamp(iso).isNotNull(), F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd"))


def exact_weeks(end: Column, start: Column) -> Column:
    """Whole weeks between two days; null if negative or not a multiple of seven."""
    days = F.datediff(end, start)
    return F.when((days >= 0) & (days % 7 == 0), (days / 7).cast("int"))


def trimester(week: Column) -> Column:
    return F.when(week <= 13, 1).when(week <= 27, 2).when(week.isNotNull(), 3)


def gestational_month(week: Column) -> Column:
    return F.least(F.lit(9), F.floor((week - 1) / F.lit(4)) + 1).cast("int")


def calendar_years(later: Column, earlier: Column) -> Column:
    """Full years by the calendar: 29 February counts as reached on 1 March of common years."""
    short = F.date_format(later, "MMdd") < F.date_format(earlier, "MMdd")
    return F.year(later) - F.year(earlier) - short.cast("int")


def age_band(later: Column, earlier: Column) -> Column:
    """The lower end of the five-year band of the age."""
    return (F.floor(calendar_years(later, earlier) / F.lit(5)) * 5).cast("int")


def day_at_least(day: Column, start: Column, end: Column) -> Column:
    """Inclusive containment in a period whose end may be open (null)."""
    return (start <= day) & (end.isNull() | (day <= end))
