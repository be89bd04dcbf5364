"""Calendar expressions: period keys, half-open ranges, spoken timeframes and age labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spoken timeframes in the order they are tried.
TIMEFRAME_PHRASES = [
    "yesterday", "today", "last week", "this week", "last month", "this month", "last year", "this year",
]
DAY_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
MONTH_PATTERN = r"^\d{4}-\d{2}$"
WEEK_PATTERN = r"^\d{4}-W\d{2}$"
YEAR_PATTERN = r"^\d{4}$"


def _range(start: Column, end: Column) -> Column:
    return F.struct(start.cast("date").alias("start"), end.cast("date").alias("end"))


def monday(day: Column) -> Column:
    return F.trunc(day, "week")


def period_range(period: Column) -> Column:
    """A day, month, ISO week or year string as ``struct(start, end)``; NULL for anything else."""
    day = F.try_to_date(period, "yyyy-MM-dd")
    month = F.try_to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd")
    year = F.try_to_date(F.concat(period, F.lit("-01-01")), "yyyy-MM-dd")
    jan4 = F.try_to_date(F.concat(F.substring(period, 1, 4), F.lit("-01-04")), "yyyy-MM-dd")
    week_no = F.substring(period, 7, 2).try_cast("int")
    week = F.date_add(monday(jan4), (week_no - 1) * 7)
    return (
        F.when(period.rlike(DAY_PATTERN) & day.isNotNull(), _range(day, F.date_add(day, 1)))
        .when(period.rlike(MONTH_PATTERN) & month.isNotNull(), _range(month, F.add_months(month, 1)))
        .when(period.rlike(WEEK_PATTERN), _range(week, F.date_add(week, 7)))
        .when(period.rlike(YEAR_PATTERN) & year.isNotNull(), _range(year, F.add_months(year, 12)))
    )


def period_as_of(period: Column) -> Column:
    """Last day of a period."""
    return F.date_sub(period_range(period)["end"], 1)


def period_key(day: Column, level: str) -> Column:
    if level == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    if level == "monthly":
        return F.date_format(day, "yyyy-MM")
    if level == "yearly":
        return F.date_format(day, "yyyy")
    if level == "weekly":
        iso_year = F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0")
        return F.concat(iso_year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    raise ValueError(f"unknown level {level}")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def resolve_timeframe(query: Column, as_of: Column) -> Column:
    """Range of the first spoken timeframe of a query around ``as_of``; NULL when there is none."""
    today = F.to_date(as_of)
    week, month, year = monday(today), F.trunc(today, "month"), F.trunc(today, "year")
    ranges = {
        "yesterday": _range(F.date_sub(today, 1), today),
        "today": _range(today, F.date_add(today, 1)),
        "last week": _range(F.date_sub(week, 7), week),
        "this week": _range(week, F.date_add(week, 7)),
        "last month": _range(F.add_months(month, -1), month),
        "this month": _range(month, F.add_months(month, 1)),
        "last year": _range(F.add_months(year, -12), year),
        "this year": _range(year, F.add_months(year, 12)),
    }
    low = F.lower(query)
    out = None
    for phrase in TIMEFRAME_PHRASES:
        hit = F.contains(low, F.lit(phrase))
        out = F.when(hit, ranges[phrase]) if out is None else out.when(hit, ranges[phrase])
    return out


def age_days(start: Column, as_of: Column) -> Column:
    """Whole days between two instants, cut towards zero."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return (seconds / F.lit(86400e6)).cast("long")


def _age_label(start: Column, as_of: Column, wording: str) -> Column:
    days = age_days(start, as_of)

    def unit(count: Column, name: str) -> Column:
        n = F.greatest(count.cast("long"), F.lit(1))
        return F.when(n == 1, F.lit(f"1 {name} {wording}")).otherwise(
            F.concat(n.cast("string"), F.lit(f" {name}s {wording}"))
        )

    weeks = F.round(days / 7)
    months = F.round(days / F.lit(30.44))
    years = F.round(days / F.lit(365.25))
    return (
        F.when(days < 0, F.lit(""))
        .when(days == 0, F.lit("today"))
        .when(days < 7, unit(days, "day"))
        .when(days < 60, unit(weeks, "week"))
        .when(months < 12, unit(months, "month"))
        .otherwise(unit(years, "year"))
    )


def relative_date_label(start: Column, as_of: Column) -> Column:
    return _age_label(start, as_of, "before now")


def relative_delta_ago(start: Column, as_of: Column) -> Column:
    return _age_label(start, as_of, "ago")


def parse_spoken_date(text: Column) -> Column:
    """``3:04 pm on 2 January, 2006`` as a timestamp, NULL when it does not fit."""
    return F.try_to_timestamp(F.upper(text), F.lit("h:mm a 'ON' d MMMM, yyyy"))


def parse_slash_date(text: Column) -> Column:
    """``2006/01/02 (Mon) 15:04`` as a timestamp, NULL when it does not fit."""
    return F.try_to_timestamp(F.regexp_replace(text, r" \([A-Za-z]{3}\)", ""), F.lit("yyyy/MM/dd HH:mm"))
