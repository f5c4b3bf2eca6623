"""Column helpers shared by the marts: filtered aggregates, safe rates, time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def count_when(cond: Column) -> Column:
    """``COUNT(*) FILTER (WHERE cond)``."""
    return F.count_if(cond)


def sum_when(cond: Column, value: Column) -> Column:
    """``SUM(value) FILTER (WHERE cond)``, 0 when nothing matches."""
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))


def distinct_when(cond: Column, value: Column) -> Column:
    """``COUNT(DISTINCT value) FILTER (WHERE cond)``; NULL values never count."""
    return F.count_distinct(F.when(cond, value))


def rate(numerator: Column, denominator: Column) -> Column:
    """Ratio in double precision, NULL on an empty denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share(cond: Column) -> Column:
    """Share of rows satisfying ``cond`` (NULL counts as not satisfying)."""
    return rate(F.count_if(cond), F.count(F.lit(1)))


def money(amount: Column) -> Column:
    """Exact decimal sums are handed out as double."""
    return amount.cast("double")


def days(n: Column | int) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def hours(n: Column | int) -> Column:
    return F.make_dt_interval(hours=n if isinstance(n, Column) else F.lit(n))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond resolution; works on both timestamp flavours."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def month_of(ts: Column) -> Column:
    """First day of the calendar month as a date (``date_trunc`` would change the timestamp flavour)."""
    return F.trunc(ts, "MM")


def date_key(ts: Column) -> Column:
    """Integer ``YYYYMMDD`` of the UTC date, NULL for NULL."""
    day = F.to_date(ts)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")
