"""Calendars and report periods."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

# Period name -> date_trunc unit.
PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}


def unit_of(period: str) -> str:
    try:
        return PERIOD_UNITS[period]
    except KeyError:
        raise ValueError(f"period must be one of {sorted(PERIOD_UNITS)}, not {period!r}") from None


def ordered(start: date, end: date) -> tuple[date, date]:
    """Swapped bounds are put right."""
    return (start, end) if start <= end else (end, start)


def floor_to(day: date, unit: str) -> date:
    """First day of the day's bucket; weeks start on Monday."""
    if unit == "week":
        return day - timedelta(days=day.weekday())
    if unit == "month":
        return day.replace(day=1)
    return day


def next_bucket(day: date, unit: str) -> date:
    """First day of the bucket after the one that starts on ``day``."""
    if unit == "week":
        return day + timedelta(days=7)
    if unit == "month":
        return (day.replace(day=28) + timedelta(days=4)).replace(day=1)
    return day + timedelta(days=1)


def calendar(spark: SparkSession, start: date, end: date, unit: str = "day") -> DataFrame:
    """One row per bucket from the one holding ``start`` to the one holding ``end``.

    The rows sit in one partition in calendar order, so a report that keeps them
    on the left of a broadcast join needs no shuffle to be sorted.
    """
    first, last = floor_to(start, unit), floor_to(end, unit)
    return spark.range(0, 1, 1, numPartitions=1).select(
        F.explode(
            F.sequence(F.lit(first), F.lit(last), F.expr(f"interval 1 {unit}"))
        ).alias("date")
    )


def previous_window(start: date, end: date) -> tuple[date, date]:
    """Window of equal length that ends the day before ``start``."""
    days = (end - start).days + 1
    return start - timedelta(days=days), start - timedelta(days=1)


def preset_range(preset: str, as_of: date) -> tuple[date, date]:
    """Named report period that ends on ``as_of`` (or with the last full month)."""
    month_start = as_of.replace(day=1)
    if preset == "weekly":
        return as_of - timedelta(days=6), as_of
    if preset in ("monthly", "mtd"):
        return month_start, as_of
    if preset in ("quarterly", "qtd"):
        return month_start.replace(month=as_of.month - (as_of.month - 1) % 3), as_of
    if preset == "semesterly":
        return month_start.replace(month=1 if as_of.month <= 6 else 7), as_of
    if preset in ("yearly", "ytd"):
        return month_start.replace(month=1), as_of
    if preset == "last_month":
        last_day = month_start - timedelta(days=1)
        return last_day.replace(day=1), last_day
    return as_of, as_of
