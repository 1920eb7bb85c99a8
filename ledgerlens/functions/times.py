"""Time helpers; all assume a UTC session."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: datetime | str | Column) -> Column:
    """The caller's ``as_of`` as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        return F.lit(as_of).cast("timestamp")
    return F.lit(as_of)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text, with or without fraction and offset, as a timestamp; null when malformed."""
    return F.trim(text).try_cast("timestamp")


def utc_day(at: Column) -> Column:
    return F.date_trunc("day", at)


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)


def plus_hours(at: Column, hours: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), hours)


def freshness(at: Column, as_of: Column) -> Column:
    """Live up to 4 hours, Delayed up to 24, Stale beyond."""
    age = hours_between(at, as_of)
    return F.when(age > 24, "Stale").when(age > 4, "Delayed").otherwise("Live")
