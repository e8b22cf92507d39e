"""Shifts, inspection windows and periods; every function takes its time as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The moment that queries call now.
NOW = "2024-01-30 23:59:59"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def shift(ts: Column) -> tuple[Column, Column]:
    """(date, 'day' or 'night'): 08:00 to 20:00 is day; hours before 08:00 belong to the night before."""
    hour, date = F.hour(ts), F.to_date(ts)
    return F.when(hour < 8, F.date_sub(date, 1)).otherwise(date), F.when((hour >= 8) & (hour < 20), "day").otherwise("night")


def inspection_window(ts: Column, start_minutes: int, interval_minutes: int) -> tuple[Column, Column]:
    """(start, end) as epoch seconds of the window that holds ``ts``; windows begin anew each day at the start clock."""
    day = seconds(F.date_trunc("day", ts))
    origin = F.when(seconds(ts) >= day + start_minutes * 60, day + start_minutes * 60).otherwise(day + start_minutes * 60 - 86400)
    start = origin + F.floor((seconds(ts) - origin) / (interval_minutes * 60)) * (interval_minutes * 60)
    return start, start + interval_minutes * 60
