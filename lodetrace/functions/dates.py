"""Column expressions over dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(then: Column, now: Column) -> Column:
    """Days from a date written as text to a timestamp, with their fraction; null for what is no date."""
    return (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(then))) / 8.64e10


def whole_days(days: Column) -> Column:
    """Days rounded half up."""
    return F.floor(days + 0.5).cast("int")


def months(days: Column) -> Column:
    """Months of thirty days, rounded half up."""
    return F.floor(days / 30 + 0.5).cast("int")
