"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_date(text: Column) -> Column:
    """A YYYYMMDD text as a date, null if it is none."""
    fits = F.regexp_like(F.trim(text), F.lit("^[0-9]{8}$"))
    return F.when(fits, F.to_date(F.try_to_timestamp(F.trim(text), F.lit("yyyyMMdd"))))


def day_of(date: Column) -> Column:
    """Days since 1970."""
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def availability_cutoff(date: Column, lag: int = 2) -> Column:
    return F.date_sub(date, lag)


def monday_of(date: Column) -> Column:
    return F.to_date(F.date_trunc("week", date))


def satellite_end(anchor: Column, legs: Column) -> Column:
    """A circuit of several legs is only known complete a week after its last leg began."""
    return F.date_add(anchor, 7 * legs)


def local_date(instant: Column, zone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def training_window(year: Column, years: int = 3) -> Column:
    """struct<first, last>: the years before a target year, ending two days before it begins."""
    return F.struct(
        F.make_date(year - years, F.lit(1), F.lit(1)).alias("first"), F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 2).alias("last")
    )
