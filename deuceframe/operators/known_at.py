"""Attributes as they could be known at an event's time, from independent change histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_history(rows: DataFrame, keys: list[str], known: Column, value: Column) -> DataFrame:
    """The states one attribute went through: keys, `known_day`, `value`, `values_seen`.

    Everything that became known on a day is one change. `value` is the value if all rows known so far agree (null
    agreeing with null), else null; `values_seen` is 1 while they agree and 2 once they differ. Rows without a known
    day are left out. Repeated rows change nothing. The rows of a key and day are reduced before they are shuffled, so
    the window below sees at most one row per key and day.
    """
    marked = F.struct(value.isNull().alias("absent"), value.alias("v"))
    day = rows.select(*keys, known.cast("date").alias("known_day"), marked.alias("m")).where("known_day is not null")
    day = day.groupBy(*keys, "known_day").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    until = f"over (partition by {', '.join(f'`{k}`' for k in keys)} order by known_day)"
    states = day.select(
        *keys, "known_day", F.expr(f"min(lo) {until}").alias("lo"), F.expr(f"max(hi) {until}").alias("hi")
    )
    agree = F.col("lo").eqNullSafe(F.col("hi"))
    return states.select(
        *keys,
        "known_day",
        F.when(agree, F.col("lo.v")).alias("value"),
        F.when(agree, 1).otherwise(2).alias("values_seen"),
    )


def last_known(requests: DataFrame, history: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each distinct request (keys, at), the newest state of `history` known on day `at` or before.

    Requests without one, and those with a null key or day, give no row.
    """
    asked = requests.select(*keys, at).distinct()
    return (
        asked.join(history, keys)
        .where(F.col("known_day") <= F.col(at))
        .groupBy(*keys, at)
        .agg(
            F.max_by(F.struct("value", "values_seen"), "known_day").alias("s"), F.max("known_day").alias("known_day")
        )
        .select(*keys, at, "known_day", "s.value", "s.values_seen")
    )


def attributes_as_known(
    requests: DataFrame, histories: Mapping[str, DataFrame], keys: list[str], at: str
) -> DataFrame:
    """One row per distinct request with each attribute's own last known state, pivoted back into columns.

    For every attribute a: `a` (its value), `a_seen` (null: nothing known; 1: known and agreed; 2: contradicting) and
    `a_known_day`. Attributes change independently, so each is matched with its own history; no wide versions are made.
    """
    out = requests.select(*keys, at).distinct()
    for name, history in histories.items():
        found = last_known(requests, history, keys, at).select(
            *keys,
            at,
            F.col("value").alias(name),
            F.col("values_seen").alias(f"{name}_seen"),
            F.col("known_day").alias(f"{name}_known_day"),
        )
        out = out.join(found, [*keys, at], "left")
    return out


def newest_edition_by_day(rows: DataFrame, edition: Column, known: Column, days: DataFrame, day: str) -> DataFrame:
    """For each distinct `day` of `days`, the newest edition of which any row was known: `day`, `edition`.

    An edition is known from the first day on which one of its rows is. Days before any known edition are left out.
    The running maximum goes over one row per day on which something became known, which the calendar bounds.
    """
    first = (
        rows.select(edition.cast("date").alias("edition"), known.cast("date").alias("known_day"))
        .where("edition is not null and known_day is not null")
        .groupBy("edition")
        .agg(F.min("known_day").alias("known_day"))
    )
    steps = first.groupBy("known_day").agg(F.max("edition").alias("edition"))
    asked = days.select(F.col(day).alias("known_day")).where("known_day is not null").distinct()
    line = steps.withColumn("asked", F.lit(False)).unionByName(
        asked.select("known_day", F.lit(None).cast("date").alias("edition"), F.lit(True).alias("asked"))
    )
    filled = line.select(
        F.col("known_day").alias(day), F.expr("max(edition) over (order by known_day)").alias("edition"), "asked"
    )
    return filled.where("asked and edition is not null").select(day, "edition")
