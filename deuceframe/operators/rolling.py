"""Totals over trailing periods, by a range join on coarse date buckets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def day_number(day: Column) -> Column:
    return F.datediff(day.cast("date"), F.lit(EPOCH).cast("date"))


def daily_totals(facts: DataFrame, entity: Column, day: Column, measures: Mapping[str, Column]) -> DataFrame:
    """One row per entity and active day: `rows_in_day` and a sum of each measure.

    Rows without entity or day are left out; a null measure adds 0. The sums are combined before the shuffle, so an
    entity with a third of all rows sends at most one row per day and map task.
    """
    return (
        facts.select(entity.alias("entity"), day_number(day).alias("day"), *[c.alias(n) for n, c in measures.items()])
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(
            F.count(F.lit(1)).alias("rows_in_day"),
            *[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in measures],
        )
    )


def trailing_totals(
    daily: DataFrame,
    probes: DataFrame,
    periods: Mapping[str, tuple[int, int]],
    measures: tuple[str, ...] = (),
) -> DataFrame:
    """For each distinct (entity, day) of `probes`, the totals of `daily` over trailing periods.

    periods: name -> (first, last), the days before the probe's day, both included: {"7d": (7, 2)} covers day-7 to
    day-2. Result: entity, day, and for each period `rows_<name>`, and for each measure `<measure>_<name>` and
    `<measure>_avg_<name>` (per day of the period, days without activity counting as 0).

    A probe without any activity, or with a null entity or day, gets zeros; repeated probes give one row; an empty
    `daily` gives zeros for all. Only the columns named here are read, so others may have any names.

    Every day belongs to one bucket as wide as the longest period, hence a probe meets at most two buckets, and the
    equi-join on (entity, bucket) hands it at most 2 * width daily rows, however active the entity is.
    """
    if not periods or any(first < last for first, last in periods.values()):
        raise ValueError("a period is (first, last) with first >= last days before the probe")
    far = max(first for first, _ in periods.values())
    near = min(last for _, last in periods.values())
    width = max(1, far - near + 1)
    bucket = lambda c: F.floor(c / F.lit(width))
    totals = ("rows_in_day", *measures)
    right = daily.select(
        F.col("entity").alias("_e"), bucket(F.col("day")).alias("_b"), F.col("day").alias("_d"), *totals
    )
    left = probes.select("entity", "day").distinct()
    left = left.select(
        "entity", "day", F.explode_outer(F.sequence(bucket(F.col("day") - far), bucket(F.col("day") - near))).alias("bucket")
    )
    joined = left.join(
        right,
        (F.col("entity") == F.col("_e"))
        & (F.col("bucket") == F.col("_b"))
        & F.col("_d").between(F.col("day") - far, F.col("day") - near),
        "left",
    )
    out = []
    for name, (first, last) in periods.items():
        inside = F.col("_d").between(F.col("day") - first, F.col("day") - last)
        for total in totals:
            value = F.coalesce(F.sum(F.when(inside, F.col(total))), F.lit(0))
            label = "rows" if total == "rows_in_day" else total
            out.append(value.alias(f"{label}_{name}"))
            if total != "rows_in_day":
                out.append((value / F.lit(float(first - last + 1))).alias(f"{label}_avg_{name}"))
    return joined.groupBy("entity", "day").agg(*out)


def entity_calendar(daily: DataFrame, extend: int = 0) -> DataFrame:
    """Every (entity, day) from an entity's first active day to `extend` days after its last one."""
    span = daily.groupBy("entity").agg(F.min("day").alias("_from"), F.max("day").alias("_to"))
    # a few rows that become many: an explicit number of partitions, which are not put together
    span = span.repartition(4 * daily.sparkSession.sparkContext.defaultParallelism, "entity")
    return span.select("entity", F.explode(F.sequence(F.col("_from"), F.col("_to") + extend)).alias("day"))
