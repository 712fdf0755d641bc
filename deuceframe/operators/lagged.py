"""History as of a cutoff: windows that end some days before each row, and values at the k-th last released row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A result can be used two days after its date.
LAG = 2


def released(keys: list[str], first: int | None = None, lag: int = LAG, day: str = "day") -> WindowSpec:
    """Rows of the same keys dated from `first` days before (all, if None) to `lag` days before the current row."""
    low = Window.unboundedPreceding if first is None else -first
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(low, -lag)


def decayed_sum(value: Column, keys: list[str], half_life: float, origin: int, lag: int = LAG, day: str = "day") -> Column:
    """The sum of released values, each halved every `half_life` days up to the current row.

    2^((d - t) / h) = 2^(d' / h) / 2^(t' / h) with d' and t' counted from `origin`, so a running sum suffices; the origin
    should be near the data, as the powers grow with the distance from it.
    """
    weight = F.pow(F.lit(2.0), (F.col(day) - F.lit(origin)) / F.lit(half_life))
    return F.coalesce(F.sum(value * weight).over(released(keys, None, lag, day)), F.lit(0.0)) / weight


def by_day(rows: DataFrame, keys: list[str], measures: dict[str, Column], features: dict[str, Column]) -> DataFrame:
    """rows with `features`, windows over a row per key and day that holds the sums of `measures`.

    However many rows a key has, its window is no longer than the calendar. Null keys form a group of their own.
    """
    days = rows.groupBy(*keys, "day").agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    seen = days.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("day").alias("_day"), *[c.alias(n) for n, c in features.items()])
    on = F.col("day") == F.col("_day")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(seen, on, "left").drop("_day", *[f"_{k}" for k in keys])


def form_over_last(rows: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column], k: int, lag: int = LAG) -> DataFrame:
    """Each row with the sums of `measures` over its last k released rows, and how many those were (`last_n`).

    The rows of a key are numbered and summed up once; a row's released rows are the first n of its key, so their last k
    are the difference of the totals at n and at n - k, fetched by two equi-joins instead of a list per row.
    """
    number = Window.partitionBy(*keys).orderBy("day", *order)
    run = number.rowsBetween(Window.unboundedPreceding, 0)
    base = rows.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_{m}") for m, c in measures.items()])
    base = base.select(
        "*",
        F.row_number().over(number).alias("_number"),
        F.count(F.lit(1)).over(released(keys, None, lag)).alias("_n"),
        *[F.sum(f"_{m}").over(run).alias(f"_run_{m}") for m in measures],
    )
    totals = base.select(*keys, F.col("_number").alias("_at"), *[f"_run_{m}" for m in measures])
    upper = totals.select(*keys, F.col("_at").alias("_n"), *[F.col(f"_run_{m}").alias(f"_hi_{m}") for m in measures])
    lower = totals.select(*keys, F.col("_at").alias("_low"), *[F.col(f"_run_{m}").alias(f"_lo_{m}") for m in measures])
    out = base.withColumn("_low", F.col("_n") - k).join(upper, [*keys, "_n"], "left").join(lower, [*keys, "_low"], "left")
    sums = [
        (F.coalesce(F.col(f"_hi_{m}"), F.lit(0)) - F.coalesce(F.col(f"_lo_{m}"), F.lit(0))).alias(m) for m in measures
    ]
    return out.select(*rows.columns, F.least(F.col("_n"), F.lit(k)).alias("last_n"), *sums)
