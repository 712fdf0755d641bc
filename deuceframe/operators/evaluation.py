"""Scores of forecasts, reliability, contrasts, intervals, selection, calibration and pooling."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deuceframe.functions.numbers import clipped, logit, sigmoid

CLIP = 1e-6


def log_loss(p: Column, y: Column, clip: float = CLIP) -> Column:
    q = clipped(p, clip)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def was_clipped(p: Column, clip: float = CLIP) -> Column:
    return ((p < clip) | (p > 1 - clip)).cast("int")


def identical_population(forecasts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows that every forecast has, one column `p_<name>` for each."""
    named = [df.select(key, F.col("p").alias(f"p_{n}")) for n, df in forecasts.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def ladder(rows: DataFrame, names: list[str], year: str, y: Column) -> DataFrame:
    """Per year and model: n, mean log loss, Brier score, clip count, winner accuracy with half credit for ties."""
    cells = [
        F.struct(
            F.lit(n).alias("model"), log_loss(F.col(f"p_{n}"), y).alias("loss"), F.pow(F.col(f"p_{n}") - y, F.lit(2.0)).alias("brier"),
            was_clipped(F.col(f"p_{n}")).alias("clips"),
            F.when(F.col(f"p_{n}") == 0.5, 0.5).otherwise(((F.col(f"p_{n}") > 0.5) == (y == 1)).cast("double")).alias("hit"),
        )
        for n in names
    ]
    return rows.select(F.col(year).alias("year"), F.explode(F.array(*cells)).alias("x")).select("year", "x.*").groupBy("year", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss_sum"), F.avg("loss").alias("log_loss"), F.avg("brier").alias("brier"),
        F.sum("clips").alias("clips"), F.avg("hit").alias("accuracy"),
    )


def pooled(per_year: DataFrame) -> DataFrame:
    """Match-weighted and equal-year mean losses per model."""
    return per_year.groupBy("model").agg(
        F.sum("n").alias("n"), (F.sum("loss_sum") / F.sum("n")).alias("match_weighted"), F.avg("log_loss").alias("equal_year"),
        F.count(F.lit(1)).alias("years"),
    )


def reliability(rows: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Fixed edges, the last bin closed on the right; empty bins have null means."""
    edges = [i / bins for i in range(bins + 1)]
    number = F.lit(bins - 1)
    for i in reversed(range(bins - 1)):
        number = F.when(p < edges[i + 1], i).otherwise(number)
    got = rows.where(p.isNotNull()).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_prediction"), F.avg(y).alias("outcome_rate")
    )
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_prediction", "outcome_rate")


def block_bootstrap(rows: DataFrame, block: list[str], delta: Column, replicates: int = 1000, seed: int = 7) -> DataFrame:
    """(n_blocks, mean, lower, upper): whole blocks resampled with replacement; a replicate's mean is summed delta over
    summed rows. Rows are reduced to a sum per block first; a replicate's Poisson weight of a block comes from a hash, so
    blocks stay distributed and each replicate is one sum."""
    sums = rows.groupBy(*block).agg(F.sum(delta).alias("s"), F.count(delta).alias("n"))
    u = (F.pmod(F.xxhash64(*block, "replicate", F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    cumulative, term, weight = 0.0, float(np.exp(-1.0)), F.lit(8)
    steps = []
    for k in range(8):
        cumulative += term
        steps.append((k, cumulative))
        term /= k + 1
    for k, c in reversed(steps):
        weight = F.when(u < c, k).otherwise(weight)
    drawn = sums.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("lower"), F.percentile("m", 0.975).alias("upper"))
    total = sums.agg(F.count(F.lit(1)).alias("n_blocks"), (F.sum("s") / F.sum("n")).alias("mean"))
    return total.crossJoin(interval)  # two single rows


def t_interval(per_year: DataFrame, value: str, critical: float) -> DataFrame:
    return per_year.agg(F.avg(value).alias("mean"), (F.lit(critical) * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half_width"))


def select_within(candidates: DataFrame, group: list[str], loss: str, order: str, tolerance: float = 1e-12) -> DataFrame:
    """The first candidate in menu order whose loss is within the tolerance of the group's least."""
    keys = ", ".join(group)
    near = candidates.withColumn("_least", F.expr(f"min({loss}) over (partition by {keys})")).where(F.col(loss) <= F.col("_least") + tolerance)
    return near.withColumn("_n", F.expr(f"row_number() over (partition by {keys} order by {order})")).where("_n = 1").drop("_n", "_least")


def pool(logits: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted mean of log-odds over the members that are present, as a probability; null if none is."""
    present = [F.when(logits[n].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for n, w in weights.items()]
    total = reduce(lambda a, b: a + b, present)
    mixed = reduce(lambda a, b: a + b, [F.coalesce(logits[n], F.lit(0.0)) * w for n, w in weights.items()])
    return F.when(total > 0, sigmoid(mixed / total))


def equal_year_slope(rows: DataFrame, p: Column, y: Column, year: str, steps: int = 40) -> float:
    """The non-negative slope on the log-odds that minimises the equal-year mean log loss.

    The rows are reduced to fine bins of log-odds per year (4,000 bins between -10 and 10), so that the bisection on the
    derivative runs on a bounded table.
    """
    x = F.greatest(F.least(logit(p, 1e-12), F.lit(10.0)), F.lit(-10.0))
    binned = rows.groupBy(year, F.round(x * 200).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("wins"), F.avg(x).alias("x")
    ).toPandas()
    if binned.empty:
        return 1.0
    size = binned.groupby(year)["n"].transform("sum")
    weight = 1.0 / (size * binned[year].nunique())

    def slope_of(k: float) -> float:
        q = 1 / (1 + np.exp(-k * binned.x))
        return float((weight * binned.x * (binned.n * q - binned.wins)).sum())

    low, high = 0.0, 1.0
    if slope_of(0.0) >= 0:
        return 0.0
    while slope_of(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if slope_of(middle) < 0 else (low, middle)
    return (low + high) / 2


def fit_ridge_logistic(x: np.ndarray, y: np.ndarray, c: float, weight: np.ndarray | None = None, nonnegative: bool = False) -> np.ndarray:
    """Coefficients without intercept of logistic regression with penalty 1/(2c) on features scaled by their root mean
    square, in the features' own units. Optionally all non-negative (projected steps)."""
    scale = np.sqrt((x**2).mean(0))
    scale[scale == 0] = 1.0
    z, w = x / scale, np.ones(len(x)) if weight is None else weight
    beta = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (p - y)) + beta / c
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.eye(len(beta)) / c
        free = ~((beta <= 0) & (gradient > 0)) if nonnegative else np.ones(len(beta), bool)
        step = np.zeros(len(beta))
        if free.any():
            step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        new = np.maximum(beta - step, 0) if nonnegative else beta - step
        if np.abs(new - beta).max() < 1e-10:
            beta = new
            break
        beta = new
    return beta / scale


def swap_symmetric_predictions(rows: DataFrame, signed: list[str], beta: np.ndarray) -> DataFrame:
    """p = (f(x) + 1 - f(-x)) / 2 for signed features: equal to f(x) for a model without intercept, kept general."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * float(v) for c, v in zip(signed, beta, strict=True)])
    return rows.withColumn("p", (sigmoid(score) + 1 - sigmoid(-score)) / 2)


def yearly_models(rows: DataFrame, plan: DataFrame, features: list[str], fit_rows: int = 200_000) -> DataFrame:
    """Coefficients per fold, fitted only on rows from its window: one task per fold, each on about `fit_rows` rows at most
    (all, or those whose hash lies below the share that gives so many). plan: fold, first, last, c; its rows are broadcast,
    being settings."""
    inside = (F.col("match_date") >= F.col("first")) & (F.col("match_date") <= F.col("last"))
    within = rows.join(F.broadcast(plan), inside)
    share = within.groupBy("fold").agg((F.lit(float(fit_rows)) / F.count(F.lit(1))).alias("_share"))  # a row a fold
    chosen = within.join(F.broadcast(share), "fold").where(F.pmod(F.xxhash64("match_id"), F.lit(1 << 20)) < F.col("_share") * (1 << 20))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        beta = fit_ridge_logistic(pdf[features].fillna(0.0).to_numpy(float), pdf.y.to_numpy(float), float(pdf.c.iloc[0]))
        return pd.DataFrame({"fold": [key[0]], "n": [len(pdf)], "beta": [beta.tolist()]})

    return chosen.groupBy("fold").applyInPandas(fit, "fold string, n bigint, beta array<double>")
