"""Tree models, fitted so that exchanging the sides exchanges the forecast."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_orientations(rows: DataFrame, signed: list[str], y: str) -> DataFrame:
    """Every row as it is and exchanged, at half weight: signed features negate, the rest stay, the outcome turns."""
    sign = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign")
    doubled = rows.select("*", sign)
    turned = [(F.col(c) * F.col("_sign")).alias(c) if c in signed else F.col(c) for c in rows.columns if c != y]
    outcome = F.when(F.col("_sign") == 1, F.col(y)).otherwise(1 - F.col(y)).cast("double").alias(y)
    return doubled.select(*turned, outcome, F.lit(0.5).alias("_weight"))


def fit_trees(rows: DataFrame, signed: list[str], context: list[str], y: str, kind: str = "boosted", seed: int = 7, **settings):
    """A fitted tree model on rows without nulls in `y`; missing features are 0 and have a flag of their own, as the
    trees know no missing values."""
    filled, columns = with_missing_flags(rows.where(F.col(y).isNotNull()), signed, context)
    data = VectorAssembler(inputCols=columns, outputCol="_x").transform(both_orientations(filled, signed, y))
    common = {"featuresCol": "_x", "labelCol": y, "weightCol": "_weight", "seed": seed}
    if kind == "boosted":
        return GBTClassifier(**common, **{"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, **settings}).fit(data)
    return RandomForestClassifier(**common, **{"numTrees": 50, "maxDepth": 6, "minInstancesPerNode": 50, "featureSubsetStrategy": "all", **settings}).fit(data)


def with_missing_flags(rows: DataFrame, signed: list[str], context: list[str]) -> tuple[DataFrame, list[str]]:
    features = [*signed, *context]
    flags = [F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features]
    kept = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in rows.columns]
    return rows.select(*kept, *flags), [*features, *[f"{c}_missing" for c in features]]


def symmetric_forecast(model, rows: DataFrame, signed: list[str], context: list[str], key: str) -> DataFrame:
    """(key, p): the mean of the forecast and of one less the exchanged forecast."""
    filled, columns = with_missing_flags(rows, signed, context)
    assembler = VectorAssembler(inputCols=columns, outputCol="_x")

    def scored(df: DataFrame, name: str) -> DataFrame:
        return model.transform(assembler.transform(df)).select(key, vector_to_array("probability")[1].alias(name))

    turned = reduce(lambda df, c: df.withColumn(c, -F.col(c)), signed, filled)
    return scored(filled, "_p").join(scored(turned, "_q"), key).select(key, ((F.col("_p") + 1 - F.col("_q")) / 2).alias("p"))
