"""Joins that resolve, merge and compare records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deuceframe.session import Scratch


def merge_with_precedence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of `first`, and those of `second` whose key `first` does not have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, change): added, removed, revised, duplicate (several rows of one key) or same, comparing nulls as equal."""

    def state(df: DataFrame, tag: str) -> DataFrame:
        packed = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{tag}_n"), F.min(packed).alias(f"{tag}_v"))

    both = state(old, "old").join(state(new, "new"), key, "full")
    change = (
        F.when(F.col("new_n").isNull(), "removed")
        .when(F.col("new_n") > 1, "duplicate")
        .when(F.col("old_n").isNull(), "added")
        .when(F.col("old_v").eqNullSafe(F.col("new_v")), "same")
        .otherwise("revised")
    )
    return both.select(key, change.alias("change"))


def guarded_patch(rows: DataFrame, patches: DataFrame, key: str, asserts: list[str], sets: list[str]) -> DataFrame:
    """Rows with corrections applied where every asserted prior value matches; `patch` says applied, refused or none.

    patches: key, `was_<c>` for each asserted column and `new_<c>` for each that is set; one patch per key.
    """
    both = rows.join(patches.withColumn("_there", F.lit(True)), key, "left")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in asserts])
    hit = F.coalesce(F.col("_there"), F.lit(False))
    out = [
        (F.when(hit & match, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)) for c in rows.columns
    ]
    return both.select(*out, F.when(~hit, "none").when(match, "applied").otherwise("refused").alias("patch"))


def unique_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing by key: `paired` where both sides have exactly one row, else ambiguous or the missing side."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_n"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_n"))
    outcome = (
        F.when(F.col("left_n").isNull(), "right_only")
        .when(F.col("right_n").isNull(), "left_only")
        .when((F.col("left_n") == 1) & (F.col("right_n") == 1), "paired")
        .otherwise("ambiguous")
    )
    return l.join(r, keys, "full").select(*keys, outcome.alias("outcome"))


def cascade(rows: DataFrame, tables: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """The first table's answer that is unique for a row: (table, key column, label), tried in order.

    A key with several distinct values is ambiguous and stops the search: later tables are not asked.
    """
    out = rows
    answers, stops = [], []
    for i, (lookup, key, label) in enumerate(tables):
        grouped = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.min(value).alias(f"_v{i}"), F.countDistinct(value).alias(f"_n{i}")
        )
        out = out.join(grouped, key, "left")
        answers.append(F.when(F.col(f"_n{i}") == 1, F.struct(F.col(f"_v{i}").alias("value"), F.lit(label).alias("by"))))
        stops.append(F.when(F.col(f"_n{i}") > 1, F.struct(F.lit(None).cast(lookup.schema[value].dataType).alias("value"), F.lit("ambiguous").alias("by"))))
    picked = F.coalesce(*[x for pair in zip(answers, stops, strict=True) for x in pair])
    return out.select(*rows.columns, picked["value"].alias(value), F.coalesce(picked["by"], F.lit("none")).alias("by"))


def compared_fields(pairs: DataFrame, key: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, field, left, right) for each compared field in which both sides have values and differ."""
    cells = [
        F.struct(F.lit(n).alias("field"), a.cast("string").alias("left"), b.cast("string").alias("right")) for n, (a, b) in fields.items()
    ]
    return pairs.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*").where("left <> right")


def sole_claimants(claims: DataFrame, target: str, strong: Column) -> DataFrame:
    """One claimant per target: the only strong claim wins; otherwise all claims of the target stay unresolved."""
    w = Window.partitionBy(target)
    return claims.withColumn("_strong", F.count_if(strong).over(w)).select(
        *claims.columns, F.when(strong & (F.col("_strong") == 1), "accepted").otherwise("unresolved").alias("verdict")
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each connected component, by propagating minima and jumping ahead.

    Each round takes the smallest label among the neighbours, then the label of that label; states are written to the
    shared folder, so lineage stays short. Rounds grow with the logarithm of the longest path in practice.
    """
    scratch = Scratch(edges.sparkSession, "components")
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = scratch.write(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("label")), "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.x == labels.node).groupBy("y").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.y, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("ahead"))
        ahead = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("ahead", "label")).alias("label"))
        labels = scratch.write(ahead, f"labels{step}")
        scratch.drop(f"labels{step - 1}")
        if labels.where("label <> old").isEmpty():
            scratch.keep_only(f"labels{step}")
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("old")


def residual_similarity(left: DataFrame, right: DataFrame, name: str, opponent: str) -> DataFrame:
    """(left_name, right_name, similarity): shared opponents as multisets, over the smaller multiset.

    Only names that share an opponent are compared.
    """
    count = lambda df, tag: df.groupBy(F.col(name).alias(f"{tag}_name"), opponent).agg(F.count(F.lit(1)).alias(f"{tag}_n"))
    l, r = count(left, "left"), count(right, "right")
    size = lambda df, tag: df.groupBy(f"{tag}_name").agg(F.sum(f"{tag}_n").alias(f"{tag}_size"))
    shared = l.join(r, opponent).groupBy("left_name", "right_name").agg(F.sum(F.least("left_n", "right_n")).alias("shared"))
    sized = shared.join(size(l, "left"), "left_name").join(size(r, "right"), "right_name")
    return sized.select("left_name", "right_name", (F.col("shared") / F.least("left_size", "right_size")).alias("similarity"))
