"""Filling containers of fixed capacity by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deuceframe.session import Scratch

#: Items that one task packs together (it bounds the task's memory and time at every size of the input), and how many
#: times fewer of them its emptiest bins may give back.
GROUP_ITEMS, GIVEN_BACK = 20_000, 16
PACKED = "container bigint, row bigint, doc_id bigint, piece int, token_from bigint, n_tokens bigint, loss_tokens bigint, position int"


@dataclass(frozen=True)
class Limits:
    """What a container may hold: tokens, segments (items) and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


def pack(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each item; sizes has a row of demands for each, none above its limit.

    Bins are filled one after another. The next item is the one whose demands, as shares of the limits, have the
    largest dot product with what the bin has left, among those that fit in every dimension. Equal items are
    interchangeable, so the search goes over distinct demands with their numbers. Ties go to the larger demand.
    """
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    kinds, kind_of = kinds[::-1], len(kinds) - 1 - kind_of
    order = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    next_item = np.concatenate(([0], np.cumsum(left)))[:-1]
    share = kinds / limits
    bins = np.full(len(sizes), -1, np.int64)
    alive = np.arange(len(kinds))
    current = 0
    room = limits.astype(float).copy()
    remaining = len(sizes)
    while remaining:
        fits = (kinds[alive] <= room).all(axis=1)
        if not fits.any():
            current, room = current + 1, limits.astype(float).copy()
            continue
        able = alive[fits]
        best = able[np.argmax(share[able] @ (room / limits))]
        bins[order[next_item[best]]] = current
        next_item[best] += 1
        left[best] -= 1
        room = room - kinds[best]
        remaining -= 1
        if not left[best]:
            alive = alive[alive != best]
    return bins


def _kept(demand: np.ndarray, bins: np.ndarray, cap: np.ndarray, give_back: int) -> np.ndarray:
    """Which bins are final: those nearly full, and of the others all but the emptiest, which together give back at most
    `give_back` items. What fills no bins (items just over half a container) stays where it is after one round."""
    used = np.zeros((bins.max() + 1, 3))
    np.add.at(used, bins, demand)
    room = ((cap - used) / cap).min(axis=1)
    order = np.argsort(-room, kind="stable")
    given = np.cumsum(used[order, 1]) <= give_back
    keep = np.ones(len(used), bool)
    keep[order[given]] = room[order[given]] <= 0.002
    return keep


def _packed(round_no: int, limits: Limits, give_back: int):
    """Packs each group; the items of bins that are not final are given back (container null)."""
    cap = limits.array()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "row"], kind="stable").reset_index(drop=True)
        demand = np.stack([pdf.n_tokens.to_numpy(), np.ones(len(pdf)), pdf.loss_tokens.to_numpy()], 1).astype(float)
        bins = pack(demand, cap)
        keep = _kept(demand, bins, cap, give_back)
        group = int(pdf.grp.iloc[0])
        container = np.where(keep[bins], (round_no << 56) + (group << 24) + bins, -1)
        out = pdf[["row", "doc_id", "piece", "token_from", "n_tokens", "loss_tokens"]].copy()
        out.insert(0, "container", pd.array(container, "Int64"))
        out["position"] = pd.Series(bins).groupby(bins).cumcount().astype("int32")
        out.loc[out.container == -1, "container"] = pd.NA
        return out

    return run


def fill_containers(items: DataFrame, limits: Limits = Limits(), group_items: int = GROUP_ITEMS) -> DataFrame:
    """(container, doc_id, piece, token_from, n_tokens, position): where the tokens of each item went.

    items: doc_id bigint, n_tokens bigint, optionally loss_tokens bigint (else all tokens bear loss). Items without
    tokens take no space and get no row; null n_tokens count as 0. Only an item longer than a container is divided, into
    full containers and a rest. Repeated doc_ids are packed as separate items. An empty table gives an empty table.

    Items go to groups by a hash, so that no key decides a group's size, and each group is packed alone. Its emptiest bins
    are given back, with at most one in GIVEN_BACK of its items, and what all groups gave back is packed again in the
    same way, until one group is left: the rounds shrink fast, no task ever has more than about group_items, and what is
    lost is the space in the last group's bins and in bins that items of such sizes cannot fill.
    """
    has_loss = "loss_tokens" in items.columns
    given = items.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"),
        *([F.coalesce(F.col("loss_tokens").cast("bigint"), F.lit(0)).alias("loss_of_item")] if has_loss else []),
    ).where("n_tokens > 0")
    cap = min(limits.tokens, limits.loss_tokens)
    start = F.col("piece").cast("bigint") * cap
    cut = given.withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / cap).cast("int")))
    ).select("*", start.alias("token_from"), F.least(F.col("n_tokens") - start, F.lit(cap)).alias("part"))
    loss = F.col("part")
    if has_loss:  # the loss-bearing tokens of a divided item are taken to lie at its end
        before = F.col("n_tokens") - F.col("loss_of_item")
        loss = F.greatest(F.least(F.col("part"), F.col("token_from") + F.col("part") - before), F.lit(0))
    ready = cut.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "piece",
        "token_from",
        F.col("part").alias("n_tokens"),
        loss.cast("bigint").alias("loss_tokens"),
        F.lit(0).alias("position"),
    )
    spark = items.sparkSession
    scratch = Scratch(spark, "packing")
    rest = scratch.write(ready, "items")
    full = (F.col("n_tokens") == cap) | (F.lit(limits.segments) == 1)
    done = [rest.where(full).withColumn("container", F.lit(1 << 62) + F.col("row"))]
    rest = rest.where(~full)
    waiting = rest.count()
    round_no = 0
    while waiting:
        groups = -(-waiting // group_items)
        last = groups == 1
        grouped = rest.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups)).cast("int"))
        # one task a group: small partitions would be put together, though their work is large
        spread = grouped.drop("position").repartition(groups, "grp")
        packed = spread.groupBy("grp").applyInPandas(_packed(round_no, limits, 0 if last else group_items // GIVEN_BACK), PACKED)
        packed = scratch.write(packed, f"round{round_no}")
        done.append(packed.where("container is not null"))
        rest = packed.where("container is null")
        waiting = 0 if last else rest.count()
        round_no += 1
    columns = ["container", "doc_id", "piece", "token_from", "n_tokens", "position"]
    out = done[0].select(*columns)
    for part in done[1:]:
        out = out.unionByName(part.select(*columns))
    out = scratch.write(out, "placed")
    scratch.keep_only("placed")
    return out
