"""One ranking of all items from pairwise outcomes, by Gaussian message passing.

Every item's skill is a Gaussian; an outcome says that the winner's noisy performance was higher. Outcomes of the same
pair are one factor with a number. In each sweep all factors send both items a Gaussian message (moment matching of the
truncated difference, computed from the items' states without the factor's own message), and each item multiplies the
prior with its messages. The same sweeps carry marks from one well-connected item along and against the wins: items
that get both marks are comparable with it through chains of wins in both directions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deuceframe.session import Scratch

#: Coefficients of the normal tail integral's rational approximation (fixed values, Abramowitz and Stegun 26.2.17).
TAIL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Up to so many states are broadcast (about 40 bytes each); beyond, the joins shuffle.
BROADCAST_ITEMS = 200_000


@dataclass(frozen=True)
class Skill:
    """Prior mean and deviation of a skill, deviation of a performance, and when sweeps end: once no mean moves by
    `tolerance` of its own deviation, or after so many sweeps (items that still move are then marked as unsettled)."""

    mean: float = 25.0
    deviation: float = 25.0 / 3
    performance: float = 25.0 / 6
    damping: float = 0.7
    tolerance: float = 0.05
    sweeps: int = 400


def _ratio(t: str) -> str:
    """The normal density over the normal distribution function at t."""
    p, *b = TAIL
    k = f"(1D / (1D + {p}D * abs({t})))"
    poly = "0D"
    for c in reversed(b):
        poly = f"({poly} + {c}D) * {k}"
    density = f"exp(-0.5D * {t} * {t}) * {1 / sqrt(2 * pi)}D"
    return f"case when {t} < 0 then 1D / ({poly}) else {density} / (1D - {density} * {poly}) end"


def _messages(joined: str, skill: Skill, first: bool) -> str:
    """SQL that adds the precision and precision-weighted mean of one outcome's message to winner and loser.

    A state contains the factor's own message, which has to come out first. Nothing is stored for a factor: its message
    is solved for from the two states, once with the states as they are and twice more with that message taken out.
    """
    text = f"select *, vw qw, vl ql, mw uw, ml ul from ({joined})"
    for again in range(1 if first else 3):
        base = "board, winner, loser, n, mw, vw, ml, vl, fw, bl, free"
        if again:  # the state without the message: never less precise than a tenth of the state
            text = f"""select {base}, qw, ql, (mw / vw - tw) * qw uw, (ml / vl - tl) * ql ul from (
              select *, 1D / greatest(1D / vw - pw, 0.1D / vw) qw, 1D / greatest(1D / vl - pl, 0.1D / vl) ql
              from ({text}))"""
        inner = f"{base}, qw, ql, uw, ul"
        text = f"select {inner}, c, (uw - ul) / c d from (select *, sqrt(qw + ql + {2 * skill.performance**2}D) c from ({text}))"
        text = f"select *, least(greatest(v * (v + d), 1e-9D), {1 - 1e-9}D) w from (select *, {_ratio('d')} v from ({text}))"
        text = f"""select {base}, pw, pl, pw * (uw + c * v / w) tw, pl * (ul - c * v / w) tl from (
          select *, 1D / (c * c / w - qw) pw, 1D / (c * c / w - ql) pl from ({text}))"""
    return text


def _sweep(edges: DataFrame, states: DataFrame, small: bool, skill: Skill, first: bool, beliefs: bool) -> DataFrame:
    """The states after one round of messages; marks pass only between items that are not in a part yet."""
    hint = "/*+ broadcast(x), broadcast(y) */" if small else ""
    joined = f"""select {hint} e.board, winner, loser, n, x.mean mw, x.variance vw, y.mean ml, y.variance vl,
      x.forward and x.part is null and y.part is null fw, y.backward and x.part is null and y.part is null bl,
      x.part is null and y.part is null free
      from {{edges}} e join {{states}} x on x.board = e.board and x.item = winner
      join {{states}} y on y.board = e.board and y.item = loser"""
    sums = "n * pw pw, n * tw tw, n * pl pl, n * tl tl" if beliefs else "0D pw, 0D tw, 0D pl, 0D tl"
    sent = f"select board, winner, loser, fw, bl, free, {sums} from ({_messages(joined, skill, first) if beliefs else joined})"
    got = f"""select board, item, sum(p) p, sum(t) t, max(f) f, max(b) b, max(o) o, max(i) i from (
      select board, inline(array(
        named_struct('item', winner, 'p', pw, 't', tw, 'f', false, 'b', bl, 'o', free, 'i', false),
        named_struct('item', loser, 'p', pl, 't', tl, 'f', fw, 'b', false, 'o', false, 'i', free)))
      from ({sent})) group by board, item"""
    rate = 1.0 if first else skill.damping
    new = f"""select s.*, g.f, g.b, g.o, g.i,
      {1 - rate}D / variance + {rate}D * ({1 / skill.deviation**2}D + g.p) precision,
      {1 - rate}D * mean / variance + {rate}D * ({skill.mean / skill.deviation**2}D + g.t) weighted
      from {{states}} s join ({got}) g on g.board = s.board and g.item = s.item"""
    mean, variance = ("weighted / precision", "1D / precision") if beliefs else ("mean", "variance")
    moved = f"abs({mean} - mean) * sqrt(precision)" if beliefs else "0D"
    return edges.sparkSession.sql(
        f"""select board, item, wins, losses, {mean} mean, {variance} variance, forward or f forward, backward or b backward,
        -- an unassigned item that beat nobody, or lost to nobody, of the unassigned is a part of its own
        case when part is not null then part when not (o and i) then item end part,
        {f"{moved} < {skill.tolerance}D" if beliefs else "settled"} settled, {moved} moved, (not forward and f) or (not backward and b) marked, part is null and not (o and i) single
        from ({new})""",
        edges=edges,
        states=states,
    )


def _start_marks(states: DataFrame) -> DataFrame:
    """Marks, of each board, the unassigned item with the most wins times losses (the smallest item of equals)."""
    start = states.where("part is null").groupBy("board").agg(
        F.max(F.struct((F.col("wins") * F.col("losses")).alias("score"), (-F.col("item")).alias("item"))).alias("s")
    )
    at = states.join(start.select("board", (-F.col("s.item")).alias("start")), "board", "left")
    here = F.coalesce(F.col("part").isNull() & (F.col("item") == F.col("start")), F.lit(False))
    return at.withColumn("forward", here).withColumn("backward", here).drop("start")


def gaussian_ranking(outcomes: DataFrame, skill: Skill = Skill()) -> DataFrame:
    """(board, item, wins, losses, mean, deviation, strength, comparable, settled, place) of every item with an outcome.

    outcomes: board (any groups that are ranked apart), winner, loser (bigint); rows with a null in one of them, and
    those of an item against itself, are left out. Repeated rows are outcomes of their own. strength is the mean less
    three deviations. comparable: the item belongs to the board's largest set of items between any two of which chains
    of wins lead in both directions (of equal sets, the one with the smallest item). place ranks the comparable items
    of a board by strength, equal strengths by item; others have none. settled: the item's mean no longer moved when the
    sweeps ended. An empty table gives an empty table.

    Equal pairs are counted before anything is shuffled, so a factor is a pair, not an outcome. Sweeps go on until the
    means have settled and no mark is new. Sets other than the first are only looked for while they could be
    larger; items that can be in none (no wins or no losses among the rest) are taken out on the way.
    """
    spark = outcomes.sparkSession
    scratch = Scratch(spark, "ranking")
    pairs = outcomes.where("board is not null and winner is not null and loser is not null and winner <> loser")
    edges = scratch.write(pairs.groupBy("board", "winner", "loser").agg(F.count(F.lit(1)).alias("n")), "edges")
    sides = edges.select(
        "board",
        F.explode(
            F.array(
                F.struct(F.col("winner").alias("item"), F.col("n").alias("wins"), F.lit(0).cast("bigint").alias("losses")),
                F.struct(F.col("loser").alias("item"), F.lit(0).cast("bigint").alias("wins"), F.col("n").alias("losses")),
            )
        ).alias("x"),
    ).select("board", "x.*")
    states = sides.groupBy("board", "item").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses")).select(
        "*",
        F.lit(skill.mean).alias("mean"),
        F.lit(skill.deviation**2).alias("variance"),
        F.lit(None).cast("bigint").alias("part"),
        F.lit(False).alias("settled"),
    )
    states = scratch.write(_start_marks(scratch.write(states, "items")), "states0")
    small = states.count() <= BROADCAST_ITEMS
    number, settled, first = 0, False, True
    while True:
        # one set after another: sweep until the marks (and, the first time, the means) stand still
        for _ in range(1_000_000):
            number += 1
            nxt = scratch.write(_sweep(edges, states.drop("moved", "marked", "single"), small, skill, number == 1, first), f"states{number}")
            if number > 1:
                scratch.drop(f"states{number - 1}")
            states = nxt
            r = states.agg(F.max("moved").alias("moved"), F.max("marked").alias("marked"), F.max("single").alias("single")).first()
            if first:
                settled = r.moved is None or r.moved < skill.tolerance or number >= skill.sweeps
            if (settled or not first) and not r.marked and not (r.single and not first):
                break
        first = False
        part = F.col("forward") & F.col("backward") & F.col("part").isNull()
        smallest = states.where(part).groupBy("board").agg(F.min("item").alias("smallest"))
        assigned = states.join(smallest, "board", "left").withColumn(
            "part", F.when(part, F.col("smallest")).otherwise(F.col("part"))
        ).drop("smallest")
        number += 1
        assigned = scratch.write(assigned, f"assigned{number}")
        sizes = assigned.where("part is not null").groupBy("board", "part").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("board").agg(F.max("size").alias("largest"))
        rest = assigned.where("part is null").groupBy("board").agg(F.count(F.lit(1)).alias("rest"))
        if rest.join(largest, "board", "left").where("rest >= coalesce(largest, 0)").isEmpty():
            break
        states = scratch.write(_start_marks(assigned.drop("moved", "marked", "single")), f"states{number}")
    best = sizes.groupBy("board").agg(F.max(F.struct("size", (-F.col("part")).alias("p"))).alias("s"))
    ranked = assigned.join(best.select("board", (-F.col("s.p")).alias("best")), "board", "left")
    ranked = ranked.select(
        "board",
        "item",
        "wins",
        "losses",
        "mean",
        F.sqrt("variance").alias("deviation"),
        (F.col("mean") - 3 * F.sqrt("variance")).alias("strength"),
        F.coalesce(F.col("part") == F.col("best"), F.lit(False)).alias("comparable"),
        "settled",
    )
    ranked = scratch.write(ranked, "ranked")
    placed = scratch.write(ranked.join(_places(ranked.where("comparable"), scratch), ["board", "item"], "left"), "placed")
    scratch.keep_only("placed")
    return placed


def _places(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """(board, item, place) by a distributed sort: a row's place is its place in its task plus the sizes before it."""
    ordered = ranked.select("board", "item", "strength").orderBy("board", F.desc("strength"), "item")
    numbered = scratch.write(ordered.withColumn("at", F.monotonically_increasing_id()), "order")
    task = F.shiftright("at", 33)
    counts = numbered.groupBy(task.alias("task"), "board").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = counts.select(  # a row for each task and board
        "task", "board", "first", F.expr("coalesce(sum(n) over (partition by board order by task rows between unbounded preceding and 1 preceding), 0)").alias("before")
    )
    return numbered.withColumn("task", task).join(before, ["task", "board"]).select(
        "board", "item", (F.col("before") + F.col("at") - F.col("first") + 1).alias("place")
    )
