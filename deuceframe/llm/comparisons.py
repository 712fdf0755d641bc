"""Problem 4 as queries: a ranking of the players from who beat whom, and the players it cannot compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.llm.ranking import gaussian_ranking
from deuceframe.sources.tables import table

OVERALL = "overall"


def decided_matches(records: DataFrame) -> DataFrame:
    """winner, loser, surface of each accepted match with an outcome, once; rows without match_id stand for themselves."""
    key = F.coalesce(F.col("match_id"), F.concat(F.lit("rec:"), F.col("rec_id").cast("string")))
    first = (
        records.where("batch_no = 0 and a_won is not null")
        .groupBy(key.alias("match_key"))
        .agg(*[F.min_by(c, "rec_id").alias(c) for c in ("player_a", "player_b", "a_won", "surface")])
    )
    return first.select(
        F.when(F.col("a_won"), F.col("player_a")).otherwise(F.col("player_b")).alias("winner"),
        F.when(F.col("a_won"), F.col("player_b")).otherwise(F.col("player_a")).alias("loser"),
        "surface",
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    matches = decided_matches(table(spark, folder, "records")).select(F.lit(OVERALL).alias("board"), "winner", "loser")
    return gaussian_ranking(matches).where("not comparable").select(F.col("item").alias("player_id"))


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All players overall and by surface; matches without a surface count only overall."""
    matches = decided_matches(table(spark, folder, "records"))
    boards = F.array_compact(F.array(F.lit(OVERALL), F.col("surface")))
    ranked = gaussian_ranking(matches.select(F.explode(boards).alias("board"), "winner", "loser"))
    return ranked.select(
        F.col("board").alias("surface"),
        F.col("item").alias("player_id"),
        "wins",
        "losses",
        F.round("mean", 4).alias("mean"),
        F.round("deviation", 4).alias("deviation"),
        F.round("strength", 4).alias("strength"),
        "comparable",
        "settled",
        "place",
    )


P4_FOUND_SQL = """with recursive m as (select player_a a, player_b b, a_won w from
  (select *, row_number() over (partition by coalesce(match_id, 'rec:' || rec_id) order by rec_id) rn
   from records where batch_no = 0 and a_won is not null) where rn = 1 and player_a <> player_b),
e as (select distinct case when w then a else b end x, case when w then b else a end y from m),
deg as (select p, sum(o) o, sum(i) i from (select x p, 1 o, 0 i from e union all select y, 0, 1 from e) group by p),
start_at as (select p from deg order by o * i desc, p limit 1),
fwd as (select p from start_at union select e.y from fwd join e on e.x = fwd.p),
bwd as (select p from start_at union select e.x from bwd join e on e.y = bwd.p)
select p player_id from deg where p not in (select p from fwd intersect select p from bwd)"""

QUERIES = {"p4_found": p4_found, "p4_ranking": p4_ranking}
SQL = {"p4_found": P4_FOUND_SQL}
