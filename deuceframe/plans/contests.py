"""The contest view: each accepted match once, and each side of it as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.functions.dates import day_of
from deuceframe.sources.tables import table

KEPT = (
    "match_id", "match_date", "calendar_year", "source_season", "tourney_id", "tourney_level", "competition_type", "round",
    "surface", "best_of", "player_a", "player_b", "a_won", "identity_tier", "status", "date_basis", "ps_probability_a",
    "entry_a", "entry_b", "a_serve_points", "a_first_in", "a_first_won", "a_second_won", "b_serve_points", "b_first_in",
    "b_first_won", "b_second_won",
)

CONTESTS_SQL = """c as (select match_id, match_date, match_date - date '1970-01-01' as d, calendar_year, source_season,
  tourney_id, tourney_level, competition_type, round, surface, best_of, player_a, player_b, a_won, identity_tier, status,
  date_basis, case when isnan(ps_probability_a) then null else ps_probability_a end p, entry_a, entry_b,
  a_serve_points, a_first_in, a_first_won, a_second_won, b_serve_points, b_first_in, b_first_won, b_second_won
  from (select *, row_number() over (partition by match_id order by rec_id) rn from records
        where batch_no = 0 and match_id is not null) where rn = 1)"""
SIDES_SQL = """s as (
  select match_id, match_date, d, player_a me, player_b opp, a_won won, surface, tourney_level, round, status, best_of,
    a_first_won + a_second_won spw, a_serve_points sp from c
  union all select match_id, match_date, d, player_b, player_a, not a_won, surface, tourney_level, round, status, best_of,
    b_first_won + b_second_won, b_serve_points from c)"""


def contests(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Accepted matches by their first delivered row; `day` counts from 1970 and `p` is the stored forecast or null."""
    wanted = columns or KEPT
    rows = table(spark, folder, "records").where("batch_no = 0 and match_id is not null")
    first = rows.groupBy("match_id").agg(
        *[F.min_by(c, "rec_id").alias(c) for c in KEPT if c != "match_id" and c in {*wanted, "match_date"}]
    )
    out = first.withColumn("day", day_of(F.col("match_date")))
    if "ps_probability_a" in wanted:
        out = out.withColumn("p", F.when(~F.isnan("ps_probability_a"), F.col("ps_probability_a")))
    return out


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per match: the player `me`, the opponent `opp`, and everything from the player's view."""

    def side(me: str, opp: str) -> DataFrame:
        won = F.col("a_won") if me == "a" else ~F.col("a_won")
        return F.struct(
            F.col(f"player_{me}").alias("me"),
            F.col(f"player_{opp}").alias("opp"),
            won.alias("won"),
            (F.col(f"{me}_first_won") + F.col(f"{me}_second_won")).alias("spw"),
            F.col(f"{me}_serve_points").alias("sp"),
        )

    kept = ["match_id", "match_date", "day", "surface", "tourney_level", "round", "status", "best_of"]
    return matches.select(*kept, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select(*kept, "x.*")
