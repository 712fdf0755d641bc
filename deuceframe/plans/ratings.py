"""Ratings as of two days before each match, by ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.functions.numbers import match_probability
from deuceframe.functions.scores import winner_game_share
from deuceframe.operators.folds import (
    ALL_TIER_VALUES, ELO_SCHEMA, FILTER_VALUES, TIER_WEIGHT, AllTierRatings, FilterSettings, PooledElo, RatingSuite, ServeFilter, ordered_fold,
)
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.sources.tables import table

#: What players start with below the standard start, who are first seen below the tour; one replay each.
HORIZONS = {"near": -100.0, "far": -150.0}
#: Settings of the serve filter that are compared: a grid around the first.
GRID = [FilterSettings(), FilterSettings(variance=0.02), FilterSettings(variance=0.12), FilterSettings(surface_variance=0.0), FilterSettings(temper_lower=1.0), FilterSettings(intercept_rate=0.0)]
ORDER = ["day", "tier_order", "tourney_id", "match_id"]


def tier() -> Column:
    """The tier of a row by its level and round: qualifying rounds come before the level."""
    return (
        F.when(F.col("round").rlike("^Q[0-9]$"), "qualifying").when(F.col("tourney_level") == "C", "challenger")
        .when(F.col("tourney_level") == "S", "futures").otherwise("tour")
    )


def counted() -> Column:
    """Rows of which both sides' serve points can be used."""
    valid = F.col("status").isin("completed", "retired")
    for s in "ab":
        valid = valid & (F.col(f"{s}_sp") > 0) & F.col(f"{s}_spw").between(0, F.col(f"{s}_sp"))
    return F.coalesce(valid, F.lit(False))


def rated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The contests as the folds take them. There is one population: tours would be further values of `tour`."""
    c = contests(spark, folder).where("player_a is not null and player_b is not null and match_date is not null")
    serve = [(F.col(f"{s}_first_won") + F.col(f"{s}_second_won")).cast("double").alias(f"{s}_spw") for s in "ab"]
    played = [F.col(f"{s}_serve_points").cast("double").alias(f"{s}_sp") for s in "ab"]
    kept = ["match_id", "day", "match_date", "calendar_year", "player_a", "player_b", "surface", "a_won", "p", "tourney_id", "tourney_level", "round", "status", "best_of"]
    rows = c.select(F.lit("all").alias("tour"), *kept, *serve, *played).withColumn("tier", tier()).withColumn("counted", counted())
    order = F.when(F.col("tier") == "tour", 0).when(F.col("tier") == "qualifying", 1).when(F.col("tier") == "challenger", 2).otherwise(3)
    return rows.withColumn("tier_order", order)


FOLDED = ["tour", "match_id", "day", "player_a", "player_b", "surface", "a_won"]


def elo_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    rows = rated_rows(spark, folder).select(*FOLDED)
    out = ordered_fold(rows, ["tour"], ["day", "match_id"], lambda key: PooledElo(), ELO_SCHEMA)
    return out.select("match_id", *[F.round(c, 6).alias(c) for c in ("p_overall", "p_surface", "p")])


def base_elo(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings moved by outcomes and ratings moved by prices, as pseudo-outcomes, and whose history is absent."""
    rows = rated_rows(spark, folder).select(*FOLDED, "p")
    sports = ordered_fold(rows, ["tour"], ["day", "match_id"], lambda key: PooledElo(), ELO_SCHEMA)
    market = ordered_fold(rows, ["tour"], ["day", "match_id"], lambda key: PooledElo(column="p"), ELO_SCHEMA)
    market = market.select("match_id", F.col("p_overall").alias("m_overall"), F.col("p_surface").alias("m_surface"), F.col("absent_a").alias("market_absent_a"))
    both = sports.join(market, "match_id")
    return both.select("match_id", *[F.round(c, 6).alias(c) for c in ("p_overall", "p_surface", "m_overall", "m_surface")], "absent_a", "absent_surface_b", "market_absent_a")


def tier_elo(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled ratings with steps by tier and a lower start for players first seen below the tour; a replay per horizon."""
    horizons = F.array(*[F.lit(h) for h in HORIZONS])
    rows = rated_rows(spark, folder).where("a_won is not null").select(*FOLDED, "tier", F.explode(horizons).alias("horizon"))
    start = lambda key: PooledElo(weights=TIER_WEIGHT, offset=HORIZONS[key[0]])
    parts = None
    for h in HORIZONS:  # the horizon is a group of its own: its replays run side by side
        one = ordered_fold(rows.where(F.col("horizon") == h), ["horizon"], ["day", "match_id"], start, ELO_SCHEMA).withColumn("horizon", F.lit(h))
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("horizon", "match_id", *[F.round(c, 6).alias(c) for c in ("p_overall", "p_surface", "p")])


def game_shares(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """rows with game_share: the winner's share of games by the archive score of the same tourney, round, players and
    winner; null where there is none, or several that differ."""
    key = ["tourney_id", "round", "low", "high", "winner"]
    scores = raw.select(
        "tourney_id", "round", F.least("winner_id", "loser_id").alias("low"), F.greatest("winner_id", "loser_id").alias("high"),
        F.col("winner_id").alias("winner"), winner_game_share(F.col("score")).alias("share"),
    ).groupBy(*key).agg(F.when(F.min("share") == F.max("share"), F.max("share")).alias("game_share"))
    sides = rows.withColumn("low", F.least("player_a", "player_b")).withColumn("high", F.greatest("player_a", "player_b"))
    won = F.when(F.col("a_won"), F.col("player_a")).when(~F.col("a_won"), F.col("player_b"))
    return sides.withColumn("winner", won).join(scores, key, "left").drop("low", "high", "winner")


def suite_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    shared = game_shares(rated_rows(spark, folder), table(spark, folder, "raw_matches")).select(*FOLDED, "tourney_level", "game_share")
    schema = "match_id string, fixed_k double, decaying_k double, games_weighted double, surface_mix double"
    return ordered_fold(shared, ["tour"], ["day", "match_id"], lambda key: RatingSuite(), schema)


def _all_tier(spark: SparkSession, folder: str) -> DataFrame:
    rows = rated_rows(spark, folder).select(*FOLDED, "tier", "status", "counted", "tourney_id", "tier_order", "a_spw", "a_sp", "b_spw", "b_sp")
    return ordered_fold(rows, ["tour"], ORDER, lambda key: AllTierRatings(), f"match_id string, {', '.join(f'{c} double' for c in ALL_TIER_VALUES)}")


def all_tier_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return _all_tier(spark, folder).select("match_id", *[c for c in ALL_TIER_VALUES if c[:3] in ("elo", "tou", "sur", "rd_")])


def point_skills(spark: SparkSession, folder: str) -> DataFrame:
    """The point model's log-odds on serve of both sides, and the match probability that follows."""
    x = _all_tier(spark, folder).withColumn("eta_a", F.col("mu") + F.col("serve_a") - F.col("return_b")).withColumn("eta_b", F.col("mu") + F.col("serve_b") - F.col("return_a"))
    x = x.withColumn("pa", 1 / (1 + F.exp(-F.col("eta_a")))).withColumn("pb", 1 / (1 + F.exp(-F.col("eta_b"))))
    both = x.join(contests(spark, folder, "match_id", "best_of").select("match_id", "best_of"), "match_id")
    return both.select("match_id", "eta_a", "eta_b", (F.col("eta_a") - F.col("eta_b")).alias("serve_logit_diff"), match_probability("pa", "pb", F.coalesce("best_of", F.lit(3))).alias("p"))


FILTERED = ["tour", "match_id", "day", "player_a", "player_b", "surface", "tier", "counted", "tourney_id", "tier_order", "a_spw", "a_sp", "b_spw", "b_sp"]
FILTER_SCHEMA = f"match_id string, {', '.join(f'{c} double' for c in FILTER_VALUES)}"


def serve_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Filtered point probabilities and the match probability that follows from them."""
    rows = rated_rows(spark, folder)
    state = ordered_fold(rows.select(*FILTERED), ["tour"], ORDER, lambda key: ServeFilter(), FILTER_SCHEMA)
    points = [(1 / (1 + F.exp(-F.col(f"eta_{s}")))).alias(f"point_{s}") for s in "ab"]
    both = state.select("match_id", *points, "variance_a", "variance_b").join(rows.select("match_id", "best_of"), "match_id")
    return both.select("match_id", "point_a", "point_b", "variance_a", "variance_b", match_probability("point_a", "point_b", F.coalesce("best_of", F.lit(3))).alias("p"))


def filter_tuning(spark: SparkSession, folder: str) -> DataFrame:
    """For each setting of GRID the log-likelihood a serve point of the second season's counted rows, best first. The
    settings are groups: they are replayed side by side."""
    rows = rated_rows(spark, folder).select(*FILTERED, "calendar_year", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("setting"))
    year = rows.select("match_id", "a_spw", "a_sp", "b_spw", "b_sp", "calendar_year", "counted").distinct()
    parts = None
    for k in range(len(GRID)):
        one = ordered_fold(rows.where(F.col("setting") == k), ["setting"], ORDER, lambda key: ServeFilter(GRID[key[0]]), FILTER_SCHEMA).withColumn("setting", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    scored = parts.join(year.where("counted and calendar_year = 2023"), "match_id")
    part = lambda s: F.col(f"{s}_sp") * -F.log1p(F.exp(-F.col(f"eta_{s}"))) - (F.col(f"{s}_sp") - F.col(f"{s}_spw")) * F.col(f"eta_{s}")
    sums = scored.groupBy("setting").agg(F.sum(part("a") + part("b")).alias("ll"), F.sum(F.col("a_sp") + F.col("b_sp")).alias("points"), F.count(F.lit(1)).alias("rows"))
    return sums.select("setting", (F.col("ll") / F.col("points")).alias("log_likelihood"), "points", "rows")


def elo_sql(y: str = "a_won::int::double", weights: str = "1.0::double", start: str = "1500.0::double") -> str:
    """The pooled ratings as a recursion over source days: (i, p, s, r, n) is the state of each player overall and on each
    surface after the i-th day that has rows, and the number of rows it took in; z reads it two days before each match."""
    return f"""with recursive {CONTESTS_SQL}, m as (select *, case when regexp_matches(round, '^Q[0-9]$') then 'qualifying' when tourney_level = 'C' then 'challenger' when tourney_level = 'S' then 'futures' else 'tour' end tier
        from c where player_a is not null and player_b is not null and match_date is not null),
      u as (select match_id, d, player_a a, player_b b, surface, {y} y, 32 * {weights} k, tier from m where {y} is not null),
      days as (select d, row_number() over (order by d) i from (select distinct d from u)),
      first as (select p, arg_min(tier, (d, match_id)) tier from (select a p, tier, d, match_id from u union all select b, tier, d, match_id from u) group by p),
      keys as (select p, s, {start} r from first, (values ('all'), ('Hard'), ('Clay'), ('Grass'), ('Carpet')) v(s)),
      v as (select i, a, b, y, k, unnest(case when surface in ('Hard', 'Clay', 'Grass', 'Carpet') then ['all', surface] else ['all'] end) s from u join days using (d)),
      st(i, p, s, r, n) as (select 0::bigint, p, s, r, 0::bigint from keys
        union all select st.i + 1, st.p, st.s, st.r + coalesce(g.x, 0), st.n + coalesce(g.n, 0) from st left join (
          select p, s, sum(x) x, count(*) n from (
            select unnest([struct_pack(p := v.a, x := v.k * (v.y - 1 / (1 + pow(10, (q.r - o.r) / 400)))), struct_pack(p := v.b, x := -v.k * (v.y - 1 / (1 + pow(10, (q.r - o.r) / 400))))], recursive := true), v.s s
            from v join st o on o.i + 1 = v.i and o.p = v.a and o.s = v.s join st q on q.i + 1 = v.i and q.p = v.b and q.s = v.s) group by p, s) g
          on g.p = st.p and g.s = st.s where st.i < (select max(i) from days)),
      t as (select m.*, coalesce((select max(i) from days where days.d <= m.d - 2), 0) i from m),
      w as (select t.*, case when oa.n > 0 then oa.r else 1500 end ra, case when ob.n > 0 then ob.r else 1500 end rb, coalesce(oa.n, 0) na, coalesce(ob.n, 0) nb, coalesce(sa.n, 0) sna, coalesce(sb.n, 0) snb,
          surface in ('Hard', 'Clay', 'Grass', 'Carpet') known, case when oa.n > 0 then sa.r else 1500 end qa, case when ob.n > 0 then sb.r else 1500 end qb
        from t left join st oa on oa.i = t.i and oa.p = player_a and oa.s = 'all' left join st ob on ob.i = t.i and ob.p = player_b and ob.s = 'all'
        left join st sa on sa.i = t.i and sa.p = player_a and sa.s = surface left join st sb on sb.i = t.i and sb.p = player_b and sb.s = surface),
      z as (select *, 1 / (1 + pow(10, (rb - ra) / 400)) po, case when known then 1 / (1 + pow(10, (qb - qa) / 400)) else 1 / (1 + pow(10, (rb - ra) / 400)) end ps from w)"""


QUERIES = {
    "fo1_base_elo": base_elo, "fo2_elo_forecasts": elo_forecasts, "fo3_tier_elo": tier_elo, "fo4_all_tier_ratings": all_tier_ratings, "fo5_point_skills": point_skills,
    "fo6_serve_forecasts": serve_forecasts, "fo8_suite_forecasts": suite_forecasts, "ml16_filter_tuning": filter_tuning,
}
_P = "round(po, 6) p_overall, round(ps, 6) p_surface"
_TIERS = "case tier when 'tour' then 1.0::double when 'futures' then 0.6::double else 0.8::double end"
SQL = {
    "fo2_elo_forecasts": f"{elo_sql()} select match_id, {_P}, round((po + ps) / 2, 6) p from z",
    "fo1_base_elo": f"""select x.match_id, p_overall, p_surface, m_overall, m_surface, absent_a, absent_surface_b, market_absent_a
      from ({elo_sql()} select match_id, {_P}, (na = 0)::int absent_a, (snb = 0)::int absent_surface_b from z) x
      join ({elo_sql("p")} select match_id, round(po, 6) m_overall, round(ps, 6) m_surface, (na = 0)::int market_absent_a from z) y using (match_id)""",
    "fo3_tier_elo": " union all ".join(
        f"select * from ({elo_sql(weights=_TIERS, start=f'case tier when {chr(39)}tour{chr(39)} then 1500.0::double else {1500 + o} end')} select '{h}' horizon, match_id, {_P}, round((po + ps) / 2, 6) p from z where a_won is not null)"
        for h, o in HORIZONS.items()
    ),
}
