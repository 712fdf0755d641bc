"""Problems 1 and 6: auditing stored workload and ranking features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.operators.known_at import attributes_as_known, change_history, newest_edition_by_day
from deuceframe.operators.rolling import daily_totals, day_number, entity_calendar, trailing_totals
from deuceframe.sources.tables import table

#: Days before the match, both included.
WORKLOAD = {"7d": (7, 2), "28d": (28, 2)}
LAG_DAYS = 2


def accepted_matches(records: DataFrame) -> DataFrame:
    """Each accepted match once, by its first delivered row; a row without match_id stands for itself."""
    key = F.coalesce(F.col("match_id"), F.concat(F.lit("rec:"), F.col("rec_id").cast("string")))
    fields = ("match_date", "player_a", "player_b", "a_serve_points", "b_serve_points")
    return (
        records.where("batch_no = 0")
        .groupBy(key.alias("match_key"))
        .agg(*[F.min_by(c, "rec_id").alias(c) for c in fields])
    )


def player_days(records: DataFrame) -> DataFrame:
    matches = accepted_matches(records)
    points = F.coalesce(F.col("a_serve_points") + F.col("b_serve_points"), F.lit(0)).cast("bigint")
    sides = matches.select(
        F.explode(F.array_distinct(F.array("player_a", "player_b"))).alias("player_id"),
        "match_date",
        points.alias("points"),
    )
    return daily_totals(sides, F.col("player_id"), F.col("match_date"), {"points": F.col("points")})


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "features").select(
        "match_id", "player_a", "match_date", "matches_7d_a", "matches_28d_a", "points_28d_a"
    )
    features = features.withColumn("day", day_number(F.col("match_date")))
    totals = trailing_totals(
        player_days(table(spark, folder, "records")),
        features.select(F.col("player_a").alias("entity"), "day"),
        WORKLOAD,
        ("points",),
    )
    totals = totals.select(
        F.col("entity").alias("_e"), F.col("day").alias("_d"), "rows_7d", "rows_28d", "points_28d"
    )
    both = features.join(totals, (F.col("player_a") == F.col("_e")) & (F.col("day") == F.col("_d")), "left")
    pairs = (("matches_7d_a", "rows_7d"), ("matches_28d_a", "rows_28d"), ("points_28d_a", "points_28d"))
    wrong = [F.when(F.col(stored) != F.coalesce(F.col(true), F.lit(0)), F.lit(stored)) for stored, true in pairs]
    return both.select("match_id", F.explode(F.array_compact(F.array(*wrong))).alias("field_name"))


P1_MATCHES = """matches as (select match_date, player_a, player_b, coalesce(a_serve_points + b_serve_points, 0) points
  from (select *, row_number() over (partition by coalesce(match_id, 'rec:' || rec_id) order by rec_id) rn
        from records where batch_no = 0) where rn = 1),
sides as (select player_a p, match_date d, points from matches
  union all select player_b, match_date, points from matches where player_b is distinct from player_a),
daily as (select p, d, count(*) n, sum(points) points from sides where p is not null and d is not null group by p, d)"""

P1_FOUND_SQL = f"""with {P1_MATCHES},
recount as (select f.match_id, f.matches_7d_a s7, f.matches_28d_a s28, f.points_28d_a sp,
  coalesce(sum(d.n) filter (where d.d >= f.match_date - 7), 0) n7, coalesce(sum(d.n), 0) n28, coalesce(sum(d.points), 0) p28
  from features f left join daily d on d.p = f.player_a and d.d between f.match_date - 28 and f.match_date - 2
  group by all)
select match_id, 'matches_7d_a' field_name from recount where s7 <> n7
union all select match_id, 'matches_28d_a' from recount where s28 <> n28
union all select match_id, 'points_28d_a' from recount where sp <> p28"""


def p1_rolling_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Every player and day, from the player's first day to 28 days after the last, with all trailing totals."""
    daily = player_days(table(spark, folder, "records"))
    out = trailing_totals(daily, entity_calendar(daily, 28), WORKLOAD, ("points",))
    return out.select(
        F.col("entity").alias("player_id"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"),
        F.col("rows_7d").alias("matches_7d"),
        F.col("rows_28d").alias("matches_28d"),
        "points_7d",
        "points_28d",
        F.round("points_avg_28d", 6).alias("points_avg_28d"),
    )


P1_ROLLING_SQL = f"""with {P1_MATCHES},
span as (select p, min(d) lo, max(d) + 28 hi from daily group by p),
cal as (select p, unnest(generate_series(lo, hi, interval 1 day))::date d from span)
select c.p player_id, c.d as "day",
  coalesce(sum(x.n) filter (where x.d >= c.d - 7), 0)::bigint matches_7d, coalesce(sum(x.n), 0)::bigint matches_28d,
  coalesce(sum(x.points) filter (where x.d >= c.d - 7), 0)::bigint points_7d, coalesce(sum(x.points), 0)::bigint points_28d,
  round(coalesce(sum(x.points), 0) / 27.0, 6)::double points_avg_28d
from cal c left join daily x on x.p = c.p and x.d between c.d - 28 and c.d - 2 group by c.p, c.d"""

NO_EDITION = "no_global_edition_on_or_before_cutoff"
ABSENT = "player_absent_on_selected_global_edition"
CONFLICT = "conflicting_duplicate_on_selected_global_edition"


def ranking_histories(rankings: DataFrame) -> dict[str, DataFrame]:
    """A change history per attribute of (player_id, edition): listing, rank and points."""
    known = F.greatest(F.col("edition"), F.to_date("received_at"))
    rows = rankings.select(
        "player_id", F.col("effective_date").alias("edition"), "received_at", "raw_rank", "raw_ranking_points"
    )
    keys = ["player_id", "edition"]
    known = F.when(F.col("received_at").isNotNull(), known)
    return {
        name: change_history(rows, keys, known, value)
        for name, value in (("rank", F.col("raw_rank")), ("points", F.col("raw_ranking_points")))
    }


def ranking_as_known(rankings: DataFrame, requests: DataFrame) -> DataFrame:
    """For each distinct (player_id, cutoff): rank, points and the reason why they are missing ('' if they are not).

    The edition is chosen first, over all players; only the player's rows of that edition count.
    """
    known = F.when(
        F.col("received_at").isNotNull(), F.greatest(F.col("effective_date"), F.to_date("received_at"))
    )
    asked = requests.select("player_id", "cutoff").distinct()
    editions = newest_edition_by_day(rankings, F.col("effective_date"), known, asked, "cutoff")
    dated = asked.join(editions, "cutoff", "left")
    states = attributes_as_known(dated, ranking_histories(rankings), ["player_id", "edition"], "cutoff")
    clash = (F.col("rank_seen") == 2) | (F.col("points_seen") == 2)
    reason = (
        F.when(F.col("edition").isNull(), NO_EDITION)
        .when(F.col("rank_seen").isNull(), ABSENT)
        .when(clash, CONFLICT)
        .otherwise("")
    )
    fine = reason == ""
    return states.select(
        "player_id",
        "cutoff",
        "edition",
        F.when(fine, F.col("rank")).alias("rank"),
        F.when(fine, F.col("points")).alias("points"),
        reason.alias("reason"),
    )


def _p6_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    features = table(spark, folder, "features").select(
        "match_id",
        F.col("player_a").alias("player_id"),
        F.date_sub("match_date", LAG_DAYS).alias("cutoff"),
        "rank_a",
        "rank_points_a",
        "ranking_missing_reason_a",
    )
    return features, ranking_as_known(table(spark, folder, "rankings"), features)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    features, states = _p6_features(spark, folder)
    both = features.alias("f").join(
        states.alias("s"),
        F.col("f.player_id").eqNullSafe(F.col("s.player_id")) & F.col("f.cutoff").eqNullSafe(F.col("s.cutoff")),
        "left",
    )
    same = (
        F.col("rank_a").eqNullSafe(F.col("rank"))
        & F.col("rank_points_a").eqNullSafe(F.col("points"))
        & F.col("ranking_missing_reason_a").eqNullSafe(F.col("reason"))
    )
    return both.where(~same).select("match_id")


def p6_as_known(spark: SparkSession, folder: str) -> DataFrame:
    features, states = _p6_features(spark, folder)
    return features.select("match_id", "player_id", "cutoff").join(states, ["player_id", "cutoff"]).select(
        "match_id", "edition", "rank", "points", "reason"
    )


P6_STATES = """known as (select effective_date e, player_id p, raw_rank r, raw_ranking_points pts,
  greatest(effective_date, received_at::date) k from rankings where received_at is not null and effective_date is not null),
asked as (select match_id, player_a p, match_date - 2 c, rank_a, rank_points_a, ranking_missing_reason_a from features),
first_known as (select e, min(k) k from known group by e),
cut as (select c, max(e) e from (select distinct c from asked) join first_known on k <= c group by c),
states as (select a.*, cut.e, count(k.k) n, count(distinct (k.r, k.pts)) v, min(k.r) r, min(k.pts) pts
  from asked a left join cut using (c) left join known k on k.p = a.p and k.e = cut.e and k.k <= a.c group by all),
judged as (select *, case when e is null then 'no_global_edition_on_or_before_cutoff'
  when n = 0 then 'player_absent_on_selected_global_edition'
  when v > 1 then 'conflicting_duplicate_on_selected_global_edition' else '' end reason from states)"""

P6_FOUND_SQL = f"""with {P6_STATES} select match_id from judged
where rank_a is distinct from (case when reason = '' then r end)
  or rank_points_a is distinct from (case when reason = '' then pts end) or ranking_missing_reason_a is distinct from reason"""
P6_AS_KNOWN_SQL = f"""with {P6_STATES} select match_id, e edition, case when reason = '' then r end "rank",
case when reason = '' then pts end points, reason from judged where p is not null and c is not null"""

QUERIES = {
    "p1_found": p1_found,
    "p1_rolling_totals": p1_rolling_totals,
    "p6_found": p6_found,
    "p6_as_known": p6_as_known,
}
SQL = {
    "p1_found": P1_FOUND_SQL,
    "p1_rolling_totals": P1_ROLLING_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_as_known": P6_AS_KNOWN_SQL,
}
