"""Point-in-time features from released results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deuceframe.functions.dates import compact_date
from deuceframe.operators.lagged import by_day, decayed_sum, form_over_last, released
from deuceframe.operators.rolling import day_number
from deuceframe.plans.contests import CONTESTS_SQL, SIDES_SQL, contests, sides
from deuceframe.sources.tables import table

BASE = f"with {CONTESTS_SQL}, {SIDES_SQL} "
ORIGIN = 19000
HALF_LIFE = 180.0


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    return sides(contests(spark, folder))


def _total(measure: str, first: int | None = None, keys: tuple[str, ...] = ("me",)):
    """The sum of a daily measure over what is released."""
    return F.coalesce(F.sum(measure).over(released([*keys], first)), F.lit(0)).cast("bigint")


def _flag(condition):
    return F.coalesce(condition.cast("int"), F.lit(0))


def recent_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches played in trailing periods; a walkover is none."""
    counts = {f"n{n}": _total("played", n) for n in (7, 14, 30, 90)}
    played = F.coalesce(F.col("status") != "walkover", F.lit(True))
    return by_day(_sides(spark, folder), ["me"], {"played": played.cast("int")}, counts).select("match_id", "me", *counts)


def rest_and_absence(spark: SparkSession, folder: str) -> DataFrame:
    rows = by_day(_sides(spark, folder), ["me"], {"n": F.lit(1)}, {"last": F.max("day").over(released(["me"]))})
    rows = by_day(rows, ["me", "surface"], {"n": F.lit(1)}, {"surface_matches": _total("n", None, ("me", "surface"))})
    rest = F.least(F.coalesce(F.col("day") - F.col("last"), F.lit(365)), F.lit(365))
    return rows.select("match_id", "me", rest.alias("rest_days"), F.col("last").isNull().cast("int").alias("unseen"), "surface_matches")


def retirements(spark: SparkSession, folder: str) -> DataFrame:
    gone = (F.col("status") == "retired") & ~F.col("won")
    since = F.max(F.when(F.col("gone") > 0, F.col("day"))).over(released(["me"]))
    rows = by_day(_sides(spark, folder), ["me"], {"gone": _flag(gone)}, {"ret90": _total("gone", 90), "ret365": _total("gone", 365), "since": since})
    return rows.select("match_id", "me", "ret90", "ret365", F.least(F.coalesce(F.col("day") - F.col("since"), F.lit(365)), F.lit(365)).alias("days_since_ret"))


def career_counts(spark: SparkSession, folder: str) -> DataFrame:
    final = F.col("round") == "F"
    measures = {f"level_{x.lower()}": _flag(F.col("tourney_level") == x) for x in "ACDS"} | {"finals": _flag(final), "titles": _flag(final & F.col("won"))}
    rows = by_day(_sides(spark, folder), ["me"], measures, {m: _total(m) for m in measures})
    return rows.select("match_id", "me", *measures, F.least("level_s", F.lit(20).cast("bigint")).alias("lower_capped"))


def decayed_serve(spark: SparkSession, folder: str) -> DataFrame:
    """Serve share with a prior of 300 points at 0.6, older points halved every 180 days."""
    both = {f"x_{c}": decayed_sum(F.col(f"day_{c}"), ["me"], HALF_LIFE, ORIGIN) for c in ("spw", "sp")}
    rows = by_day(_sides(spark, folder), ["me"], {f"day_{c}": F.col(c).cast("double") for c in ("spw", "sp")}, both)
    won, played = F.col("x_spw"), F.col("x_sp")
    return rows.select(
        "match_id",
        "me",
        F.round(played, 4).alias("effective_points"),
        F.round((won + F.lit(180.0)) / (played + F.lit(300.0)), 8).alias("serve_rate"),
    )


def population_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of serve points won by all players together in everything released at each day."""
    rows = contests(spark, folder)
    daily = rows.groupBy("match_date", "day").agg(
        F.sum(F.col("a_first_won") + F.col("a_second_won") + F.col("b_first_won") + F.col("b_second_won")).alias("won"),
        F.sum(F.col("a_serve_points") + F.col("b_serve_points")).alias("points"),
    )
    w = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -2)  # a row per day: bounded by the calendar
    return daily.select("match_date", F.round(F.sum("won").over(w) / F.sum("points").over(w), 8).alias("share"))


def head_to_head(spark: SparkSession, folder: str) -> DataFrame:
    played = F.coalesce(F.col("status").isin("completed", "retired"), F.lit(False))
    rows = contests(spark, folder).withColumn("y", F.when(played, F.col("a_won").cast("int")))
    pair, on = released(["player_a", "player_b"]), released(["player_a", "player_b", "surface"])
    return rows.select(
        "match_id",
        F.count("y").over(pair).alias("met"),
        F.coalesce(F.sum("y").over(pair), F.lit(0)).alias("a_wins"),
        F.count("y").over(on).alias("met_on_surface"),
        F.round(F.coalesce(F.sum(F.col("y") - 0.5).over(pair), F.lit(0.0)), 4).alias("centred"),
    )


def recent_form(spark: SparkSession, folder: str) -> DataFrame:
    """Wins among the last 5 and 25 released matches with an outcome."""
    rows = _sides(spark, folder).where("won is not null")
    five = form_over_last(rows, ["me"], ["match_id"], {"wins5": F.col("won").cast("int")}, 5)
    both = form_over_last(five.withColumnRenamed("last_n", "n5"), ["me"], ["match_id"], {"wins25": F.col("won").cast("int")}, 25)
    return both.select("match_id", "me", "n5", "wins5", F.col("last_n").alias("n25"), "wins25")


def row_order_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many matches each player had before each, in plain row order and without lag: thin if fewer than ten."""
    w = Window.partitionBy("me").orderBy("day", "match_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _sides(spark, folder).select("match_id", "me", F.count(F.lit(1)).over(w).alias("before"))
    return rows.select("match_id", "me", "before", (F.col("before") < 10).cast("int").alias("thin"))


def ranking_momentum(spark: SparkSession, folder: str) -> DataFrame:
    """Points of each player's last edition at least 28 and 91 days before each of the player's editions."""
    rows = (
        table(spark, folder, "rankings")
        .where("raw_ranking_points is not null")
        .groupBy("player_id", "effective_date")
        .agg(F.max("raw_ranking_points").alias("points"))
        .withColumn("day", day_number(F.col("effective_date")))
    )
    ago = [F.max_by("points", "day").over(released(["player_id"], None, n)).alias(f"points_{n}") for n in (28, 91)]
    return rows.select("player_id", "effective_date", "points", *ago)


def ranking_stream_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Per source member: rows, editions, players, and rows whose date is before that of the line before."""
    w = Window.partitionBy("source_member").orderBy("source_physical_line", "player_id")
    rows = table(spark, folder, "rankings").withColumn("earlier", F.col("effective_date") < F.lag("effective_date").over(w))
    return rows.groupBy("source_member").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("effective_date").alias("editions"),
        F.countDistinct("player_id").alias("players"),
        F.count_if("earlier").alias("order_decreases"),
    )


def changed_heights(spark: SparkSession, folder: str) -> DataFrame:
    """How many heights, birth dates and hands each player's rows give, and whether any changed."""
    p = table(spark, folder, "players")
    values = p.groupBy("player_id").agg(
        F.countDistinct("height").alias("heights"), F.countDistinct("dob").alias("births"), F.countDistinct("hand").alias("hands")
    )
    return values.withColumn("changed", F.expr("heights > 1 or births > 1 or hands > 1"))


def debut_ages(spark: SparkSession, folder: str) -> DataFrame:
    """Each player's first match and age at it, from the smallest valid birth date."""
    first = _sides(spark, folder).groupBy("me").agg(F.min("match_date").alias("debut"), F.min_by("tourney_level", F.struct("day", "match_id")).alias("debut_level"))
    births = table(spark, folder, "players").groupBy(F.col("player_id").alias("me")).agg(F.min(compact_date(F.col("dob"))).alias("birth"))
    age = F.round(F.datediff("debut", "birth") / F.lit(365.25), 6)
    return first.join(births, "me", "left").select(F.col("me").alias("player_id"), "debut", "debut_level", age.alias("age"))


def _w(keys: str, first: str = "unbounded") -> str:
    return f"(partition by {keys} order by d range between {first} preceding and 2 preceding)"


QUERIES = {
    "wn1_recent_matches": recent_matches,
    "wn3_rest_and_absence": rest_and_absence,
    "wn4_retirements": retirements,
    "wn5_career_counts": career_counts,
    "wn8_row_order_audit": row_order_audit,
    "wn9_recent_form": recent_form,
    "wn10_ranking_momentum": ranking_momentum,
    "wn11_decayed_serve": decayed_serve,
    "wn12_population_share": population_share,
    "wn13_head_to_head": head_to_head,
    "wn16_changed_traits": changed_heights,
    "wn18_ranking_stream_quality": ranking_stream_quality,
    "wn21_debut_ages": debut_ages,
}
SQL = {
    "wn1_recent_matches": BASE + "select match_id, me, " + ", ".join(f"count(*) filter (where coalesce(status <> 'walkover', true)) over {_w('me', str(n))} n{n}" for n in (7, 14, 30, 90)) + " from s",
    "wn3_rest_and_absence": BASE + f"""select match_id, me, least(coalesce(d - max(d) over {_w('me')}, 365), 365) rest_days,
        (max(d) over {_w('me')} is null)::int unseen, count(*) over {_w('me, surface')} surface_matches from s""",
    "wn4_retirements": BASE + f"""select match_id, me, count(*) filter (where status = 'retired' and not won) over {_w('me', '90')} ret90,
        count(*) filter (where status = 'retired' and not won) over {_w('me', '365')} ret365,
        least(coalesce(d - max(case when status = 'retired' and not won then d end) over {_w('me')}, 365), 365) days_since_ret from s""",
    "wn5_career_counts": BASE + "select match_id, me, " + ", ".join(f"count(*) filter (where tourney_level = '{x}') over {_w('me')} level_{x.lower()}" for x in "ACDS") + f""",
        count(*) filter (where round = 'F') over {_w('me')} finals, count(*) filter (where round = 'F' and won) over {_w('me')} titles,
        least(count(*) filter (where tourney_level = 'S') over {_w('me')}, 20) lower_capped from s""",
    "wn8_row_order_audit": BASE + """select match_id, me, before, (before < 10)::int thin from (select match_id, me, count(*) over
        (partition by me order by d, match_id rows between unbounded preceding and 1 preceding) before from s)""",
    "wn9_recent_form": BASE + f""", o as (select * from s where won is not null),
      n as (select *, row_number() over (partition by me order by d, match_id) k, count(*) over {_w('me')} n from o)
      select a.match_id, a.me, least(a.n, 5) n5, count(*) filter (where b.won and b.k > a.n - 5) wins5, least(a.n, 25) n25,
        count(*) filter (where b.won) wins25
      from n a left join n b on b.me = a.me and b.k <= a.n and b.k > a.n - 25 group by a.match_id, a.me, a.n""",
    "wn10_ranking_momentum": """with r as (select player_id, effective_date, max(raw_ranking_points) points from rankings
        where raw_ranking_points is not null group by all)
      select a.player_id, a.effective_date, a.points,
        (select arg_max(b.points, b.effective_date) from r b where b.player_id = a.player_id and b.effective_date <= a.effective_date - 28) points_28,
        (select arg_max(b.points, b.effective_date) from r b where b.player_id = a.player_id and b.effective_date <= a.effective_date - 91) points_91
      from r a""",
    "wn11_decayed_serve": BASE + f""", x as (select match_id, me,
        coalesce(sum(spw * pow(2, (d - {ORIGIN}) / 180.0::double)) over {_w('me')}, 0) / pow(2, (d - {ORIGIN}) / 180.0::double) w,
        coalesce(sum(sp * pow(2, (d - {ORIGIN}) / 180.0::double)) over {_w('me')}, 0) / pow(2, (d - {ORIGIN}) / 180.0::double) p from s)
      select match_id, me, round(p, 4) effective_points, round((w + 180) / (p + 300), 8) serve_rate from x""",
    "wn12_population_share": f"""with {CONTESTS_SQL}, y as (select match_date, d,
        sum(a_first_won + a_second_won + b_first_won + b_second_won) w, sum(a_serve_points + b_serve_points) p from c group by all)
      select match_date, round(sum(w) over z::double / sum(p) over z::double, 8) "share" from y
      window z as (order by d range between unbounded preceding and 2 preceding)""",
    "wn13_head_to_head": f"""with {CONTESTS_SQL.replace("player_b, a_won,", "player_b, case when status in ('completed', 'retired') then a_won end a_won,")} select match_id, count(a_won) over {_w('player_a, player_b')} met,
        coalesce(sum(a_won::int) over {_w('player_a, player_b')}, 0)::bigint a_wins, count(a_won) over {_w('player_a, player_b, surface')} met_on_surface,
        round(coalesce(sum(a_won::int - 0.5::double) over {_w('player_a, player_b')}, 0), 4) centred from c""",
    "wn16_changed_traits": """select player_id, count(distinct height) heights, count(distinct dob) births, count(distinct hand) hands,
      count(distinct height) > 1 or count(distinct dob) > 1 or count(distinct hand) > 1 changed from players group by 1""",
    "wn18_ranking_stream_quality": """select source_member, count(*) "rows", count(distinct effective_date) editions,
        count(distinct player_id) players, count(*) filter (where earlier) order_decreases from
      (select *, effective_date < lag(effective_date) over (partition by source_member order by source_physical_line, player_id) earlier from rankings)
      group by 1""",
    "wn21_debut_ages": BASE + """, f as (select me, min(match_date) debut, arg_min(tourney_level, (d, match_id)) debut_level from s group by me),
      b as (select player_id, min(try_strptime(trim(dob), '%Y%m%d')::date) birth from players group by 1)
      select f.me player_id, debut, debut_level, round((debut - birth) / 365.25::double, 6) age from f left join b on b.player_id = f.me""",
}
