"""Features of both sides as of two days before each match, reduced to a row per player and day before any window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deuceframe.functions.scores import score_totals
from deuceframe.operators.lagged import by_day, form_over_last, released
from deuceframe.plans.audits import ranking_as_known
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.plans.ratings import TIER_WEIGHT, tier
from deuceframe.sources.tables import table

ORIGIN, HALF_LIFE, PRIOR_POINTS, SHARE = 19000, 180.0, 50.0, 0.62
#: Levels that count as the highest two of the tour, in this data (a parameter of the experience counts).
MAJOR, MASTERS = "A", "P"
LEVELS = ("A", "P", "J", "D", "C", "S")


def player_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of each contest, with the games and sets of the archive's score of the same match where it has one."""
    c = contests(spark, folder).where("player_a is not null and player_b is not null").withColumn("tier", tier())
    raw = table(spark, folder, "raw_matches").select(
        "tourney_id", "round", F.least("winner_id", "loser_id").alias("low"), F.greatest("winner_id", "loser_id").alias("high"), F.col("winner_id").alias("w"), "source_key", "score",
    )
    key = ["tourney_id", "round", "low", "high"]
    scores = raw.groupBy(*key).agg(F.min_by(F.struct("w", "score"), "source_key").alias("s")).select(*key, "s.w", score_totals(F.col("s.score")).alias("t"))
    c = c.withColumn("low", F.least("player_a", "player_b")).withColumn("high", F.greatest("player_a", "player_b"))
    c = c.join(scores, key, "left")

    def side(me: str, opp: str) -> Column:
        mine = F.col("w") == F.col(f"player_{me}")
        pick = lambda won, lost: F.when(mine, F.col(f"t.{won}")).otherwise(F.col(f"t.{lost}"))
        won = F.col("a_won") if me == "a" else ~F.col("a_won")
        sp, osp = F.col(f"{me}_serve_points"), F.col(f"{opp}_serve_points")
        return F.struct(
            F.col(f"player_{me}").alias("me"), F.col(f"player_{opp}").alias("opp"), F.lit(me).alias("side"), won.alias("won"),
            (F.col(f"{me}_first_won") + F.col(f"{me}_second_won")).alias("spw"), sp.alias("sp"), (osp - F.col(f"{opp}_first_won") - F.col(f"{opp}_second_won")).alias("rpw"), osp.alias("rp"),
            pick("games_won", "games_lost").alias("gw"), pick("games_lost", "games_won").alias("gl"), pick("sets_won", "sets_lost").alias("sw"), pick("sets_lost", "sets_won").alias("sl"),
        )

    kept = ["match_id", "match_date", "day", "surface", "tourney_level", "tier", "round", "status", "best_of"]
    return c.select(*kept, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select(*kept, "x.*")


PLAYERS_SQL = f"""{CONTESTS_SQL}, f as (select *, case when regexp_matches(round, '^Q[0-9]$') then 'qualifying' when tourney_level = 'C' then 'challenger' when tourney_level = 'S' then 'futures' else 'tour' end tier
      from c where player_a is not null and player_b is not null),
    sc as (select tourney_id, round, least(winner_id, loser_id) low, greatest(winner_id, loser_id) high, arg_min(winner_id, source_key) w, arg_min(score, source_key) score from raw_matches group by all),
    tk as (select *, list_filter(string_split_regex(trim(score), '\\s+'), lambda t: regexp_matches(t, '^\\[?[0-9]+-[0-9]+\\]?(\\([0-9]+\\))?[?]?$')) toks,
      regexp_matches(upper(score), '(^|\\s)(W/O|WALKOVER)') wo, regexp_matches(upper(score), '(^|\\s)(RET|RE|DEF|DEFAULT|PLAYED|ABANDONED|ABD|UNFINISHED)[.]?(\\s|$)') part from sc),
    ps as (select tourney_id, round, low, high, w, wo, part, list_transform(toks, lambda t, i: struct_pack(br := t[1] = '[', x := regexp_extract(t, '^\\[?([0-9]+)-([0-9]+)', 1)::int, y := regexp_extract(t, '^\\[?([0-9]+)-([0-9]+)', 2)::int, tb := contains(t, '('), last := i = len(toks))) s from tk),
    pt as (select tourney_id, round, low, high, w, case when wo then 0 else coalesce(list_sum(list_transform(s, lambda z: case when z.br then (z.x > z.y)::int else z.x end)), 0) end gw,
      case when wo then 0 else coalesce(list_sum(list_transform(s, lambda z: case when z.br then (z.x < z.y)::int else z.y end)), 0) end gl,
      case when wo then 0 else coalesce(list_sum(list_transform(s, lambda z: (z.x > z.y and (z.br or not part or not z.last or z.tb or (greatest(z.x, z.y) >= 6 and abs(z.x - z.y) >= 2) or (greatest(z.x, z.y) = 7 and least(z.x, z.y) = 6)))::int)), 0) end sw,
      case when wo then 0 else coalesce(list_sum(list_transform(s, lambda z: (z.x < z.y and (z.br or not part or not z.last or z.tb or (greatest(z.x, z.y) >= 6 and abs(z.x - z.y) >= 2) or (greatest(z.x, z.y) = 7 and least(z.x, z.y) = 6)))::int)), 0) end sl from ps where s is not null),
    g as (select f.*, pt.w, pt.gw, pt.gl, pt.sw, pt.sl from f left join pt on pt.tourney_id = f.tourney_id and pt.round = f.round and pt.low = least(player_a, player_b) and pt.high = greatest(player_a, player_b)),
    s as (select match_id, match_date, d, surface, tourney_level, tier, round, status, best_of, player_a me, player_b opp, 'a' side, a_won won, a_first_won + a_second_won spw, a_serve_points sp, b_serve_points - b_first_won - b_second_won rpw, b_serve_points rp,
        case when w = player_a then gw else gl end gw, case when w = player_a then gl else gw end gl, case when w = player_a then sw else sl end sw, case when w = player_a then sl else sw end sl from g
      union all select match_id, match_date, d, surface, tourney_level, tier, round, status, best_of, player_b, player_a, 'b', not a_won, b_first_won + b_second_won, b_serve_points, a_serve_points - a_first_won - a_second_won, a_serve_points,
        case when w = player_b then gw else gl end, case when w = player_b then gl else gw end, case when w = player_b then sw else sl end, case when w = player_b then sl else sw end from g)"""


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def _sum(measure: str, first: int | None = None, keys: tuple[str, ...] = ("me",)) -> Column:
    return F.coalesce(F.sum(measure).over(released([*keys], first)), F.lit(0)).cast("bigint")


def _w(first: str = "unbounded", keys: str = "me") -> str:
    return f"(partition by {keys} order by d range between {first} preceding and 2 preceding)"


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Played matches (walkovers are none) in trailing periods, retirements and walkovers, rest, by player and match."""
    played, gone = F.col("status") != "walkover", (F.col("status") == "retired") & ~F.col("won")
    since = lambda m: F.max(F.when(F.col(m) > 0, F.col("day"))).over(released(["me"]))
    rows = by_day(
        player_rows(spark, folder), ["me"], {"played": _flag(F.coalesce(played, F.lit(True))), "ret": _flag(gone), "wo": _flag((F.col("status") == "walkover") & ~F.col("won"))},
        {**{f"n{n}": _sum("played", n) for n in (7, 14, 30, 90)}, **{f"{m}{n}": _sum(m, n) for m in ("ret", "wo") for n in (90, 365)},
         "last_day": since("played"), "last_ret": since("ret")},
    )
    rest = lambda c: F.least(F.coalesce(F.col("day") - F.col(c), F.lit(365)), F.lit(365))
    return rows.select("match_id", "side", *[f"n{n}" for n in (7, 14, 30, 90)], "ret90", "ret365", "wo90", "wo365", rest("last_day").alias("days_since"), F.col("last_day").isNull().cast("int").alias("unseen"), rest("last_ret").alias("days_since_ret"))


def experience(spark: SparkSession, folder: str) -> DataFrame:
    """Career counts by tier, finals and titles of the tour, matches of its two highest levels, and thin histories."""
    tour, final = F.col("tier") == "tour", F.col("round") == "F"
    played = F.coalesce(F.col("status") != "walkover", F.lit(True))
    measures = {f"c_{t}": _flag(played & (F.col("tier") == t)) for t in TIER_WEIGHT} | {
        "finals": _flag(tour & final), "titles": _flag(tour & final & F.col("won")), "major": _flag(played & (F.col("tourney_level") == MAJOR)), "masters": _flag(played & (F.col("tourney_level") == MASTERS)),
    }
    rows = by_day(player_rows(spark, folder), ["me"], measures, {m: _sum(m) for m in measures})
    return rows.select("match_id", "side", *measures, F.least("c_futures", F.lit(20).cast("bigint")).alias("futures_capped"), (F.col("c_tour") < 10).cast("int").alias("thin"))


def tier_form(spark: SparkSession, folder: str) -> DataFrame:
    """Over the last 10 and 25 released completed or retired matches: tier-weighted rate of wins, shares of games and sets."""
    rows = player_rows(spark, folder).where("won is not null and status in ('completed', 'retired')")
    weight = F.when(F.col("tier") == "tour", 1.0).when(F.col("tier") == "futures", 0.6).otherwise(0.8)
    measures = {"tw": weight, "ww": F.when(F.col("won"), weight).otherwise(0.0), "g": F.col("gw"), "gt": F.col("gw") + F.col("gl"), "s": F.col("sw"), "st": F.col("sw") + F.col("sl")}
    out = None
    for k in (10, 25):
        f = form_over_last(rows.select("match_id", "side", "me", "day", "won", "tier", "gw", "gl", "sw", "sl"), ["me"], ["match_id"], measures, k)
        share = lambda x, y: F.round(F.when(F.col(y) > 1e-9, F.col(x) / F.col(y)), 6)
        f = f.select("match_id", "side", F.col("last_n").alias(f"n{k}"), share("ww", "tw").alias(f"win{k}"), share("g", "gt").alias(f"games{k}"), share("s", "st").alias(f"sets{k}"))
        out = f if out is None else out.join(f, ["match_id", "side"])
    return out


def decayed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Serve and return shares of points, halved every 180 days and drawn to the population's share by 50 points."""
    rows = player_rows(spark, folder)
    ok = F.col("status").isin("completed", "retired") & (F.col("sp") > 0) & (F.col("rp") > 0) & F.col("spw").between(0, F.col("sp")) & F.col("rpw").between(0, F.col("rp"))
    pool = rows.where(ok).groupBy("day").agg(F.sum("spw").alias("w"), F.sum("sp").alias("p"))  # a row for each day
    days = rows.select("day").distinct().join(pool, "day", "left")
    run = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -2)
    share = days.select("day", F.coalesce(F.sum("w").over(run) / F.sum("p").over(run), F.lit(SHARE)).alias("avg"))
    power = F.pow(F.lit(2.0), (F.col("day") - ORIGIN) / F.lit(HALF_LIFE))
    total = lambda m: F.coalesce(F.sum(F.col(m) * power).over(released(["me"])), F.lit(0.0)) / power
    measures = {m: F.when(ok, F.col(m)) for m in ("spw", "sp", "rpw", "rp")}
    base = rows.select("match_id", "side", "me", "day", "status", "spw", "sp", "rpw", "rp")
    out = by_day(base, ["me"], {f"d_{m}": c for m, c in measures.items()}, {f"x_{m}": total(f"d_{m}") for m in measures}).join(share, "day")
    return out.select(
        "match_id", "side", F.round("x_sp", 4).alias("serve_points"), F.round((F.col("x_spw") + PRIOR_POINTS * F.col("avg")) / (F.col("x_sp") + PRIOR_POINTS), 7).alias("serve_rate"),
        F.round((F.col("x_rpw") + PRIOR_POINTS * (1 - F.col("avg"))) / (F.col("x_rp") + PRIOR_POINTS), 7).alias("return_rate"),
    )


def _ranked_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of each contest with rank and points as known two days before."""
    c = contests(spark, folder).where("player_a is not null and player_b is not null and match_date is not null")
    sides = c.select("match_id", "match_date", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"player_{s}").alias("player_id")) for s in "ab"])).alias("x")).select("match_id", "x.*", F.date_sub("match_date", 2).alias("cutoff"))
    known = ranking_as_known(table(spark, folder, "rankings"), sides.select("player_id", "cutoff"))
    return sides.join(known, ["player_id", "cutoff"], "left")


RANKED_SQL = f"""{CONTESTS_SQL}, q as (select match_id, 'a' side, player_a player_id, match_date - 2 cutoff from c where player_a is not null and player_b is not null union all select match_id, 'b', player_b, match_date - 2 from c where player_a is not null and player_b is not null),
    k as (select player_id, effective_date e, greatest(effective_date, received_at::date) k, raw_rank r, raw_ranking_points p from rankings where received_at is not null),
    o as (select e, min(k) k from k group by e), u as (select distinct cutoff from q), n as (select cutoff, max(e) e from u join o on o.k <= cutoff group by cutoff),
    h as (select q.match_id, q.side, count(*) m, count(distinct coalesce(r, -1)) nr, count(distinct coalesce(p, -1)) np, max(r) r, max(p) p from q join n using (cutoff) join k on k.e = n.e and k.player_id = q.player_id and k.k <= q.cutoff group by all),
    rk as (select q.match_id, q.side, q.player_id, case when nr = 1 and np = 1 then r end "rank", case when nr = 1 and np = 1 then p end points from q left join h using (match_id, side))"""


def rank_features(spark: SparkSession, folder: str) -> DataFrame:
    """Signed differences of log points, rank strength and missing flags, as known two days before."""
    values = {"lp": F.coalesce(F.log1p(F.col("points")), F.lit(0.0)), "rs": F.coalesce(-F.ln(F.col("rank")), F.lit(0.0)), "rm": F.col("rank").isNull().cast("int"), "pm": F.col("points").isNull().cast("int")}
    sign = F.when(F.col("side") == "a", 1).otherwise(-1)
    return _ranked_sides(spark, folder).groupBy("match_id").agg(
        F.round(F.sum(sign * values["lp"]), 7).alias("rank_points_log_diff"), F.round(F.sum(sign * values["rs"]), 7).alias("rank_strength_diff"),
        F.sum(sign * values["rm"]).alias("rank_missing_diff"), F.sum(sign * values["pm"]).alias("rank_points_missing_diff"),
    )


def top50_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Released wins over players ranked in the top 50 two days before they were played."""
    ranks = _ranked_sides(spark, folder).select("match_id", F.col("side").alias("other"), F.col("rank").alias("opp_rank"))
    rows = player_rows(spark, folder).where("day is not null")
    rows = rows.withColumn("other", F.when(F.col("side") == "a", "b").otherwise("a")).join(ranks, ["match_id", "other"], "left")
    out = by_day(rows, ["me"], {"top": _flag(F.col("won") & (F.col("opp_rank") <= 50))}, {"top50_wins": _sum("top")})
    return out.select("match_id", "side", "top50_wins")


CONTEXTS = {
    "clay": "surface = 'Clay'", "grass": "surface = 'Grass'", "carpet": "surface = 'Carpet'", "best_of_5": "best_of = 5",
    "indoor": "court_recorded = 'Indoor'", "indoor_unknown": "court_recorded is null or court_recorded not in ('Indoor', 'Outdoor')",
}


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The context flags of each match, and the products of the signed rank features with them."""
    rows = table(spark, folder, "records").where("batch_no = 0 and match_id is not null").groupBy("match_id").agg(*[F.min_by(c, "rec_id").alias(c) for c in ("surface", "best_of", "court_recorded")])
    flags = [F.coalesce(F.expr(e), F.lit(False)).cast("int").alias(f"context_{n}") for n, e in CONTEXTS.items()]
    both = rank_features(spark, folder).join(rows.select("match_id", *flags), "match_id")
    return both.select("match_id", *[f"context_{n}" for n in CONTEXTS], *[F.round(F.col(b) * F.col(f"context_{n}"), 7).alias(f"{b}_x_{n}") for b in ("rank_points_log_diff", "rank_strength_diff") for n in CONTEXTS])


def traits(spark: SparkSession, folder: str) -> DataFrame:
    """Signed traits: age in decades about 25, its square, centred height, left hand, and flags of what is missing or
    contradicted by repeated rows of a player."""
    one = lambda c, v: F.when(F.countDistinct(v) == 1, F.max(v)).alias(c)
    birth = F.to_date(F.try_to_timestamp(F.trim("dob"), F.lit("yyyyMMdd")))
    p = table(spark, folder, "players").groupBy("player_id").agg(one("birth", birth), one("height", F.col("height")), one("hand", F.upper(F.trim("hand"))))
    c = contests(spark, folder, "match_id", "match_date", "player_a", "player_b").where("player_a is not null and player_b is not null")
    sides = c.select("match_id", "match_date", F.explode(F.array(*[F.struct(F.lit(v).alias("sign"), F.col(f"player_{s}").alias("player_id")) for s, v in (("a", 1), ("b", -1))])).alias("x")).select("match_id", "match_date", "x.*")
    x = sides.join(p, "player_id", "left").withColumn("z", (F.datediff("match_date", "birth") / 365.25 - 25) / 10)
    x = x.withColumn("z", F.when(F.col("z").between(-1.2, 3.5), F.col("z")))  # ages from 13 to 60
    signed = lambda v: F.sum(F.col("sign") * v)
    return x.groupBy("match_id").agg(
        F.round(signed(F.coalesce("z", F.lit(0.0))), 7).alias("age_diff"), F.round(signed(F.coalesce(F.col("z") * F.col("z"), F.lit(0.0))), 7).alias("age_sq_diff"),
        F.round(signed(F.coalesce((F.col("height") - 185) / 10, F.lit(0.0))), 7).alias("height_diff"), signed(_flag(F.col("hand") == "L")).alias("lefty_diff"),
        signed(F.col("z").isNull().cast("int")).alias("age_missing_diff"), signed(F.col("height").isNull().cast("int")).alias("height_missing_diff"),
        signed((~F.coalesce(F.col("hand").isin("R", "L", "A"), F.lit(False))).cast("int")).alias("hand_missing_diff"),
    )


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    """One row a match: signed differences of activity (as they are) and of experience (as logs), and the level's flags."""
    act = ["n7", "n14", "n30", "n90", "days_since", "unseen", "ret90", "ret365", "days_since_ret"]
    exp = ["c_tour", "c_challenger", "c_futures", "titles", "finals", "major", "masters"]
    sides = activity(spark, folder).select("match_id", "side", *act).join(experience(spark, folder).select("match_id", "side", *exp), ["match_id", "side"])
    sign = F.when(F.col("side") == "a", 1).otherwise(-1)
    diffs = sides.groupBy("match_id").agg(*[F.sum(sign * F.col(a)).cast("bigint").alias(f"act_{a}_diff") for a in act], *[F.round(F.sum(sign * F.log1p(F.col(e))), 7).alias(f"exp_{e}_log_diff") for e in exp])
    level = contests(spark, folder, "match_id", "tourney_level").select("match_id", F.when(F.col("tourney_level").isin(*LEVELS), F.col("tourney_level")).otherwise("O").alias("l"))
    hot = [(F.col("l") == x).cast("int").alias(f"level_{x.lower()}") for x in (*LEVELS, "O")]
    return diffs.join(level.select("match_id", *hot), "match_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "wn1_activity": activity, "wn5_experience": experience, "wn9_tier_form": tier_form, "wn11_decayed_rates": decayed_rates, "ma5_rank_features": rank_features, "so6_top50_wins": top50_wins,
    "ma13_interactions": interactions, "ma14_traits": traits, "ma16_assembled": assembled,
}
_PLAYED = "coalesce(status <> 'walkover', true)"
_ACT = f"""select match_id, side, me, d, {", ".join(f"count(*) filter (where {_PLAYED}) over {_w(str(n))} n{n}" for n in (7, 14, 30, 90))},
    {", ".join(f"count(*) filter (where status = '{st}' and not won) over {_w(str(n))} {m}{n}" for m, st in (("ret", "retired"), ("wo", "walkover")) for n in (90, 365))},
    least(coalesce(d - max(case when {_PLAYED} then d end) over {_w()}, 365), 365)::int days_since, (max(case when {_PLAYED} then d end) over {_w()} is null)::int unseen,
    least(coalesce(d - max(case when status = 'retired' and not won then d end) over {_w()}, 365), 365)::int days_since_ret from s"""
_EXP_COLUMNS = {f"c_{t}": f"{_PLAYED} and tier = '{t}'" for t in TIER_WEIGHT} | {"finals": "tier = 'tour' and round = 'F'", "titles": "tier = 'tour' and round = 'F' and won", "major": f"{_PLAYED} and tourney_level = '{MAJOR}'", "masters": f"{_PLAYED} and tourney_level = '{MASTERS}'"}
_EXP = f"select match_id, side, {', '.join(f'count(*) filter (where {e}) over {_w()} {n}' for n, e in _EXP_COLUMNS.items())} from s"
_OK = "status in ('completed', 'retired') and sp > 0 and rp > 0 and spw between 0 and sp and rpw between 0 and rp"
_POW = f"pow(2, (d - {ORIGIN}) / {HALF_LIFE}::double)"
_RF = f"""with {RANKED_SQL}, rf as (select match_id, round(sum(sg * coalesce(ln(1 + points), 0)), 7) rank_points_log_diff, round(sum(sg * coalesce(-ln("rank"), 0)), 7) rank_strength_diff,
    sum(sg * ("rank" is null)::int)::bigint rank_missing_diff, sum(sg * (points is null)::int)::bigint rank_points_missing_diff from (select *, case side when 'a' then 1 else -1 end sg from rk) group by 1)"""
SQL = {
    "wn1_activity": f"with {PLAYERS_SQL} select * exclude (me, d) from ({_ACT})",
    "wn5_experience": f"with {PLAYERS_SQL} select *, least(c_futures, 20) futures_capped, (c_tour < 10)::int thin from ({_EXP})",
    "wn9_tier_form": f"""with {PLAYERS_SQL}, o as (select *, case tier when 'tour' then 1.0::double when 'futures' then 0.6::double else 0.8::double end tw from s where won is not null and status in ('completed', 'retired')),
      n as (select *, row_number() over (partition by me order by d, match_id) k, count(*) over {_w()} n from o),
      j as (select a.match_id, a.side, a.n, b.k, b.tw, b.won, b.gw, b.gl, b.sw, b.sl from n a left join n b on b.me = a.me and b.k <= a.n and b.k > a.n - 25)
      select match_id, side, {", ".join(f'''least(n, {k}) n{k}, round(sum(case when won then tw else 0 end) filter (where k > n - {k}) / sum(tw) filter (where k > n - {k}), 6) win{k},
        round(sum(gw) filter (where k > n - {k})::double / nullif(sum(gw + gl) filter (where k > n - {k}), 0), 6) games{k}, round(sum(sw) filter (where k > n - {k})::double / nullif(sum(sw + sl) filter (where k > n - {k}), 0), 6) sets{k}''' for k in (10, 25))}
      from j group by match_id, side, n""",
    "wn11_decayed_rates": f"""with {PLAYERS_SQL}, pl as (select d, sum(w) over z::double / sum(p) over z avg from (select d, sum(case when {_OK} then spw end) w, sum(case when {_OK} then sp end) p from s group by d) window z as (order by d range between unbounded preceding and 2 preceding)),
      x as (select match_id, side, d, {", ".join(f"coalesce(sum(case when {_OK} then {m} end * {_POW}) over {_w()}, 0) / {_POW} x_{m}" for m in ("spw", "sp", "rpw", "rp"))} from s)
      select match_id, side, round(x_sp, 4) serve_points, round((x_spw + 50 * coalesce(avg, {SHARE})) / (x_sp + 50), 7) serve_rate, round((x_rpw + 50 * (1 - coalesce(avg, {SHARE}))) / (x_rp + 50), 7) return_rate from x join pl using (d)""",
    "ma5_rank_features": f"{_RF} select * from rf",
    "so6_top50_wins": f"""with {PLAYERS_SQL}, {RANKED_SQL.removeprefix(CONTESTS_SQL + ',')} select s.match_id, s.side, count(*) filter (where won and o."rank" <= 50) over (partition by me order by d range between unbounded preceding and 2 preceding) top50_wins
      from s left join rk o on o.match_id = s.match_id and o.side <> s.side where d is not null""",
    "ma13_interactions": f"""{_RF}, x as (select match_id, {", ".join(f"coalesce({e}, false)::int context_{n}" for n, e in CONTEXTS.items())} from (select *, row_number() over (partition by match_id order by rec_id) rn from records where batch_no = 0 and match_id is not null) where rn = 1)
      select match_id, {", ".join(f"context_{n}" for n in CONTEXTS)}, {", ".join(f"round({b} * context_{n}, 7) {b}_x_{n}" for b in ("rank_points_log_diff", "rank_strength_diff") for n in CONTEXTS)} from rf join x using (match_id)""",
    "ma14_traits": f"""with {CONTESTS_SQL}, p as (select player_id, case when count(distinct b) = 1 then max(b) end birth, case when count(distinct height) = 1 then max(height) end height, case when count(distinct h) = 1 then max(h) end hand
        from (select *, try_strptime(trim(dob), '%Y%m%d')::date b, upper(trim(hand)) h from players) group by 1),
      v as (select match_id, match_date, 1 sg, player_a player_id from c where player_a is not null and player_b is not null union all select match_id, match_date, -1, player_b from c where player_a is not null and player_b is not null),
      z as (select v.*, height, hand, case when ((match_date - birth) / 365.25::double - 25) / 10 between -1.2 and 3.5 then ((match_date - birth) / 365.25::double - 25) / 10 end z from v left join p using (player_id))
      select match_id, round(sum(sg * coalesce(z, 0)), 7) age_diff, round(sum(sg * coalesce(z * z, 0)), 7) age_sq_diff, round(sum(sg * coalesce((height - 185) / 10::double, 0)), 7) height_diff, sum(sg * coalesce((hand = 'L')::int, 0))::bigint lefty_diff,
        sum(sg * (z is null)::int)::bigint age_missing_diff, sum(sg * (height is null)::int)::bigint height_missing_diff, sum(sg * (not coalesce(hand in ('R', 'L', 'A'), false))::int)::bigint hand_missing_diff from z group by 1""",
    "ma16_assembled": f"""with {PLAYERS_SQL}, a as ({_ACT}), e as ({_EXP}), b as (select *, case side when 'a' then 1 else -1 end sg from a join e using (match_id, side)),
      y as (select match_id, {", ".join(f"sum(sg * {a})::bigint act_{a}_diff" for a in ("n7", "n14", "n30", "n90", "days_since", "unseen", "ret90", "ret365", "days_since_ret"))},
        {", ".join(f"round(sum(sg * ln(1 + {e}::double)), 7) exp_{e}_log_diff" for e in ("c_tour", "c_challenger", "c_futures", "titles", "finals", "major", "masters"))} from b group by 1)
      select y.*, {", ".join(f"coalesce(tourney_level = '{x}', false)::int level_{x.lower()}" for x in LEVELS)}, (tourney_level is null or tourney_level not in {LEVELS})::int level_o from y join c using (match_id)""",
}
