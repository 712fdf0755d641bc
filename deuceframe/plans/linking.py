"""Resolution, merging and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deuceframe.functions.dates import compact_date
from deuceframe.operators.linking import (
    cascade, compared_fields, components, guarded_patch, merge_with_precedence, residual_similarity, snapshot_diff, sole_claimants, unique_pairs,
)
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.sources.tables import table


def dated_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Each archive row's date: the newest contest of its tourney and round, else of its tourney, else anchor + 7."""
    c = contests(spark, folder, "match_id", "match_date", "tourney_id", "round")
    by_round = c.groupBy("tourney_id", "round").agg(F.max("match_date").alias("round_date"))
    by_tourney = c.groupBy("tourney_id").agg(F.max("match_date").alias("tourney_date_max"))
    rows = table(spark, folder, "raw_matches").select("source_key", "tourney_id", "round", compact_date(F.col("tourney_date")).alias("anchor"))
    both = rows.join(by_round, ["tourney_id", "round"], "left").join(by_tourney, "tourney_id", "left")
    basis = F.when(F.col("round_date").isNotNull(), "round").when(F.col("tourney_date_max").isNotNull(), "tourney").otherwise("anchor_plus_7")
    return both.select("source_key", F.coalesce("round_date", "tourney_date_max", F.date_add("anchor", 7)).alias("date"), basis.alias("basis"))


def ranking_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Each player's newest row by the last day of the data, whatever its edition, and how old it is."""
    r = table(spark, folder, "rankings").where("raw_rank is not null")
    newest = r.groupBy("player_id").agg(F.max("effective_date").alias("newest"), F.max_by("raw_rank", F.struct("effective_date", "received_at", -F.col("raw_rank"))).alias("rank"))
    end = r.agg(F.max("effective_date").alias("end"))  # one row
    return newest.crossJoin(F.broadcast(end)).select("player_id", "newest", "rank", F.datediff("end", "newest").alias("age_days"))


def edition_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per edition: rows, players, repeated players that agree, and that contradict."""
    r = table(spark, folder, "rankings").groupBy("effective_date", "player_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(F.coalesce("raw_rank", F.lit(-1)), F.coalesce("raw_ranking_points", F.lit(-1)))).alias("v")
    )
    return r.groupBy("effective_date").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("players"), F.count_if(F.expr("n > 1 and v = 1")).alias("exact"), F.count_if(F.expr("v > 1")).alias("conflicting")
    )


def paired_tourneys(spark: SparkSession, folder: str) -> DataFrame:
    """Pairing of archive rows and contests by tourney, round and players."""
    raw = table(spark, folder, "raw_matches").select(
        "tourney_id", "round", F.least("winner_id", "loser_id").alias("player_a"), F.greatest("winner_id", "loser_id").alias("player_b")
    )
    pairs = unique_pairs(raw, contests(spark, folder, "tourney_id", "round", "player_a", "player_b"), ["tourney_id", "round", "player_a", "player_b"])
    return pairs.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each reviewed link: the market title equals, contains or lacks the archive's event name."""
    m = table(spark, folder, "market_rows").select("market_row_id", F.lower("market_tournament").alias("t"), F.lower("market_location").alias("l"))
    x = table(spark, folder, "crosswalk_reviewed").select("market_row_id", "archive_source_key", F.lower(F.regexp_extract("archive_tourney_name", "^[^ ]+", 0)).alias("e"))
    found = F.when(F.col("l") == F.col("e"), "location").when(F.contains("t", "e"), "containment").otherwise("none")
    return x.join(m, "market_row_id").select("market_row_id", "archive_source_key", found.alias("evidence"))


def name_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Market winners resolved to player ids: surname and initial, then surname alone; ambiguity never widens."""
    p = table(spark, folder, "players").select(
        "player_id", F.lower(F.concat_ws(" ", F.trim("name_last"), F.concat(F.substring(F.trim("name_first"), 1, 1), F.lit(".")))).alias("full"), F.lower(F.trim("name_last")).alias("last")
    )
    rows = table(spark, folder, "market_rows").select(
        "market_row_id", F.lower(F.trim("market_winner_name")).alias("full"), F.lower(F.regexp_replace(F.trim("market_winner_name"), r"\s+([^\s.]{1,2}\.)+$", "")).alias("last")
    )
    return cascade(rows, [(p.drop("last"), "full", "surname_initial"), (p.drop("full"), "last", "surname")], "player_id").select("market_row_id", "player_id", "by")


def merged_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Later rows whose match_id the history does not have, after the history's own: counts per origin and season."""
    r = table(spark, folder, "records").select("match_id", "source_season", (F.col("batch_no") > 0).alias("later"))
    one = lambda df: df.groupBy("match_id").agg(F.min("source_season").alias("source_season"), F.min("later").alias("later"))
    merged = merge_with_precedence(one(r.where("not later")), one(r.where("later")), ["match_id"])
    return merged.groupBy("later", "source_season").agg(F.count(F.lit(1)).alias("n"))


def membership_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many features have a contest, and how many contests have none."""
    c, f = contests(spark, folder, "match_id").select("match_id"), table(spark, folder, "features").select("match_id")
    return (
        f.join(c, "match_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("features_with_contest").alias("audit"), "n")
        .unionByName(f.join(c, "match_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("features_without").alias("audit"), "n"))
        .unionByName(c.join(f, "match_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("contests_without").alias("audit"), "n"))
    )


def same_event(spark: SparkSession, folder: str) -> DataFrame:
    """For each match, the earlier rounds of its tourney released two days before: how many, from when to when."""
    c = contests(spark, folder, "match_id", "match_date", "tourney_id").select("match_id", "tourney_id", "day", "match_date")
    daily = c.groupBy("tourney_id", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tourney_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -2)
    state = daily.select(
        "tourney_id", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("members"), F.min("day").over(w).alias("first_day"), F.max("day").over(w).alias("last_day")
    )
    return c.join(state, ["tourney_id", "day"]).select("match_id", "members", "first_day", "last_day")


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Later deliveries applied as corrections to the counts of the history where the stated surface still agrees."""
    r = table(spark, folder, "records")
    old = r.where("batch_no = 0").groupBy("match_id").agg(F.min_by("surface", "rec_id").alias("surface"), F.min_by("a_ace", "rec_id").alias("a_ace"))
    new = r.where("batch_no > 0").groupBy("match_id").agg(F.min_by("surface", "rec_id").alias("was_surface"), F.min_by("a_ace", "rec_id").alias("new_a_ace"))
    return guarded_patch(old, new, "match_id", ["surface"], ["a_ace"]).groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.sum("a_ace").alias("aces"))


def field_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Fields in which a later delivery of a match_id differs from its first row."""
    r = table(spark, folder, "records").where("match_id is not null")
    first = r.groupBy("match_id").agg(F.min("rec_id").alias("first_id"))
    f = r.join(first, "match_id").where("rec_id = first_id").select("match_id", F.col("surface").alias("s0"), F.col("best_of").alias("b0"), F.col("status").alias("t0"), F.col("match_date").alias("d0"))
    later = r.join(first, "match_id").where("rec_id > first_id").select("rec_id", "match_id", "surface", "best_of", "status", "match_date")
    c = F.col
    fields = {"surface": (c("s0"), c("surface")), "best_of": (c("b0"), c("best_of")), "status": (c("t0"), c("status")), "match_date": (c("d0"), c("match_date"))}
    return compared_fields(later.join(f, "match_id"), "rec_id", fields)


def edition_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue cities claimed by typed locations: the only claim with many editions wins."""
    a = table(spark, folder, "wta_event_alias_table").select("alias_id", F.lower(F.trim("td_location_values")).alias("city"), "editions").where("city is not null")
    return sole_claimants(a, "city", F.col("editions") >= 5).select("alias_id", "verdict")


def carried_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    """Unresolved aliases that take over the newest earlier resolution of the same location; contradicting ones cancel."""
    a = table(spark, folder, "wta_event_alias_table").withColumn("loc", F.lower(F.trim("td_location_values")))
    done = a.where("mirror_tourney_name_norm is not null and loc is not null").select("loc", F.col("season_max").alias("from_season"), F.col("mirror_tourney_name_norm").alias("offer"))
    todo = a.where("mirror_tourney_name_norm is null").select("alias_id", "loc", "season_min")
    offers = todo.join(done, "loc").where("from_season < season_min").groupBy("alias_id", "from_season").agg(F.min("offer").alias("offer"), F.countDistinct("offer").alias("n"))
    newest = offers.groupBy("alias_id").agg(F.max_by(F.struct("offer", "n"), "from_season").alias("o"))
    return newest.where("o.n = 1").select("alias_id", F.col("o.offer").alias("carried"))


def batch_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Rankings as received by mid and by end: what was added, revised or came twice, by (edition, player)."""
    r = table(spark, folder, "rankings").where("effective_date is not null").withColumn("k", F.concat_ws("|", F.col("effective_date").cast("string"), F.col("player_id").cast("string")))
    half = r.where(F.to_date("received_at") <= "2022-12-31")
    return snapshot_diff(half, r, "k", ["raw_rank", "raw_ranking_points"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def opponents_alike(spark: SparkSession, folder: str) -> DataFrame:
    """Winners of the first season and of the second by the names of those they beat: multiset similarity of one half or more."""
    raw = table(spark, folder, "raw_matches")
    left = raw.where("season = 2022").select(F.col("winner_name").alias("n"), F.col("loser_name").alias("o"))
    right = raw.where("season = 2023").select(F.col("winner_name").alias("n"), F.col("loser_name").alias("o"))
    return residual_similarity(left, right, "n", "o").where("similarity >= 0.5").select("left_name", "right_name", F.round("similarity", 6).alias("similarity"))


def country_components(spark: SparkSession, folder: str) -> DataFrame:
    """The sizes of the sets of players whom contests connect."""
    p = contests(spark, folder, "match_id", "player_a", "player_b").where("player_a is not null and player_b is not null")
    return components(p, "player_a", "player_b").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def market_eras(spark: SparkSession, folder: str) -> DataFrame:
    """The scoring rule in force at each match by an era table of intervals (the first that fits)."""
    eras = [(1, "2000-01-01", "2022-06-30", "old"), (2, "2022-07-01", "2023-03-31", "middle"), (3, "2023-01-01", "2030-12-31", "new")]
    e = spark.createDataFrame(eras, "era int, lo string, hi string, rule string").select("era", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"), "rule")
    m = table(spark, folder, "market_rows").select("market_row_id", "market_match_date")
    both = m.join(F.broadcast(e), F.col("market_match_date").between(F.col("lo"), F.col("hi")), "left")  # three eras
    return both.groupBy("market_row_id").agg(F.min_by("rule", "era").alias("rule"))


QUERIES = {
    "j3_dated_with_fallback": dated_with_fallback, "j6_ranking_freshness": ranking_freshness, "ag9_edition_index": edition_index,
    "j12_paired_tourneys": paired_tourneys, "j13_evidence": evidence, "j15_eras": market_eras, "j17_name_cascade": name_cascade,
    "j19_opponents_alike": opponents_alike, "j20_components": country_components, "j21_merged_histories": merged_histories,
    "j22_membership_audit": membership_audit, "j25_same_event": same_event, "j28_corrections": corrections, "j30_field_conflicts": field_conflicts,
    "j33_edition_claims": edition_claims, "j34_carried_resolutions": carried_resolutions, "se4_batch_diff": batch_diff,
}
SQL = {
    "j20_components": f"""with recursive {CONTESTS_SQL}, e as (select player_a x, player_b y from c where player_a is not null and player_b is not null union select player_b, player_a from c where player_a is not null and player_b is not null),
      r(p, q) as (select x, x from e union select r.p, e.y from r join e on e.x = r.q), k as (select p, min(q) component from r group by p) select component, count(*) nodes from k group by 1""",
    "j3_dated_with_fallback": f"""with {CONTESTS_SQL}, a as (select tourney_id, round, max(match_date) m from c group by all), b as (select tourney_id, max(match_date) m from c group by all)
      select source_key, coalesce(a.m, b.m, try_strptime(r.tourney_date, '%Y%m%d')::date + 7) "date",
        case when a.m is not null then 'round' when b.m is not null then 'tourney' else 'anchor_plus_7' end basis
      from raw_matches r left join a on a.tourney_id = r.tourney_id and a.round = r.round left join b on b.tourney_id = r.tourney_id""",
    "j6_ranking_freshness": """with r as (select * from rankings where raw_rank is not null)
      select player_id, max(effective_date) newest, arg_max(raw_rank, (effective_date, received_at, -raw_rank)) "rank",
        ((select max(effective_date) from r) - max(effective_date))::int age_days from r group by player_id""",
    "ag9_edition_index": """with g as (select effective_date, player_id, count(*) n, count(distinct (coalesce(raw_rank, -1), coalesce(raw_ranking_points, -1))) v from rankings group by all)
      select effective_date, sum(n)::bigint "rows", count(*) players, count(*) filter (where n > 1 and v = 1) exact, count(*) filter (where v > 1) conflicting from g group by 1""",
    "j12_paired_tourneys": f"""with {CONTESTS_SQL}, l as (select tourney_id, round, least(winner_id, loser_id) a, greatest(winner_id, loser_id) b, count(*) n from raw_matches group by all),
      r as (select tourney_id, round, player_a a, player_b b, count(*) n from c group by all)
      select case when l.n is null then 'right_only' when r.n is null then 'left_only' when l.n = 1 and r.n = 1 then 'paired' else 'ambiguous' end outcome, count(*) n
      from l full join r on l.tourney_id = r.tourney_id and l.round = r.round and l.a = r.a and l.b = r.b group by 1""",
    "j13_evidence": """select market_row_id, archive_source_key, case when lower(market_location) = lower(regexp_extract(archive_tourney_name, '^[^ ]+')) then 'location'
      when contains(lower(market_tournament), lower(regexp_extract(archive_tourney_name, '^[^ ]+'))) then 'containment' else 'none' end evidence
      from crosswalk_reviewed join market_rows using (market_row_id)""",
    "j15_eras": """select market_row_id, case when market_match_date between date '2000-01-01' and date '2022-06-30' then 'old'
      when market_match_date between date '2022-07-01' and date '2023-03-31' then 'middle' when market_match_date between date '2023-01-01' and date '2030-12-31' then 'new' end rule from market_rows""",
    "j17_name_cascade": r"""with p as (select player_id, lower(concat_ws(' ', trim(name_last), substr(trim(name_first), 1, 1) || '.')) "full", lower(trim(name_last)) "last" from players),
      f as (select "full", min(player_id) v, count(distinct player_id) n from p where "full" is not null group by 1), l as (select "last", min(player_id) v, count(distinct player_id) n from p where "last" is not null group by 1),
      m as (select market_row_id, lower(trim(market_winner_name)) a, lower(regexp_replace(trim(market_winner_name), '\s+([^\s.]{1,2}\.)+$', '')) b from market_rows)
      select market_row_id, case when f.n = 1 then f.v when f.n > 1 then null when l.n = 1 then l.v end player_id,
        case when f.n = 1 then 'surname_initial' when f.n > 1 then 'ambiguous' when l.n = 1 then 'surname' when l.n > 1 then 'ambiguous' else 'none' end "by"
      from m left join f on f."full" = m.a left join l on l."last" = m.b""",
    "j19_opponents_alike": """with l as (select winner_name w, loser_name o, count(*) n from raw_matches where season = 2022 group by all), r as (select winner_name w, loser_name o, count(*) n from raw_matches where season = 2023 group by all),
      x as (select l.w a, r.w b, sum(least(l.n, r.n)) k from l join r using (o) group by all), ls as (select w, sum(n) z from l group by 1), rs as (select w, sum(n) z from r group by 1)
      select a left_name, b right_name, round(k / least(ls.z, rs.z)::double, 6)::double similarity from x join ls on ls.w = a join rs on rs.w = b where k / least(ls.z, rs.z)::double >= 0.5""",
    "j21_merged_histories": """with x as (select match_id, min(source_season) filter (where batch_no = 0) h, min(source_season) filter (where batch_no > 0) l from records group by 1)
      select h is null later, coalesce(h, l) source_season, count(*) n from x group by all""",
    "j22_membership_audit": f"""with {CONTESTS_SQL} select 'features_with_contest' audit, count(*) n from features where match_id in (select match_id from c)
      union all select 'features_without', count(*) from features where match_id not in (select match_id from c)
      union all select 'contests_without', count(*) from c where match_id not in (select match_id from features)""",
    "j25_same_event": f"""with {CONTESTS_SQL} select match_id, count(*) over w members, min(d) over w first_day, max(d) over w last_day from c
      window w as (partition by tourney_id order by d range between unbounded preceding and 2 preceding)""",
    "j28_corrections": """with o as (select match_id, arg_min(struct_pack(s := surface, a := a_ace), rec_id) v from records where batch_no = 0 group by 1),
      n as (select match_id, arg_min(struct_pack(s := surface, a := a_ace), rec_id) v from records where batch_no > 0 group by 1),
      x as (select case when n.match_id is null then 'none' when o.v.s is not distinct from n.v.s then 'applied' else 'refused' end patch,
        case when n.match_id is not null and o.v.s is not distinct from n.v.s then n.v.a else o.v.a end a from o left join n using (match_id))
      select patch, count(*) n, sum(a)::bigint aces from x group by 1""",
    "j30_field_conflicts": """with f as (select * from (select *, row_number() over (partition by match_id order by rec_id) k from records where match_id is not null)),
      x as (select l.rec_id, unnest([struct_pack(field := 'surface', "left" := f.surface, "right" := l.surface), struct_pack(field := 'best_of', "left" := f.best_of::varchar, "right" := l.best_of::varchar),
        struct_pack(field := 'status', "left" := f.status, "right" := l.status), struct_pack(field := 'match_date', "left" := f.match_date::varchar, "right" := l.match_date::varchar)]) v
        from f join f l on l.match_id = f.match_id and f.k = 1 and l.k > 1)
      select rec_id, v.field field, v."left" "left", v."right" "right" from x where v."left" <> v."right" """,
    "j33_edition_claims": """with a as (select alias_id, lower(trim(td_location_values)) city, editions from wta_event_alias_table where td_location_values is not null)
      select alias_id, case when editions >= 5 and count(*) filter (where editions >= 5) over (partition by city) = 1 then 'accepted' else 'unresolved' end verdict from a""",
    "j34_carried_resolutions": """with a as (select *, lower(trim(td_location_values)) loc from wta_event_alias_table),
      o as (select t.alias_id, d.season_max s, min(d.mirror_tourney_name_norm) v, count(distinct d.mirror_tourney_name_norm) n from a t join a d on d.loc = t.loc
        where t.mirror_tourney_name_norm is null and d.mirror_tourney_name_norm is not null and d.season_max < t.season_min group by all),
      b as (select *, row_number() over (partition by alias_id order by s desc) k from o) select alias_id, v carried from b where k = 1 and n = 1""",
    "se4_batch_diff": """with r as (select effective_date || '|' || player_id k, received_at, raw_rank, raw_ranking_points from rankings where effective_date is not null),
      o as (select k, count(*) n, min((coalesce(raw_rank, -1), coalesce(raw_ranking_points, -1))) v from r where received_at::date <= date '2022-12-31' group by 1),
      w as (select k, count(*) n, min((coalesce(raw_rank, -1), coalesce(raw_ranking_points, -1))) v from r group by 1)
      select case when w.n is null then 'removed' when w.n > 1 then 'duplicate' when o.n is null then 'added' when o.v is not distinct from w.v then 'same' else 'revised' end change, count(*) n
      from o full join w using (k) group by 1""",
}
