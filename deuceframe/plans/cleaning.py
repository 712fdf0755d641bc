"""Cleaning and parsing: scores, dates, names, counts, orientation, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.functions.dates import compact_date, monday_of, satellite_end, training_window
from deuceframe.functions.names import plain_name, surname_signature
from deuceframe.functions.numbers import (
    COUNT_CHECKS, COUNT_FIELDS, count_block_status, count_violations, elo_probability, fair_probability, game_probability, logit, rank_probability,
    widened_deviation,
)
from deuceframe.functions.scores import (
    EARLY_WORDS, LATE_WORDS, ROUND_DEPTH, ROUND_SORT, archive_status, entry_code, lookup, round_word, score_sets, score_status, score_totals, winner_game_share,
)
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.sources.tables import table


def parsed_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("score")
    return table(spark, folder, "raw_matches").select(
        "source_key", score_status(s).alias("status"), archive_status(s).alias("archive_status"), score_totals(s).alias("t"),
        F.round(winner_game_share(s), 8).alias("game_share"),
    ).select("source_key", "status", "archive_status", "t.*", "game_share")


def oriented_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Side A is the smaller id, whoever won; fields of the winner and loser follow their side."""
    a_is_winner = F.col("winner_id") < F.col("loser_id")
    side = lambda w, l: F.when(a_is_winner, F.col(w)).otherwise(F.col(l))
    return table(spark, folder, "raw_matches").select(
        "source_key",
        F.least("winner_id", "loser_id").alias("player_a"),
        F.greatest("winner_id", "loser_id").alias("player_b"),
        a_is_winner.alias("a_won"),
        side("winner_name", "loser_name").alias("name_a"),
        side("loser_ioc", "winner_ioc").alias("ioc_b"),
        compact_date(F.col("tourney_date")).alias("anchor"),
        monday_of(compact_date(F.col("tourney_date"))).alias("week"),
    )


def market_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The market's word for each archive round, and the round's orders."""
    r = F.col("round")
    return table(spark, folder, "raw_matches").select(
        "source_key",
        round_word(r, F.col("draw_size")).alias("word"),
        lookup(r, ROUND_SORT, 99).alias("sort_order"),
        lookup(r, ROUND_DEPTH).alias("depth"),
    )


def folded_names(spark: SparkSession, folder: str) -> DataFrame:
    sig = surname_signature(F.col("market_winner_name"))
    return table(spark, folder, "market_rows").select(
        "market_row_id", plain_name(F.col("market_winner_name")).alias("plain"), sig["surname"].alias("surname"), sig["initials"].alias("initials")
    )


def count_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each record's service counts and the identities that side A breaks."""
    return table(spark, folder, "records").select(
        "rec_id", count_block_status().alias("block"), F.array_join(count_violations("a"), ";").alias("broken_a")
    )


def admitted_records(spark: SparkSession, folder: str) -> DataFrame:
    """The first reason why a row is not admitted, or 'admitted', by batch."""
    reason = (
        F.when(F.col("match_id").isNull() | F.col("tourney_id").isNull(), "no_identity")
        .when(F.col("player_a").isNull() | F.col("player_b").isNull(), "no_player")
        .when(F.col("player_a") >= F.col("player_b"), "not_oriented")
        .when(F.col("match_date").isNull(), "no_date")
        .when(F.year("match_date") != F.col("calendar_year"), "year_differs")
        .when(F.col("a_won").isNull(), "no_outcome")
        .when(~F.col("source_field_agreement"), "fields_disagree")
        .otherwise("admitted")
    )
    return table(spark, folder, "records").groupBy("batch_no", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def event_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an event's matches are included, on what basis; team events and their tourneys are left out."""
    rows = table(spark, folder, "records").where("batch_no = 0")
    team = rows.where("competition_type = 'team_league'").select("tourney_id").distinct()
    kept = rows.join(team, "tourney_id", "left_anti")
    basis = F.when(F.col("competition_type") == "closed_series", "closed").when(F.col("tourney_level").isin("A", "P"), "upper").otherwise("lower")
    return kept.groupBy("competition_type", basis.alias("basis")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tourney_id").alias("tourneys"))


def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the evaluation cohorts per year; a match can be in several."""
    known = F.col("a_won").isNotNull()
    flags = {
        "all": F.lit(True), "primary": (F.col("identity_tier") == "primary") & known, "priced": F.col("p").isNotNull() & known,
        "completed": F.col("status") == "completed", "plus_provisional": known,
    }
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return contests(spark, folder).select("calendar_year", F.explode(names).alias("cohort")).groupBy("calendar_year", "cohort").agg(
        F.count(F.lit(1)).alias("n")
    )


def folds(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows of each walk-forward fold: matches from its window, which ends two days before its period."""
    plan = spark.createDataFrame([(f"2023-{m:02d}", f"2023-{m:02d}-01") for m in range(1, 13)], "fold string, starts string")
    plan = plan.select("fold", F.to_date("starts").alias("starts"), F.add_months(F.to_date("starts"), -6).alias("first"))
    rows = contests(spark, folder, "match_id", "match_date", "a_won").where("a_won is not null")
    inside = (F.col("match_date") >= F.col("first")) & (F.col("match_date") <= F.date_sub("starts", 2))
    last = F.date_sub("starts", 30)  # what is dated later stops the training early
    # twelve folds: the broadcast side is bounded by the plan
    return rows.join(F.broadcast(plan), inside).groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("match_date") >= last).alias("stopping_rows"), F.max("match_date").alias("newest")
    )


def priced_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fair probabilities, log-odds and the quality of each market row's prices."""
    p = fair_probability(F.col("psw"), F.col("psl"))
    return table(spark, folder, "market_rows").select(
        "market_row_id", F.round(p, 8).alias("fair"), F.round(logit(p), 6).alias("log_odds"),
        F.when(F.col("psw").isNull() | F.isnan("psw"), "missing").when((F.col("psw") <= 1) | (F.col("psl") <= 1), "invalid").otherwise("valid").alias("quality"),
    )


def serve_model(spark: SparkSession, folder: str) -> DataFrame:
    """Hold probability, Elo probability of a 100 point lead scaled by the share, and widened deviation per match."""
    share = (F.col("a_first_won") + F.col("a_second_won")) / F.col("a_serve_points")
    return contests(spark, folder).where("a_serve_points > 0").select(
        "match_id", F.round(game_probability(share), 8).alias("hold"),
        F.round(elo_probability(F.lit(1500.0) + share * 100, F.lit(1500.0)), 8).alias("elo"),
        F.round(widened_deviation(F.lit(60.0), F.col("best_of") * 100), 6).alias("rd"),
    )


def rank_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-only probability of each edition's neighbours in rank."""
    r = table(spark, folder, "rankings").groupBy("effective_date", "player_id").agg(F.min("raw_rank").alias("rank"))
    return r.select("effective_date", "player_id", F.round(rank_probability(F.col("rank"), F.col("rank") + 10), 8).alias("p"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entry codes and one-hot levels per year and level."""
    rows = contests(spark, folder)
    q = lambda c: (entry_code(F.col(c)) == "Q").cast("int")
    return rows.groupBy("calendar_year", "tourney_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(q("entry_a") - q("entry_b"), F.lit(0))).alias("qualifier_diff"),
        F.sum(F.greatest(F.coalesce(q("entry_a"), F.lit(0)), F.coalesce(q("entry_b"), F.lit(0)))).alias("any_qualifier"),
    )


def calendar_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per tourney: anchor, end by the number of weeks it spans, and the training window of its season."""
    rows = table(spark, folder, "raw_matches").select("tourney_id", "season", compact_date(F.col("tourney_date")).alias("anchor"), "draw_size")
    t = rows.groupBy("tourney_id", "season").agg(F.min("anchor").alias("anchor"), F.countDistinct("draw_size").alias("legs"))
    w = training_window(F.col("season"))
    return t.select("tourney_id", "anchor", satellite_end(F.col("anchor"), F.col("legs").cast("int")).alias("known_on"), w["first"].alias("first"), w["last"].alias("last"))


_SET = "'^\\[?[0-9]+-[0-9]+\\]?(\\([0-9]+\\))?[?]?$'"
_TOK = f"list_filter(regexp_split_to_array(trim(score), '\\s+'), lambda t: regexp_matches(t, {_SET}))"
_NUM = "regexp_extract(t, '^\\[?([0-9]+)-([0-9]+)', {g})::int"


def _viol(s: str) -> str:
    c = lambda x: f"{s}_{x}"
    second = f"({c('serve_points')} - {c('first_in')})"
    e = [
        f"{c('first_in')} <= {c('serve_points')}", f"{c('first_won')} <= {c('first_in')}", f"{c('second_won')} <= {second}",
        f"{c('double_faults')} <= {second}", f"{c('second_won')} + {c('double_faults')} <= {second}",
        f"{c('ace')} <= {c('first_won')} + {c('second_won')}", f"{c('break_points_saved')} <= {c('break_points_faced')}",
        f"{c('first_won')} + {c('second_won')} <= {c('serve_points')}",
    ]
    listed = ", ".join(f"case when not ({x}) then '{n}' end" for x, n in zip(e, COUNT_CHECKS, strict=True))
    present = " and ".join(f"{c(f)} is not null" for f in COUNT_FIELDS)
    return f"case when {present} then list_filter([{listed}], lambda x: x is not null) end"


def _case(value: str, table_: dict, default: str = "null") -> str:
    return f"case {value} " + " ".join(f"when '{k}' then {v!r}" for k, v in table_.items()) + f" else {default} end"


_EARLY = " ".join(f"when regexp_matches(round, '^R[0-9]+$') and ((2 ** ceil(log2(draw_size)))::int >> {i}) = try_cast(substr(round, 2) as int) then '{w}'" for i, w in enumerate(EARLY_WORDS))

QUERIES = {
    "st5_parsed_scores": parsed_scores,
    "pf1_oriented_matches": oriented_matches,
    "st12_market_rounds": market_rounds,
    "st1_folded_names": folded_names,
    "pf10_count_blocks": count_blocks,
    "pf7_admission": admitted_records,
    "pf4_event_rule": event_rule,
    "pf12_cohorts": cohorts,
    "pf14_folds": folds,
    "ma11_priced_rows": priced_rows,
    "ma6_serve_model": serve_model,
    "ma10_rank_forecasts": rank_forecasts,
    "ma15_entries": entries,
    "dt4_calendar_rules": calendar_rules,
}
SQL = {
    "st5_parsed_scores": f"""with t as (select source_key, score, {_TOK} k,
        list_transform(regexp_split_to_array(upper(trim(score)), '\\s+'), lambda w: rtrim(w, '.')) w, upper(trim(score)) u from raw_matches),
      st as (select *, case when list_has_any(w, ['W/O', 'WALKOVER']) then 'walkover' when list_has_any(w, ['RET', 'RE']) then 'retired'
        when list_has_any(w, ['DEF', 'DEFAULT']) then 'defaulted' when list_has_any(w, ['PLAYED', 'ABANDONED', 'ABD', 'UNFINISHED']) then 'abandoned'
        when len(k) = 0 then 'unknown' else 'completed' end status from t),
      e as (select source_key, status, unnest(k) t, generate_subscripts(k, 1) i, len(k) n from st),
      v as (select *, starts_with(t, '[') br, {_NUM.format(g=1)} x, {_NUM.format(g=2)} y from e),
      g as (select *, br or status = 'completed' or i < n or (greatest(x, y) >= 6 and abs(x - y) >= 2) or (greatest(x, y) = 7 and least(x, y) = 6)
        or contains(t, '(') full_set from v),
      a as (select source_key, sum(case when br then (x > y)::int else x end) gw, sum(case when br then (x < y)::int else y end) gl,
        sum((full_set and x > y)::int) sw, sum((full_set and x < y)::int) sl,
        sum(case when not br then x end) px, sum(case when not br then y end) py from g group by 1)
      select st.source_key, st.status, case when u = 'WALKOVER' or contains(u, 'W/O') then 'walkover' when regexp_matches(u, '\\bRET\\b') then 'retired'
        when regexp_matches(u, '\\bDEF(AULT)?\\b') then 'default' when regexp_matches(u, '\\b(ABN|ABD|ABANDONED)\\b') then 'abandoned'
        when u = '' or regexp_matches(u, '[A-Z]') then 'unknown' else 'completed' end archive_status,
        case when st.status = 'walkover' then 0 else coalesce(gw, 0) end::int games_won, case when st.status = 'walkover' then 0 else coalesce(gl, 0) end::int games_lost,
        case when st.status = 'walkover' then 0 else coalesce(sw, 0) end::int sets_won, case when st.status = 'walkover' then 0 else coalesce(sl, 0) end::int sets_lost,
        round(case when px + py > 0 then px::double / (px + py) end, 8) game_share
      from st left join a using (source_key)""",
    "pf1_oriented_matches": """select source_key, least(winner_id, loser_id) player_a, greatest(winner_id, loser_id) player_b, winner_id < loser_id a_won,
        case when winner_id < loser_id then winner_name else loser_name end name_a, case when winner_id < loser_id then loser_ioc else winner_ioc end ioc_b,
        try_strptime(tourney_date, '%Y%m%d')::date anchor, date_trunc('week', try_strptime(tourney_date, '%Y%m%d'))::date "week" from raw_matches""",
    "st12_market_rounds": f"""select source_key, case round when 'QF' then 'Quarterfinals' when 'SF' then 'Semifinals' when 'F' then 'The Final' when 'RR' then 'Round Robin'
        else case {_EARLY} end end word, {_case('round', ROUND_SORT, '99')} sort_order, {_case('round', ROUND_DEPTH)} depth from raw_matches""",
    "st1_folded_names": r"""with t as (select market_row_id, trim(regexp_replace(lower(strip_accents(market_winner_name)), '[^a-z0-9]+', ' ', 'g')) plain,
        trim(market_winner_name) n, regexp_matches(trim(market_winner_name), '^(.*?)\s+((?:[^\s.]{1,2}\.)+)$') ok from market_rows)
      select market_row_id, plain, case when ok then lower(regexp_extract(n, '^(.*?)\s+((?:[^\s.]{1,2}\.)+)$', 1)) end surname,
        case when ok then lower(replace(regexp_extract(n, '^(.*?)\s+((?:[^\s.]{1,2}\.)+)$', 2), '.', '')) end initials from t""",
    "pf10_count_blocks": f"""with v as (select rec_id, {_viol('a')} va, {_viol('b')} vb from records)
      select rec_id, case when va is null or vb is null then 'missing_all' when len(va) + len(vb) > 0 then 'quarantined_invalid' else 'usable' end block,
        case when len(va) = 0 then '' else array_to_string(va, ';') end broken_a from v""",
    "pf7_admission": """select batch_no, case when match_id is null or tourney_id is null then 'no_identity' when player_a is null or player_b is null then 'no_player'
        when player_a >= player_b then 'not_oriented' when match_date is null then 'no_date' when year(match_date) <> calendar_year then 'year_differs'
        when a_won is null then 'no_outcome' when not source_field_agreement then 'fields_disagree' else 'admitted' end reason, count(*) n from records group by all""",
    "pf4_event_rule": """select competition_type, case when competition_type = 'closed_series' then 'closed' when tourney_level in ('A', 'P') then 'upper' else 'lower' end basis,
        count(*) n, count(distinct tourney_id) tourneys from records r where batch_no = 0 and not exists
        (select 1 from records t where t.batch_no = 0 and t.competition_type = 'team_league' and t.tourney_id = r.tourney_id) group by all""",
    "pf12_cohorts": f"""with {CONTESTS_SQL}, x as (select calendar_year, unnest(['all', case when identity_tier = 'primary' and a_won is not null then 'primary' end,
        case when p is not null and a_won is not null then 'priced' end, case when status = 'completed' then 'completed' end,
        case when a_won is not null then 'plus_provisional' end]) cohort from c) select calendar_year, cohort, count(*) n from x where cohort is not null group by all""",
    "pf14_folds": f"""with {CONTESTS_SQL}, f as (select strftime(m, '%Y-%m') fold, m::date starts, (m - interval 6 month)::date "first"
        from generate_series(date '2023-01-01', date '2023-12-01', interval 1 month) g(m))
      select fold, count(*) "rows", count(*) filter (where match_date >= starts - 30) stopping_rows, max(match_date) newest
      from c join f on match_date between f."first" and f.starts - 2 where a_won is not null group by fold""",
    "ma11_priced_rows": """with q as (select market_row_id, psw, psl, case when psw > 1 and psl > 1 and not isnan(psw) and not isnan(psl)
        then (1 / psw) / (1 / psw + 1 / psl) end f from market_rows)
      select market_row_id, round(f, 8) fair, round(ln(f) - ln(1 - f), 6) log_odds, case when psw is null or isnan(psw) then 'missing'
        when psw <= 1 or psl <= 1 then 'invalid' else 'valid' end quality from q""",
    "ma6_serve_model": f"""with {CONTESTS_SQL}, x as (select match_id, best_of, (a_first_won + a_second_won)::double / a_serve_points p from c where a_serve_points > 0)
      select match_id, round(pow(p, 4) * (1 + 4 * (1 - p) + 10 * (1 - p) * (1 - p)) + 20 * pow(p * (1 - p), 3) * p * p / (1 - 2 * p * (1 - p)), 8) hold,
        round(1 / (1 + pow(10, -p * 100 / 400)), 8) elo, round(least(350, sqrt(3600 + (122500 - 2500)::double / 1095 * best_of * 100)), 6) rd from x""",
    "ma10_rank_forecasts": """select effective_date, player_id, round(case when min(raw_rank) > 0 then 1 / (1 + exp(-ln((min(raw_rank) + 10) / min(raw_rank)::double))) else 0.5 end, 8)::double p
      from rankings group by 1, 2""",
    "ma15_entries": f"""with {CONTESTS_SQL}, x as (select calendar_year, tourney_level, (upper(trim(entry_a)) = 'Q')::int a, (upper(trim(entry_b)) = 'Q')::int b from c)
      select calendar_year, tourney_level, count(*) n, sum(coalesce(a - b, 0))::bigint qualifier_diff, sum(greatest(coalesce(a, 0), coalesce(b, 0)))::bigint any_qualifier from x group by all""",
    "dt4_calendar_rules": """with t as (select tourney_id, season, min(try_strptime(tourney_date, '%Y%m%d')::date) anchor, count(distinct draw_size) legs from raw_matches group by all)
      select tourney_id, anchor, (anchor + (7 * legs)::int)::date known_on, make_date(season - 3, 1, 1) "first", make_date(season, 1, 1) - 2 "last" from t""",
}
