"""Parsing, admission, membership, comparison and inference queries on the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deuceframe.functions.dates import compact_date
from deuceframe.functions.scores import ROUND_SORT, lookup, normal_score, score_sets
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.plans.ratings import TIER_WEIGHT, tier
from deuceframe.sources.tables import table

REPLICATES = 50
#: Days from a tourney's anchor to each round, for events of a week and for longer ones (a draw of over 32 places).
WEEK_OFFSETS = {"R32": 1, "R16": 2, "QF": 4, "SF": 5, "F": 6, "RR": 3}
LONG_OFFSETS = {"R128": 1, "R64": 3, "R32": 5, "R16": 7, "QF": 9, "SF": 11, "F": 13}
TIER_SQL = "case when regexp_matches(round, '^Q[0-9]$') then 'qualifying' when tourney_level = 'C' then 'challenger' when tourney_level = 'S' then 'futures' else 'tour' end"
SETS_SQL = "array_to_string(list_transform(list_filter(string_split_regex(trim(score), '\\s+'), lambda t: regexp_matches(t, '^\\[?[0-9]+-[0-9]+\\]?(\\([0-9]+\\))?[?]?$')), lambda t: regexp_extract(t, '^\\[?([0-9]+-[0-9]+)', 1)), ' ')"


def _case(column: str, values: dict, otherwise: str = "null") -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {otherwise} end"


def normal_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_matches").select("source_key", normal_score(F.col("score")).alias("score"))


def event_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Tourney ids in parts: the season, the event's code, and its number without leading zeros where it is one."""
    ids = table(spark, folder, "records").where("tourney_id is not null").select("tourney_id").distinct()
    code = F.regexp_extract(F.upper(F.trim("tourney_id")), "^([0-9]{4})[^0-9A-Z]([0-9A-Z]+)$", 2)
    number = F.regexp_extract(code, "^0*([0-9]+)$", 1)
    season = F.regexp_extract(F.trim("tourney_id"), "^([0-9]{4})[^0-9A-Za-z]", 1)
    return ids.select("tourney_id", F.when(season != "", season.cast("int")).alias("season"), F.when(code != "", code).alias("code"), F.when(number != "", number.cast("bigint")).alias("number"))


def round_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Each archive row's date by its round: the anchor day and the round's offset in events of its length."""
    r = table(spark, folder, "raw_matches")
    offset = F.when(F.col("draw_size") > 32, lookup(F.col("round"), LONG_OFFSETS)).otherwise(lookup(F.col("round"), WEEK_OFFSETS))
    return r.select("source_key", offset.cast("int").alias("offset"), F.date_add(compact_date(F.col("tourney_date")), offset.cast("int")).alias("date"))


def week_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every week from the first to the last with its contests, weeks without any included."""
    weeks = contests(spark, folder, "match_id", "match_date").groupBy(F.to_date(F.date_trunc("week", "match_date")).alias("week")).agg(F.count(F.lit(1)).alias("n"))
    grid = weeks.agg(F.min("week").alias("a"), F.max("week").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week"))
    return grid.join(weeks, "week", "left").select("week", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def row_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The identity of each archive row as a hash of its fields, null and empty apart."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("season", "tourney_id", "round", "winner_id", "loser_id", "score")]
    return table(spark, folder, "raw_matches").select("source_key", F.sha2(F.concat_ws("|", *parts), 256).alias("hash"))


def rule_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The rule of each kind of match as JSON, and the sets to win read back from it."""
    kinds = contests(spark, folder, "match_id", "best_of", "tourney_level").where("best_of is not null").select("best_of", "tourney_level").distinct()
    rule = F.to_json(F.struct((F.col("best_of") / 2 + 0.5).cast("int").alias("sets_to_win"), F.lit("tiebreak").alias("mode"), F.lit(6).alias("at_games"), F.when(F.col("tourney_level") == "D", 10).otherwise(7).alias("points")))
    return kinds.select("best_of", "tourney_level", rule.alias("rule"), F.get_json_object(rule, "$.sets_to_win").cast("int").alias("sets_to_win"))


def tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Contests by tier, season and level."""
    c = contests(spark, folder, "match_id", "round", "tourney_level", "source_season").select(tier().alias("tier"), "source_season", "tourney_level")
    return c.groupBy("tier", "source_season", "tourney_level").agg(F.count(F.lit(1)).alias("n"))


def withheld(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of the later batches under the first reason it is withheld, and how many there are."""
    r = table(spark, folder, "records").where("batch_no >= 1")
    reason = (
        F.when(F.col("match_id").isNull(), "no_identity").when(F.col("date_basis") == "inferred_event_end", "date_not_reported").when(F.col("status") == "unresolved", "unresolved")
        .when(F.col("a_won").isNull(), "no_outcome").when(~F.coalesce("source_field_agreement", F.lit(False)), "sources_disagree").otherwise("eligible")
    )
    return r.groupBy(reason.alias("reason"), "batch_no").agg(F.count(F.lit(1)).alias("rows"))


def all_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Every reason against each market row, in order, or an empty text."""
    m = table(spark, folder, "market_rows")
    bad = {"no_date": "market_match_date is null", "no_round": "coalesce(trim(market_round), '') = ''", "no_price": "psw is null or psl is null or isnan(psw) or isnan(psl) or psw <= 1 or psl <= 1",
           "no_sets": "w1 is null or l1 is null", "no_place": "coalesce(trim(market_location), '') = ''", "commented": "coalesce(trim(market_comment), '') not in ('', 'Completed')"}
    return m.select("market_row_id", F.array_join(F.array_compact(F.array(*[F.when(F.expr(e), n) for n, e in bad.items()])), ";").alias("reasons"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Why each side's serve line of an accepted row cannot be used; one side may be usable while the other is not."""
    r = table(spark, folder, "records").where("batch_no = 0")

    def line(s: str) -> Column:
        won = F.col(f"{s}_first_won") + F.col(f"{s}_second_won")
        reasons = [
            F.when(F.col("status").isNull() | ~F.col("status").isin("completed", "retired"), "status"), F.when(F.col(f"{s}_serve_points").isNull() | won.isNull(), "missing"),
            F.when(F.col(f"{s}_serve_points") <= 0, "no_points"), F.when((won < 0) | (won > F.col(f"{s}_serve_points")), "more_won_than_played"), F.when(F.col(f"{s}_first_in") > F.col(f"{s}_serve_points"), "more_in_than_played"),
        ]
        return F.array_join(F.array_compact(F.array(*reasons)), ";")

    x = r.select("rec_id", line("a").alias("reasons_a"), line("b").alias("reasons_b"))
    return x.select("*", ((F.col("reasons_a") == "").cast("int") + (F.col("reasons_b") == "").cast("int")).alias("usable_sides"))


def fold_rows(spark: SparkSession, folder: str) -> DataFrame:
    """For each target month: the rows of the year that ends two days before it, whether every one of its months has rows,
    and the rows of the month itself."""
    c = contests(spark, folder, "match_id", "match_date", "a_won", "identity_tier").where("a_won is not null and identity_tier = 'primary'")
    days = c.groupBy("match_date").agg(F.count(F.lit(1)).alias("n"))  # a row a day meets the folds
    months = days.select(F.trunc("match_date", "month").alias("month")).distinct()
    span = (F.col("match_date") >= F.date_sub(F.add_months("month", -12), 1)) & (F.col("match_date") <= F.date_sub("month", 2))
    train = months.join(days, span).groupBy("month").agg(F.sum("n").alias("training"), F.countDistinct(F.trunc("match_date", "month")).alias("months_seen"))
    target = days.groupBy(F.trunc("match_date", "month").alias("month")).agg(F.sum("n").alias("target"))
    return target.join(train, "month", "left").select("month", F.coalesce("training", F.lit(0).cast("bigint")).alias("training"), (F.coalesce("months_seen", F.lit(0)) >= 12).alias("complete"), "target")


def field_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Features against the contests they were made from: how many rows agree, field by field."""
    fields = ["match_date", "calendar_year", "source_season", "tourney_id", "tourney_level", "round", "surface", "player_a", "player_b"]
    f = table(spark, folder, "features").select("match_id", *[F.col(c).alias(f"f_{c}") for c in fields])
    both = f.join(contests(spark, folder, "match_id", *fields), "match_id", "left")
    checks = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).eqNullSafe(F.col(f"f_{c}")).alias("same")) for c in fields])
    x = both.select(F.explode(checks).alias("x")).select("x.*")
    return x.groupBy("field").agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("different"))


def set_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Archive rows joined to contests of their tourney and round, and what the sets of players say."""
    r = table(spark, folder, "raw_matches").select("source_key", "tourney_id", "round", F.array_sort(F.array("winner_id", "loser_id")).alias("mine"))
    c = contests(spark, folder, "match_id", "tourney_id", "round", "player_a", "player_b").where("player_a is not null and player_b is not null")
    c = c.select("match_id", "tourney_id", "round", "player_a", "player_b")
    # the players meet by either id: a tourney's round may be large, a player's part of it is not
    by_one = r.select("source_key", "tourney_id", "round", "mine", F.explode("mine").alias("player"))
    either = c.select("match_id", "tourney_id", "round", F.array_sort(F.array("player_a", "player_b")).alias("theirs"), F.explode(F.array("player_a", "player_b")).alias("player"))
    met = by_one.join(either, ["tourney_id", "round", "player"], "left")
    agree = F.max(F.when(F.col("mine") == F.col("theirs"), F.col("match_id")))
    verdict = F.when(agree.isNotNull(), "same_players").when(F.max("match_id").isNotNull(), "one_common_player").otherwise("none")
    return met.groupBy("source_key").agg(agree.alias("match_id"), verdict.alias("verdict"))


def set_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The sets of each reviewed link on both sides: the same, the same from the other side, or not."""
    m = table(spark, folder, "market_rows")
    pairs = [F.when(F.col(f"w{i}").isNotNull() & F.col(f"l{i}").isNotNull(), F.concat_ws("-", f"w{i}", f"l{i}")) for i in (1, 2, 3)]
    turned = [F.when(F.col(f"w{i}").isNotNull() & F.col(f"l{i}").isNotNull(), F.concat_ws("-", f"l{i}", f"w{i}")) for i in (1, 2, 3)]
    m = m.select("market_row_id", F.array_join(F.array_compact(F.array(*pairs)), " ").alias("mine"), F.array_join(F.array_compact(F.array(*turned)), " ").alias("turned"))
    sets = F.array_join(F.transform(score_sets(F.col("score")), lambda s: F.concat_ws("-", s.x.cast("string"), s.y.cast("string"))), " ")
    a = table(spark, folder, "raw_matches").select(F.col("source_key").alias("archive_source_key"), sets.alias("theirs"))
    x = table(spark, folder, "crosswalk_reviewed").select("market_row_id", "archive_source_key", "review_decision").join(m, "market_row_id").join(a, "archive_source_key")
    verdict = F.when((F.col("mine") == "") | F.coalesce(F.col("theirs") == "", F.lit(True)), "unknown").when(F.col("mine") == F.col("theirs"), "same").when(F.col("turned") == F.col("theirs"), "turned").otherwise("different")
    return x.groupBy("review_decision", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("links"))


def carried_editions(spark: SparkSession, folder: str) -> DataFrame:
    """Each event of a season carried to the next by its name: exactly one edition there, several, or none."""
    name = F.trim(F.regexp_replace(F.lower("tourney_name"), "[^a-z0-9]+", " "))
    e = table(spark, folder, "raw_matches").where("tourney_name is not null").select(name.alias("name"), "season", "tourney_id").distinct()
    now = e.groupBy("name", "season").agg(F.count(F.lit(1)).alias("editions"))
    later = e.groupBy("name", (F.col("season") - 1).alias("season")).agg(F.count(F.lit(1)).alias("next"), F.min("tourney_id").alias("tourney_id"))
    x = now.join(later, ["name", "season"], "left")
    return x.select("name", "season", F.when(F.col("next").isNull(), "none").when((F.col("next") == 1) & (F.col("editions") == 1), "carried").otherwise("ambiguous").alias("outcome"), F.when((F.col("next") == 1) & (F.col("editions") == 1), F.col("tourney_id")).alias("tourney_id"))


def date_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted links by event and days off the anchor: deltas that several links share are candidates for a correction."""
    x = table(spark, folder, "crosswalk_reviewed").where("review_decision = 'accepted' and match_date_minus_anchor_days is not null")
    out = x.groupBy("archive_tourney_name", "match_date_minus_anchor_days").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("archive_round").alias("rounds"))
    return out.select("*", ((F.col("links") >= 2) & ~F.col("match_date_minus_anchor_days").between(0, 7)).alias("candidate"))


def cover_index(spark: SparkSession, folder: str) -> DataFrame:
    """For each archive tourney, the rounds that are there, the contests the first round implies, and what lacks."""
    r = table(spark, folder, "raw_matches").where("round rlike '^(R[0-9]+|QF|SF|F)$'")
    places = F.coalesce(lookup(F.col("round"), {"QF": 8, "SF": 4, "F": 2}), F.expr("try_cast(substring(round, 2) as int)"))
    per = r.withColumn("places", places).groupBy("tourney_id", "season", "round", "places").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tourney_id", "season").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum("n").alias("contests"), (F.max("places") - 1).alias("implied"), F.count_if(F.col("n") * 2 > F.col("places")).alias("overfull"), F.count_if(F.col("n") * 2 == F.col("places")).alias("whole"),
    )


def relative_depths(spark: SparkSession, folder: str) -> DataFrame:
    """The rounds of each tourney counted from its last."""
    r = table(spark, folder, "raw_matches").where("round is not null and tourney_id is not null").select("tourney_id", "round").distinct()
    w = Window.partitionBy("tourney_id").orderBy(F.desc("o"))
    return r.withColumn("o", F.coalesce(lookup(F.col("round"), ROUND_SORT), F.lit(99))).select("tourney_id", "round", (F.dense_rank().over(w) - 1).alias("depth"))


def total_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each contest within its day: by tier, tourney, round and id."""
    c = contests(spark, folder, "match_id", "match_date", "tourney_id", "round", "tourney_level").withColumn("tier", tier())
    code = lookup(F.col("tier"), {t: i for i, t in enumerate(TIER_WEIGHT)})
    w = Window.partitionBy("match_date").orderBy(code, F.coalesce("tourney_id", F.lit("")), F.coalesce(lookup(F.col("round"), ROUND_SORT), F.lit(99)), "match_id")
    return c.select("match_id", F.row_number().over(w).alias("place"))


def best_two(spark: SparkSession, folder: str) -> DataFrame:
    """The winner most often seen at each tourney, if it leads the next by two matches at least."""
    wins = table(spark, folder, "raw_matches").where("winner_id is not null and tourney_id is not null").groupBy("tourney_id", "winner_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tourney_id").orderBy(F.desc("n"), "winner_id")
    ranked = wins.select("*", F.row_number().over(w).alias("k"), F.lead("n").over(w).alias("second")).where("k = 1")
    margin = F.col("n") - F.coalesce("second", F.lit(0))
    return ranked.select("tourney_id", "winner_id", "n", margin.alias("margin"), (margin >= 2).alias("clear"))


def symmetric_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Match ids that only the features or only the accepted records hold."""
    f = table(spark, folder, "features").select("match_id").distinct()
    r = table(spark, folder, "records").where("batch_no = 0 and match_id is not null").select("match_id").distinct()
    only = f.exceptAll(r).select(F.lit("features").alias("only_in")).unionByName(r.exceptAll(f).select(F.lit("records").alias("only_in")))
    return only.groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


def dedupe_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Market rows under a key of season, round and both names in any order, and how many share it."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z]+", " "))
    key = F.concat_ws("|", "season", plain("market_round"), F.array_join(F.array_sort(F.array(plain("market_winner_name"), plain("market_loser_name"))), "|"))
    return table(spark, folder, "market_rows").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("market_row_id").alias("first"))


def multiset_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Per player, the opponents of the second season beyond those of the first, each as often as it is more often met."""
    r = table(spark, folder, "raw_matches").where("winner_id is not null and loser_id is not null")
    both = r.select("season", F.explode(F.array(F.struct(F.col("winner_id").alias("me"), F.col("loser_id").alias("opp")), F.struct(F.col("loser_id").alias("me"), F.col("winner_id").alias("opp")))).alias("x")).select("season", "x.*")
    n = both.groupBy("me", "opp").agg(F.count_if(F.col("season") == 2022).alias("a"), F.count_if(F.col("season") == 2023).alias("b"))
    return n.groupBy("me").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0).cast("bigint"))).alias("more"), F.sum(F.least("a", "b")).alias("common"))


def archive_summary(spark: SparkSession, folder: str) -> DataFrame:
    r, text = table(spark, folder, "raw_matches"), F.upper(F.coalesce(F.col("score"), F.lit("")))
    flags = {
        "retired": text.rlike(r"\bRET\b"), "walkovers": text.contains("W/O"), "no_score": F.trim(text) == "", "no_date": compact_date(F.col("tourney_date")).isNull(), "no_surface": F.coalesce(F.col("surface"), F.lit("")) == "",
        "no_draw": F.col("draw_size").isNull(), "no_minutes": F.col("minutes").isNull(), "finals": F.coalesce(F.col("round") == "F", F.lit(False)), "best_of_5": F.coalesce(F.col("best_of") == 5, F.lit(False)), "no_country": F.col("winner_ioc").isNull() | F.col("loser_ioc").isNull(),
    }
    return r.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tourney_id").alias("tourneys"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def auc_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """The area under the curve of the stored price, per year, from counts of each distinct price (ties count half)."""
    c = contests(spark, folder).where("a_won is not null and p is not null").select("calendar_year", "p", F.col("a_won").cast("int").alias("y"))
    v = c.groupBy("calendar_year", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    w = Window.partitionBy("calendar_year").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    s = v.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return s.groupBy("calendar_year").agg(F.round(F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))) / (F.sum("pos") * F.sum("neg")), 8).alias("auc"), F.sum("pos").alias("wins"), F.sum("neg").alias("losses"))


def _loss(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    c = contests(spark, folder).where("a_won is not null and p is not null and identity_tier = 'primary'").withColumn("y", F.col("a_won").cast("int"))
    return c.select("match_id", "match_date", "calendar_year", (_loss(0.5 + 0.8 * (F.col("p") - 0.5)) - _loss(F.col("p"))).alias("d"))


def match_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of losses with an interval by resampling matches within years: each match counts in each replicate as
    often as a Poisson variable of mean one that is read off a hash of its id."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "match_id", "rep")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    weight = F.lit(0)
    for k, bound in enumerate((0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)):
        weight = F.when(u >= bound, k + 1).otherwise(weight) if k else F.when(u >= bound, 1).otherwise(0)
    rows = _losses(spark, folder).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES))))
    rows = rows.withColumn("w", F.when(F.col("rep") == 0, 1).otherwise(weight))
    years = rows.groupBy("rep", "calendar_year").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    reps = years.groupBy("rep").agg(F.avg("m").alias("m"))
    return reps.agg(F.round(F.max(F.when(F.col("rep") == 0, F.col("m"))), 7).alias("delta"), *[F.round(F.expr(f"percentile(m, {q}) filter (where rep > 0)"), 7).alias(n) for n, q in (("lower", 0.025), ("upper", 0.975))])


def leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    """The mean difference of losses with each quarter left out, from a row per quarter."""
    quarter = F.concat(F.year("match_date"), F.lit("Q"), F.quarter("match_date"))
    q = _losses(spark, folder).groupBy(quarter.alias("dropped")).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row a quarter
    return q.select("dropped", F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 8).alias("delta"), "n")


def patience(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly losses as a curve: its least value so far, and where a search of patience three months stops."""
    m = _losses(spark, folder).groupBy(F.trunc("match_date", "month").alias("month")).agg(F.avg("d").alias("d"))
    order = Window.partitionBy(F.lit(1)).orderBy("month")  # a row a month
    x = m.withColumn("k", F.row_number().over(order)).withColumn("least", F.min("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("at", F.max(F.when(F.col("d") == F.col("least"), F.col("k"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("k") - F.col("at") >= 3, F.col("k"))).over(Window.partitionBy(F.lit(1)))
    return x.select("month", F.round("least", 8).alias("least"), F.col("at"), (F.col("k") > F.coalesce(stop, F.lit(10**6))).alias("after_stop"))


def point_losses(spark: SparkSession, folder: str) -> DataFrame:
    """The log loss of serve points, per year, of three constant rates: a ratio of sums."""
    c = contests(spark, folder).where("a_serve_points > 0 and a_first_won + a_second_won between 0 and a_serve_points")
    rows = c.select("calendar_year", F.col("a_serve_points").alias("n"), (F.col("a_first_won") + F.col("a_second_won")).alias("k"), F.explode(F.array(*[F.lit(x) for x in (0.58, 0.62, 0.66)])).alias("rate"))
    loss = -(F.col("k") * F.ln("rate") + (F.col("n") - F.col("k")) * F.ln(1 - F.col("rate")))
    return rows.groupBy("calendar_year", "rate").agg(F.round(F.sum(loss) / F.sum("n"), 8).alias("loss"), F.sum("n").alias("points"))


def null_alarm(spark: SparkSession, folder: str) -> DataFrame:
    """The likelihood ratio of the stored price against a coin, per year, and whether the price does no better."""
    c = contests(spark, folder).where("a_won is not null and p is not null").withColumn("y", F.col("a_won").cast("int"))
    return c.groupBy("calendar_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.lit(0.6931471805599453) - _loss(F.col("p"))), 5).alias("log_ratio"), (F.sum(F.lit(0.6931471805599453) - _loss(F.col("p"))) <= 0).alias("alarm"))


QUERIES = {
    "st8_normal_scores": normal_scores, "st10_event_numbers": event_numbers, "dt3_round_dates": round_dates, "dt6_week_grid": week_grid, "aj2_row_hashes": row_hashes, "aj3_rule_documents": rule_documents, "pf11_tiers": tiers,
    "pf19_withheld": withheld, "pf20_all_reasons": all_reasons, "pf23_observations": observations, "pf24_fold_rows": fold_rows, "j8_field_agreement": field_agreement, "j2_set_joined": set_joined, "st7_set_comparison": set_comparison,
    "j26_carried_editions": carried_editions, "j31_date_corrections": date_corrections, "j32_cover_index": cover_index, "wn19_relative_depths": relative_depths, "so1_total_order": total_order, "so5_best_two": best_two,
    "se3_symmetric_difference": symmetric_difference, "se5_dedupe_keys": dedupe_keys, "se6_multiset_residual": multiset_residual, "ag10_archive_summary": archive_summary, "ag23_auc": auc_by_year, "rs1_match_bootstrap": match_bootstrap,
    "rs5_leave_one_out": leave_one_out, "wn22_patience": patience, "ag17_point_losses": point_losses, "ag18_null_alarm": null_alarm,
}
_PL = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z]+', ' ', 'g'))"
_LL = "(-(y * ln(greatest(least({0}, 1 - 1e-6::double), 1e-6::double)) + (1 - y) * ln(1 - greatest(least({0}, 1 - 1e-6::double), 1e-6::double))))"
_D = f"""{CONTESTS_SQL}, l as (select match_id, match_date, calendar_year, {_LL.format("(0.5::double + 0.8::double * (p - 0.5::double))")} - {_LL.format("p")} dd from (select *, a_won::int y from c where a_won is not null and p is not null and identity_tier = 'primary'))"""
_LINE = """array_to_string(list_filter([case when status is null or status not in ('completed', 'retired') then 'status' end, case when {0}_serve_points is null or {0}_first_won + {0}_second_won is null then 'missing' end,
    case when {0}_serve_points <= 0 then 'no_points' end, case when {0}_first_won + {0}_second_won < 0 or {0}_first_won + {0}_second_won > {0}_serve_points then 'more_won_than_played' end,
    case when {0}_first_in > {0}_serve_points then 'more_in_than_played' end], lambda x: x is not null), ';')"""
SQL = {
    "st8_normal_scores": r"""select source_key, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(score, '&nbsp;|\x{00a0}', ' ', 'g'), '‐‑‒–—−', '------'),
      '\s*-\s*', '-', 'g'), '(?i)\b(retired|ret''d|ret)\b\.?', 'RET', 'g'), '(?i)\b(walkover|w/o|wo)\b\.?', 'W/O', 'g'), '[,;]', ' ', 'g'), '(^|\s)0-0(\s|$)', ' ', 'g'), '\s+', ' ', 'g')), '') score from raw_matches""",
    "st10_event_numbers": r"""select tourney_id, try_cast(nullif(regexp_extract(trim(tourney_id), '^([0-9]{4})[^0-9A-Za-z]', 1), '') as int) season, nullif(regexp_extract(upper(trim(tourney_id)), '^([0-9]{4})[^0-9A-Z]([0-9A-Z]+)$', 2), '') code,
      try_cast(nullif(regexp_extract(regexp_extract(upper(trim(tourney_id)), '^([0-9]{4})[^0-9A-Z]([0-9A-Z]+)$', 2), '^0*([0-9]+)$', 1), '') as bigint) number from (select distinct tourney_id from records where tourney_id is not null)""",
    "dt3_round_dates": f"""select source_key, o::int "offset", (try_strptime(tourney_date, '%Y%m%d')::date + o::int)::date "date" from (select *, case when draw_size > 32 then {_case('round', LONG_OFFSETS)} else {_case('round', WEEK_OFFSETS)} end o from raw_matches)""",
    "dt6_week_grid": f"""with {CONTESTS_SQL}, w as (select date_trunc('week', match_date)::date "week", count(*) n from c group by 1)
      select g.k::date "week", coalesce(n, 0) n from (select unnest(generate_series((select min("week") from w)::timestamp, (select max("week") from w)::timestamp, interval 7 day)) k) g left join w on w."week" = g.k::date""",
    "aj2_row_hashes": "select source_key, sha256(concat_ws('|', coalesce(season::varchar, '~'), coalesce(tourney_id, '~'), coalesce(round, '~'), coalesce(winner_id::varchar, '~'), coalesce(loser_id::varchar, '~'), coalesce(score, '~'))) hash from raw_matches",
    "aj3_rule_documents": f"""with {CONTESTS_SQL}, k as (select distinct best_of, tourney_level from c where best_of is not null)
      select best_of, tourney_level, to_json(struct_pack(sets_to_win := (best_of + 1) // 2, mode := 'tiebreak', at_games := 6, points := case when tourney_level = 'D' then 10 else 7 end))::varchar rule, ((best_of + 1) // 2)::int sets_to_win from k""",
    "pf11_tiers": f"with {CONTESTS_SQL} select {TIER_SQL} tier, source_season, tourney_level, count(*) n from c group by all",
    "pf19_withheld": """select case when match_id is null then 'no_identity' when date_basis = 'inferred_event_end' then 'date_not_reported' when status = 'unresolved' then 'unresolved' when a_won is null then 'no_outcome'
      when not coalesce(source_field_agreement, false) then 'sources_disagree' else 'eligible' end reason, batch_no, count(*) "rows" from records where batch_no >= 1 group by all""",
    "pf20_all_reasons": """select market_row_id, array_to_string(list_filter([case when market_match_date is null then 'no_date' end, case when coalesce(trim(market_round), '') = '' then 'no_round' end,
      case when psw is null or psl is null or isnan(psw) or isnan(psl) or psw <= 1 or psl <= 1 then 'no_price' end, case when w1 is null or l1 is null then 'no_sets' end, case when coalesce(trim(market_location), '') = '' then 'no_place' end,
      case when coalesce(trim(market_comment), '') not in ('', 'Completed') then 'commented' end], lambda x: x is not null), ';') reasons from market_rows""",
    "pf23_observations": f"select *, (reasons_a = '')::int + (reasons_b = '')::int usable_sides from (select rec_id, {_LINE.format('a')} reasons_a, {_LINE.format('b')} reasons_b from records where batch_no = 0)",
    "pf24_fold_rows": f"""with {CONTESTS_SQL}, x as (select match_date, date_trunc('month', match_date)::date mo from c where a_won is not null and identity_tier = 'primary'), m as (select mo, count(*) n from x group by 1)
      select m.mo "month", (select count(*) from x where match_date between (m.mo - interval 12 month)::date - 1 and m.mo - 2) training, (select count(distinct mo) from x where match_date between (m.mo - interval 12 month)::date - 1 and m.mo - 2) >= 12 complete, n target from m""",
    "j8_field_agreement": f"with {CONTESTS_SQL} " + " union all ".join(
        f"select '{x}' field, count(*) filter (where f.{x} is not distinct from c.{x}) same, count(*) filter (where f.{x} is distinct from c.{x}) \"different\" from features f left join c using (match_id)"
        for x in ("match_date", "calendar_year", "source_season", "tourney_id", "tourney_level", "round", "surface", "player_a", "player_b")
    ),
    "j2_set_joined": f"""with {CONTESTS_SQL}, k as (select * from c where player_a is not null and player_b is not null), j as (select r.source_key, max(k.match_id) any_id,
        max(case when least(winner_id, loser_id) = least(player_a, player_b) and greatest(winner_id, loser_id) = greatest(player_a, player_b) then k.match_id end) match_id
        from raw_matches r left join k on k.tourney_id = r.tourney_id and k.round = r.round and (player_a in (winner_id, loser_id) or player_b in (winner_id, loser_id)) group by 1)
      select source_key, match_id, case when match_id is not null then 'same_players' when any_id is not null then 'one_common_player' else 'none' end verdict from j""",
    "st7_set_comparison": f"""with m as (select market_row_id, array_to_string(list_filter([w1 || '-' || l1, w2 || '-' || l2, w3 || '-' || l3], lambda x: x is not null), ' ') mine, array_to_string(list_filter([l1 || '-' || w1, l2 || '-' || w2, l3 || '-' || w3], lambda x: x is not null), ' ') turned from market_rows),
      a as (select source_key, {SETS_SQL} theirs from raw_matches)
      select review_decision, case when mine = '' or coalesce(theirs = '', true) then 'unknown' when mine = theirs then 'same' when turned = theirs then 'turned' else 'different' end verdict, count(*) links
      from crosswalk_reviewed x join m using (market_row_id) join a on a.source_key = x.archive_source_key group by all""",
    "j26_carried_editions": """with e as (select distinct trim(regexp_replace(lower(tourney_name), '[^a-z0-9]+', ' ', 'g')) "name", season, tourney_id from raw_matches where tourney_name is not null), n as (select "name", season, count(*) k, min(tourney_id) t from e group by all)
      select a."name", a.season, case when b.k is null then 'none' when b.k = 1 and a.k = 1 then 'carried' else 'ambiguous' end outcome, case when b.k = 1 and a.k = 1 then b.t end tourney_id from n a left join n b on b."name" = a."name" and b.season = a.season + 1""",
    "j31_date_corrections": """select *, links >= 2 and match_date_minus_anchor_days not between 0 and 7 candidate from (select archive_tourney_name, match_date_minus_anchor_days, count(*) links, count(distinct archive_round) rounds
      from crosswalk_reviewed where review_decision = 'accepted' and match_date_minus_anchor_days is not null group by all)""",
    "j32_cover_index": """with p as (select tourney_id, season, round, case round when 'QF' then 8 when 'SF' then 4 when 'F' then 2 else try_cast(substr(round, 2) as int) end places, count(*) n from raw_matches where regexp_matches(round, '^(R[0-9]+|QF|SF|F)$') group by all)
      select tourney_id, season, count(*) rounds, sum(n)::bigint contests, (max(places) - 1)::int implied, count(*) filter (where n * 2 > places) overfull, count(*) filter (where n * 2 = places) whole from p group by all""",
    "wn19_relative_depths": f"select tourney_id, round, (dense_rank() over (partition by tourney_id order by {_case('round', ROUND_SORT, '99')} desc) - 1)::int depth from (select distinct tourney_id, round from raw_matches where round is not null and tourney_id is not null)",
    "so1_total_order": f"""with {CONTESTS_SQL} select match_id, (row_number() over (partition by match_date order by {_case(TIER_SQL, {t: i for i, t in enumerate(TIER_WEIGHT)})}, coalesce(tourney_id, ''), {_case('round', ROUND_SORT, '99')}, match_id))::int place from c""",
    "so5_best_two": """with w as (select tourney_id, winner_id, count(*) n from raw_matches where winner_id is not null and tourney_id is not null group by all),
      k as (select *, row_number() over (partition by tourney_id order by n desc, winner_id) k, lead(n) over (partition by tourney_id order by n desc, winner_id) m from w)
      select tourney_id, winner_id, n, n - coalesce(m, 0) margin, n - coalesce(m, 0) >= 2 clear from k where k = 1""",
    "se3_symmetric_difference": """with f as (select distinct match_id from features), r as (select distinct match_id from records where batch_no = 0 and match_id is not null)
      select only_in, count(*) n from (select 'features' only_in, match_id from f where match_id is null or match_id not in (select match_id from r) union all select 'records', match_id from r where match_id not in (select match_id from f where match_id is not null)) group by 1""",
    "se5_dedupe_keys": f"""select concat_ws('|', season, {_PL.format('market_round')}, least({_PL.format('market_winner_name')}, {_PL.format('market_loser_name')}), greatest({_PL.format('market_winner_name')}, {_PL.format('market_loser_name')})) "key", count(*) n, min(market_row_id) "first" from market_rows group by 1""",
    "se6_multiset_residual": """with x as (select season, winner_id me, loser_id opp from raw_matches where winner_id is not null and loser_id is not null union all select season, loser_id, winner_id from raw_matches where winner_id is not null and loser_id is not null),
      n as (select me, opp, count(*) filter (where season = 2022) a, count(*) filter (where season = 2023) b from x group by all) select me, sum(greatest(b - a, 0))::bigint more, sum(least(a, b))::bigint common from n group by 1""",
    "ag10_archive_summary": r"""select season, count(*) n, count(distinct tourney_id) tourneys, count(*) filter (where regexp_matches(upper(coalesce(score, '')), '\bRET\b')) retired, count(*) filter (where contains(upper(coalesce(score, '')), 'W/O')) walkovers,
      count(*) filter (where trim(coalesce(score, '')) = '') no_score, count(*) filter (where try_strptime(tourney_date, '%Y%m%d') is null) no_date, count(*) filter (where coalesce(surface, '') = '') no_surface, count(*) filter (where draw_size is null) no_draw,
      count(*) filter (where minutes is null) no_minutes, count(*) filter (where round = 'F') finals, count(*) filter (where best_of = 5) best_of_5, count(*) filter (where winner_ioc is null or loser_ioc is null) no_country from raw_matches group by 1""",
    "ag23_auc": f"""with {CONTESTS_SQL}, v as (select calendar_year, p, sum(a_won::int) pos, sum(1 - a_won::int) neg from c where a_won is not null and p is not null group by all),
      s as (select *, coalesce(sum(neg) over (partition by calendar_year order by p rows between unbounded preceding and 1 preceding), 0) below from v)
      select calendar_year, round(sum(pos * (below + 0.5 * neg))::double / (sum(pos) * sum(neg))::double, 8) auc, sum(pos)::bigint wins, sum(neg)::bigint losses from s group by 1""",
    "rs1_match_bootstrap": f"""with {_D}, r as (select *, unnest(range({REPLICATES + 1})) rep from l), u as (select *, ('0x' || substr(md5(match_id || ':' || rep), 1, 8))::bigint / 4294967296.0::double u from r),
      w as (select *, case when rep = 0 then 1 else (u >= 0.367879)::int + (u >= 0.735759)::int + (u >= 0.919699)::int + (u >= 0.981012)::int + (u >= 0.996340)::int + (u >= 0.999406)::int end w from u),
      y as (select rep, calendar_year, sum(w * dd) / sum(w) m from w group by all), m as (select rep, avg(m) m from y group by 1)
      select round(max(case when rep = 0 then m end), 7) delta, round(quantile_cont(m, 0.025) filter (where rep > 0), 7) "lower", round(quantile_cont(m, 0.975) filter (where rep > 0), 7) "upper" from m""",
    "rs5_leave_one_out": f"""with {_D}, q as (select year(match_date) || 'Q' || quarter(match_date) dropped, sum(dd) s, count(*) n from l group by 1) select dropped, round((sum(s) over () - s) / (sum(n) over () - n), 8) delta, n from q""",
    "wn22_patience": f"""with {_D}, m as (select date_trunc('month', match_date)::date mo, avg(dd) v from l group by 1), x as (select *, row_number() over (order by mo) k, min(v) over (order by mo rows unbounded preceding) lo from m),
      y as (select *, max(case when v = lo then k end) over (order by mo rows unbounded preceding) at_k from x), z as (select *, min(case when k - at_k >= 3 then k end) over () stop from y)
      select mo "month", round(lo, 8) least, at_k::int "at", k > coalesce(stop, 1000000) after_stop from z""",
    "ag17_point_losses": f"""with {CONTESTS_SQL}, x as (select calendar_year, a_serve_points n, a_first_won + a_second_won k, unnest([0.58::double, 0.62::double, 0.66::double]) rate from c where a_serve_points > 0 and a_first_won + a_second_won between 0 and a_serve_points)
      select calendar_year, rate, round(sum(-(k * ln(rate) + (n - k) * ln(1 - rate))) / sum(n), 8) loss, sum(n)::bigint points from x group by all""",
    "ag18_null_alarm": f"""with {CONTESTS_SQL}, x as (select calendar_year, 0.6931471805599453::double - {_LL.format('p')} v from (select *, a_won::int y from c where a_won is not null and p is not null))
      select calendar_year, count(*) n, round(sum(v), 5) log_ratio, sum(v) <= 0 alarm from x group by 1""",
}
