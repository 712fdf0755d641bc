"""Resolution of names and events, deliveries and versions, blends and simultaneous intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deuceframe.functions.dates import compact_date
from deuceframe.functions.names import matching_ratio
from deuceframe.operators.lagged import by_day, released
from deuceframe.plans.checks import REPLICATES, _LL, _loss
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.plans.features import ORIGIN, PLAYERS_SQL, player_rows
from deuceframe.plans.ratings import TIER_WEIGHT, elo_forecasts, elo_sql, tier
from deuceframe.sources.tables import table

#: Weights of the logits of overall ratings, surface ratings and price in the saved combination.
SAVED = {"p_overall": 0.2, "p_surface": 0.15, "price": 0.7}
#: Mean length of a block of weeks.
BLOCK = 8


def market_signature(name: Column) -> Column:
    """The surname of a market name, without initials: lower case letters and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(^|\s)([a-z]{1,2}\.)+", " "), "[^a-z]+", " "))


def archive_signature(name: Column) -> Column:
    """The name behind its first word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s*\S+\s+", ""), "[^a-z]+", " "))


def _name_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(market_row_id, n, source_key): archive rows of the season with the same two surnames, and how many there are."""
    pair = lambda f, a, b: F.array_sort(F.array(f(F.col(a)), f(F.col(b))))
    m = table(spark, folder, "market_rows").select("market_row_id", "season", pair(market_signature, "market_winner_name", "market_loser_name").alias("pair"), "market_match_date")
    a = table(spark, folder, "raw_matches").select("season", pair(archive_signature, "winner_name", "loser_name").alias("pair"), "source_key", compact_date(F.col("tourney_date")).alias("anchor"))
    near = F.datediff("market_match_date", "anchor").between(-1, 8)
    per = m.join(a, ["season", "pair"], "left").groupBy("market_row_id").agg(F.count("source_key").alias("n"), F.count_if(near).alias("n_near"), F.min("source_key").alias("any"), F.min(F.when(near, F.col("source_key"))).alias("near"))
    return per


def classified_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each market row's candidates by names, classified: one, one by its date, several, or none."""
    c = _name_candidates(spark, folder)
    verdict = F.when(F.col("n") == 1, "unique").when(F.col("n_near") == 1, "unique_by_date").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return c.select("market_row_id", "n", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("any")).when(F.col("n_near") == 1, F.col("near")).alias("source_key"))


def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Judged links against what the names alone resolve: right, wrong, open."""
    x = table(spark, folder, "crosswalk_reviewed").where("review_decision = 'accepted'").select("market_row_id", "archive_source_key").join(classified_names(spark, folder), "market_row_id", "left")
    outcome = F.when(F.col("source_key").isNull(), "open").when(F.col("source_key") == F.col("archive_source_key"), "right").otherwise("wrong")
    return x.groupBy(F.coalesce("verdict", F.lit("absent")).alias("verdict"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("links"))


def fuzzy_surnames(spark: SparkSession, folder: str) -> DataFrame:
    """Market surnames that no archive name of the season has, linked to its one most similar surname (ratio of 0.85 or
    more, no equal second). Only surnames that share two neighbouring letters are compared: others cannot be so similar."""
    m = table(spark, folder, "market_rows").select("season", F.explode(F.array(market_signature(F.col("market_winner_name")), market_signature(F.col("market_loser_name")))).alias("name")).where("length(name) > 2").distinct()
    a = table(spark, folder, "raw_matches").select("season", F.explode(F.array(archive_signature(F.col("winner_name")), archive_signature(F.col("loser_name")))).alias("known")).where("length(known) > 2").distinct()
    new = m.join(a.withColumnRenamed("known", "name"), ["season", "name"], "left_anti")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    x = new.withColumn("g", F.explode(grams(F.col("name")))).join(a.withColumn("g", F.explode(grams(F.col("known")))), ["season", "g"]).select("season", "name", "known").distinct()
    x = x.where(F.abs(F.length("name") - F.length("known")) <= 0.15 * (F.length("name") + F.length("known"))).withColumn("ratio", matching_ratio("name", "known")).where("ratio >= 0.85")
    best = x.groupBy("season", "name").agg(F.max("ratio").alias("ratio"), F.max_by("known", "ratio").alias("known"), F.collect_list("ratio").alias("all"))
    return best.where(F.size(F.filter("all", lambda r: r >= F.col("ratio") - 1e-12)) == 1).select("season", "name", "known", F.round("ratio", 6).alias("ratio"))


def serve_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Later rows with serve counts and the one event of their player in whose window they are dated, if it is one."""
    r = table(spark, folder, "records").where("batch_no >= 1 and a_serve_points is not null and player_a is not null and match_date is not null").select("rec_id", "player_a", "match_date")
    e = table(spark, folder, "raw_matches").select("tourney_id", compact_date(F.col("tourney_date")).alias("anchor"), F.explode(F.array("winner_id", "loser_id")).alias("player_a")).where("anchor is not null and tourney_id is not null").distinct()
    near = r.join(e, "player_a").where("match_date between date_sub(anchor, 1) and date_add(anchor, 8)")
    n = near.groupBy("rec_id").agg(F.countDistinct("tourney_id").alias("events"), F.min("tourney_id").alias("tourney_id"))
    return r.join(n, "rec_id", "left").select("rec_id", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"), F.when(F.col("events") == 1, F.col("tourney_id")).alias("tourney_id"))


def biographies(spark: SparkSession, folder: str) -> DataFrame:
    """Sides of contests against the biographies: unknown players, and what known ones lack."""
    p = table(spark, folder, "players").groupBy("player_id").agg(F.max(compact_date(F.trim("dob"))).alias("birth"), F.max("height").alias("height"), F.count(F.lit(1)).alias("rows"))
    c = contests(spark, folder, "match_id", "player_a", "player_b", "calendar_year", "tourney_level")
    s = c.select("calendar_year", "tourney_level", F.explode(F.array("player_a", "player_b")).alias("player_id")).where("player_id is not null").join(p, "player_id", "left")
    return s.groupBy("calendar_year", "tourney_level").agg(
        F.count(F.lit(1)).alias("sides"), F.count_if(F.col("rows").isNull()).alias("unknown"), F.count_if(F.col("rows").isNotNull() & F.col("birth").isNull()).alias("no_birth"), F.count_if(F.col("rows").isNotNull() & F.col("height").isNull()).alias("no_height"), F.count_if(F.col("rows") > 1).alias("repeated"),
    )


def oriented(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's rows as A and B: as in the contest of the same tourney, round and players, else the smaller id first."""
    c = contests(spark, folder, "match_id", "tourney_id", "round", "player_a", "player_b").select("tourney_id", "round", F.least("player_a", "player_b").alias("low"), F.greatest("player_a", "player_b").alias("high"), "match_id", F.col("player_a").alias("a"))
    own = c.groupBy("tourney_id", "round", "low", "high").agg(F.min_by("a", "match_id").alias("a"))
    r = table(spark, folder, "raw_matches").withColumn("low", F.least("winner_id", "loser_id")).withColumn("high", F.greatest("winner_id", "loser_id")).join(own, ["tourney_id", "round", "low", "high"], "left")
    a = F.coalesce("a", "low")
    return r.select("source_key", a.alias("player_a"), F.when(a == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("player_b"), (a == F.col("winner_id")).alias("a_won"), F.when(F.col("a").isNull(), "smaller_id").otherwise("contest").alias("basis"))


def memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Contests by what they may be used for: aligned primary, aligned provisional, or neither; with and without price."""
    c = contests(spark, folder)
    aligned = (F.col("calendar_year") == F.col("source_season")) & F.col("a_won").isNotNull() & F.col("status").isin("completed", "retired")
    kind = F.when(aligned & (F.col("identity_tier") == "primary"), "primary").when(aligned & (F.col("identity_tier") == "provisional"), "provisional").otherwise("none")
    return c.groupBy(F.coalesce(kind, F.lit("none")).alias("member"), F.col("p").isNotNull().alias("priced"), "calendar_year").agg(F.count(F.lit(1)).alias("n"))


def constraints(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the tables, and how many rows break it."""
    f, m, r = table(spark, folder, "features"), table(spark, folder, "market_rows"), table(spark, folder, "records")
    parts = {
        "features_match_id_unique": f.groupBy("match_id").count().where("count > 1"), "market_rows_winner_differs": m.where("market_winner_name = market_loser_name"),
        "records_players_differ": r.where("player_a = player_b"), "records_history_in_order": r.where("batch_no = 0 and player_a >= player_b"), "records_year_is_of_date": r.where("calendar_year <> year(match_date)"),
        "features_cutoff_two_days": f.where("datediff(match_date, eligible_through_date) <> 2"),
    }
    out = None
    for name, bad in parts.items():
        one = bad.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = one if out is None else out.unionByName(one)
    return out


def available(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose date may be relied on by two days before the end of the history: by the basis of the date."""
    last = contests(spark, folder, "match_id", "match_date").agg(F.date_sub(F.max("match_date"), 2).alias("cutoff"))
    c = contests(spark, folder, "match_id", "match_date", "date_basis").crossJoin(F.broadcast(last))  # one row
    ok = F.col("date_basis").isin("tennis_data_reported_date", "tournament_start_plus_round_order") & (F.col("match_date") <= F.col("cutoff"))
    return c.groupBy("date_basis").agg(F.count_if(ok).alias("available"), F.count_if(~ok).alias("withheld"))


def latest_source(spark: SparkSession, folder: str) -> DataFrame:
    """For each day with contests, the newest day that may be used on it."""
    d = contests(spark, folder, "match_id", "match_date").groupBy("match_date").agg(F.count(F.lit(1)).alias("n"), F.first("day").alias("day"))
    w = Window.orderBy("day").rangeBetween(Window.unboundedPreceding, -2)  # a row a day
    return d.select("match_date", F.max("match_date").over(w).alias("latest"), F.sum("n").over(w).alias("usable"))


def surface_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Unadjusted serve shares by surface, points halved every 365 days, drawn to 0.62 by 100 points."""
    rows = player_rows(spark, folder)
    power = F.pow(F.lit(2.0), (F.col("day") - ORIGIN) / F.lit(365.0))
    total = lambda m: F.coalesce(F.sum(F.col(m) * power).over(released(["me", "surface"])), F.lit(0.0)) / power
    base = rows.select("match_id", "side", "me", "surface", "day", "spw", "sp")
    out = by_day(base, ["me", "surface"], {"w": F.col("spw").cast("double"), "p": F.col("sp").cast("double")}, {"xw": total("w"), "xp": total("p")})
    return out.select("match_id", "side", F.round("xp", 4).alias("points"), F.round((F.col("xw") + 62) / (F.col("xp") + 100), 7).alias("rate"))


def decaying_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The step of each player's rating by the number of released matches, and that of a fixed step by tier."""
    rows = player_rows(spark, folder)
    out = by_day(rows, ["me"], {"n": F.lit(1)}, {"before": F.coalesce(F.sum("n").over(released(["me"])), F.lit(0)).cast("bigint")})
    weight = F.when(F.col("tier") == "tour", TIER_WEIGHT["tour"]).when(F.col("tier") == "futures", TIER_WEIGHT["futures"]).otherwise(TIER_WEIGHT["challenger"])
    return out.select("match_id", "side", "before", F.round(250.0 / F.pow(F.col("before") + 5.0, 0.4), 8).alias("decaying"), (32.0 * weight).alias("fixed"))


def document_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Each archive row's key fields as one JSON document with its keys in order, and that document's hash."""
    doc = F.to_json(F.struct("best_of", "loser_id", "round", "season", "winner_id"))
    return table(spark, folder, "raw_matches").where("best_of is not null and loser_id is not null and round is not null and winner_id is not null and season is not null").select("source_key", F.sha2(doc, 256).alias("hash"))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(q) - F.ln(1 - q)


def blends(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed blend of probabilities, and the saved combination of logits, of ratings and price."""
    e = elo_forecasts(spark, folder).join(contests(spark, folder, "match_id", "ps_probability_a").select("match_id", F.col("p").alias("price")).where("price is not null"), "match_id")
    z = sum((_logit(F.col(c)) * w for c, w in SAVED.items()), F.lit(0.0))
    return e.select("match_id", F.round(0.3 * F.col("p") + 0.7 * F.col("price"), 8).alias("blend"), F.round(1 / (1 + F.exp(-z)), 6).alias("combined"))


def simultaneous_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of losses against the price, with intervals that hold for all models together: weeks are resampled in
    blocks of geometric length (mean BLOCK), and every model's half width is the same multiple of its own deviation, the
    quantile of the largest studentised deviation of a replicate.

    A replicate's week is the next one unless a hash of it begins a new block, at a week another hash names: the last
    beginning before each week says it all, so no week waits for the one before it.
    """
    c = contests(spark, folder).where("a_won is not null and p is not null and identity_tier = 'primary'").withColumn("y", F.col("a_won").cast("int"))
    d = {"half": _loss(F.lit(0.5)) - _loss(F.col("p")), "shrunk": _loss(0.5 + 0.8 * (F.col("p") - 0.5)) - _loss(F.col("p"))}
    weeks = c.groupBy(F.to_date(F.date_trunc("week", "match_date")).alias("week")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(k) for k, x in d.items()])
    one = Window.partitionBy(F.lit(1))  # a row a week
    weeks = weeks.select("*", (F.row_number().over(one.orderBy("week")) - 1).alias("t"), F.count(F.lit(1)).over(one).alias("size"))
    unit = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    steps = weeks.select("t", "size", F.explode(F.sequence(F.lit(1), F.lit(4 * REPLICATES))).alias("rep"))
    begins = (F.col("t") == 0) | (unit(F.lit("b"), "rep", "t") < 1.0 / BLOCK)
    w = Window.partitionBy("rep").orderBy("t")
    steps = steps.withColumn("t0", F.max(F.when(begins, F.col("t"))).over(w))
    at = F.pmod(F.floor(unit(F.lit("s"), "rep", "t0") * F.col("size")).cast("int") + F.col("t") - F.col("t0"), F.col("size").cast("int"))
    drawn = steps.select("rep", at.alias("t")).join(weeks.select("t", "n", *d), "t")
    reps = drawn.groupBy("rep").agg(*[(F.sum(k) / F.sum("n")).alias(k) for k in d])
    base = weeks.agg(*[(F.sum(k) / F.sum("n")).alias(f"base_{k}") for k in d])
    sds = reps.agg(*[F.stddev_samp(k).alias(f"sd_{k}") for k in d])
    both = reps.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(sds))  # one row each
    t = both.withColumn("t", F.greatest(*[F.abs(F.col(k) - F.col(f"base_{k}")) / F.col(f"sd_{k}") for k in d]))
    q = t.agg(F.percentile("t", F.lit(0.95)).alias("q"), *[F.max(f"{p}_{k}").alias(f"{p}_{k}") for p in ("base", "sd") for k in d])
    rows = q.select("q", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"base_{k}").alias("delta"), F.col(f"sd_{k}").alias("sd")) for k in d])).alias("x"))
    return rows.select("x.model", *[F.round(v, 7).alias(n) for n, v in (("delta", F.col("x.delta")), ("lower", F.col("x.delta") - F.col("q") * F.col("x.sd")), ("upper", F.col("x.delta") + F.col("q") * F.col("x.sd")), ("multiple", F.col("q")))])


def priced_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Contests with and without a price by year and tier: how many, how many decided, the favourites' share of wins."""
    c = contests(spark, folder).withColumn("tier", tier())
    right = F.when(F.col("p") == 0.5, 0.5).otherwise(((F.col("p") > 0.5) == F.col("a_won")).cast("double"))
    return c.groupBy("calendar_year", "tier").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("priced"), F.count("a_won").alias("decided"), F.round(F.avg(F.when(F.col("p").isNotNull() & F.col("a_won").isNotNull(), right)), 8).alias("favourites"))


def structure(spark: SparkSession, folder: str) -> DataFrame:
    """The shape of each batch, outcomes unread: rows, days, players, and nulls by column."""
    r = table(spark, folder, "records")
    columns = ["match_id", "match_date", "tourney_id", "round", "player_a", "player_b", "a_serve_points", "b_serve_points"]
    return r.groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("match_date").alias("days"), F.countDistinct("player_a").alias("players"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns])


def normalised_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of each match: one, several that agree, or several that contradict each other and are set apart."""
    r = table(spark, folder, "records").where("match_id is not null")
    content = F.struct("match_date", "player_a", "player_b", "a_won", "a_serve_points", "b_serve_points")
    g = r.groupBy("match_id").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct(F.to_json(content)).alias("contents"))
    kind = F.when(F.col("deliveries") == 1, "single").when(F.col("contents") == 1, "duplicate").otherwise("conflict")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("matches"), F.sum("deliveries").alias("deliveries"))


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Each match's versions by delivery, and its latest: the row of the greatest rec_id."""
    r = table(spark, folder, "records").where("match_id is not null")
    g = r.groupBy("match_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("batch_no", "rec_id").alias("latest_batch"), F.max("rec_id").alias("latest"), F.max_by("a_won", "rec_id").alias("a_won"))
    return g.select("match_id", "versions", "latest", "latest_batch", "a_won")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of later batches by how late they came after their day, and by the basis of their date; those of no reported
    day are withheld, and counted."""
    r = table(spark, folder, "records").where("batch_no >= 1")
    days = F.datediff(F.to_date("received_at"), F.col("match_date"))
    late = F.when(days.isNull(), "undated").when(days < 0, "before_its_day").when(days <= 2, "in_time").when(days <= 30, "late").otherwise("very_late")
    return r.groupBy(late.alias("late"), "date_basis").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("date_basis") == "inferred_event_end").alias("withheld"))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name in ("records", "features", "rankings", "players", "raw_matches", "market_rows"):
        one = table(spark, folder, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "j11_classified_names": classified_names, "ag25_round_trip": round_trip, "j18_fuzzy_surnames": fuzzy_surnames, "j23_serve_windows": serve_windows, "j27_biographies": biographies, "pf2_oriented": oriented, "pf13_memberships": memberships,
    "pf17_constraints": constraints, "pf22_available": available, "wn17_latest_source": latest_source, "wn20_surface_rates": surface_rates, "ma2_decaying_steps": decaying_steps, "aj1_document_hashes": document_hashes, "ml11_blends": blends,
    "rs3_simultaneous_intervals": simultaneous_intervals, "rs6_priced_summary": priced_summary, "sc16_structure": structure, "sm9_captures": normalised_captures, "sm8_versions": versions, "sm4_late_rows": late_rows, "sc14_row_counts": row_counts,
}
_MS = r"trim(regexp_replace(regexp_replace(lower({0}), '(^|\s)([a-z]{{1,2}}\.)+', ' ', 'g'), '[^a-z]+', ' ', 'g'))"
_AS = r"trim(regexp_replace(regexp_replace(lower({0}), '^\s*\S+\s+', ''), '[^a-z]+', ' ', 'g'))"
_CAND = f"""m as (select market_row_id, season, list_sort([{_MS.format('market_winner_name')}, {_MS.format('market_loser_name')}]) pair, market_match_date from market_rows),
    a as (select season, list_sort([{_AS.format('winner_name')}, {_AS.format('loser_name')}]) pair, source_key, try_strptime(tourney_date, '%Y%m%d')::date anchor from raw_matches),
    k as (select market_row_id, count(source_key) n, count(*) filter (where market_match_date - anchor between -1 and 8) n_near, min(source_key) any_key, min(source_key) filter (where market_match_date - anchor between -1 and 8) near_key from m left join a using (season, pair) group by 1),
    v as (select market_row_id, n, case when n = 1 then 'unique' when n_near = 1 then 'unique_by_date' when n > 1 then 'ambiguous' else 'none' end verdict, case when n = 1 then any_key when n_near = 1 then near_key end source_key from k)"""
_U = "('0x' || substr(md5({0}), 1, 8))::bigint / 4294967296.0::double"
_LG = "(ln(greatest(least({0}, 1 - 1e-6::double), 1e-6::double)) - ln(1 - greatest(least({0}, 1 - 1e-6::double), 1e-6::double)))"
SQL = {
    "j11_classified_names": f"with {_CAND} select * from v",
    "ag25_round_trip": f"with {_CAND} select coalesce(verdict, 'absent') verdict, case when source_key is null then 'open' when source_key = archive_source_key then 'right' else 'wrong' end outcome, count(*) links from crosswalk_reviewed x left join v using (market_row_id) where review_decision = 'accepted' group by all",
    "j23_serve_windows": """with r as (select rec_id, player_a, match_date from records where batch_no >= 1 and a_serve_points is not null and player_a is not null and match_date is not null),
      e as (select distinct tourney_id, try_strptime(tourney_date, '%Y%m%d')::date anchor, unnest([winner_id, loser_id]) player from raw_matches),
      n as (select rec_id, count(distinct tourney_id) events, min(tourney_id) tourney_id from r join e on e.player = r.player_a and match_date between anchor - 1 and anchor + 8 where tourney_id is not null group by 1)
      select rec_id, coalesce(events, 0) events, case when events = 1 then tourney_id end tourney_id from r left join n using (rec_id)""",
    "j27_biographies": f"""with {CONTESTS_SQL}, p as (select player_id, max(try_strptime(trim(dob), '%Y%m%d')::date) birth, max(height) height, count(*) k from players group by 1), s as (select calendar_year, tourney_level, unnest([player_a, player_b]) player_id from c)
      select calendar_year, tourney_level, count(*) sides, count(*) filter (where k is null) "unknown", count(*) filter (where k is not null and birth is null) no_birth, count(*) filter (where k is not null and height is null) no_height, count(*) filter (where k > 1) repeated
      from s left join p using (player_id) where player_id is not null group by all""",
    "pf2_oriented": f"""with {CONTESTS_SQL}, o as (select tourney_id, round, least(player_a, player_b) low, greatest(player_a, player_b) high, arg_min(player_a, match_id) a from c group by all),
      r as (select m.*, o.a, least(winner_id, loser_id) lo, greatest(winner_id, loser_id) hi from raw_matches m left join o on o.tourney_id = m.tourney_id and o.round = m.round and o.low = least(winner_id, loser_id) and o.high = greatest(winner_id, loser_id))
      select source_key, coalesce(a, lo) player_a, case when coalesce(a, lo) = lo then hi else lo end player_b, coalesce(a, lo) = winner_id a_won, case when a is null then 'smaller_id' else 'contest' end basis from r""",
    "pf13_memberships": f"""with {CONTESTS_SQL}, k as (select *, calendar_year = source_season and a_won is not null and status in ('completed', 'retired') al from c)
      select case when al and identity_tier = 'primary' then 'primary' when al and identity_tier = 'provisional' then 'provisional' else 'none' end "member", p is not null priced, calendar_year, count(*) n from k group by all""",
    "pf17_constraints": """select 'features_match_id_unique' "rule", count(*) broken from (select match_id from features group by 1 having count(*) > 1) union all select 'market_rows_winner_differs', count(*) from market_rows where market_winner_name = market_loser_name
      union all select 'records_players_differ', count(*) from records where player_a = player_b union all select 'records_history_in_order', count(*) from records where batch_no = 0 and player_a >= player_b
      union all select 'records_year_is_of_date', count(*) from records where calendar_year <> year(match_date) union all select 'features_cutoff_two_days', count(*) from features where match_date - eligible_through_date <> 2""",
    "pf22_available": f"""with {CONTESTS_SQL}, x as (select *, date_basis in ('tennis_data_reported_date', 'tournament_start_plus_round_order') and match_date <= (select max(match_date) - 2 from c) ok from c)
      select date_basis, count(*) filter (where ok) available, count(*) filter (where not ok) withheld from x group by 1""",
    "wn17_latest_source": f"""with {CONTESTS_SQL}, x as (select match_date, d, count(*) n from c group by all) select match_date, max(match_date) over w latest, (sum(n) over w)::bigint usable from x window w as (order by d range between unbounded preceding and 2 preceding)""",
    "wn20_surface_rates": f"""with {PLAYERS_SQL}, x as (select match_id, side, coalesce(sum(spw * pow(2, (d - {ORIGIN}) / 365.0::double)) over w, 0) / pow(2, (d - {ORIGIN}) / 365.0::double) a, coalesce(sum(sp * pow(2, (d - {ORIGIN}) / 365.0::double)) over w, 0) / pow(2, (d - {ORIGIN}) / 365.0::double) b
      from s window w as (partition by me, surface order by d range between unbounded preceding and 2 preceding)) select match_id, side, round(b, 4) points, round((a + 62) / (b + 100), 7) rate from x""",
    "ma2_decaying_steps": f"""with {PLAYERS_SQL}, x as (select match_id, side, tier, count(*) over (partition by me order by d range between unbounded preceding and 2 preceding) before from s)
      select match_id, side, before, round(250 / pow(before + 5.0::double, 0.4::double), 8) decaying, 32.0::double * case tier when 'tour' then 1.0 when 'futures' then 0.6 else 0.8 end fixed from x""",
    "aj1_document_hashes": "select source_key, sha256(to_json(struct_pack(best_of := best_of, loser_id := loser_id, round := round, season := season, winner_id := winner_id))::varchar) hash from raw_matches where best_of is not null and loser_id is not null and round is not null and winner_id is not null and season is not null",
    "ml11_blends": f"""{elo_sql()} select match_id, round(0.3 * round((po + ps) / 2, 6) + 0.7 * p, 8) blend, round(1 / (1 + exp(-(0.2 * {_LG.format('round(po, 6)')} + 0.15 * {_LG.format('round(ps, 6)')} + 0.7 * {_LG.format('p')}))), 6) combined from z where p is not null""",
    "rs3_simultaneous_intervals": f"""with {CONTESTS_SQL}, k as (select *, a_won::int y from c where a_won is not null and p is not null and identity_tier = 'primary'),
      w as (select *, row_number() over (order by wk) - 1 t, count(*) over () sz from (select date_trunc('week', match_date)::date wk, count(*) n, sum({_LL.format('0.5::double')} - {_LL.format('p')}) h, sum({_LL.format('(0.5::double + 0.8::double * (p - 0.5::double))')} - {_LL.format('p')}) s from k group by 1)),
      st as (select t, sz, unnest(range(1, {4 * REPLICATES + 1})) rep from w), b as (select *, max(case when t = 0 or {_U.format("'b:' || rep || ':' || t")} < 1.0::double / {BLOCK} then t end) over (partition by rep order by t) t0 from st),
      dr as (select rep, (floor({_U.format("'s:' || rep || ':' || t0")} * sz)::bigint + t - t0) % sz t from b), rp as (select rep, sum(h) / sum(n) h, sum(s) / sum(n) s from dr join w using (t) group by 1),
      bs as (select sum(h) / sum(n) h, sum(s) / sum(n) s from w), sd as (select stddev_samp(h) h, stddev_samp(s) s from rp),
      q as (select quantile_cont(greatest(abs(rp.h - bs.h) / sd.h, abs(rp.s - bs.s) / sd.s), 0.95) q from rp, bs, sd)
      select 'half' model, round(bs.h, 7) delta, round(bs.h - q * sd.h, 7) "lower", round(bs.h + q * sd.h, 7) "upper", round(q, 7) multiple from bs, sd, q union all select 'shrunk', round(bs.s, 7), round(bs.s - q * sd.s, 7), round(bs.s + q * sd.s, 7), round(q, 7) from bs, sd, q""",
    "rs6_priced_summary": f"""with {CONTESTS_SQL}, k as (select *, case when regexp_matches(round, '^Q[0-9]$') then 'qualifying' when tourney_level = 'C' then 'challenger' when tourney_level = 'S' then 'futures' else 'tour' end tier from c)
      select calendar_year, tier, count(*) n, count(p) priced, count(a_won) decided, round(avg(case when p is not null and a_won is not null then case when p = 0.5 then 0.5::double else ((p > 0.5) = a_won)::int::double end end), 8) favourites from k group by all""",
    "sc16_structure": """select batch_no, count(*) "rows", count(distinct match_date) "days", count(distinct player_a) players, """ + ", ".join(f"count(*) filter (where {c} is null) no_{c}" for c in ("match_id", "match_date", "tourney_id", "round", "player_a", "player_b", "a_serve_points", "b_serve_points")) + " from records group by 1",
    "sm9_captures": """with g as (select match_id, count(*) k, count(distinct (coalesce(match_date::varchar, '~') || '|' || coalesce(player_a::varchar, '~') || '|' || coalesce(player_b::varchar, '~') || '|' || coalesce(a_won::varchar, '~') || '|' || coalesce(a_serve_points::varchar, '~') || '|' || coalesce(b_serve_points::varchar, '~'))) v from records where match_id is not null group by 1)
      select case when k = 1 then 'single' when v = 1 then 'duplicate' else 'conflict' end kind, count(*) matches, sum(k)::bigint deliveries from g group by 1""",
    "sm8_versions": "select match_id, count(*) \"versions\", max(rec_id) latest, max_by(batch_no, rec_id) latest_batch, (select a_won from records r where r.rec_id = max(x.rec_id)) a_won from records x where match_id is not null group by 1",
    "sm4_late_rows": """select case when match_date is null or received_at is null then 'undated' when received_at::date - match_date < 0 then 'before_its_day' when received_at::date - match_date <= 2 then 'in_time' when received_at::date - match_date <= 30 then 'late' else 'very_late' end late,
      date_basis, count(*) "rows", count(*) filter (where date_basis = 'inferred_event_end') withheld from records where batch_no >= 1 group by all""",
    "sc14_row_counts": " union all ".join(f"select '{t}' \"name\", count(*) \"rows\" from {t}" for t in ("records", "features", "rankings", "players", "raw_matches", "market_rows")),
}
