"""Forecasts, their scores and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.functions.numbers import logit
from deuceframe.operators.evaluation import (
    block_bootstrap, equal_year_slope, identical_population, ladder, log_loss, pool, pooled, reliability, select_within, swap_symmetric_predictions,
    yearly_models,
)
from deuceframe.operators.models import fit_trees, symmetric_forecast
from deuceframe.plans.contests import CONTESTS_SQL, contests
from deuceframe.plans.features import rank_features
from deuceframe.plans.ratings import elo_forecasts, elo_sql
from deuceframe.session import Scratch

#: Four forecasters that need no state: a constant, the stored price, a shrunken price and serve shares of the match.
MODELS = ["half", "price", "shrunk"]


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = contests(spark, folder).where("a_won is not null and p is not null and identity_tier = 'primary'")
    return rows.select(
        "match_id", "calendar_year", "tourney_id", "match_date", F.col("a_won").cast("int").alias("y"), F.lit(0.5).alias("p_half"), F.col("p").alias("p_price"),
        (0.5 + 0.8 * (F.col("p") - 0.5)).alias("p_shrunk"),
    )


def ladder_years(spark: SparkSession, folder: str) -> DataFrame:
    out = ladder(_scored(spark, folder), MODELS, "calendar_year", F.col("y"))
    return out.select("year", "model", "n", "clips", *[F.round(c, 8).alias(c) for c in ("log_loss", "brier", "accuracy")])


def ladder_pooled(spark: SparkSession, folder: str) -> DataFrame:
    out = pooled(ladder(_scored(spark, folder), MODELS, "calendar_year", F.col("y")))
    return out.select("model", "n", "years", F.round("match_weighted", 8).alias("match_weighted"), F.round("equal_year", 8).alias("equal_year"))


def contrasts(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's loss minus that of the price, per month: mean, and whether it is negative."""
    y = F.col("y")
    cells = [F.struct(F.lit(m).alias("model"), (log_loss(F.col(f"p_{m}"), y) - log_loss(F.col("p_price"), y)).alias("delta")) for m in ("half", "shrunk")]
    rows = _scored(spark, folder).select(F.date_format("match_date", "yyyy-MM").alias("month"), F.explode(F.array(*cells)).alias("x")).select("month", "x.*")
    monthly = rows.groupBy("model", "month").agg(F.avg("delta").alias("m"), F.count(F.lit(1)).alias("n"))
    return monthly.groupBy("model").agg(
        F.count_if(F.col("m") < 0).alias("months_negative"), F.count(F.lit(1)).alias("months"), F.round(F.avg("m"), 8).alias("equal_month"),
        F.round(F.stddev_samp("m") / F.sqrt(F.count(F.lit(1))), 8).alias("standard_error"), F.round(F.percentile("m", 0.975), 8).alias("upper"),
    )


def reliability_bins(spark: SparkSession, folder: str) -> DataFrame:
    out = reliability(_scored(spark, folder), F.col("p_price"), F.col("y"))
    return out.select("bin", "n", F.round("mean_prediction", 8).alias("mean_prediction"), F.round("outcome_rate", 8).alias("outcome_rate"))


def calibration_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Equal-year weights, their weighted loss per model, and root mean squares of the log-odds."""
    rows = _scored(spark, folder).withColumn("n_y", F.expr("count(1) over (partition by calendar_year)"))
    years = rows.agg(F.countDistinct("calendar_year").alias("ys"))
    w = 1.0 / (F.col("n_y") * F.col("ys"))
    both = rows.crossJoin(F.broadcast(years))  # one row
    return both.agg(
        F.round(F.sum(w), 8).alias("total"), F.round(F.sum(w * log_loss(F.col("p_price"), F.col("y"))), 8).alias("price"),
        F.round(F.sum(w * log_loss(F.col("p_shrunk"), F.col("y"))), 8).alias("shrunk"), F.round(F.sqrt(F.avg(F.pow(logit(F.col("p_price")), F.lit(2.0)))), 8).alias("rms"),
    )


def dispersion(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).groupBy("calendar_year").agg(
        F.countDistinct("p_price").alias("distinct_values"), F.round(F.stddev_pop("p_price"), 8).alias("sd"), (F.stddev_pop("p_price") > 1e-6).alias("informative")
    )


def selected_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Per year, the shrinkage with the least loss, ties by menu order."""
    menu = F.array(*[F.struct(F.lit(i).alias("menu"), F.lit(s).alias("shrink")) for i, s in enumerate((1.0, 0.9, 0.8, 0.6))])
    rows = _scored(spark, folder).select("calendar_year", "y", "p_price", F.explode(menu).alias("c")).select("*", "c.menu", "c.shrink")
    loss = log_loss(0.5 + F.col("shrink") * (F.col("p_price") - 0.5), F.col("y"))
    means = rows.groupBy("calendar_year", "menu", "shrink").agg(F.round(F.avg(loss), 10).alias("loss"))
    return select_within(means, ["calendar_year"], "loss", "menu").select("calendar_year", "menu", "shrink", F.round("loss", 8).alias("loss"))


def pooled_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """The stored price pooled with the market's where the archive has one, on log-odds."""
    rows = contests(spark, folder).select("match_id", "p", ((F.col("a_first_won") + F.col("a_second_won")) / F.col("a_serve_points")).alias("share"))
    parts = {"price": logit(F.col("p")), "serve": logit(F.col("share"), 0.05)}
    return rows.select("match_id", F.round(pool(parts, {"price": 0.7, "serve": 0.3}), 8).alias("pooled"))


def rated_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: ratings, the stored price and a constant on identical matches, per year."""
    c = contests(spark, folder).where("a_won is not null and identity_tier = 'primary'").select("match_id", "calendar_year", F.col("a_won").cast("int").alias("y"), "p")
    price = c.where("p is not null").select("match_id", "p")
    both = identical_population({"elo": elo_forecasts(spark, folder), "price": price, "half": c.select("match_id", F.lit(0.5).alias("p"))}, "match_id")
    out = ladder(both.join(c.select("match_id", "calendar_year", "y"), "match_id"), ["elo", "price", "half"], "calendar_year", F.col("y"))
    return out.select("year", "model", "n", *[F.round(c, 7).alias(c) for c in ("log_loss", "brier", "accuracy")])


def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The shrunken minus the stored price by tournament blocks."""
    y = F.col("y")
    return block_bootstrap(_scored(spark, folder), ["tourney_id"], log_loss(F.col("p_shrunk"), y) - log_loss(F.col("p_price"), y), 400)


def quarter_folds(rows: DataFrame) -> DataFrame:
    """(fold, first, last, c) of each quarter with matches whose training window, the year that ends two days before it,
    begins no earlier than the first quarter with matches."""
    quarters = rows.where("match_date is not null").select(F.trunc("match_date", "quarter").alias("start")).distinct()
    least = quarters.agg(F.min("start").alias("least"))
    plan = quarters.crossJoin(F.broadcast(least)).withColumn("first", F.add_months("start", -12)).where("first >= least")  # least: one row
    return plan.select(F.concat(F.year("start"), F.lit("Q"), F.quarter("start")).alias("fold"), "first", F.date_sub("start", 2).alias("last"), F.lit(1.0).alias("c"))


def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of yearly models on the price's log-odds and the differences of log points and rank strength as known two
    days before (all change sign when the sides are interchanged), each fitted before its quarter; from the third quarter
    on calibrated on all earlier ones."""
    c = contests(spark, folder, "match_id", "match_date", "a_won", "calendar_year", "ps_probability_a").where("a_won is not null")
    rows = c.join(rank_features(spark, folder), "match_id").select(
        "match_id", "match_date", "calendar_year", F.col("a_won").cast("int").alias("y"), F.coalesce(logit(F.col("p")), F.lit(0.0)).alias("x1"),
        F.col("rank_points_log_diff").alias("x2"), F.col("rank_strength_diff").alias("x3"),
    )
    rows = Scratch(spark, "walk").write(rows, "rows")  # every fold and calibration reads them
    plan = quarter_folds(rows)
    betas = {r.fold: r.beta for r in yearly_models(rows, plan, ["x1", "x2", "x3"]).collect()}  # one row per fold
    parts = []
    for fold, beta in sorted(betas.items()):
        quarter = rows.where(F.concat(F.year("match_date"), F.lit("Q"), F.quarter("match_date")) == fold)
        parts.append(swap_symmetric_predictions(quarter, ["x1", "x2", "x3"], beta).withColumn("fold", F.lit(fold)))
    if not parts:
        return spark.createDataFrame([], "fold string, n bigint, raw double, calibrated double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    calibrated = F.col("p")
    for fold in sorted(betas)[2:]:
        slope = equal_year_slope(out.where(F.col("fold") < fold), F.col("p"), F.col("y"), "fold")
        calibrated = F.when(F.col("fold") == fold, pool({"p": logit(F.col("p")) * slope}, {"p": 1.0})).otherwise(calibrated)
    return out.withColumn("q", calibrated).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("raw"), F.avg(log_loss(F.col("q"), F.col("y"))).alias("calibrated"))


def tree_forecasts(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees and a forest fitted on matches before 2023, scored on those from 2023, against the stored price."""
    c = contests(spark, folder).where("a_won is not null")
    elo = elo_forecasts(spark, folder).select("match_id", (F.col("p_overall") - 0.5).alias("elo"), (F.col("p_surface") - 0.5).alias("surface_elo"))
    rows = c.join(elo, "match_id").select("match_id", "calendar_year", F.col("a_won").cast("double").alias("y"), (F.col("p") - 0.5).alias("price"), "elo", "surface_elo", F.col("best_of").cast("double").alias("best_of"))
    signed, context = ["price", "elo", "surface_elo"], ["best_of"]
    past, target = rows.where("calendar_year < 2023"), rows.where("calendar_year >= 2023")
    forecasts = {
        kind: symmetric_forecast(fit_trees(past, signed, context, "y", kind), target, signed, context, "match_id") for kind in ("boosted", "forest")
    } | {"price": target.where("price is not null").select("match_id", (F.col("price") + 0.5).alias("p"))}
    both = identical_population(forecasts, "match_id").join(target.select("match_id", "calendar_year", "y"), "match_id")
    return ladder(both, list(forecasts), "calendar_year", F.col("y")).select("year", "model", "n", "log_loss", "brier", "accuracy")


_SCORED = f"""with {CONTESTS_SQL}, z as (select match_id, calendar_year, tourney_id, match_date, a_won::int y, 0.5::double p_half, p p_price, 0.5::double + 0.8::double * (p - 0.5::double) p_shrunk from c
  where a_won is not null and p is not null and identity_tier = 'primary')"""
_CL = "greatest(least({p}, 1 - 1e-6::double), 1e-6::double)"


def _ll(p: str) -> str:
    q = _CL.format(p=p)
    return f"(-(y * ln({q}) + (1 - y) * ln(1 - {q})))"


_LONG = f"""{_SCORED}, m as (select calendar_year, y, unnest([struct_pack(model := 'half', p := p_half), struct_pack(model := 'price', p := p_price), struct_pack(model := 'shrunk', p := p_shrunk)]) v from z),
  l as (select calendar_year, v.model model, y, v.p p, {_ll('v.p')} loss from m)"""
QUERIES = {
    "rs4_rated_ladder": rated_ladder, "ag3_ladder_years": ladder_years, "ag2_ladder_pooled": ladder_pooled, "ag6_contrasts": contrasts,
    "ag4_reliability": reliability_bins, "ag16_calibration_weights": calibration_weights, "ag12_dispersion": dispersion, "so3_selected_candidates": selected_candidates,
    "ml8_pooled_forecasts": pooled_forecasts,
    "rs2_bootstrap_interval": bootstrap_interval, "ml1_walk_forward": walk_forward, "ml3_tree_forecasts": tree_forecasts,
}
SQL = {
    "rs4_rated_ladder": f"""{elo_sql()}, e as (select match_id, calendar_year, a_won::int y, p price, round((po + ps) / 2, 6) elo from z where a_won is not null and identity_tier = 'primary' and p is not null),
      mm as (select calendar_year, y, unnest([struct_pack(model := 'elo', p := elo), struct_pack(model := 'price', p := price), struct_pack(model := 'half', p := 0.5::double)], recursive := true) from e)
      select calendar_year "year", model, count(*) n, round(avg({_ll('p')}), 7) log_loss, round(avg((p - y) * (p - y)), 7) brier,
      round(avg(case when p = 0.5 then 0.5::double else ((p > 0.5) = (y = 1))::int::double end), 7) accuracy from mm group by all""",
    "ag3_ladder_years": f"""{_LONG} select calendar_year "year", model, count(*) n, sum((p < 1e-6 or p > 1 - 1e-6)::int)::bigint clips, round(avg(loss), 8) log_loss, round(avg((p - y) * (p - y)), 8) brier,
      round(avg(case when p = 0.5 then 0.5::double else ((p > 0.5) = (y = 1))::int::double end), 8) accuracy from l group by all""",
    "ag2_ladder_pooled": f"""{_LONG}, a as (select calendar_year, model, count(*) n, sum(loss) s from l group by all)
      select model, sum(n)::bigint n, count(*) "years", round(sum(s) / sum(n), 8) match_weighted, round(avg(s / n), 8) equal_year from a group by 1""",
    "ag6_contrasts": f"""{_SCORED}, m as (select strftime(match_date, '%Y-%m') mo, 'half' model, {_ll('p_half')} - {_ll('p_price')} d from z
      union all select strftime(match_date, '%Y-%m'), 'shrunk', {_ll('p_shrunk')} - {_ll('p_price')} from z), a as (select model, mo, avg(d) v from m group by all)
      select model, count(*) filter (where v < 0) months_negative, count(*) "months", round(avg(v), 8) equal_month, round(stddev_samp(v) / sqrt(count(*)), 8) standard_error, round(quantile_cont(v, 0.975), 8) upper from a group by 1""",
    "ag4_reliability": f"""{_SCORED}, b as (select case when p_price < 0.1 then 0 when p_price < 0.2 then 1 when p_price < 0.3 then 2 when p_price < 0.4 then 3 when p_price < 0.5 then 4 when p_price < 0.6 then 5
      when p_price < 0.7 then 6 when p_price < 0.8 then 7 when p_price < 0.9 then 8 else 9 end bin, p_price p, y from z)
      select r.bin::int bin, count(p) n, round(avg(p), 8) mean_prediction, round(avg(y), 8) outcome_rate from range(10) r(bin) left join b on b.bin = r.bin group by 1""",
    "ag16_calibration_weights": f"""{_SCORED}, w as (select *, 1.0::double / (count(*) over (partition by calendar_year) * (select count(distinct calendar_year) from z)) w from z)
      select round(sum(w), 8) total, round(sum(w * {_ll('p_price')}), 8) price, round(sum(w * {_ll('p_shrunk')}), 8) shrunk, round(sqrt(avg(pow(ln(p_price) - ln(1 - p_price), 2))), 8) rms from w""",
    "ag12_dispersion": f"""{_SCORED} select calendar_year, count(distinct p_price) distinct_values, round(stddev_pop(p_price), 8) sd, stddev_pop(p_price) > 1e-6 informative from z group by 1""",
    "so3_selected_candidates": f"""{_SCORED}, s as (select calendar_year, m menu, [1.0, 0.9, 0.8, 0.6][m + 1]::double shrink, y, 0.5::double + [1.0, 0.9, 0.8, 0.6][m + 1]::double * (p_price - 0.5::double) p from z, range(4) r(m)),
      a as (select calendar_year, menu::int menu, shrink, round(avg({_ll('p')}), 10) loss from s group by all), b as (select *, min(loss) over (partition by calendar_year) least_loss from a),
      k as (select *, row_number() over (partition by calendar_year order by menu) n from b where loss <= least_loss + 1e-12) select calendar_year, menu, shrink, round(loss, 8) loss from k where n = 1""",
    "ml8_pooled_forecasts": f"""with {CONTESTS_SQL}, x as (select match_id, case when p is not null then greatest(least(p, 1 - 1e-12::double), 1e-12::double) end p, case when a_first_won + a_second_won is not null and a_serve_points <> 0 then greatest(least((a_first_won + a_second_won)::double / a_serve_points, 0.95::double), 0.05::double) end s from c),
      y as (select match_id, case when p is not null then ln(p) - ln(1 - p) end a, case when s is not null and not isnan(s) then ln(s) - ln(1 - s) end b from x)
      select match_id, round(case when a is not null or b is not null then 1 / (1 + exp(-(coalesce(a, 0) * 0.7::double + coalesce(b, 0) * 0.3::double)
        / (case when a is not null then 0.7::double else 0 end + case when b is not null then 0.3::double else 0 end))) end, 8) pooled from y""",
}
