"""Windows, as-of, linking, folds and evaluation against plain Python."""

import datetime as dt
import math
import random
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deuceframe.functions import numbers as N
from deuceframe.functions.names import full_name_signatures, plain_name, surname_signature, without_disambiguator
from deuceframe.functions.scores import normal_score, round_word, score_status, score_totals, winner_game_share
from deuceframe.operators.evaluation import block_bootstrap, equal_year_slope, fit_ridge_logistic, pool, reliability, select_within
from deuceframe.operators.folds import ELO_SCHEMA, RD_GROWTH, AllTierRatings, FilterSettings, PooledElo, RatingSuite, ServeFilter, ordered_fold
from deuceframe.operators.known_at import attributes_as_known, change_history, newest_edition_by_day
from deuceframe.operators.lagged import by_day, decayed_sum, form_over_last, released
from deuceframe.operators.linking import cascade, components, guarded_patch, merge_with_precedence, residual_similarity, snapshot_diff, sole_claimants, unique_pairs
from deuceframe.operators.rolling import daily_totals, entity_calendar, trailing_totals
from deuceframe.plans import evaluation as evaluation_plans
from deuceframe.plans import ratings as rating_plans


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(3)
    facts = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)]), rng.choice([None, 1, 5])) for _ in range(300)]
    rows = [(e, None if d is None else dt.date(2022, 1, 1) + dt.timedelta(d), v, "x") for e, d, v in facts]
    df = spark.createDataFrame(rows, "player int, day date, points int, entity string")
    daily = daily_totals(df, F.col("player"), F.col("day"), {"points": F.col("points")})
    base = (dt.date(2022, 1, 1) - dt.date(1970, 1, 1)).days
    probes = [(e, base + d) for e in (1, 2, 3, None) for d in range(-5, 75, 3)] + [(1, None), (1, base), (1, base)]
    got = trailing_totals(daily, spark.createDataFrame(probes, "entity int, day int"), {"7d": (7, 2), "28d": (28, 2)}, ("points",)).collect()
    assert len(got) == len(set(probes))
    for r in got:
        for name, first in (("7d", 7), ("28d", 28)):
            inside = [v or 0 for e, d, v in facts if e is not None and d is not None and e == r.entity and r.day is not None and r.day - first <= base + d <= r.day - 2]
            assert (r[f"rows_{name}"], r[f"points_{name}"]) == (len(inside), sum(inside))
            assert r[f"points_avg_{name}"] == pytest.approx(sum(inside) / (first - 1))
    empty = trailing_totals(daily.where("false"), spark.createDataFrame([(1, base)], "entity int, day int"), {"7d": (7, 2)}, ("points",))
    assert empty.first().rows_7d == 0
    assert entity_calendar(daily, 2).where("entity = 2").count() >= 1
    with pytest.raises(ValueError):
        trailing_totals(daily, daily, {"bad": (1, 2)})


def test_attributes_as_known(spark):
    day = lambda n: dt.date(2022, 1, 1) + dt.timedelta(n)
    rows = [(1, day(0), 5, day(0)), (1, day(0), 5, day(1)), (1, day(0), 6, day(4)), (2, day(0), None, day(2)), (None, day(0), 1, day(0)), (1, None, 1, day(0)), (1, day(0), 9, None)]
    df = spark.createDataFrame(rows, "k int, e date, v int, known date")
    history = change_history(df.where("e is not null"), ["k"], F.col("known"), F.col("v"))
    asked = spark.createDataFrame([(1, day(0)), (1, day(3)), (1, day(4)), (2, day(1)), (2, day(2)), (3, day(9)), (None, day(1))], "k int, at date")
    got = {(r.k, r.at): (r.a, r.a_seen) for r in attributes_as_known(asked, {"a": history}, ["k"], "at").collect()}
    assert got[1, day(0)] == (5, 1) and got[1, day(3)] == (5, 1) and got[1, day(4)] == (None, 2)
    assert got[2, day(1)] == (None, None) and got[2, day(2)] == (None, 1) and got[3, day(9)] == (None, None)
    editions = newest_edition_by_day(df, F.col("e"), F.col("known"), asked, "at").collect()
    assert all(r.edition == day(0) for r in editions) and editions
    assert newest_edition_by_day(df.where("false"), F.col("e"), F.col("known"), asked, "at").count() == 0


def test_lag_windows_and_decay(spark):
    days = [0, 1, 1, 3, 5, 9, 12, 12, 20]
    df = spark.createDataFrame([(1, d, float(i)) for i, d in enumerate(days)], "me int, day int, v double")
    got = df.select("day", "v", F.count(F.lit(1)).over(released(["me"], 7)).alias("n"), decayed_sum(F.col("v"), ["me"], 10.0, 0).alias("s")).collect()
    for r in got:
        usable = [(d, i) for i, d in enumerate(days) if d <= r.day - 2]
        assert r.n == sum(d >= r.day - 7 for d, _ in usable)
        assert r.s == pytest.approx(sum(i * 2 ** (-(r.day - d) / 10) for d, i in usable))
    form = form_over_last(df, ["me"], ["v"], {"w": F.col("v")}, 3).collect()
    for r in form:
        last = [i for i, d in enumerate(days) if d <= r.day - 2][-3:]
        assert (r.last_n, r.w) == (len(last), sum(last))


def test_scores(spark):
    cases = {
        "6-4 2-6 3-1 RET": ("retired", 11, 11, 1, 1), "6-3 [10-8]": ("completed", 7, 3, 2, 0), "7-6(4) 6-2": ("completed", 13, 8, 2, 0),
        "W/O": ("walkover", 0, 0, 0, 0), "6-1 3-0 DEF": ("defaulted", 9, 1, 1, 0), "": ("unknown", 0, 0, 0, 0), "6-4 7-5": ("completed", 13, 9, 2, 0),
    }
    df = spark.createDataFrame([(s, "R16", 32) for s in cases] + [(None, "QF", 32)], "s string, r string, d int")
    got = df.select("s", score_status(F.col("s")).alias("st"), score_totals(F.col("s")).alias("t"), winner_game_share(F.col("s")).alias("g"), round_word(F.col("r"), F.col("d")).alias("w")).collect()
    for r in got:
        if r.s is not None:
            assert (r.st, *r.t) == cases[r.s]
            assert r.w == "2nd Round"
        else:
            assert r.st is None and r.w == "Quarterfinals"


def test_names(spark):
    df = spark.createDataFrame([("Müller-Ríos A.B.", "Ana María Ríos (tennis)"), (None, None)], "a string, b string")
    r = df.select(plain_name(F.col("a")).alias("p"), surname_signature(F.col("a")).alias("s"), full_name_signatures(without_disambiguator(F.col("b"))).alias("f")).collect()
    assert r[0].p == "muller rios a b" and r[0].s.surname == "müller-ríos" and r[0].s.initials == "ab"
    assert [(x.surname, x.initials) for x in r[0].f] == [("maría ríos", "a"), ("ríos", "am")]
    assert r[1].p is None and r[1].s is None


def test_chains_against_simulation_and_recursion():
    assert N._game(np.array([0.5]))[0] == pytest.approx(0.5)
    assert N._tiebreak(np.array([0.6]), np.array([0.6]))[0] == pytest.approx(0.5, abs=1e-9)
    got = N.match_probability_array(np.array([0.65, 0.6]), np.array([0.6, 0.6]), np.array([3, 5]))
    assert got[1] == pytest.approx(0.5) and 0.6 < got[0] < 0.8
    assert N.carried_match_probability(0.65, 0.6) == pytest.approx(got[0], abs=5e-3)
    rng = np.random.default_rng(1)
    p, wins, n = 0.62, 0, 20000
    for _ in range(n):
        a = b = 0
        while not (max(a, b) >= 4 and abs(a - b) >= 2):
            if rng.random() < p:
                a += 1
            else:
                b += 1
        wins += a > b
    assert N._game(np.array([p]))[0] == pytest.approx(wins / n, abs=0.015)


def test_linking(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (1, None)], "k int, v string")
    assert sorted(r.k for r in merge_with_precedence(a, b, ["k"]).collect()) == [1, 2, 2, 3]
    assert {r.k: r.change for r in snapshot_diff(b, a, "k", ["v"]).collect()} == {1: "revised", 2: "duplicate", 3: "removed"}
    assert {r.k: r.outcome for r in unique_pairs(a, b, ["k"]).collect()} == {1: "paired", 2: "ambiguous", 3: "right_only"}
    patches = spark.createDataFrame([(1, "x", "q"), (3, "no", "q")], "k int, was_v string, new_v string")
    assert {(r.k, r.v): r.patch for r in guarded_patch(b.where("k <> 1").union(a.where("k = 1")), patches, "k", ["v"], ["v"]).collect()} == {(2, "y"): "none", (3, "w"): "refused", (1, "q"): "applied"}
    t1 = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "x string, id int")
    t2 = spark.createDataFrame([("s", 7)], "y string, id int")
    rows = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s"), (None, None)], "x string, y string")
    assert [(r.x, r.id, r.by) for r in cascade(rows, [(t1, "x", "one"), (t2, "y", "two")], "id").orderBy("x").collect()] == [(None, None, "none"), ("a", 1, "one"), ("b", None, "ambiguous"), ("c", 7, "two")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (52, 51), (None, 3)], "a int, b int")
    assert {r.node: r.component for r in components(chain, "a", "b").collect()} == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50, 52: 50}
    alike = residual_similarity(spark.createDataFrame([("p", "o1"), ("p", "o2"), ("p", "o2")], "n string, o string"), spark.createDataFrame([("q", "o2"), ("q", "o3")], "n string, o string"), "n", "o").first()
    assert alike.similarity == pytest.approx(0.5)
    claims = spark.createDataFrame([(1, "c", 9), (2, "c", 1), (3, "d", 9), (4, "d", 8)], "id int, city string, n int")
    assert {r.id: r.verdict for r in sole_claimants(claims, "city", F.col("n") > 5).collect()} == {1: "accepted", 2: "unresolved", 3: "unresolved", 4: "unresolved"}


def _matches(n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = sorted(rng.sample(range(1, 9), 2))
        rows.append((f"m{i:03d}", rng.randrange(90), a, b, rng.choice(["Hard", "Clay", "Carpet"]), rng.choice([True, False, None]), rng.choice("ASC")))
    return pd.DataFrame(rows, columns=["match_id", "day", "player_a", "player_b", "surface", "a_won", "tourney_level"]).sort_values(["day", "match_id"]).reset_index(drop=True)


def test_pooled_elo_against_plain_python(spark):
    pdf = _matches()
    got = PooledElo().feed(pdf).set_index("match_id")
    for target in pdf.itertuples():
        if target.Index % 17:
            continue
        o, s = {}, {}
        p = lambda x, y: 1 / (1 + 10 ** ((y - x) / 400))
        for day in sorted(set(pdf.day[pdf.day <= target.day - 2])):
            do, ds = {}, {}
            for r in pdf[pdf.day == day].itertuples():
                if r.a_won is None:
                    continue
                c = 32 * (r.a_won - p(o.get(r.player_a, 1500), o.get(r.player_b, 1500)))
                for k, v in ((r.player_a, c), (r.player_b, -c)):
                    do[k] = do.get(k, 0) + v
                if r.surface is not None:
                    c = 32 * (r.a_won - p(s.get((r.player_a, r.surface), 1500), s.get((r.player_b, r.surface), 1500)))
                    for k, v in (((r.player_a, r.surface), c), ((r.player_b, r.surface), -c)):
                        ds[k] = ds.get(k, 0) + v
            for d, state in ((do, o), (ds, s)):
                for k, v in d.items():
                    state[k] = state.get(k, 1500) + v
        assert got.p_overall[target.match_id] == pytest.approx(p(o.get(target.player_a, 1500), o.get(target.player_b, 1500)))
    df = spark.createDataFrame(pdf.astype({"a_won": "object"})).withColumn("tour", F.lit("t"))
    folded = ordered_fold(df, ["tour"], ["day", "match_id"], lambda key: PooledElo(), ELO_SCHEMA).toPandas().set_index("match_id")
    assert np.allclose(folded.p.sort_index(), got.p.sort_index())


def _tiered(rows):
    columns = ["match_id", "day", "player_a", "player_b", "a_won", "surface", "tier", "status", "counted", "a_spw", "a_sp", "b_spw", "b_sp"]
    return pd.DataFrame(rows, columns=columns)


def _row(i, day, a=1, b=2, won=True, surface="Hard", tier="tour", status="completed", counts=(62.0, 100.0, 60.0, 100.0)):
    return (f"m{i}", day, a, b, won, surface, tier, status, counts is not None, *(counts or (np.nan,) * 4))


def test_future_and_own_outcomes_do_not_matter():
    """Flipping a match's own outcome, or deleting later ones, leaves its forecast as it is; earlier ones matter."""
    pdf = _matches().sort_values(["day", "match_id"]).reset_index(drop=True)
    pdf["game_share"], pdf["tier"], pdf["status"], pdf["counted"] = None, "tour", "completed", False
    for column in ("a_spw", "a_sp", "b_spw", "b_sp"):
        pdf[column] = np.nan
    for start, column in ((PooledElo, "p"), (RatingSuite, "surface_mix"), (AllTierRatings, "elo_a")):
        values = lambda x, start=start, column=column: start().feed(x).set_index("match_id")[column]
        base = values(pdf)
        at = pdf.index[150]
        flipped = pdf.copy()
        flipped.loc[at:, "a_won"] = [not v for v in flipped.a_won[at:]]
        early = pdf.match_id[pdf.day <= pdf.day[at]]
        assert np.allclose(base[early], values(flipped)[early])
        changed = pdf.copy()
        changed.loc[:40, "a_won"] = True
        assert not np.allclose(base, values(changed))


def test_all_tier_ratings():
    fold = AllTierRatings().feed
    out = fold(_tiered([_row(1, 0, 1, 2, tier="futures"), _row(2, 1, 1, 3, tier="tour"), _row(3, 2, 1, 2, status="walkover"), _row(4, 5, 1, 2), _row(5, 5, 3, 4, tier="challenger")])).set_index("match_id")
    assert out.elo_a["m1"] == 1300 and out.elo_b["m2"] == 1500 and out.elo_a["m5"] > 1500 - 32 and out.elo_b["m5"] == 1400  # the tier of the first row read
    assert out.elo_a["m2"] == 1300  # a row is released two days later
    assert out.elo_a["m3"] == pytest.approx(1300 + 0.6 * 16) and out.tour_a["m3"] == 1500
    # the tour row of day 1 (a win over 1500) moved both; the walkover of day 2 moved nothing
    gain = 32 * (1 - 1 / (1 + 10 ** ((1500 - 1309.6) / 400)))
    assert out.elo_a["m4"] == pytest.approx(1309.6 + gain) and out.elo_b["m4"] == pytest.approx(1300 - 9.6) and out.tour_a["m4"] == 1516
    q = np.log(10) / 400
    g = 1 / np.sqrt(1 + 3 * (q * 350 / np.pi) ** 2)
    rd = 1 / np.sqrt(1 / 350**2 + (q * g) ** 2 * 0.25)
    assert out.rd_a["m3"] == pytest.approx(np.sqrt(rd**2 + RD_GROWTH * 2)) and RD_GROWTH == pytest.approx(109.589, abs=1e-3)
    assert out.serve_a["m3"] == pytest.approx(0.002 * (62 - 100 * 0.62)) and out.serve_b["m3"] == pytest.approx(0.002 * (60 - 100 * 0.62))
    assert fold(_tiered([_row(9, 9, won=None, status="unresolved", counts=None)])).elo_a.notna().all()


def test_serve_filter():
    learn = [_row(i, 3 * i, counts=(70.0, 100.0, 55.0, 100.0)) for i in range(60)]
    out = ServeFilter(FilterSettings(intercept_rate=0.001)).feed(_tiered(learn))
    point = 1 / (1 + np.exp(-out[["eta_a", "eta_b"]]))
    assert point.eta_a[0] == pytest.approx(0.62) and abs(point.eta_a.iloc[-1] - 0.70) < 0.02 and abs(point.eta_b.iloc[-1] - 0.55) < 0.02
    # both directions start from the state before the row: interchanging the sides interchanges the values
    rows = [_row(1, 0, counts=(70.0, 100.0, 55.0, 90.0)), _row(2, 3)]
    turned = [_row(1, 0, 2, 1, False, counts=(55.0, 90.0, 70.0, 100.0)), _row(2, 3, 2, 1)]
    x, y = (ServeFilter().feed(_tiered(r)).iloc[1] for r in (rows, turned))
    assert x.eta_a == pytest.approx(y.eta_b) and x.variance_b == pytest.approx(y.variance_a) and x.serve_a == pytest.approx(y.serve_b)
    # one step by hand, without surface deviations
    s = FilterSettings(surface_variance=0.0, growth=0.0, intercept_rate=0.0)
    z = ServeFilter(s).feed(_tiered(rows)).iloc[1]
    g, i = 70 - 62.0, 100 * 0.62 * 0.38
    assert z.serve_a == pytest.approx(0.05 * g / (1 + i * 0.1)) and z.return_b == pytest.approx(-z.serve_a)
    # a deviation acts on its surface only; lower tiers count less; another surface reads its own intercept
    on = lambda surface, tier="tour", first="tour": ServeFilter().feed(_tiered([_row(1, 0, tier=first, counts=(80.0, 100.0, 50.0, 100.0)), _row(2, 3, surface=surface, tier=tier)])).iloc[1]
    assert on("Hard").eta_a > on("Clay").eta_a and on("Hard").serve_a == on("Clay").serve_a
    assert abs(on("Hard", "tour", "futures").serve_a) < abs(on("Hard").serve_a)
    assert on("Hard", "futures").eta_a == on("Hard").eta_a  # not updated yet: the tour's intercept


def test_evaluation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-x))).astype(int)
    df = spark.createDataFrame([(int(i % 3), float(1 / (1 + np.exp(-2 * v))), int(t)) for i, (v, t) in enumerate(zip(x, y))], "year int, p double, y int")
    assert equal_year_slope(df, F.col("p"), F.col("y"), "year") == pytest.approx(0.5, abs=0.08)
    bins = reliability(df, F.col("p"), F.col("y")).collect()
    assert len(bins) == 10 and sum(b.n for b in bins) == 4000
    edge = reliability(spark.createDataFrame([(1.0, 1), (0.1, 0)], "p double, y int"), F.col("p"), F.col("y")).orderBy("bin").collect()
    assert edge[9].n == 1 and edge[1].n == 1 and edge[5].mean_prediction is None
    beta = fit_ridge_logistic(np.stack([x, rng.normal(size=4000)], 1), y, 10.0)
    assert beta[0] == pytest.approx(1.0, abs=0.12) and abs(beta[1]) < 0.1
    assert (fit_ridge_logistic(np.stack([-x, x], 1), y, 1.0, nonnegative=True) >= 0).all()
    menu = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.4999999999999)], "g int, menu int, loss double")
    assert select_within(menu, ["g"], "loss", "menu").first().menu == 0
    one = spark.createDataFrame([(0.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in one.select(pool({"a": F.col("a"), "b": F.col("b")}, {"a": 1.0, "b": 2.0})).collect()] == [0.5, None]
    blocks = spark.createDataFrame([(i % 40, float(v)) for i, v in enumerate(x)], "b int, d double")
    r = block_bootstrap(blocks, ["b"], F.col("d"), 200).first()
    assert r.lower < r["mean"] < r.upper and r.upper - r.lower == pytest.approx(4 / math.sqrt(4000), rel=0.4)


def test_trees_are_swap_symmetric(spark):
    from deuceframe.operators.models import fit_trees, symmetric_forecast

    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    y = (rng.random(800) < 1 / (1 + np.exp(-2 * x))).astype(float)
    rows = [(i, None if i % 9 == 0 else float(v), 3.0, float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, s double, best_of double, y double")
    model = fit_trees(df, ["s"], ["best_of"], "y", maxIter=5)
    p = {r.id: r.p for r in symmetric_forecast(model, df, ["s"], ["best_of"], "id").collect()}
    q = {r.id: r.p for r in symmetric_forecast(model, df.withColumn("s", -F.col("s")), ["s"], ["best_of"], "id").collect()}
    assert all(p[i] + q[i] == pytest.approx(1.0) for i in p) and p[0] == pytest.approx(0.5)
    assert np.corrcoef([x[i] for i in p if i % 9], [v for i, v in p.items() if i % 9])[0, 1] > 0.8


def test_game_shares_reach_the_suite(spark):
    rows = spark.createDataFrame([("m1", "T", "QF", 1, 2, True), ("m2", "T", "SF", 2, 1, True), ("m3", "T", "F", 1, 2, True), ("m4", "U", "QF", 1, 2, None)], "match_id string, tourney_id string, round string, player_a long, player_b long, a_won boolean")
    raw = spark.createDataFrame([("T", "QF", 1, 2, "6-0 6-0"), ("T", "SF", 2, 1, "6-4 4-6 6-4"), ("T", "F", 2, 1, "6-1 6-1"), ("U", "QF", 1, 2, "6-1 6-1")], "tourney_id string, round string, winner_id long, loser_id long, score string")
    got = {r.match_id: r.game_share for r in rating_plans.game_shares(rows, raw).collect()}
    assert got == {"m1": 1.0, "m2": pytest.approx(16 / 30), "m3": None, "m4": None}


def test_walk_forward_folds_cover_the_data(spark):
    days = [dt.date(2022, 1, 5) + dt.timedelta(7 * i) for i in range(118)]  # until April 2024
    plan = evaluation_plans.quarter_folds(spark.createDataFrame([(d,) for d in days] + [(None,)], "match_date date"))
    got = {r.fold: (r.first, r.last) for r in plan.collect()}
    assert sorted(got) == ["2023Q1", "2023Q2", "2023Q3", "2023Q4", "2024Q1", "2024Q2"]
    assert got["2023Q2"] == (dt.date(2022, 4, 1), dt.date(2023, 3, 30)) and got["2023Q4"] == (dt.date(2022, 10, 1), dt.date(2023, 9, 29))


def test_rounds_of_draws_with_byes(spark):
    rows = [("R32", 28, "1st Round"), ("R16", 28, "2nd Round"), ("R64", 48, "1st Round"), ("R64", 96, "2nd Round"), ("R128", 96, "1st Round"), ("R32", 56, "2nd Round"), ("R16", 16, "1st Round"), ("R16", 128, "4th Round"), ("R64", 32, None), ("RR", 8, "Round Robin"), ("RR", None, "Round Robin"), ("R32", None, None), (None, 32, None), ("SF", 4, "Semifinals")]
    df = spark.createDataFrame(rows, "round string, draw int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", round_word(F.col("round"), F.col("draw"))).collect())


def test_normal_scores(spark):
    rows = [("6–4 6 - 3", "6-4 6-3"), ("6-4, 2-1 ret.", "6-4 2-1 RET"), ("0–0 walkover", "W/O"), ("7-6(5)&nbsp;6-0", "7-6(5) 6-0"), ("6-1 0-0 Retired", "6-1 RET"), ("  ", None), (None, None), ("10-0 6-0", "10-0 6-0")]
    df = spark.createDataFrame(rows, "score string, want string")
    assert [(r.score, r.got) for r in df.withColumn("got", normal_score(F.col("score"))).collect()] == rows


def test_daily_windows_equal_row_windows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["Hard", None]), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, me int, surface string, day int, v int")
    plain = df.where("day is not null").select("id", F.sum("v").over(released(["me", "surface"], 9)).alias("a"))
    got = by_day(df.where("day is not null"), ["me", "surface"], {"daily": F.col("v")}, {"a": F.sum("daily").over(released(["me", "surface"], 9))}).select("id", "a")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, got.collect())) and got.count() == df.where("day is not null").count()
    assert by_day(df.where("false"), ["me"], {"daily": F.col("v")}, {"a": F.sum("daily").over(released(["me"]))}).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the tables are not here")
def test_queries_against_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    plain = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else v
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("fo2_elo_forecasts", "fo3_tier_elo", "wn1_activity", "wn5_experience", "wn9_tier_form", "ma16_assembled", "rs1_match_bootstrap", "rs3_simultaneous_intervals", "j2_set_joined", "j11_classified_names", "wn22_patience"):
        got, want = queries[name](spark, folder), con.sql(sql[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=str), name


def test_fuzzy_surnames(spark):
    from deuceframe.plans.more import archive_signature, market_signature

    df = spark.createDataFrame([("Plioltrek S.", "Skura Trolpliek"), ("Van Doren A.B.", "Ana van Doren"), (None, None), ("", "")], "m string, a string")
    assert [tuple(r) for r in df.select(market_signature(F.col("m")), archive_signature(F.col("a"))).collect()] == [("plioltrek", "trolpliek"), ("van doren", "van doren"), (None, None), ("", "")]
