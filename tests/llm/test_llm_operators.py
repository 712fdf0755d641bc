"""The training-data operators against brute force, public libraries and planted cases."""

import base64
import datetime as dt
import math
import pathlib
import random
import string

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deuceframe.llm import bktree, bpe, history, matching, packing, ranking, smallworld, truncation
from deuceframe.llm.aliases import map_values
from deuceframe.session import Scratch

RANKS = bpe.read_ranks()


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_corpus_encoding(spark, tiktoken_encoding):
    texts = [None, "", " ", "\n\n  \t", "it's we'll", "a" * 3000, "ab" * 2000, "né à Šibenik 🎾🎾", "<|endoftext|>", "的" * 700, "x" * 5 + " " * 600 + "y", "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, F.col("doc_id"), F.col("text"), RANKS).collect()}
    vocabulary = bpe.build_vocabulary(RANKS)
    for i, t in enumerate(texts):
        assert got[i] == (tiktoken_encoding.encode_ordinary(t) if t else [])
        assert b"".join(vocabulary.tokens[k] for k in got[i]).decode() == (t or "")
    counts = {r.doc_id: r.n_tokens for r in bpe.encode_corpus(df, F.col("doc_id"), F.col("text"), RANKS, counts_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode_corpus(df.where("false"), F.col("doc_id"), F.col("text"), RANKS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab cdeINGthe.,'\né一", max_size=400))
def test_encoding_equals_the_library(text):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.Encoder(RANKS).encode([text])[0].tolist() == encoding.encode_ordinary(text)


def _placed(df, limits, **k):
    return packing.fill_containers(df, limits, **k).toPandas()


def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = [None, 0, 2048, 2049, 10_000, *rng.integers(1, 600, 3000).tolist()]
    df = spark.createDataFrame([(i, None if s is None else int(s), "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    out = _placed(df, packing.Limits(2048, 64, 2048), group_items=700)
    assert out.groupby("container").n_tokens.sum().max() <= 2048 and out.groupby("container").size().max() <= 64
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == {i: s for i, s in enumerate(sizes) if s}
    divided = out.groupby("doc_id").size()
    assert all((divided[i] > 1) == (sizes[i] > 2048) for i in divided.index)
    pieces = out[out.doc_id == 4].sort_values("piece")
    assert pieces.token_from.tolist() == [0, 2048, 4096, 6144, 8192] and out.n_tokens.sum() / (out.container.nunique() * 2048) > 0.99
    assert len(_placed(df.where("false"), packing.Limits())) == 0
    loss = spark.createDataFrame([(i, 100, 90) for i in range(30)], "doc_id long, n_tokens long, loss_tokens long")
    assert _placed(loss, packing.Limits(1000, 128, 200)).groupby("container").size().max() == 2
    same = spark.createDataFrame([(7, 5)] * 1000, "doc_id long, n_tokens long")
    assert len(_placed(same, packing.Limits(), group_items=100)) == 1000


def test_items_that_fill_no_bin_stay_in_many_tasks(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    plain = packing.pack

    def counted(sizes, limits):
        assert len(sizes) < 200
        seen.add(1)
        return plain(sizes, limits)

    monkeypatch.setattr(packing, "pack", counted)
    df = spark.createDataFrame([(i, 1100 if i % 10 else 30) for i in range(3000)], "doc_id long, n_tokens long")
    out = _placed(df, packing.Limits(), group_items=100)
    assert len(out) == 3000 and out.container.nunique() == 2700 and out.groupby("container").n_tokens.sum().max() <= 2048


def _plain_distance(a, b):
    seen, d, far = {}, {}, len(a) + len(b)
    d[-1, -1] = far
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m, cost = seen.get(b[j - 1], 0), last, 1
            if a[i - 1] == b[j - 1]:
                cost, last = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def test_bk_tree_finds_all(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(150)]
    asked = [*words[:40], "x" * 5000, "", "ab"]
    want = {(a, w, _plain_distance(a, w)) for a in set(asked) if len(a) < 100 for w in set(words) if _plain_distance(a, w) <= 2}
    values = spark.createDataFrame([(a, 2) for a in asked] + [(None, 2), ("abc", None)], "text string, max_distance int")
    reference = spark.createDataFrame([(w,) for w in words] + [(None,)], "entry string")
    for shard in (1000, 40):
        got = bktree.within_distance(values, reference, shard)
        assert {(r.text, r.entry, r.distance) for r in got.collect()} == want
    assert bktree.within_distance(values, reference.where("false")).count() == 0


def test_alias_mapping(spark):
    catalogue = spark.createDataFrame(
        [(1, "rovinje", "Rovinje Open", None, "Rovinje"), (2, "rovinje 2", "Copa Marlantis", "Torneo Rovinje", "Rovinje"), (3, "quelborg", "Quelborg Ladies Classic", None, "Quelborg")] + [(10 + i, f"zz{i}stadtqx", f"Zz{i}stadtqx {w}", None, f"Zz{i}stadtqx") for i in range(10) for w in ("Open", "Cup") if (i % 2) == (w == "Cup")],
        "event_id long, mirror_tourney_name_norm string, event_title string, event_past_title string, event_city string",
    ).unionByName(spark.createDataFrame([(50, "rio", "Rio Open", None, "Rio"), (51, "pau", "Pau Ladies Cup", None, "Pau")], "event_id long, mirror_tourney_name_norm string, event_title string, event_past_title string, event_city string"))
    rows = spark.createDataFrame(
        [(1, "ROVINJE", "Rovniej Open"), (2, None, "copa marlanits presented by X"), (3, "Rovinje 2", None), (4, "Qeulborg", "Foo Challenge"), (5, "Nowhereville", "Nowhereville Open"), (6, None, None), (7, "", "|/ "), (8, "x" * 50_000, "Quelborg"), (9, "Rio", None), (10, "PAU", "Cup"), (11, "Rioo", "Open")],
        "alias_id long, a string, b string",
    )
    got = {r.alias_id: r.event_id for r in map_values(rows, "alias_id", ["a", "b"], catalogue).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: None, 6: None, 7: None, 8: 3, 9: 50, 10: 51, 11: None}
    assert {r.event_id for r in map_values(rows, "alias_id", ["a", "b"], catalogue.where("false")).collect()} == {None}


def test_ranking(spark):
    rng = random.Random(4)
    skill = {i: i / 2 for i in range(12)}
    games = []
    for _ in range(900):
        a, b = rng.sample(range(12), 2)
        games.append(("all", a, b) if rng.random() < 1 / (1 + np.exp(skill[b] - skill[a])) else ("all", b, a))
    games += [("all", 20, 0), ("all", 1, 21), ("all", 30, 31), ("all", 31, 32), ("all", 32, 30), ("all", 5, 5), ("all", None, 3), (None, 1, 2)]
    df = spark.createDataFrame(games, "board string, winner long, loser long")
    out = ranking.gaussian_ranking(df).toPandas().set_index("item")
    assert set(out.index[~out.comparable]) == {20, 21, 30, 31, 32}
    best = out[out.comparable].sort_values("place")
    assert best.place.tolist() == list(range(1, 13)) and best.strength.is_monotonic_decreasing
    assert np.corrcoef([skill[i] for i in best.index], best["mean"])[0, 1] > 0.95
    ties = ranking.gaussian_ranking(spark.createDataFrame([("x", 1, 2), ("x", 2, 1), ("x", 3, 4), ("x", 4, 3)], df.schema)).toPandas()
    assert set(ties.item[ties.comparable]) == {1, 2}
    chain = ranking.gaussian_ranking(spark.createDataFrame([("x", i, i + 1) for i in range(6)], df.schema)).toPandas()
    assert chain.item[chain.comparable].tolist() == [0]
    assert ranking.gaussian_ranking(df.where("false")).count() == 0


def _sequential_inference(games, skill, rounds=200):
    """Expectation propagation, one factor for each outcome, one after another until nothing moves."""
    pdf, cdf = (lambda t: np.exp(-t * t / 2) / np.sqrt(2 * np.pi)), (lambda t: 0.5 * (1 + math.erf(t / np.sqrt(2))))
    pi, tau = {}, {}
    for i in {x for g in games for x in g}:
        pi[i], tau[i] = 1 / skill.deviation**2, skill.mean / skill.deviation**2
    sent = {(k, s): (0.0, 0.0) for k in range(len(games)) for s in (0, 1)}
    for _ in range(rounds):
        for k, g in enumerate(games):
            p, t = zip(*((pi[x] - sent[k, s][0], tau[x] - sent[k, s][1]) for s, x in enumerate(g)), strict=True)
            (mw, vw), (ml, vl) = ((t[s] / p[s], 1 / p[s]) for s in (0, 1))
            c = np.sqrt(vw + vl + 2 * skill.performance**2)
            d = (mw - ml) / c
            v = pdf(d) / cdf(d)
            w = v * (v + d)
            for s, (m, q, sign) in enumerate(((mw, vw, 1), (ml, vl, -1))):
                mean, var = m + sign * q / c * v, q * (1 - q / c**2 * w)
                new = (1 / var - p[s], mean / var - t[s])
                pi[g[s]], tau[g[s]] = p[s] + new[0], t[s] + new[1]
                sent[k, s] = new
    return {i: (tau[i] / pi[i], 1 / np.sqrt(pi[i])) for i in pi}


def test_strengths_against_sequential_inference(spark):
    rng = random.Random(12)
    games = []
    for _ in range(150):
        a, b = rng.sample(range(15), 2)
        games.append((a, b) if rng.random() < 1 / (1 + np.exp((b - a) / 4)) else (b, a))
    skill = ranking.Skill(tolerance=1e-4)
    want = _sequential_inference(games, skill)
    out = ranking.gaussian_ranking(spark.createDataFrame([("x", *g) for g in games], "board string, winner long, loser long"), skill).toPandas().set_index("item")
    assert out.settled.all() and set(out.index) == set(want)
    assert max(abs(out["mean"][i] - m) for i, (m, _) in want.items()) < 0.05 and max(abs(out.deviation[i] - d) for i, (_, d) in want.items()) < 0.02
    few = ranking.gaussian_ranking(spark.createDataFrame([("x", *g) for g in games], "board string, winner long, loser long"), ranking.Skill(tolerance=1e-9, sweeps=2)).toPandas()
    assert not few.settled.all()  # what still moves says so


def test_graph_recall_against_exhaustive_search():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 10)).astype(np.float32)
    q = v[:300] + rng.normal(size=(300, 10)).astype(np.float32) * 0.02
    radius = np.full(300, 1.6)
    graph = smallworld.Graph(v)
    assert graph.tune(q, radius) >= smallworld.RECALL
    row, node = graph.within(q, radius)
    got = set(zip(row.tolist(), graph.order[node].tolist(), strict=True))
    near = np.sqrt(((q[:, None] - v[None]) ** 2).sum(2))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(near <= 1.6)), strict=True))
    assert len(got & want) / len(want) >= 0.99 and len(want) > 600
    again = smallworld.Graph.stored(graph.vectors, graph.links.astype(np.int16), graph.beam)
    assert all((x == y).all() for x, y in zip(again.within(q, radius), (row, node), strict=True))
    for n in (0, 1, 5, 129):
        assert len(smallworld.Graph(v[:n]).within(q, radius)[0]) >= min(n, 1)
    same = smallworld.Graph(np.zeros((500, 10), np.float32))
    assert len(same.within(np.zeros((2, 10), np.float32), np.ones(2))[0]) == 1000  # more than any beam holds


def _record(rec_id, batch, tid="2022-0007", rnd="R16", a=200001, b=200002, day=dt.date(2022, 5, 6), points=(60, 70), season=2022):
    p, q = points or (None, None)
    return (rec_id, batch, tid, season, rnd, day, a, b, p, p and p // 2, q, q and q // 3)


RECORD = "rec_id long, batch_no int, tourney_id string, source_season int, round string, match_date date, player_a long, player_b long, a_serve_points int, a_first_in int, b_serve_points int, b_first_in int"


def test_repeated_deliveries(spark):
    d = dt.timedelta
    day = dt.date(2022, 5, 6)
    league = lambda i, batch, when, **k: _record(i, batch, "2022-L900", "RR", day=day + d(when), **k)
    rows = [
        _record(1, 0), _record(2, 0), _record(3, 0, a=200003, b=200004, points=None), league(4, 0, 0), league(5, 0, 7), _record(6, 0, rnd="QF"),
        _record(7, 1, tid="0007/2022", rnd="Round of 16", a=200002, b=200001, points=(70, 60)), _record(8, 1, tid="202200000007", rnd="1/8", a=None),
        _record(9, 1, tid="22-0007", a=7200003, b=200004, points=None), league(10, 1, 2), league(11, 1, 14), league(12, 2, 14, a=None),
        _record(13, 2, tid="2022-0008"), _record(14, 2, tid="2022-8", rnd="r16"), _record(15, 2, a=None, b=None), _record(16, 3, tid=None, rnd=None), _record(17, 3, day=None),
        _record(18, 3, a=20000404, b=200003, points=None),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("n", F.lit("clash"))
    got = {r.rec_id_repeat: r.rec_id_first for r in history.repeated_deliveries(df).collect()}
    assert got == {7: 1, 8: 1, 9: 3, 10: 4, 12: 11, 14: 13, 16: 1, 17: 1, 18: 3}
    assert history.repeated_deliveries(df.where("false")).count() == 0
    copies = spark.createDataFrame([_record(i, 0 if i < 50 else 1) for i in range(1, 400)], RECORD)
    got = history.repeated_deliveries(copies).toPandas()
    assert len(got) == 350 and set(got.rec_id_first) == {1}


def test_stored_index_takes_deliveries_and_compacts(spark, monkeypatch, tmp_path):
    rng = random.Random(7)
    day = dt.date(2022, 5, 2)
    rows = [_record(i, 0, a=200000 + i % 40, b=300000 + i % 37, tid=f"2022-{1 + i % 5}", rnd=["R16", "RR", "QF"][i % 3], day=day + dt.timedelta(i % 80), points=(40 + i % 50, 60)) for i in range(1, 400)]
    for i in range(400, 700):
        old = rng.choice(rows[:399] if i < 500 else rows)
        a, b = (old[6], old[7]) if i % 7 else (old[6], None)
        tid = old[2] if i % 11 else None
        rows.append((i, 1 + (i - 400) // 40, tid, *old[3:6], a, b, *old[8:]) if i % 3 else _record(i, 1 + (i - 400) // 40, a=210000 + i, b=310000 + i % 90, tid="2022-9"))
    df = spark.createDataFrame(rows, RECORD).cache()
    whole = {r.rec_id_repeat: r.rec_id_first for r in history.repeated_deliveries(df).collect()}
    monkeypatch.setattr(history, "COMPACT_AFTER", 2)
    monkeypatch.setattr(history, "SEGMENT_ROWS", 60)
    root, got = f"file://{tmp_path}/index", {}
    history.MatchIndex(spark, root).add(df.where("batch_no = 0"))
    for batch in range(1, 9):
        index = history.MatchIndex(spark, root)  # what was stored is all it knows
        got |= {r.rec_id_repeat: r.rec_id_first for r in index.add(df.where(f"batch_no = {batch}")).collect()}
        assert len(index.live) <= history.COMPACT_AFTER + 2
    assert len(whole) > 150 and got == whole


def test_recall_over_all_true_pairs_by_days_apart(spark):
    rng = np.random.default_rng(11)
    n, day, d = 2200, dt.date(2022, 1, 3), dt.timedelta
    held = [_record(i, 0, a=int(rng.integers(200000, 200150)), b=int(rng.integers(300000, 300150)), tid=f"2022-{i % 6}", rnd=["R16", "RR"][i % 2], day=day + d(int(rng.integers(0, 200))), points=None) for i in range(1, n)]
    asked = [(n + k, 1, *h[2:5], h[5] + d(k // 2 % (22 if h[4] == "R16" else 4)), *h[6:]) for k, h in enumerate(held)]
    got = {r.rec_id_repeat: r.rec_id_first for r in history.repeated_deliveries(spark.createDataFrame(held + asked, RECORD)).collect()}
    hit = np.array([n + k in got and got[n + k] <= held[k][0] for k in range(len(held))])
    apart = np.arange(len(held)) // 2 % 22
    single = np.array([h[4] == "R16" for h in held])
    assert hit.mean() > 0.995 and all(hit[single & (apart == k)].mean() >= 0.95 for k in range(22))


def test_repeats_weeks_apart_cross_date_slices(spark, monkeypatch):
    day = dt.date(2022, 3, 1)
    rows = [_record(i, 0, a=200000 + i, b=300000 + i, day=day + dt.timedelta(i), points=None) for i in range(1, 101)]
    rows += [_record(100 + i, 1, a=200000 + i, b=300000 + i, day=day + dt.timedelta(i + (21 if i % 2 else -13)), points=None) for i in range(1, 101)]
    df = spark.createDataFrame(rows, RECORD)
    want = {100 + i: i for i in range(1, 101)}
    monkeypatch.setattr(history, "SEGMENT_ROWS", 20)
    assert {r.rec_id_repeat: r.rec_id_first for r in history.repeated_deliveries(df).collect()} == want


def _dense_league(n=4000, a_day=530):
    """Rows of one tourney, round robin, many a day, between players who often play."""
    rng = np.random.default_rng(5)
    lo, hi = rng.integers(1, 400, n), rng.integers(400, 800, n)
    return {"rec_id": np.arange(n), "batch_no": np.zeros(n, int), "tourney": np.full(n, 5), "round": np.full(n, 7),
            "day": 19000 + np.arange(n) // a_day, "lo": lo, "hi": hi, **{c: rng.integers(20, 90, n) for c in history.COUNTS}}


def test_rows_without_a_player_meet_all_rows_of_their_player(spark):
    rows = _dense_league(1500, 200)
    n = len(rows["rec_id"])
    lacking = rows | {"hi": np.full(n, -1)}
    off = {"rec_id": rows["rec_id"] + n, "day": rows["day"] + np.arange(n) % 4 - 1, "batch_no": np.ones(n, int)}
    other = lacking | {"lo": rows["hi"]}  # names only the other player, the counts in the same places
    for held, asked in ((rows, lacking | off), (lacking, rows | off), (lacking, other | off)):
        every = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        equal = history.same_match(history._take(asked, every[0]), history._take(held, every[1]))
        want = np.full(n, n)
        np.minimum.at(want, every[0][equal], every[1][equal])
        none = lambda x, least: None if x < least else int(x)
        table = [
            (int(r["rec_id"][i]) + 1, int(r["batch_no"][i]), "2022-L", 2022, "RR", dt.date(1970, 1, 1) + dt.timedelta(int(r["day"][i])), none(r["lo"][i], 0), none(r["hi"][i], 0), *[int(r[c][i]) for c in history.COUNTS])
            for r in (held, asked) for i in range(n)
        ]
        got = {r.rec_id_repeat - n - 1: r.rec_id_first - 1 for r in history.repeated_deliveries(spark.createDataFrame(table, RECORD)).collect()}
        found = want < n
        assert found.mean() > 0.7 and np.mean([got.get(i, n) <= want[i] for i in np.flatnonzero(found)]) > 0.98


def test_matching(spark):
    rng = random.Random(6)
    syllables = ["bra", "kel", "vin", "tos", "mur", "lai", "zon", "pet", "qui", "hal", "dre", "fos"]
    name = lambda: "".join(rng.choice(syllables) for _ in range(3)).capitalize()
    people = [(f"{name()[:5]}", name()) for _ in range(120)]
    market, archive, truth = [], [], {}
    for i in range(400):
        (f1, s1), (f2, s2) = rng.sample(people, 2)
        city, monday = rng.choice(["Osterby", "Kvalheim", "Montelga", "Brennock"]), dt.date(2022, 1, 3) + dt.timedelta(7 * rng.randrange(40))
        sets = rng.sample([(6, 1), (6, 2), (6, 3), (6, 4), (7, 5)], 2)
        archive.append((f"k{i}", f"{f1} {s1}", f"{f2} {s2}", f"{city} W25", monday, 2022, "R16", 32, "Clay", " ".join(f"{a}-{b}" for a, b in sets)))
        if i % 4:
            typo = s1[:3] + s1[4:] if i % 5 == 0 else s1
            market.append((i, f"{typo} {f1[0]}.", f"{s2} {f2[0]}.", None if i % 7 == 0 else city, "Sponsor Open", None if i % 11 == 0 else monday + dt.timedelta(rng.randrange(6)), 2022, "2nd Round", "Clay", *sets[0], *sets[1], None, None))
            truth[i] = f"k{i}"
        else:
            a, b = rng.sample(people, 2)
            market.append((i, f"{a[1]} {a[0][0]}.", f"{b[1]} {b[0][0]}.", city, "Sponsor Open", monday, 2022, "2nd Round", "Clay", *sets[0], *sets[1], None, None))
    market.append((1000, None, "", None, None, None, None, None, None, *[None] * 6))
    m = spark.createDataFrame(market, "id long, winner string, loser string, event string, title string, day date, season int, round string, surface string, w1 int, l1 int, w2 int, l2 int, w3 int, l3 int")
    a = spark.createDataFrame(archive + [("none", None, None, None, None, None, None, None, None, None)], "id string, winner string, loser string, event string, day date, season int, round string, draw int, surface string, score string")
    judged = spark.createDataFrame([(i, f"k{i}", True) for i in range(1, 40) if i % 4] + [(i, f"k{i + 1}", False) for i in range(1, 40)], "market_id long, archive_id string, accepted boolean")
    got = {r.market_id: r.archive_id for r in matching.match_sources(m, a, judged).collect()}
    right = sum(got.get(i) == k for i, k in truth.items())
    assert right / len(truth) > 0.97 and sum(i not in truth for i in got) <= 5  # those agree in all but the names
    assert matching.match_sources(m.where("false"), a, judged).count() == 0


def test_matching_stores_rows_not_keys(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    people = [(name(), name()) for _ in range(800)]
    market, archive = [], []
    for i in range(6000):
        (f1, s1), (f2, s2) = rng.sample(people, 2)
        city, day, sets = name(), dt.date(2022, 1, 3) + dt.timedelta(7 * rng.randrange(100)), rng.sample([(6, 1), (6, 2), (6, 3), (7, 5)], 2)
        archive.append((f"k{i}", f"{f1} {s1}", f"{f2} {s2}", city, None if i % 97 == 0 else day, day.year, "R16", 32, "Clay", " ".join(f"{a}-{b}" for a, b in sets)))
        market.append((i, f"{s1} {f1[0]}.", f"{s2} {f2[0]}.", city, "Open", None if i % 89 == 0 else day + dt.timedelta(rng.randrange(6)), day.year, "2nd Round", "Clay", *sets[0], *sets[1], None, None))
    frames = {
        "m": spark.createDataFrame(market, "id long, winner string, loser string, event string, title string, day date, season int, round string, surface string, w1 int, l1 int, w2 int, l2 int, w3 int, l3 int"),
        "a": spark.createDataFrame(archive, "id string, winner string, loser string, event string, day date, season int, round string, draw int, surface string, score string"),
        "j": spark.createDataFrame([(i, f"k{i + i % 2}", i % 2 == 0) for i in range(100)], "market_id long, archive_id string, accepted boolean"),
    }
    for n, df in frames.items():
        df.write.parquet(str(tmp_path / n))
    m, a, judged = (spark.read.parquet(str(tmp_path / n)) for n in frames)
    size = lambda folder: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    stored = []

    def keep_only(scratch, *names):
        stored.append(size(pathlib.Path(scratch.root.removeprefix("file://").removeprefix("file:"))))

    monkeypatch.setattr(Scratch, "keep_only", keep_only)
    got = {r.market_id: r.archive_id for r in matching.match_sources(m, a, judged).collect()}
    assert sum(got.get(i) == f"k{i}" for i in range(6000)) > 5900
    assert stored[0] < 4 * size(tmp_path)
    found = [tuple(r) for r in matching.candidates(m, a, Scratch(spark, "test")).collect()]
    assert len(found) == len(set(found)) and {(i, f"k{i}") for i in range(6000)} <= set(found)


def test_large_keys_keep_undated_rows(spark, monkeypatch):
    sets = [(6, 1), (6, 2), (6, 3), (6, 4)]
    day = dt.date(2022, 1, 3)
    market = [(i, "Kelvin B.", "Tosmur Q.", None, None, day if i % 3 == 0 else None, 2022, None, None, *(sets[i % 4] if i % 2 else (None, None)), 6, 0, None, None) for i in range(12)]
    archive = [(f"k{i}", "Bra Kelvin", "Qui Tosmur", None, day + dt.timedelta(7 * i), 2022, None, None, None, "6-4 7-5") for i in range(12)]
    m = spark.createDataFrame(market, "id long, winner string, loser string, event string, title string, day date, season int, round string, surface string, w1 int, l1 int, w2 int, l2 int, w3 int, l3 int")
    a = spark.createDataFrame(archive, "id string, winner string, loser string, event string, day date, season int, round string, draw int, surface string, score string")
    found = lambda: sorted(map(tuple, matching.candidates(m, a, Scratch(spark, "test")).collect()))
    whole = found()
    assert {(i, f"k{j}") for i in range(12) if i % 3 for j in range(12)} <= set(whole)
    monkeypatch.setattr(matching, "BLOCK_PAIRS", 10)
    assert found() == whole


def test_truncation(spark):
    rng = random.Random(8)
    subjects = [w.capitalize() for w in ("the umpire", "a player", "the desk", "our correspondent", "the referee", "nobody here")]
    verbs = ["waited for the rain to stop", "measured the clay twice", "entered the score by hand", "left before the final", "played on the second court"]
    sentence = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} on {rng.choice(['Monday', 'Friday', 'Sunday'])}."
    docs, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence() for _ in range(rng.randint(1, 5)))
        if i % 10 == 0:
            text += f"\n— {rng.choice(string.ascii_uppercase)}{rng.choice(['orvik', 'andel', 'umo'])} desk"
        elif i % 15 == 1:
            at = rng.randint(12, len(text) - 3)
            while text[at - 1] in ". " or text[at] in ". ":
                at -= 1
            text, _ = text[:at] + ("…" if i % 2 else ""), cut.add(i)
        docs.append((i, text, "en" if i % 3 else "EN", "src", i))
    docs += [(5000, None, "en", "src", 0), (5001, "  ", None, "src", 0), (5002, docs[1][1], None, None, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n int")
    out = truncation.truncated(df).toPandas()
    found = set(out.doc_id[out.is_cut])
    assert not {5000, 5001} & set(out.doc_id) and 5002 in found
    found -= {5002}
    assert len(found & cut) / len(cut) > 0.85 and len(found - cut) <= 5
    report = truncation.truncation_report(truncation.truncated(df)).toPandas().set_index("source")
    assert report.texts.sum() == 1501
    assert truncation.truncated(df.where("false")).count() == 0


def test_marks_of_transport_behind_many_cuts(spark):
    """Marks behind cuts of many texts are no authors' marks, though the last letter and the mark recur; a phrase's own mark is."""
    rng = random.Random(3)
    words = ["court", "umpire", "rain", "clay", "serve", "final", "card", "tunnel", "ball", "crowd", "feed", "draw"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(5, 9))).capitalize() + "."
    docs, cut, authors = [], set(), set()
    for i in range(3000):
        text = " ".join(sentence() for _ in range(rng.randint(2, 5)))
        if i % 12 == 0:
            at = rng.randint(30, len(text) - 3)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at -= 1
            text, _ = text[:at] + " [more]", cut.add(i)
        elif i % 12 == 1:
            text, _ = text + " And nobody came...", authors.add(i)
        docs.append((i, text, "en", "src"))
    docs += [(4000 + k, docs[1][1], "en", "src") for k in range(40)]  # copies count with copies
    out = truncation.truncated(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).toPandas()
    found = set(out.doc_id[out.is_cut])
    assert len(found & cut) / len(cut) > 0.95
    assert not found & authors and len(found - cut) <= 5 and not found & set(range(4000, 4040))


def test_truncation_filter_in_passes_and_valleys(spark, monkeypatch):
    docs = [(i, f"the report of day {i % 7} ends here" + ("." if i % 9 else ""), "en", "s") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    one = {r.doc_id: round(r.log_odds, 6) for r in truncation.truncated(df).collect()}
    monkeypatch.setattr(truncation, "FILTER_BITS", 9)
    assert {r.doc_id: round(r.log_odds, 6) for r in truncation.truncated(df).collect()} == one
    heights = np.zeros(180)
    heights[[20, 21, 22]], heights[[60, 61, 62]], heights[100] = (5, 40, 5), (50, 400, 50), 300
    assert 25 < truncation.valley(heights) <= 59
    heights[:30] = 0
    heights[5] = 1
    assert truncation.valley(heights) is None and truncation.valley(np.zeros(180)) is None


def test_context_hashes_do_not_depend_on_neighbours():
    one = {j: h[last[-1]] for j, h, last in truncation.contexts(["short.", "and then the rain came."])}
    two = {j: h[last[0]] for j, h, last in truncation.contexts(["and then the rain came."])}
    assert one == two
    assert pd.Series(list(one)).is_unique
