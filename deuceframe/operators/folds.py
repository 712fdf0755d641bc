"""Ordered state folds: ratings whose update needs both sides' current values.

The state of a population is one fold, serial in date; work is spread over fold groups (tours, settings, candidates). A
group's rows arrive sorted and in batches, and what is held is the state and the rows of the last days, never the whole
group. Rows of a day are read with the state two days before it.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LAG_DAYS = 2
SURFACES = ("Hard", "Clay", "Grass", "Carpet")
INITIAL, SCALE = 1500.0, 400.0
#: Steps of the all-tier ratings by tier, and where a player starts that is first seen in it (fixed values).
TIER_WEIGHT = {"tour": 1.0, "qualifying": 0.8, "challenger": 0.8, "futures": 0.6}
TIER_START = {"tour": 1500.0, "qualifying": 1400.0, "challenger": 1400.0, "futures": 1300.0}
#: Greatest deviation of a rating, and its growth a day: from 50 to the greatest in three years (fixed values).
RD_MAX, RD_GROWTH = 350.0, (350.0**2 - 50.0**2) / (3 * 365.0)
#: Rates of the point model's skills and of its intercept, and the share of serve points won it starts from (fixed values).
SKILL_RATE, INTERCEPT_RATE, SERVE_SHARE = 0.002, 0.0001, 0.62


class Rows:
    """Some rows as arrays, one attribute a column; much lighter than a frame for the few rows of a day."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.day)

    def __getitem__(self, at) -> Rows:
        return Rows({k: v[at] for k, v in self.columns.items()})

    def tuples(self) -> Iterator:
        row = namedtuple("row", self.columns)
        return map(row._make, zip(*[v.tolist() for v in self.columns.values()], strict=True))

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Rows:
        return cls({c: pdf[c].to_numpy() for c in pdf.columns})

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return parts[0] if len(parts) == 1 else cls({k: np.concatenate([p.columns[k] for p in parts]) for k in parts[0].columns})


class Fold:
    """A population's state: `read` gives a day's rows their values, `release` takes a day's rows into the state."""

    def __init__(self) -> None:
        self.pending: list[Rows] = []

    def read(self, rows: Rows) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def release(self, rows: Rows) -> None:
        raise NotImplementedError

    def feed(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """The next rows, in order of day; their values."""
        rows, out = Rows.of(pdf), []
        days, starts = np.unique(rows.day, return_index=True)
        for day, start, stop in zip(days.tolist(), starts, [*starts[1:], len(pdf)], strict=True):
            while self.pending and self.pending[0].day[0] <= day - LAG_DAYS:
                first, batch = self.pending[0].day[0], []
                while self.pending and self.pending[0].day[0] == first:
                    batch.append(self.pending.pop(0))
                self.release(Rows.joined(batch))
            part = rows[start:stop]
            out.append(self.read(part))
            self.pending.append(part)
        return pd.DataFrame({"match_id": rows.match_id} | {k: np.concatenate([o[k] for o in out]) for k in out[0]})


def ordered_fold(rows: DataFrame, group: list[str], order: list[str], start: Callable[[tuple], Fold], schema: str) -> DataFrame:
    """The values of the fold `start(key)` over each group's rows, sorted by `order` (its first column is `day`).

    One task a group, in which rows stream through the fold; `group` should hold all that is independent. Rows with a null
    day come first and are left out.
    """
    keys = [*group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = None, None
        for pdf in batches:
            pdf = pdf[pdf.day.notna()]
            # the groups of a task follow one another
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                if fold is None or key != at:
                    at, fold = key, start(key)
                yield fold.feed(part)

    wanted = rows.repartition(*group).sortWithinPartitions(*group, *order)
    return wanted.mapInPandas(run, schema)


def expected(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + 10.0 ** ((b - a) / SCALE))


def _outcomes(values: np.ndarray) -> np.ndarray:
    """1 and 0 for true and false, nan for what is missing; numbers stay."""
    return values.astype(float) if values.dtype.kind in "fib" else np.array([np.nan if v is None or v != v else float(v) for v in values.tolist()])


def _known(surface: np.ndarray) -> np.ndarray:
    return np.array([s in SURFACES for s in surface.tolist()], bool)


class PooledElo(Fold):
    """Overall and surface ratings, one frozen batch for each source day; both probabilities are averaged.

    column: what a row adds to the state, an outcome (boolean) or the price of side A as a pseudo-outcome; rows without it
    add nothing. weights: a factor of the steps for each tier; offset: what is added to the start of players whose first
    released row is not of the tour. Rows on an unknown surface move the overall rating only and are read by it.
    """

    def __init__(self, k: float = 32.0, column: str = "a_won", weights: dict[str, float] | None = None, offset: float = 0.0):
        super().__init__()
        self.k, self.column, self.weights, self.offset = k, column, weights, offset
        self.overall: dict = {}
        self.surface: dict = {}
        self.start: dict = {}
        self.seen: dict = {}

    def _of(self, ratings: dict, keys: list) -> np.ndarray:
        base = self.start.get
        return np.array([ratings[k] if k in ratings else base(k[0] if isinstance(k, tuple) else k, INITIAL) for k in keys], float)

    def release(self, rows: Rows) -> None:
        y = _outcomes(rows.columns[self.column])
        rows, y = rows[~np.isnan(y)], y[~np.isnan(y)]
        a, b = rows.player_a.tolist(), rows.player_b.tolist()
        k = np.full(len(rows), self.k)
        if self.weights is not None:
            k *= np.array([self.weights[t] for t in rows.tier.tolist()], float)
            for x, z, tier in zip(a, b, rows.tier.tolist(), strict=True):
                for player in (x, z):
                    self.start.setdefault(player, INITIAL if tier == "tour" else INITIAL + self.offset)
        on = np.flatnonzero(_known(rows.surface))
        surface = rows.surface.tolist()
        sa, sb = [(a[i], surface[i]) for i in on], [(b[i], surface[i]) for i in on]
        for ratings, x, z, yy, kk in ((self.overall, a, b, y, k), (self.surface, sa, sb, y[on], k[on])):
            step = kk * (yy - expected(self._of(ratings, x), self._of(ratings, z)))
            moved: dict = {}
            for i, j, d in zip(x, z, step.tolist(), strict=True):
                moved[i], moved[j] = moved.get(i, 0.0) + d, moved.get(j, 0.0) - d
            for key, d in moved.items():
                ratings[key] = float(self._of(ratings, [key])[0]) + d
            for key in (*x, *z):
                self.seen[key] = self.seen.get(key, 0) + 1

    def read(self, rows: Rows) -> dict[str, np.ndarray]:
        a, b, s = rows.player_a.tolist(), rows.player_b.tolist(), rows.surface.tolist()
        ra, rb = self._of(self.overall, a), self._of(self.overall, b)
        on = _known(rows.surface)
        ka, kb = list(zip(a, s, strict=True)), list(zip(b, s, strict=True))
        whole = expected(ra, rb)
        part = np.where(on, expected(self._of(self.surface, ka), self._of(self.surface, kb)), whole)
        absent = lambda keys: np.array([int(self.seen.get(k, 0) == 0) for k in keys])
        return {"p_overall": whole, "p_surface": part, "p": (whole + part) / 2, "absent_a": absent(a), "absent_b": absent(b), "absent_surface_a": absent(ka), "absent_surface_b": absent(kb)}


ELO_SCHEMA = "match_id string, p_overall double, p_surface double, p double, absent_a int, absent_b int, absent_surface_a int, absent_surface_b int"


def decaying_k(n: float) -> float:
    return 250.0 / (n + 5.0) ** 0.4


class RatingSuite(Fold):
    """Four rating services advanced together: fixed K pooled with surface, decaying K with a factor for majors, decaying
    K weighted by the winner's share of games, and a weighted sum of overall and surface ratings with decaying K."""

    def __init__(self, majors: tuple[str, ...] = ("S",)):
        super().__init__()
        self.majors = majors
        self.r: list[dict] = [{} for _ in range(6)]  # fixed, fixed by surface, decaying, by games, mixed, mixed by surface
        self.n: dict = {}

    def release(self, rows: Rows) -> None:
        steps: list[dict] = [{} for _ in range(6)]
        met: list = []
        columns = (rows.player_a, rows.player_b, rows.surface, _outcomes(rows.a_won), rows.tourney_level, rows.game_share)
        for a, b, s, y, level, games in zip(*[c.tolist() for c in columns], strict=True):
            if y != y:
                continue
            games = 1.0 if games is None or games != games else games
            keys = [(a, b)] * 6
            known = s in SURFACES
            keys[1] = keys[5] = ((a, s), (b, s))
            factor = 1.1 if level in self.majors else 1.0
            for i, (x, z) in enumerate(keys):
                if i in (1, 5) and not known:
                    continue
                ratings = self.r[i]
                e = 1.0 / (1.0 + 10.0 ** ((ratings.get(z, INITIAL) - ratings.get(x, INITIAL)) / SCALE))
                step = y - e
                kx, kz = (32.0, 32.0) if i < 2 else (decaying_k(self.n.get(x, 0)), decaying_k(self.n.get(z, 0)))
                weight = factor if i == 2 else games if i == 3 else 1.0
                steps[i][x] = steps[i].get(x, 0.0) + kx * step * weight
                steps[i][z] = steps[i].get(z, 0.0) - kz * step * weight
            met += [a, b, *([(a, s), (b, s)] if known else [])]
        for ratings, moved in zip(self.r, steps, strict=True):
            for key, d in moved.items():
                ratings[key] = ratings.get(key, INITIAL) + d
        for key in met:
            self.n[key] = self.n.get(key, 0) + 1

    def read(self, rows: Rows) -> dict[str, np.ndarray]:
        get = lambda i, keys: np.array([self.r[i].get(k, INITIAL) for k in keys], float)
        a, b, s = rows.player_a.tolist(), rows.player_b.tolist(), rows.surface.tolist()
        ka, kb = list(zip(a, s, strict=True)), list(zip(b, s, strict=True))
        known = _known(rows.surface)
        whole = expected(get(0, a), get(0, b))
        mix = lambda keys, on: np.where(known, 0.71 * get(4, keys) + 0.29 * get(5, on), get(4, keys))
        return {
            "fixed_k": np.where(known, (whole + expected(get(1, ka), get(1, kb))) / 2, whole),
            "decaying_k": expected(get(2, a), get(2, b)),
            "games_weighted": expected(get(3, a), get(3, b)),
            "surface_mix": expected(mix(a, ka), mix(b, kb)),
        }


@dataclass
class Rated:
    """A player of the all-tier ratings, who starts by the tier and day of the row that first reads it."""

    elo: float
    start: float
    day: int
    tour: float = INITIAL
    rd: float = RD_MAX
    surface: dict = field(default_factory=dict)
    serve: float = 0.0
    ret: float = 0.0

    def widened(self, day: int) -> float:
        return min(RD_MAX, sqrt(self.rd * self.rd + RD_GROWTH * (day - self.day)))


class AllTierRatings(Fold):
    """Ratings over all tiers, of the tour alone and by surface, rating deviations, and serve and return skills of a point
    model with a common intercept. Rows are released one by one, in total order: a later row of a day sees the earlier.

    Only completed and retired rows move ratings; only rows with valid counts (`counted`) move skills.
    """

    def __init__(self) -> None:
        super().__init__()
        self.players: dict = {}
        self.mu = log(SERVE_SHARE / (1 - SERVE_SHARE))

    def _get(self, player, tier: str, day: int) -> Rated:
        if player not in self.players:
            start = TIER_START[tier]
            self.players[player] = Rated(start, start, day)
        return self.players[player]

    def release(self, rows: Rows) -> None:
        q = log(10) / SCALE
        for r in rows.tuples():
            day, weight = int(r.day), TIER_WEIGHT[r.tier]
            w, x = (self.players[p] for p in ((r.player_a, r.player_b) if r.a_won is True or r.a_won == 1 else (r.player_b, r.player_a)))
            known = r.a_won is not None and r.a_won == r.a_won
            if known and r.status in ("completed", "retired"):
                rw, rx, dw, dx = w.elo, x.elo, w.widened(day), x.widened(day)
                for p, own, other, d_own, d_other in ((w, rw, rx, dw, dx), (x, rx, rw, dx, dw)):
                    g = 1 / sqrt(1 + 3 * q * q * d_other * d_other / pi**2)
                    e = 1 / (1 + 10 ** (-g * (own - other) / SCALE))
                    p.rd, p.day = 1 / sqrt(1 / (d_own * d_own) + q * q * g * g * e * (1 - e)), day
                step = 32.0 * weight / (1 + 10 ** ((rw - rx) / SCALE))
                w.elo, x.elo = rw + step, rx - step
                if r.tier == "tour":
                    step = 32.0 / (1 + 10 ** ((w.tour - x.tour) / SCALE))
                    w.tour, x.tour = w.tour + step, x.tour - step
                if r.surface in SURFACES:
                    sw, sx = w.surface.get(r.surface, w.start), x.surface.get(r.surface, x.start)
                    step = 32.0 * weight / (1 + 10 ** ((sw - sx) / SCALE))
                    w.surface[r.surface], x.surface[r.surface] = sw + step, sx - step
            if r.counted:
                a, b = self.players[r.player_a], self.players[r.player_b]
                # against the state before the row, of both directions
                ra = r.a_spw - r.a_sp / (1 + exp(-(self.mu + a.serve - b.ret)))
                rb = r.b_spw - r.b_sp / (1 + exp(-(self.mu + b.serve - a.ret)))
                a.serve, b.ret = a.serve + SKILL_RATE * ra, b.ret - SKILL_RATE * ra
                b.serve, a.ret = b.serve + SKILL_RATE * rb, a.ret - SKILL_RATE * rb
                self.mu += INTERCEPT_RATE * (ra + rb)

    def read(self, rows: Rows) -> dict[str, np.ndarray]:
        out = []
        for r in rows.tuples():
            day = int(r.day)
            a, b = self._get(r.player_a, r.tier, day), self._get(r.player_b, r.tier, day)
            on = [p.surface.get(r.surface, p.start) if r.surface in SURFACES else np.nan for p in (a, b)]
            out.append((a.elo, b.elo, a.tour, b.tour, *on, a.widened(day), b.widened(day), a.serve, b.serve, a.ret, b.ret, self.mu))
        return dict(zip(ALL_TIER_VALUES, np.array(out, float).reshape(-1, 13).T, strict=True))


ALL_TIER_VALUES = ["elo_a", "elo_b", "tour_a", "tour_b", "surface_a", "surface_b", "rd_a", "rd_b", "serve_a", "serve_b", "return_a", "return_b", "mu"]


@dataclass(frozen=True)
class FilterSettings:
    """Starting variance and its daily growth, variance of surface deviations (0: none), weight of rows below the tour,
    rate of the intercepts, and the share of serve points won they start from."""

    variance: float = 0.05
    growth: float = 0.0004
    surface_variance: float = 0.01
    temper_lower: float = 0.5
    intercept_rate: float = 0.01
    share: float = SERVE_SHARE


class ServeFilter(Fold):
    """A diagonal Kalman filter of serve and return skills on the log-odds of winning a point, with deviations by surface
    and intercepts by tour or lower tiers and surface.

    Both directions of a row start from the state before it. An intercept moves by `intercept_rate` times the sum of both
    untempered Newton steps; one that was not updated yet reads that of the tour on its surface. Rows without valid counts
    change nothing. Read are both skills of both sides, the total variance of each, and the log-odds of their serve points.
    """

    def __init__(self, settings: FilterSettings = FilterSettings()):
        super().__init__()
        self.s = settings
        self.mu0 = log(settings.share / (1 - settings.share))
        self.growth_on = settings.growth * settings.surface_variance / settings.variance if settings.variance > 0 else 0.0
        self.skill: dict = {}
        self.on: dict = {}
        self.mu: dict = {}

    def _intercept(self, tier: str, surface: str | None) -> tuple[tuple, float]:
        where = surface if surface in SURFACES else "other"
        key = ("tour" if tier == "tour" else "lower", where)
        return key, self.mu.get(key, self.mu.get(("tour", where), self.mu0))

    def _state(self, player, surface: str | None, day: int) -> tuple[list[float], list[float]]:
        """[serve, return, variance, variance], and the same of the surface's deviation, as of the day."""

        def at(held: tuple | None, most: float, growth: float) -> list[float]:
            if held is None:
                return [0.0, 0.0, most, most]
            gone = growth * (day - held[4])
            return [held[0], held[1], min(most, held[2] + gone), min(most, held[3] + gone)]

        base = at(self.skill.get(player), self.s.variance, self.s.growth)
        if self.s.surface_variance <= 0 or surface not in SURFACES:
            return base, [0.0] * 4
        return base, at(self.on.get((player, surface)), self.s.surface_variance, self.growth_on)

    def release(self, rows: Rows) -> None:
        for r in rows.tuples():
            if not r.counted:
                continue
            day, surface, temper = int(r.day), r.surface, 1.0 if r.tier == "tour" else self.s.temper_lower
            (a, da), (b, db) = self._state(r.player_a, surface, day), self._state(r.player_b, surface, day)
            key, m = self._intercept(r.tier, surface)
            gain, curve, newton = [], [], 0.0
            for (x, dx), (y, dy), n, won in (((a, da), (b, db), r.a_sp, r.a_spw), ((b, db), (a, da), r.b_sp, r.b_spw)):
                p = 1 / (1 + exp(-(m + x[0] + dx[0] - y[1] - dy[1])))
                g, i = won - n * p, n * p * (1 - p)
                newton += g / i
                g, i = temper * g, temper * i
                scale = 1 + i * (x[2] + dx[2] + y[3] + dy[3])
                gain.append(g / scale), curve.append(i / scale)
            self.mu[key] = m + self.s.intercept_rate * newton
            for player, parts, own, other in ((r.player_a, (a, da), 0, 1), (r.player_b, (b, db), 1, 0)):
                new = [(x[0] + x[2] * gain[own], x[1] - x[3] * gain[other], x[2] - x[2] ** 2 * curve[own], x[3] - x[3] ** 2 * curve[other], day) for x in parts]
                self.skill[player] = new[0]
                if self.s.surface_variance > 0 and surface in SURFACES:
                    self.on[player, surface] = new[1]

    def read(self, rows: Rows) -> dict[str, np.ndarray]:
        out = []
        for r in rows.tuples():
            (a, da), (b, db) = self._state(r.player_a, r.surface, int(r.day)), self._state(r.player_b, r.surface, int(r.day))
            m = self._intercept(r.tier, r.surface)[1]
            spread = [x[2] + x[3] + d[2] + d[3] for x, d in ((a, da), (b, db))]
            out.append((a[0], a[1], b[0], b[1], *spread, m + a[0] + da[0] - b[1] - db[1], m + b[0] + db[0] - a[1] - da[1]))
        return dict(zip(FILTER_VALUES, np.array(out, float).reshape(-1, 8).T, strict=True))


FILTER_VALUES = ["serve_a", "return_a", "serve_b", "return_b", "variance_a", "variance_b", "eta_a", "eta_b"]
