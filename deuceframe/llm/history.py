"""Problem 2: new batches checked against everything accepted before, by small-world graph shards.

A record becomes a vector in which reports of one match lie close together, whatever form they came in. The history is
divided into segments (by tourney, large tourneys also by the pair of players), and every segment has a graph shard of
the history and one more for each later delivery. The shards are stored: a new batch reads the segments it has rows in,
asks their shards, and adds its own shard; batch shards are merged on a schedule. What lies within the radius of a row is
compared with it exactly, field by field.

Rows that lack a player lie a player's length from their match. They are asked for, and ask, in graphs of the same kind
that hold rows under a single player; rows without a tourney in graphs that hold rows by their pair alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deuceframe.llm.smallworld import ACCEPTED, LINKS, TUNING, Graph
from deuceframe.session import Scratch, remove
from deuceframe.session import exists as _exists
from deuceframe.sources.tables import table

#: Rows of a segment, about; larger tourneys are divided by the pair of players, larger pairs by date.
SEGMENT_ROWS = 2048
#: Segments whose rows are stored together.
SEGMENTS_OF_BIN = 4
#: Deliveries that are kept apart before their shards are merged into one.
COMPACT_AFTER = 4
#: Batches of a delivery in the report on batches.
BATCHES = 4
#: Candidate pairs that are compared at once.
PAIRS = 1 << 20
#: Days by which two reports of a match may differ, in rounds that a player plays once and in repeated ones.
DAYS_ONCE, DAYS_REPEATED = 21, 3
#: Days after which the days' place in the vector repeats (neighbouring weeks lie apart, and no day far away), and its length.
DAY_CYCLE, DAY_LENGTH = 56, 0.9
#: How far apart the vectors of two reports can lie: by their days in repeated rounds, and not at all in others.
RADIUS_REPEATED, RADIUS_ONCE = 0.41, 0.05
#: What stands for an unknown day in the arrays.
NO_DAY = -(2**31)
#: Shares of equal counts that confirm or refute a match where the rest leaves it open.
CONFIRM, REFUTE = 0.6, 0.34
#: Links of a stored node.
WIDTH = LINKS + ACCEPTED
#: Wordings of the rounds (fixed values of this data).
ROUNDS = {
    "F": ("f", "final", "the final"),
    "SF": ("sf", "semi-finals", "semifinals", "semi-final", "semifinal", "1/2"),
    "QF": ("qf", "quarter-finals", "quarterfinals", "quarter-final", "quarterfinal", "1/4"),
    "R16": ("r16", "r-16", "round of 16", "1/8"),
    "R32": ("r32", "r-32", "round of 32", "1/16", "1st round"),
    "R64": ("r64", "r-64", "round of 64", "1/32"),
    "RR": ("rr", "round robin", "group"),
}
ROUND_NUMBER = {name: i + 1 for i, name in enumerate(ROUNDS)}
REPEATED = ROUND_NUMBER["RR"]
COUNTS = ("lo_points", "lo_first", "hi_points", "hi_first")


def tourney_code(tourney_id: Column, season: Column) -> Column:
    """The code of a tourney id, in whatever order and form it stands with its season: upper case, no leading zeros."""
    text = F.upper(F.trim(tourney_id))
    year = season.cast("string")
    short = F.substring(year, 3, 2)
    ahead = F.when(text.startswith(year), F.substring(text, 5, 1000)).when(
        F.regexp_like(text, F.concat(F.lit("^"), short, F.lit("[^0-9A-Z]"))), F.substring(text, 3, 1000)
    )
    behind = F.when(F.regexp_like(text, F.concat(F.lit("[^0-9A-Z]"), year, F.lit("$"))), F.expr("'x'"))
    turned = F.regexp_replace(text, r"[^0-9A-Z]\d{4}$", "")
    code = F.coalesce(F.when(ahead != "", ahead), F.when(behind.isNotNull(), turned), text)
    return F.regexp_replace(F.regexp_replace(code, "[^0-9A-Z]", ""), "^0+(?=.)", "")


def round_number(word: Column) -> Column:
    low = F.lower(F.trim(word))
    out = F.lit(None).cast("int")
    for name, words in ROUNDS.items():
        out = F.when(low.isin(*words), F.lit(ROUND_NUMBER[name])).otherwise(out)
    return out


def _players(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.array("player_a", "player_b")).alias("id")).where("id is not null").distinct()


def player_aliases(records: DataFrame, known: DataFrame) -> DataFrame:
    """(bad, good): ids of a delivery that the history does not know, and the known id they were made from.

    A feed may put digits before an id, or repeat its last two; an id is only replaced if what remains is known.
    """
    text = F.col("id").cast("string")
    cuts = [F.when(F.length(text) > n, F.substring(text, n + 1, 30)) for n in (1, 2)]
    doubled = F.when(
        (F.length(text) > 4) & (F.substring(text, -2, 2) == F.substring(text, -4, 2)), F.expr("substring(cast(id as string), 1, length(cast(id as string)) - 2)")
    )
    unknown = _players(records).join(known, "id", "left_anti")
    tries = unknown.select(F.col("id").alias("bad"), F.explode(F.array_compact(F.array(*cuts, doubled))).alias("t"))
    tries = tries.select("bad", F.expr("try_cast(t as bigint)").alias("id")).where("id is not null")
    return tries.join(known, "id").groupBy("bad").agg(F.max("id").alias("good"))


def canonical(records: DataFrame, alias: DataFrame) -> DataFrame:
    """The rows in one form: tourney and round as numbers (an unread round is 0), players in order (lo, hi; an unknown one
    is hi), the counts of each player with the player."""
    code = tourney_code(F.col("tourney_id"), F.col("source_season"))
    low = records.select(
        "rec_id",
        F.coalesce("batch_no", F.lit(0)).alias("batch_no"),
        F.when(code != "", F.xxhash64(F.col("source_season"), code)).alias("tourney"),
        F.coalesce(round_number(F.col("round")), F.lit(0)).alias("round"),
        F.datediff("match_date", F.lit("1970-01-01").cast("date")).alias("day"),
        "player_a",
        "player_b",
        *[F.col(f"{s}_{c}").alias(f"{s}_{n}") for s in "ab" for c, n in (("serve_points", "points"), ("first_in", "first"))],
    )
    for side in "ab":
        named = alias.select(F.col("bad").alias(f"player_{side}"), F.col("good").alias(f"good_{side}"))
        low = low.join(named, f"player_{side}", "left")
    low = low.withColumn("pa", F.coalesce("good_a", "player_a")).withColumn("pb", F.coalesce("good_b", "player_b"))
    a_first = (F.col("pa") <= F.col("pb")) | F.col("pb").isNull()
    pick = lambda x, y: F.when(F.coalesce(a_first, F.lit(False)), F.col(x)).otherwise(F.col(y))
    return low.select(
        "rec_id",
        "batch_no",
        "tourney",
        "round",
        "day",
        pick("pa", "pb").alias("lo"),
        pick("pb", "pa").alias("hi"),
        *[pick(f"a_{c}", f"b_{c}").cast("int").alias(f"lo_{c}") for c in ("points", "first")],
        *[pick(f"b_{c}", f"a_{c}").cast("int").alias(f"hi_{c}") for c in ("points", "first")],
    )


def _directions(ids: np.ndarray, dims: int, salt: int) -> np.ndarray:
    """A fixed unit vector for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    out = np.empty((len(ids), dims), np.float32)
    for k in range(dims):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB) + np.uint64(k + 1)
        out[:, k] = (x >> np.uint64(40)).astype(np.float32) / np.float32(2**23) - 1
    return out / np.maximum(np.sqrt((out * out).sum(1))[:, None], 1e-6)


def vectors(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Place (the tourney, or what stands for it), players in any order, round and, in repeated rounds, the day as one vector."""
    players = np.zeros((len(rows["one"]), 6), np.float32)
    for side in ("one", "two"):
        known = rows[side] >= 0
        players[known] += _directions(rows[side][known], 6, 1)
    place = _directions(rows["place"].view(np.uint64), 4, 2)
    stage = _directions(rows["round"].astype(np.int64), 2, 3) * np.float32(0.5)
    turn = rows["day"] * (2 * np.pi / DAY_CYCLE)
    day = np.stack((np.cos(turn), np.sin(turn)), 1).astype(np.float32) * np.float32(DAY_LENGTH)
    day[rows["round"] != REPEATED] = 0  # reports of a match that is played once may be dated weeks apart
    return np.concatenate((players, place, stage, day), 1)


def _radius(rows: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(rows["round"] == REPEATED, RADIUS_REPEATED, RADIUS_ONCE)


def same_match(q: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> np.ndarray:
    """The exact comparison of aligned rows.

    Tourney and round must be equal (an unread round fits any). The known players of both must be at most two, and one
    must be common; where each names only another of the two, the counts must confirm it. In rounds that a player plays
    once, the days may differ by weeks; in repeated ones by DAYS_REPEATED, a day more if the counts confirm, and they
    must not refute it at the edge. An unknown tourney fits any if both players and, as in repeated rounds, the day agree.
    An unknown day fits any in rounds played once; in repeated ones the counts must confirm it.
    """
    placed = (q["tourney"] != 0) & (x["tourney"] != 0)
    fits = ((q["tourney"] == x["tourney"]) | ~placed) & ((q["round"] == x["round"]) | (q["round"] == 0) | (x["round"] == 0))
    straight = [q["lo"] == x["lo"], q["hi"] == x["hi"]]
    cross = [q["lo"] == x["hi"], q["hi"] == x["lo"]]
    known = lambda r, s: r[s] >= 0
    q2, x2 = known(q, "hi"), known(x, "hi")
    qn, xn = known(q, "lo").astype(int) + q2, known(x, "lo").astype(int) + x2
    common = ((straight[0] | cross[0]) & known(q, "lo")).astype(int) + ((straight[1] | cross[1]) & q2)
    turned = cross[0] & ~straight[0] & known(q, "lo") | (cross[1] & ~straight[1] & q2)
    equal, seen = np.zeros(len(fits)), np.zeros(len(fits))
    for c in ("points", "first"):
        for s, o in (("lo", "hi"), ("hi", "lo")):
            mine, theirs = q[f"{s}_{c}"], np.where(turned, x[f"{o}_{c}"], x[f"{s}_{c}"])
            both = (mine >= 0) & (theirs >= 0)
            seen += both
            equal += both & (mine == theirs)
    share = np.where(seen >= 2, equal / np.maximum(seen, 1), 0.5)
    confirmed, refuted = share >= CONFIRM, share <= REFUTE
    union = qn + xn - common
    players = (union <= 2) & ((common >= 1) | (confirmed & (qn > 0) & (xn > 0)))
    dated = (q["day"] != NO_DAY) & (x["day"] != NO_DAY)
    whole = (qn == 2) & (xn == 2)
    apart = np.abs(q["day"] - x["day"])
    repeated = (q["round"] == REPEATED) | (x["round"] == REPEATED)
    near = apart <= DAYS_REPEATED
    near &= ~((apart == DAYS_REPEATED) & refuted)
    near |= (apart == DAYS_REPEATED + 1) & confirmed
    days = np.where(dated, np.where(repeated | ~placed, near, apart <= DAYS_ONCE), whole & placed & (confirmed | ~repeated))
    return fits & players & days & (placed | whole)


FIELDS = ("tourney", "round", "day", "lo", "hi", *COUNTS)


def _take(rows: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in rows.items()}


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One number for each row of equal columns (others may share it: the comparison follows)."""
    h = np.full(len(parts[0]), 0x51ED270B, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _equal_keys(mine: tuple[np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys, from (rows, keys) of both sides, some PAIRS at a time."""
    order = np.argsort(theirs[1], kind="stable")
    keys = theirs[1][order]
    start, stop = np.searchsorted(keys, mine[1], "left"), np.searchsorted(keys, mine[1], "right")
    met = np.flatnonzero(stop > start)
    ends = np.cumsum(stop[met] - start[met])
    at = 0
    while at < len(met):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some = met[at:to]
        n = stop[some] - start[some]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(mine[0][some], n), theirs[0][order[np.repeat(start[some], n) + within]]
        at = to


def _clear(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Rows that have a place in the graphs: the round is read, and in repeated rounds the day is known."""
    return (rows["round"] > 0) & ((rows["round"] != REPEATED) | (rows["day"] != NO_DAY))


class Shard:
    """Rows of a segment, their first reports, and a graph. Rows with equal vectors are one node.

    The rows are in the order of their nodes; rows that have no place in the graph come last, with node -1.
    """

    def __init__(self, rows: dict[str, np.ndarray], first: np.ndarray, graph: Graph | None = None, node: np.ndarray | None = None, v: np.ndarray | None = None):
        if graph is None:
            clear = np.flatnonzero(_clear(rows))
            day = np.where(rows["round"] == REPEATED, rows["day"], 0)
            keys = _mixed(*[(day if c == "day" else rows[c])[clear] for c in ("place", "one", "two", "round", "day")])
            _, at, of = np.unique(keys, return_index=True, return_inverse=True)
            graph = Graph(vectors(_take(rows, clear[at])) if v is None else v[clear[at]])
            place = np.empty(len(at), np.int64)
            place[graph.order] = np.arange(len(at))
            if graph.beam:  # as rows that come will ask: some days beside the node
                some = _take(rows, clear[at][graph.order][:: max(1, len(at) // TUNING)])
                some["day"] = some["day"] + np.arange(len(some["day"])) % (2 * DAYS_REPEATED + 1) - DAYS_REPEATED
                graph.tune(vectors(some), _radius(some))
            node = np.full(len(first), -1)
            node[clear] = place[of.ravel()]
            order = np.lexsort((rows["rec_id"], node, node < 0))
            rows, first, node = _take(rows, order), first[order], node[order]
        self.rows, self.first, self.graph, self.node = rows, first, graph, node
        self.starts = np.searchsorted(node[node >= 0], np.arange(len(graph.vectors) + 1))

    def pairs(self, q: dict[str, np.ndarray], v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of q, row held) of all pairs that may be one match, some PAIRS at a time."""
        clear = np.flatnonzero(_clear(q))
        who, node = self.graph.within(v[clear], _radius(q)[clear])
        who, n = clear[who], self.starts[node + 1] - self.starts[node]
        ends, at = np.cumsum(n), 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            m = n[at:to]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(who[at:to], m), np.repeat(self.starts[node[at:to]], m) + within
            at = to
        # what is in no graph meets, and is met by, everything of its place and players
        held, vague, mine = np.arange(len(self.node)), np.flatnonzero(self.node < 0), np.flatnonzero(~_clear(q))
        by = lambda rows, at: (at, _mixed(*[rows[c][at] for c in ("place", "one", "two")]))
        if len(vague) and len(clear):
            yield from _equal_keys(by(q, clear), by(self.rows, vague))
        if len(mine) and len(held):
            yield from _equal_keys(by(q, mine), by(self.rows, held))


def equal_pairs(rows: dict[str, np.ndarray], v: np.ndarray, shard: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, row held) of all pairs that are one match and of which the held row came first (v: the rows' vectors)."""
    for q, x in shard.pairs(rows, v):
        likely = shard.rows["rec_id"][x] < rows["rec_id"][q]
        q, x = q[likely], x[likely]
        equal = same_match(_take(rows, q), _take(shard.rows, x))
        yield q[equal], x[equal]


def first_reports(rows: dict[str, np.ndarray], v: np.ndarray, shards: list[Shard]) -> np.ndarray:
    """The smallest first report of the earlier rows that equal each row; -1: none."""
    none = np.iinfo(np.int64).max
    out = np.full(len(v), none)
    for shard in shards:
        for q, x in equal_pairs(rows, v, shard):
            np.minimum.at(out, q, shard.first[x])
    return np.where(out == none, -1, out)


def deliver(shards: list[Shard], rows: dict[str, np.ndarray]) -> tuple[Shard, tuple[np.ndarray, np.ndarray]]:
    """The shard of a delivery's rows (in the order of rec_id), and their repeats (first, repeat).

    The rows ask the shards so far and, for what came earlier in the same delivery, their own. Rows that do not stay
    (they ask here, but belong to another segment) are in no shard.
    """
    v, stays = vectors(rows), rows["stays"] == 1
    first = first_reports(rows, v, shards)
    own = Shard(_take(rows, stays), rows["rec_id"][stays], v=v[stays])
    where = np.searchsorted(rows["rec_id"], own.rows["rec_id"])
    pairs = [(np.empty(0, np.int64),) * 2, *((q, where[x]) for q, x in equal_pairs(rows, v, own))]
    q, x = (np.concatenate(p) for p in zip(*pairs, strict=True))
    order = np.argsort(q, kind="stable")
    # in the order of the rows: an earlier row of the delivery may be a repeat itself
    for i, k in zip(q[order].tolist(), x[order].tolist(), strict=True):
        best = first[k] if first[k] >= 0 else rows["rec_id"][k]
        first[i] = best if first[i] < 0 else min(first[i], best)
    own.first = np.where(first[where] >= 0, first[where], own.rows["rec_id"])
    hit = first >= 0
    return own, (first[hit], rows["rec_id"][hit])


HELD = ("rec_id", "first", *FIELDS)
NODE = f"segment bigint, shard int, node int, beam int, links binary, {', '.join(f'{c} bigint' for c in HELD)}, bin int"


def _arrays(t: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The columns as numbers, and what the graphs know the rows by: their pair and tourney, unless the table says else."""
    missing = {"tourney": 0, "day": NO_DAY}
    out = {c: pc.fill_null(pc.cast(t.column(c), pa.int64()), missing.get(c, -1)).to_numpy() for c in names}
    return {"one": out["lo"], "two": out["hi"], "place": out["tourney"]} | out


def _loaded(t: pa.Table) -> list[Shard]:
    """The stored shards of a segment."""
    rows, node = _arrays(t, HELD), t.column("node").to_numpy()
    run, shard, beam = (t.column(c).to_numpy() for c in ("run", "shard", "beam"))
    links, out = t.column("links").to_pylist(), []
    for key in np.unique(run * 1000 + shard):
        at = np.flatnonzero(run * 1000 + shard == key)
        at = at[np.lexsort((rows["rec_id"][at], node[at], node[at] < 0))]
        mine = _take(rows, at)
        heads = [i for i in at if links[i] is not None]
        stored = b"".join(links[i] for i in heads)
        matrix = np.frombuffer(stored, np.int16 if len(stored) == 2 * WIDTH * len(heads) else np.int32).reshape(-1, WIDTH)
        graph = Graph.stored(vectors(_take(rows, np.array(heads, np.int64))), matrix, int(beam[at].max(initial=0)))
        out.append(Shard(mine, mine["first"], graph, node[at].astype(np.int64)))
    return out


def _node_table(segment: int, bin_: int, shards: list[Shard], links: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """The shards' rows as they are stored, then the links (shard -1: first and rec_id)."""
    tables = []
    for k, s in enumerate(shards):
        matrix = s.graph.links.astype(np.int16 if len(s.graph.links) < 2**15 else np.int32)
        held = np.full(len(s.node), None, object)
        heads = np.flatnonzero((s.node >= 0) & np.concatenate(([True], s.node[1:] != s.node[:-1]))[: len(s.node)])
        raw, size = matrix.tobytes(), matrix.itemsize * WIDTH
        held[heads] = [raw[i * size : (i + 1) * size] for i in range(len(heads))]
        n = len(s.node)
        tables.append([np.full(n, segment), np.full(n, k), s.node, np.full(n, s.graph.beam), held, *[s.first if c == "first" else s.rows[c] for c in HELD], np.full(n, bin_)])
    n = len(links[0])
    fields = {"rec_id": links[1], "first": links[0]}
    tables.append([np.full(n, segment), np.full(n, -1), np.full(n, -1), np.zeros(n, int), np.full(n, None, object), *[fields.get(c, np.zeros(n, np.int64)) for c in HELD], np.full(n, bin_)])
    columns = [np.concatenate([t[i] for t in tables]) for i in range(len(tables[0]))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * len(HELD), pa.int32()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


def _process(held: list[Shard], t: pa.Table, segment: int, bin_: int, keep: bool = True) -> pa.Table:
    rows = _take(r := _arrays(t, ("rec_id", "first", "batch_no", "stays", "held", *FIELDS)), np.argsort(t.column("rec_id").to_numpy(), kind="stable"))
    known = rows["held"] == 1
    shards = list(held)
    if known.any():  # rows of the history that come in this run: their own shard, built here
        base = _take(rows, known)
        shards.append(Shard(base, base["first"]))
    own, links = deliver(shards, _take(rows, ~known))
    return _node_table(segment, bin_, [*shards[len(held) :], own] if keep else [], links)


def _first_run(keep: bool):
    return lambda key, t: _process([], t, key[1].as_py(), key[0].as_py(), keep)


def _later_run(key: tuple, t: pa.Table, stored: pa.Table) -> pa.Table:
    if not len(t):
        return _node_table(0, 0, [], (np.empty(0, np.int64),) * 2)
    return _process(_loaded(stored) if len(stored) else [], t, key[1].as_py(), key[0].as_py())


def _merge_run(key: tuple, t: pa.Table) -> pa.Table:
    rows = _arrays(t, HELD)
    return _node_table(key[1].as_py(), key[0].as_py(), [Shard(rows, rows["first"])], (np.empty(0, np.int64),) * 2)


class MatchIndex:
    """The stored index: a run for the history and one for each delivery, in a folder that all executors share.

    A run holds, in bins of segments, the rows of its shards with the graphs' links, and its repeats. The list of the
    live runs is appended last, so a delivery that is lost on the way leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.live: list[int] = []
        self.segments = self.bins = self.version = 0
        if _exists(spark, f"{root}/live"):
            last = spark.read.parquet(f"{root}/live").orderBy(F.desc("version")).first()
            self.live, self.segments, self.bins, self.version = list(last.runs), last.segments, last.bins, last.version

    def _publish(self, runs: list[int]) -> None:
        self.live, self.version = runs, self.version + 1
        state = self.spark.createDataFrame([(self.version, runs, self.segments, self.bins)], "version int, runs array<int>, segments int, bins int")
        state.coalesce(1).write.mode("append").parquet(f"{self.root}/live")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _runs(self, kind: str, runs: list[int]) -> DataFrame:
        out = None
        for run in runs:
            one = self._table(f"{kind}-{run}").withColumn("run", F.lit(run))
            out = one if out is None else out.unionByName(one)
        return out

    def _segment(self, df: DataFrame) -> DataFrame:
        """With the segment of each row: small tourneys share one, larger ones (in `splits`; the planner checks the size of
        that table before it broadcasts it) are divided by the pair of players, which all reports of a match share."""
        parted = df.join(self._table("splits"), "tourney", "left")
        number = F.pmod(F.xxhash64("tourney"), F.lit(self.segments))
        own = F.xxhash64(F.lit("large"), "tourney", F.pmod(F.xxhash64("lo", "hi"), F.col("parts")))
        return parted.withColumn("segment", F.when(F.col("parts").isNull(), number).otherwise(own)).drop("parts")

    def _binned(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bin", F.pmod(F.xxhash64("segment"), F.lit(self.bins)).cast("int"))

    def _sliced(self, df: DataFrame, key: list[str], keys: DataFrame | None) -> DataFrame:
        """With the date slice of keys that have more rows than a segment; an asking row comes into every slice that has
        a day on which its match may be reported (rows without a day into all)."""
        if keys is None:
            return df.withColumn("slice", F.lit(0).cast("bigint")).withColumn("stays", F.lit(1))
        at = df.join(keys, key, "left")
        reach = F.when(F.col("round") == REPEATED, F.lit(DAYS_REPEATED + 1)).otherwise(F.lit(DAYS_ONCE))
        floor = lambda day: F.floor(day / F.col("width"))
        asks = F.when(F.col("day").isNull(), F.sequence(floor(F.col("from_day")), floor(F.col("to_day")))).otherwise(
            F.sequence(floor(F.col("day") - reach), floor(F.col("day") + reach))
        )
        # rows of the history only wait
        asks = F.when(F.col("held") == 1, F.array(F.coalesce(floor(F.col("day")), floor(F.col("from_day"))))).otherwise(asks)
        asks = F.when(F.col("width").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(asks)
        own = F.when(F.col("width").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(floor(F.col("day")), floor(F.col("from_day"))))
        out = at.withColumn("own", own).withColumn("slice", F.explode(asks))
        return out.withColumn("stays", (F.col("slice") == F.col("own")).cast("int")).drop("own", "width", "from_day", "to_day")

    @staticmethod
    def _large(df: DataFrame, key: list[str]) -> DataFrame | None:
        """Keys with more rows than a segment and the width of their slices, or None: rows without a day lie in the first."""
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.min("day").alias("from_day"), F.max("day").alias("to_day"))
        width = F.greatest(F.lit(2 * (DAYS_REPEATED + 1)), F.ceil((F.col("to_day") - F.col("from_day") + 1) * SEGMENT_ROWS / F.col("size"))).cast("int")
        large = sizes.where((F.col("size") > SEGMENT_ROWS) & F.col("from_day").isNotNull()).select(*key, width.alias("width"), "from_day", "to_day")
        return None if large.isEmpty() else large

    def add(self, records: DataFrame, first_batch: int = 1, keep: bool = True) -> DataFrame:
        """Takes a delivery in, and returns its repeats: (rec_id_first, rec_id_repeat).

        The first delivery holds the accepted history (batch_no below first_batch, or null) and may hold batches as well;
        later ones hold batches. Of what is stored, a delivery reads only the bins of the segments it has rows in.
        keep: whether its shards are stored for later deliveries.
        """
        number, first_time = max(self.live, default=-1) + 1, not self.live
        if len(self.live) > COMPACT_AFTER + 1:
            self.compact()
            number = max(self.live) + 1
        work = Scratch(self.spark, "delivery")
        given = records.where("rec_id is not null").withColumn("batch_no", F.coalesce("batch_no", F.lit(0)))
        if first_time:
            players = _players(given.where(F.col("batch_no") < first_batch))
            players = self._write(players, "players") if keep else players
        else:
            players = self._table("players")
        later = given.where(F.col("batch_no") >= first_batch) if first_time else given
        rows = canonical(given, player_aliases(later, players)).where("lo is not null")
        rows = work.write(rows, "rows")
        unique = rows.groupBy(*FIELDS).agg(F.min("rec_id").alias("rec_id"), F.min("batch_no").alias("batch_no"), F.count(F.lit(1)).alias("n"))
        history = (F.col("batch_no") < first_batch) if first_time else F.lit(False)
        unique = work.write(unique.withColumn("held", history.cast("int")).withColumn("first", F.col("rec_id")), "unique")
        whole = F.col("hi").isNotNull() & F.col("tourney").isNotNull()
        if keep:
            self._write(unique.where(~whole & F.col("day").isNotNull()), f"odd-{number}")
        if first_time:
            total = unique.count()
            self.segments = max(1, -(-total // SEGMENT_ROWS))
            self.bins = max(1, min(8192, -(-self.segments // SEGMENTS_OF_BIN)))
            sizes = unique.where(whole).groupBy("tourney").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SEGMENT_ROWS)
            self._write(sizes.select("tourney", F.ceil(F.col("size") / SEGMENT_ROWS).cast("int").alias("parts")), "splits")
            within = unique.where(whole).join(self._table("splits").select("tourney"), "tourney", "left_semi")
            pairs = self._large(within, ["tourney", "lo", "hi"])
            if pairs is not None:
                self._write(pairs, "hot")
        hot = self._table("hot") if _exists(self.spark, f"{self.root}/hot") else None
        placed = self._sliced(self._segment(unique.where(whole)), ["tourney", "lo", "hi"], hot)
        placed = placed.withColumn("segment", F.when(F.col("slice") == 0, F.col("segment")).otherwise(F.xxhash64("segment", "slice")))
        placed = self._binned(placed).select("bin", "segment", "rec_id", "first", "batch_no", "stays", "held", *FIELDS)
        tasks = max(1, min(self.bins, 8 * self.spark.sparkContext.defaultParallelism))
        groups = placed.repartition(tasks, "bin").groupBy("bin", "segment")
        if first_time:
            done = groups.applyInArrow(_first_run(keep), NODE)
        else:
            asked = [r.bin for r in placed.select("bin").distinct().collect()]  # at most as many as bins
            stored = self._runs("nodes", self.live).where(F.col("bin").isin(asked))
            done = groups.cogroup(stored.repartition(tasks, "bin").groupBy("bin", "segment")).applyInArrow(_later_run, NODE)
        writer = done.write.mode("overwrite")
        (writer.partitionBy("bin") if keep else writer).parquet(f"{self.root}/nodes-{number}")
        nodes = self._table(f"nodes-{number}")
        links = nodes.where("shard = -1").select(F.col("first").alias("rec_id_first"), F.col("rec_id").alias("rec_id_repeat"))
        odd = self._odd(work, unique, first_time)
        if odd is not None:
            links = links.unionByName(odd)
        # copies of a row are repeats of its first report, and so of whatever that one repeats
        several = unique.where("n > 1").select(*FIELDS, F.col("rec_id").alias("kept"))
        same = F.lit(True)
        for c in FIELDS:
            same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
        asking = rows.where(F.col("batch_no") >= first_batch) if first_time else rows
        copies = (
            asking.alias("r").join(several.alias("s"), same)
            .where("r.rec_id <> s.kept").select(F.col("s.kept").alias("rec_id_first"), F.col("r.rec_id").alias("rec_id_repeat"))
        )
        links = links.unionByName(copies).groupBy("rec_id_repeat").agg(F.min("rec_id_first").alias("rec_id_first"))
        links, last = _resolved(work, links, self._runs("repeats", self.live) if self.live else None)
        if not keep:
            remove(self.spark, self.root)
            work.keep_only(last)
            return links
        out = self._write(links, f"repeats-{number}")
        work.drop()
        self._publish([*self.live, number])
        return out

    def _odd(self, work: Scratch, unique: DataFrame, first_time: bool) -> DataFrame | None:
        """Repeats among pairs of which one row lacks a player or the tourney, by graphs built for those that are asked.

        Rows lacking a player are held and asked under each player of their tourney; rows without a tourney by their pair;
        two rows that each name only another player by every two equal counts. Both need their day.
        """
        fields = [*FIELDS, "rec_id", "first", "batch_no", "held"]
        lacking, homeless = F.col("hi").isNull() & F.col("tourney").isNotNull(), F.col("tourney").isNull() & F.col("hi").isNotNull()
        new = unique.select(*fields).where("day is not null")
        odd = new.where(lacking | homeless)
        if not first_time:
            before = self._runs("odd", self.live).select(*fields).withColumn("held", F.lit(1))
            odd = odd.unionByName(before)
        odd = work.write(odd, "odd")
        if odd.isEmpty():
            return None
        known = new.where(~(lacking | homeless)).unionByName(odd)
        if not first_time:
            known = known.unionByName(self._held_for(odd.where("held = 0"), fields, new))
        views = []

        def view(rows: DataFrame, key: list[str], only: DataFrame, one: Column, two: Column) -> None:
            place = F.xxhash64(F.lit(len(views)), *key).alias("place")
            views.append(rows.join(only, key, "left_semi").select(place, "rec_id", "first", "batch_no", "held", *FIELDS, one.alias("one"), two.alias("two")))

        no = F.lit(None).cast("bigint")
        by_player = known.where("tourney is not null").withColumn("player", F.explode(F.array_compact(F.array("lo", "hi"))))
        view(by_player, ["tourney", "player"], odd.where(lacking).select("tourney", F.col("lo").alias("player")).distinct(), F.col("player"), no)
        view(known.where("hi is not null"), ["lo", "hi"], odd.where(homeless).select("lo", "hi").distinct(), F.col("lo"), F.col("hi"))
        two = [(c, d) for j, c in enumerate(COUNTS) for d in COUNTS[j + 1 :]]
        keys = [F.when(F.col(c).isNotNull() & F.col(d).isNotNull(), F.xxhash64(F.lit(i), c, d)) for i, (c, d) in enumerate(two)]
        by_counts = odd.where(lacking).withColumn("equal", F.explode(F.array_compact(F.array(*keys))))
        view(by_counts, ["tourney", "equal"], by_counts.where("held = 0").select("tourney", "equal").distinct(), no, no)
        together = work.write(views[0].unionByName(views[1]).unionByName(views[2]), "views")
        together = self._sliced(together, ["place"], self._large(together, ["place"]))
        together = together.withColumn("place", F.xxhash64("place", "slice")).drop("slice")
        bins = max(1, -(-work.read("views").count() // SEGMENT_ROWS))
        tasks = max(1, min(bins, 8 * self.spark.sparkContext.defaultParallelism))
        together = together.withColumn("bin", F.pmod(F.col("place"), F.lit(bins)).cast("int"))
        done = together.repartition(tasks, "bin").groupBy("bin").applyInArrow(_odd_run, "rec_id_first bigint, rec_id_repeat bigint")
        return work.write(done, "odd_links")

    def _held_for(self, asking: DataFrame, fields: list[str], new: DataFrame) -> DataFrame:
        """The stored rows that rows lacking something may ask for: of the bins of their tourneys if those are small."""
        nodes = self._runs("nodes", self.live).where("shard >= 0")
        large = asking.join(self._table("splits"), "tourney", "left_semi").unionByName(asking.where("tourney is null"))
        if large.isEmpty():
            bins = self._binned(self._segment(asking)).select("bin").distinct().collect()  # at most as many as bins
            nodes = nodes.where(F.col("bin").isin([r.bin for r in bins]))
        null = {"day": NO_DAY, **dict.fromkeys(COUNTS, -1)}
        rows = nodes.select(
            *[F.when(F.col(c) != null[c], F.col(c)).alias(c) if c in null else F.col(c) for c in FIELDS], "rec_id", "first", F.lit(0).alias("batch_no"), F.lit(1).alias("held")
        ).where("day is not null")
        return rows.select(*[F.col(c).cast(new.schema[c].dataType).alias(c) for c in fields])

    def compact(self) -> None:
        """Merges the shards of all deliveries after the history into one run."""
        rest, number = self.live[1:], max(self.live) + 1
        nodes = self._runs("nodes", rest).where("shard >= 0")
        tasks = max(1, min(self.bins, 8 * self.spark.sparkContext.defaultParallelism))
        merged = nodes.repartition(tasks, "bin").groupBy("bin", "segment").applyInArrow(_merge_run, NODE)
        merged.write.mode("overwrite").partitionBy("bin").parquet(f"{self.root}/nodes-{number}")
        for kind in ("odd", "repeats"):
            self._write(self._runs(kind, rest).drop("run"), f"{kind}-{number}")
        self._publish([self.live[0], number])
        for run in rest:
            for kind in ("nodes", "odd", "repeats"):
                remove(self.spark, f"{self.root}/{kind}-{run}")


def _odd_run(key: tuple, t: pa.Table) -> pa.Table:
    """All places of a bin in one graph: the place is part of the vectors and keeps them apart."""
    rows = _arrays(t, ("rec_id", "first", "batch_no", "stays", "held", *FIELDS, "one", "two", "place"))
    odd, asking, stays = (rows["hi"] < 0) | (rows["tourney"] == 0), rows["held"] == 0, rows["stays"] == 1
    out = [(np.empty(0, np.int64),) * 2]
    # complete rows have met each other by their pair: they ask only for the others
    for asks, holds in ((asking & ~odd, stays & odd), (asking & odd, stays)):
        if asks.any() and holds.any():
            base, q = _take(rows, holds), _take(rows, asks)
            first = first_reports(q, vectors(q), [Shard(base, base["first"])])
            out.append((first[first >= 0], q["rec_id"][first >= 0]))
    first, repeat = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"rec_id_first": first, "rec_id_repeat": repeat})


def _resolved(work: Scratch, links: DataFrame, before: DataFrame | None) -> tuple[DataFrame, str]:
    """The links (and the name of their table), with first reports that are repeats themselves (found in another segment, as a copy, or by an earlier
    delivery) replaced by theirs until none is left; each step halves the longest chain."""
    step = 0
    while True:
        links = work.write(links.select("rec_id_first", "rec_id_repeat"), f"links{step}")
        onward = links if before is None else links.unionByName(before.select("rec_id_first", "rec_id_repeat"))
        onward = onward.groupBy(F.col("rec_id_repeat").alias("rec_id_first")).agg(F.min("rec_id_first").alias("before"))
        joined = links.join(onward, "rec_id_first", "left")
        if joined.where("before is not null").isEmpty():
            return links, f"links{step}"
        links = joined.select(F.coalesce("before", "rec_id_first").alias("rec_id_first"), "rec_id_repeat")
        step += 1


def repeated_deliveries(records: DataFrame, first_batch: int = 1) -> DataFrame:
    """(rec_id_first, rec_id_repeat): each row of batch_no >= first_batch that reports a match which a row with a smaller
    rec_id reported, with the smallest rec_id of that match.

    rec_id is unique; rows with a null rec_id are left out, a null batch_no means the history. A null tourney, round,
    day, player or count is unknown: a row matches by what it has (see same_match); one without any player, or without
    two of tourney, day and a player, matches none. Rows equal in everything that is compared are reduced to their first
    before the graphs are built, so a group of copies, however large, is one row. An empty table gives an empty table.

    The index is built for this call and dropped; MatchIndex keeps it for the deliveries to come.
    """
    spark = records.sparkSession
    if records.isEmpty():
        return spark.createDataFrame([], "rec_id_first bigint, rec_id_repeat bigint")
    scratch = Scratch(spark, "history")
    index = MatchIndex(spark, scratch.root)
    return index.add(records, first_batch, keep=False)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_deliveries(table(spark, folder, "records"))


def p2_batches(spark: SparkSession, folder: str) -> DataFrame:
    """For each later batch, how many rows came and how many of them had been delivered before: a stored index gets the
    batches in deliveries of BATCHES, each reading what it needs of it."""
    records = table(spark, folder, "records")
    scratch = Scratch(spark, "batches")
    index = MatchIndex(spark, scratch.root)
    batches = [r.batch_no for r in records.where("batch_no >= 1").select("batch_no").distinct().orderBy("batch_no").collect()]
    index.add(records.where("batch_no = 0 or batch_no is null"))
    found = spark.createDataFrame([], "rec_id_repeat bigint")
    for at in range(0, len(batches), BATCHES):
        repeats = index.add(records.where(F.col("batch_no").isin(batches[at : at + BATCHES]))).select("rec_id_repeat")
        found = found.unionByName(scratch.write(repeats, f"found-{at}"))
    repeats = found.select(F.col("rec_id_repeat").alias("rec_id"), F.lit(True).alias("repeat"))
    rows = records.where("batch_no >= 1").select("rec_id", "batch_no").join(repeats, "rec_id", "left")
    counts = scratch.write(rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"), F.count("repeat").alias("repeats")), "counts")
    scratch.keep_only("counts")
    return counts


QUERIES = {"p2_found": p2_found, "p2_batches": p2_batches}
SQL: dict[str, str] = {}
