"""Lookup of typed values in a reference list by a BK-tree under the Damerau-Levenshtein metric.

Distances are computed for many pairs at once; the tree is built and searched level by level, so that a level is one
call. The metric counts insertions, deletions, substitutions and transpositions, with edits allowed between transposed
characters: only so does the triangle inequality hold, by which the tree leaves out whole branches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many entries one broadcast tree is used; beyond, shards of this size.
SHARD_ENTRIES = 50_000
#: Cells of the distance tables held at a time.
CELLS = 3_000_000


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of character numbers (0 behind the end), and the lengths."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    out = np.zeros((len(words), int(lengths.max(initial=1)) or 1), np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out, lengths


def _block(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wa, wb = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    alphabet, numbers = np.unique(np.concatenate((a[:, :wa].ravel(), b[:, :wb].ravel())), return_inverse=True)
    a, b = numbers[: n * wa].reshape(n, wa), numbers[n * wa :].reshape(n, wb)
    far = wa + wb + 1
    d = np.full((wa + 2, wb + 2, n), far, np.int16)
    d[1:, 1, :] = np.arange(wa + 1)[:, None]
    d[1, 1:, :] = np.arange(wb + 1)[:, None]
    row_of = np.zeros((len(alphabet), n), np.int16)  # the last row in which each character of a occurred
    each = np.arange(n)
    for i in range(1, wa + 1):
        column = np.zeros(n, np.int16)  # the last column of this row in which the characters were equal
        ai = a[:, i - 1]
        for j in range(1, wb + 1):
            bj = b[:, j - 1]
            row = row_of[bj, each]
            same = ai == bj
            swap = d[row, column, each] + (i - row - 1) + 1 + (j - column - 1)
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            d[i + 1, j + 1] = np.minimum(best, swap)
            column = np.where(same, np.int16(j), column)
        row_of[ai, each] = i
    return d[la + 1, lb + 1, each].astype(np.int64)


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The distance of each pair of rows."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort(la * 1000 + lb, kind="stable")  # pairs of like lengths together
    start = 0
    while start < len(order):
        size = max(1, CELLS // int((la[order[start]] + 2) * (lb.max() + 2)))
        part = order[start : start + size]
        while len(part) > 1 and len(part) * (la[part].max() + 2) * (lb[part].max() + 2) > 2 * CELLS:
            part = part[: len(part) // 2]
        out[part] = _block(a[part], la[part], b[part], lb[part])
        start += len(part)
    return out


class BKTree:
    def __init__(self, entries: list[str]):
        self.entries = sorted(set(entries))
        self.codes, self.lengths = codes(self.entries)
        self.edges: dict[int, list[tuple[int, int]]] = {}
        waiting = np.arange(1, len(self.entries))
        node = np.zeros(len(waiting), np.int64)
        while len(waiting):
            d = self._to(waiting, node)
            _, first, group = np.unique(node * 100_000 + d, return_index=True, return_inverse=True)
            for k in first:
                self.edges.setdefault(int(node[k]), []).append((int(d[k]), int(waiting[k])))
            heads = waiting[first]
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, node = waiting[rest], heads[group.ravel()[rest]]
        counts = [len(self.edges.get(i, ())) for i in range(len(self.entries))]
        self.starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        flat = [e for i in range(len(self.entries)) for e in self.edges.get(i, ())]
        self.edge_d = np.array([e[0] for e in flat], np.int64)
        self.edge_to = np.array([e[1] for e in flat], np.int64)

    def _to(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return distances(self.codes[i], self.lengths[i], self.codes[j], self.lengths[j])

    def search(self, words: list[str], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, entry, distance) of all entries within each word's limit."""
        found = []
        if not self.entries or not words:
            return (np.empty(0, np.int64),) * 3
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        # nothing can be within the limit of a word that is longer than every entry by more than it
        word = np.flatnonzero((lengths <= self.lengths.max() + limits) & (limits >= 0))
        if not len(word):
            return (np.empty(0, np.int64),) * 3
        matrix, _ = codes([words[i] for i in word])
        place = np.arange(len(word))
        node = np.zeros(len(word), np.int64)
        while len(place):
            d = distances(matrix[place], lengths[word[place]], self.codes[node], self.lengths[node])
            limit = limits[word[place]]
            hit = d <= limit
            found.append((word[place[hit]], node[hit], d[hit]))
            n = self.starts[node + 1] - self.starts[node]
            who = np.repeat(np.arange(len(place)), n)
            edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[node], n)
            near = np.abs(self.edge_d[edge] - d[who]) <= limit[who]
            place, node = place[who[near]], self.edge_to[edge[near]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SCHEMA = "text string, entry string, distance int"


def _search(tree: BKTree, pdf: pd.DataFrame) -> pd.DataFrame:
    words, entries, d = tree.search(list(pdf.text), pdf["max_distance"].to_numpy(np.int64))
    names = np.array(tree.entries, object)
    return pd.DataFrame({"text": pdf.text.to_numpy()[words], "entry": names[entries], "distance": d.astype(np.int32)})


def _built(key: tuple, t: pa.Table) -> pa.Table:
    tree = pickle.dumps(BKTree(t.column("entry").to_pylist()))
    return pa.table({"length": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree], pa.binary())})


def within_distance(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(text, entry, distance): for each distinct value every reference entry within its own limit.

    values: text, max_distance (int; the largest counts where a text is repeated); reference: entry. Null texts, limits
    and entries are left out; an empty text is within its limit of entries no longer than it. Values without any entry
    give no row, and neither does anything if the reference is empty. A text of any length is compared whole.

    Few entries (their number is checked) make one tree that is broadcast. More are split into shards by their length and a
    hash. Each shard's tree is built once; a value is looked up in the shards of the lengths that its limit allows, in
    slices, and all the shards' finds together are the result.
    """
    asked = values.where("text is not null and max_distance is not null").groupBy("text").agg(
        F.max("max_distance").cast("int").alias("max_distance")
    )
    entries = reference.where("entry is not null").select("entry").distinct()
    total = entries.count()
    if total <= shard_entries:
        tree = values.sparkSession.sparkContext.broadcast(BKTree([r.entry for r in entries.collect()]))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _search(tree.value, pdf)

        # the shuffle of the distinct texts may come in one small partition, whose work is large
        parts = values.sparkSession.sparkContext.defaultParallelism
        return asked.repartition(max(parts, 1), "text").mapInPandas(look_up, SCHEMA)
    # shards hold entries of one length: a value is asked for only where its length may be within its limit
    sized = entries.withColumn("length", F.length("entry"))
    parts = sized.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / shard_entries).cast("int").alias("parts"))  # a row a length
    sharded = sized.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
    slices = values.sparkSession.sparkContext.defaultParallelism
    built = sharded.select("length", "part", "entry").groupBy("length", "part").applyInArrow(_built, "length int, part int, tree binary")
    spread = built.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    near = F.sequence(F.greatest(F.length("text") - F.col("max_distance"), F.lit(0)), F.length("text") + F.col("max_distance"))
    every = asked.where("max_distance >= 0").withColumn("length", F.explode(near)).join(parts, "length")
    every = every.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn(
        "slice", F.pmod(F.xxhash64("text"), F.lit(slices)).cast("int")
    )
    keys = ["length", "part", "slice"]

    def look_up_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        found = pd.DataFrame({"text": [], "entry": [], "distance": []})
        if len(left) and len(right):
            asked = pd.DataFrame({c: left.column(c).to_pylist() for c in ("text", "max_distance")})
            found = _search(pickle.loads(right.column("tree")[0].as_py()), asked)
        kinds = {"text": pa.string(), "entry": pa.string(), "distance": pa.int32()}
        return pa.table({c: pa.array(found[c].tolist(), k) for c, k in kinds.items()})

    return every.select("text", "max_distance", *keys).groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(look_up_shard, SCHEMA)
