"""Navigable small-world graphs over vectors, searched for many queries at once."""

from __future__ import annotations

import numpy as np

#: Links a node makes when it is added, links it accepts later (the nearer ones stay, by a distance that chance makes up
#: to CHANCE shorter), candidates that are considered, and the size up to which a shard needs no graph.
LINKS, ACCEPTED, CHOICE, CHANCE, SMALL = 6, 8, 16, 0.3, 128
#: Beam while building and at first, its largest width, and the share of the near nodes that a tuned beam must find.
BUILDING, BEAM, WIDEST, RECALL = 4, 16, 192, 0.999
#: Nodes of a beam opened in one round.
OPENED = 4
#: Distances that an exhaustive search holds at a time.
CELLS = 1 << 22
#: Queries that a beam is tuned on; nodes from whose nearest a search starts while building, and one in how many
#: nodes is such an entry afterwards.
TUNING, ENTRIES, ENTRY_SHARE = 64, 128, 12
#: Queries searched for at once.
QUERIES = 512
#: New nodes that also look among each other.
BLOCK = 512


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


class Graph:
    """A shard: vectors in the order of its nodes, their links (-1: none), and the tuned beam (0: search exhaustively).

    order: the place of each node's vector in the array given at the start.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        self.beam = 0 if len(vectors) <= SMALL else BEAM
        self.built = False
        self.links = np.full((len(vectors), LINKS + ACCEPTED), -1, np.int64)
        self.order = np.arange(len(vectors))
        if not self.beam:
            return
        self.order = np.random.default_rng(len(vectors)).permutation(len(vectors))  # neighbours in the input come apart
        self.vectors = self.vectors[self.order]
        self.squares = (self.vectors * self.vectors).sum(1)
        self._add(0, min(BLOCK, len(vectors)))
        size = min(BLOCK, len(vectors))
        while size < len(vectors):
            to = min(2 * size, len(vectors))
            self._add(size, to)
            size = to
        self._finish()

    @classmethod
    def stored(cls, vectors: np.ndarray, links: np.ndarray, beam: int) -> Graph:
        """A graph that was built before, from its nodes in their order."""
        graph = cls.__new__(cls)
        graph.vectors, graph.links, graph.beam = np.ascontiguousarray(vectors, np.float32), links.astype(np.int64), beam
        graph.squares, graph.order = (graph.vectors * graph.vectors).sum(1), np.arange(len(vectors))
        graph._finish()
        return graph

    def _finish(self) -> None:
        """The entries of searches: one in ENTRY_SHARE nodes (their order is random: they lie all over), and every node to
        which no link leads."""
        n, self.built = len(self.vectors), True
        reached = np.zeros(n, bool)
        reached[self.links[self.links >= 0]] = True
        reached[: min(max(ENTRIES, n // ENTRY_SHARE), n)] = False
        self.entries = np.flatnonzero(~reached)

    def _add(self, start: int, stop: int) -> None:
        """Links nodes start..stop-1 to the nearest of the graph so far and of their block, and back."""
        new = self.vectors[start:stop]
        near, dist = [], []
        if start:
            ids, d = self._beam_search(new, start, BUILDING)
            near.append(ids), dist.append(d)
        block_ids = np.full((len(new), LINKS * 2), -1, np.int64)
        block_d = np.full((len(new), LINKS * 2), np.inf, np.float32)
        for at in range(0, len(new), BLOCK):
            part = new[at : at + BLOCK]
            d = _squares(part, part)
            np.fill_diagonal(d, np.inf)
            k = min(LINKS * 2, len(part) - 1)
            if k > 0:
                ids = np.argpartition(d, k - 1, axis=1)[:, :k]
                block_d[at : at + len(part), :k] = np.take_along_axis(d, ids, 1)
                block_ids[at : at + len(part), :k] = ids + start + at
        near.append(block_ids), dist.append(block_d)
        ids, d = np.concatenate(near, 1), np.concatenate(dist, 1)
        order = np.argsort(d, axis=1)[:, :CHOICE]
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        ids[~np.isfinite(d)] = -1
        order = self._spread(ids, d)
        self.links[start:stop, :LINKS] = np.take_along_axis(ids, order, 1)
        self._link_back(start, stop)

    def _spread(self, ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The places of LINKS candidates in each row (nearest first): those that are nearer to the new node than to any
        candidate before them, so that links lead in all directions; then the nearest of the rest."""
        near = self.vectors[np.maximum(ids, 0)]
        squares = (near * near).sum(2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
        taken, crowd = np.zeros(ids.shape, bool), np.full(ids.shape, np.inf, np.float32)
        for c in range(ids.shape[1]):
            taken[:, c] = (ids[:, c] >= 0) & (d[:, c] <= crowd[:, c]) & (taken.sum(1) < LINKS)
            crowd = np.where(taken[:, c, None], np.minimum(crowd, between[:, c]), crowd)
        rank = np.where(ids < 0, 2 * CHOICE, 0) + np.where(taken, 0, CHOICE) + np.arange(ids.shape[1])
        return np.argsort(rank, axis=1)[:, :LINKS]

    def _link_back(self, start: int, stop: int) -> None:
        source = np.repeat(np.arange(start, stop), LINKS)
        target = self.links[start:stop, :LINKS].ravel()
        ok = target >= 0
        source, target = source[ok], target[ok].astype(np.int64)
        held = self.links[:stop, LINKS:]
        node, slot = np.nonzero(held >= 0)
        source = np.concatenate((held[node, slot].astype(np.int64), source))
        target = np.concatenate((node, target))
        d = ((self.vectors[source] - self.vectors[target]) ** 2).sum(1)
        d *= np.random.default_rng(stop).uniform(CHANCE, 1, len(d))
        order = np.lexsort((d, target))
        source, target = source[order], target[order]
        first = np.concatenate(([True], target[1:] != target[:-1]))
        rank = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
        keep = rank < ACCEPTED
        self.links[:stop, LINKS:] = -1
        self.links[target[keep], LINKS + rank[keep]] = source[keep]

    def _beam_search(self, queries: np.ndarray, size: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam of each query, nearest first, over the first `size` nodes."""
        out_ids, out_d = [], []
        for at in range(0, len(queries), QUERIES):
            ids, d = self._search_some(queries[at : at + QUERIES], size, beam)
            out_ids.append(ids), out_d.append(d)
        return np.concatenate(out_ids), np.concatenate(out_d)

    def _search_some(self, queries: np.ndarray, size: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances are squared and lack the query's own square, which no comparison needs, until the end."""
        n = len(queries)
        entries = self.entries if self.built else np.arange(min(ENTRIES, size))
        d = self.squares[entries] - 2 * (queries @ self.vectors[entries].T)
        ids = np.full((n, beam), -1, np.int64)
        dist = np.full((n, beam), np.inf, np.float32)
        k = min(beam, len(entries))
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        ids[:, :k], dist[:, :k] = entries[best], np.take_along_axis(d, best, 1)
        open_ = np.isfinite(dist)
        seen = np.zeros((n, size), bool)
        seen[:, entries] = True
        seen = seen.ravel()
        column = np.zeros(n * size, np.int8)  # who reached a node last in a round: a node reached twice counts once
        live = np.arange(n)
        while len(live):
            key = np.where(open_[live], dist[live], np.inf)
            pick = np.argpartition(key, OPENED - 1, axis=1)[:, :OPENED]
            picked = np.isfinite(np.take_along_axis(key, pick, 1))
            go = picked.any(1)
            if not go.all():
                live, pick, picked = live[go], pick[go], picked[go]
                if not len(live):
                    break
            r = live[:, None]
            nodes = np.where(picked, ids[r, pick], 0)
            open_[r, pick] = False
            near = self.links[nodes]
            near[~picked] = -1
            near = near.reshape(len(live), -1)
            bad = (near < 0) | (near >= size)
            near[bad] = 0
            flat = near + r * size
            order = np.broadcast_to(np.arange(near.shape[1], dtype=np.int8), near.shape)
            column[flat] = order
            bad |= seen[flat] | (column[flat] != order)
            # a place that only a bad entry reached last is lost to this round, and found again by another way
            nd = self.squares[near] - 2 * np.einsum("ijk,ik->ij", self.vectors[near], queries[live])
            nd[bad] = np.inf
            seen[flat[~bad]] = True
            all_d = np.concatenate((dist[live], nd), 1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, top, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), 1), top, 1)
            open_[live] = np.take_along_axis(np.concatenate((open_[live], ~bad), 1), top, 1)
        order = np.argsort(dist, axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        ids[~np.isfinite(dist)] = -1
        return ids, np.maximum(dist + (queries * queries).sum(1)[:, None], 0)

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node): all nodes found within each query's own radius. A beam that lies inside the radius as a whole
        is doubled, since more may lie there; beyond WIDEST the shard is searched exhaustively, in blocks."""
        found_q, found_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not len(self.vectors):
            return found_q[0], found_x[0]
        limit = (radius.astype(np.float32) + np.float32(0.01)) ** 2
        todo, beam = np.arange(len(queries)), self.beam
        while len(todo):
            if not beam or beam > WIDEST:
                step = max(1, CELLS // len(self.vectors))
                for at in range(0, len(todo), step):
                    some = todo[at : at + step]
                    q, x = np.nonzero(_squares(queries[some], self.vectors) <= limit[some, None])
                    found_q.append(some[q]), found_x.append(x)
                break
            ids, d = self._beam_search(queries[todo], len(self.vectors), beam)
            near = (d <= limit[todo, None]) & (ids >= 0)
            whole = near.all(axis=1)
            q, x = np.nonzero(near & ~whole[:, None])
            found_q.append(todo[q]), found_x.append(ids[q, x])
            todo, beam = todo[whole], 2 * beam
        return np.concatenate(found_q), np.concatenate(found_x)

    def tune(self, queries: np.ndarray, radius: np.ndarray) -> float:
        """Widens the beam until it finds, for a sample of queries, RECALL of the nodes that an exhaustive search finds
        within their radius; beyond WIDEST the shard is searched exhaustively. Returns the recall it ends with."""
        if not self.beam or not len(queries):
            return 1.0
        step = max(1, len(queries) // TUNING)
        sample, radius = queries[::step][:TUNING], radius[::step][:TUNING]
        want = int((_squares(sample, self.vectors) <= (radius[:, None].astype(np.float32) + np.float32(0.01)) ** 2).sum())
        while self.beam:
            found = len(self.within(sample, radius)[0]) / max(want, 1)
            if found >= RECALL or not want:
                return found if want else 1.0
            self.beam = 0 if 2 * self.beam > WIDEST else 2 * self.beam
        return 1.0
