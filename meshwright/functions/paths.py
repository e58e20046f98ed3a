"""Shortest-path kernels on one tile's weighted undirected graph (plain arrays and heaps)."""

from __future__ import annotations

from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np


#: Distances that a sum over pairs holds at a time: workers share an executor's memory with its heap.
CELLS = 1 << 21


class Climb:
    """Shortest distances in one connected graph, over an elimination order of its nodes.

    Nodes go one by one, least degree first; those next to a node are then joined by the way through it.
    A shortest path thus climbs to later nodes and comes down again, so two passes over the nodes give
    the distances of a whole batch of sources. ``built`` is false where too many ways would have to be
    added (more than ``most`` a node); such a graph is searched source by source.
    """

    def __init__(self, n: int, u, v, w, most: int = 64):
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, c in zip(u.tolist(), v.tolist(), w.tolist()):
            if a != b and c < near[a].get(b, np.inf):
                near[a][b] = near[b][a] = c
        heap = [(len(x), k) for k, x in enumerate(near)]
        heapify(heap)
        order, left = [], most * n
        self.rank = np.full(n, -1)
        self.ways: list[list[tuple[int, float]]] = []
        gone = [False] * n
        while heap and left >= 0:
            degree, k = heappop(heap)
            if gone[k] or degree != len(near[k]):
                continue
            gone[k] = True
            self.rank[k] = len(order)
            order.append(k)
            ways = list(near[k].items())
            left -= len(ways)
            self.ways.append(ways)
            for i, (a, c) in enumerate(ways):
                at = near[a]
                del at[k]
                for b, e in ways[:i]:
                    if c + e < at.get(b, np.inf):
                        at[b] = near[b][a] = c + e
            for a, _ in ways:
                heappush(heap, (len(near[a]), a))
        self.built = left >= 0
        self.order = np.array(order, np.int64)
        if self.built:
            rank = self.rank.tolist()
            self.ways = [[(rank[a], c) for a, c in ways] for ways in self.ways]

    def ranked(self, sources: np.ndarray) -> np.ndarray:
        """Distances to every node (a row each, in the order of elimination) from the sources (a column each)."""
        d = np.full((len(self.rank), len(sources)), np.inf)
        start = self.rank[sources]
        d[start, np.arange(len(sources))] = 0.0
        reached = np.zeros(len(self.rank), bool)
        reached[start] = True
        reached = reached.tolist()
        rows, add, least, way = list(d), np.add, np.minimum, np.empty(len(sources))
        for k, ways in enumerate(self.ways):
            if reached[k]:
                row = rows[k]
                for h, w in ways:
                    add(row, w, out=way)
                    least(rows[h], way, out=rows[h])
                    reached[h] = True
        for k in range(len(rows) - 1, -1, -1):
            row = rows[k]
            for h, w in self.ways[k]:
                add(rows[h], w, out=way)
                least(row, way, out=row)
        return d


def labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node position of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


class TileGraph:
    """Adjacency by position; ``ids`` are the nodes in ascending order, isolated ones included."""

    def __init__(self, ids, u, v, w):
        self.ids = np.unique(np.concatenate([np.asarray(ids, np.int64), np.asarray(u, np.int64), np.asarray(v, np.int64)]))
        self.n = len(self.ids)
        self.u, self.v = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        self.w = np.asarray(w, np.float64)
        self._parts: tuple[bytes | None, list] | None = None

    @cached_property
    def near(self) -> list[list[tuple[int, float]]]:
        near: list[list[tuple[int, float]]] = [[] for _ in range(self.n)]
        for a, b, c in zip(self.u.tolist(), self.v.tolist(), self.w.tolist()):
            near[a].append((b, c))
            near[b].append((a, c))
        return near

    def parts(self, gone: np.ndarray | None = None) -> list[list]:
        """The components, a list each: the positions of its nodes, the edges by place in these, and once it was asked for, its ``Climb``."""
        key = None if gone is None else gone.tobytes()
        if self._parts is None or self._parts[0] != key:
            label = self.components(gone)
            u, v, w = self.u, self.v, self.w
            if gone is not None:
                open_ = ~(gone[u] | gone[v])
                u, v, w = u[open_], v[open_], w[open_]
            by, of = np.argsort(label, kind="stable"), np.argsort(label[u], kind="stable")
            by = by[np.searchsorted(label[by], 0) :]
            u, v, w = u[of], v[of], w[of]
            heads = np.unique(label[by])
            cuts, edges = np.searchsorted(label[by], np.r_[heads, self.n]), np.searchsorted(label[u], np.r_[heads, self.n])
            place = np.full(self.n, -1)
            found = []
            for i in range(len(heads)):
                who, span = by[cuts[i] : cuts[i + 1]], slice(edges[i], edges[i + 1])
                place[who] = np.arange(len(who))
                found.append([who, place[u[span]], place[v[span]], w[span], None])
            self._parts = (key, found)
        return self._parts[1]

    def part(self, who: np.ndarray) -> TileGraph:
        """The graph of some whole components (positions of their nodes, ascending), with their ``Climb``s."""
        place = np.full(self.n, -1)
        place[who] = np.arange(len(who))
        own = place[self.u] >= 0
        out = TileGraph(self.ids[who], self.ids[self.u[own]], self.ids[self.v[own]], self.w[own])
        for part in out.parts():
            if len(part[0]) > 1:
                self.climb(part)
        return out

    @staticmethod
    def climb(part: list) -> Climb:
        if part[4] is None:
            part[4] = Climb(len(part[0]), *part[1:4])
        return part[4]

    def from_source(self, source: int, gone: np.ndarray | None = None) -> tuple[list[float], list[int], list[int], list[list[int]], list[int]]:
        """Distances, parents (least node on ties), order of settling, all predecessors, path counts."""
        dist, parent = [float("inf")] * self.n, [-1] * self.n
        before: list[list[int]] = [[] for _ in range(self.n)]
        count, order, done = [0] * self.n, [], [False] * self.n
        if gone is not None and gone[source]:
            return dist, parent, order, before, count
        dist[source], count[source] = 0.0, 1
        heap = [(0.0, source)]
        while heap:
            d, a = heappop(heap)
            if done[a]:
                continue
            done[a] = True
            order.append(a)
            for b, w in self.near[a]:
                if done[b] or (gone is not None and gone[b]):
                    continue
                e = d + w
                if e < dist[b]:
                    dist[b], parent[b], before[b], count[b] = e, a, [a], count[a]
                    heappush(heap, (e, b))
                elif e == dist[b]:
                    before[b].append(a)
                    count[b] += count[a]
                    if self.ids[a] < self.ids[parent[b]]:
                        parent[b] = a
        return dist, parent, order, before, count

    def distances(self, sources, gone: np.ndarray | None = None, rounds: int | None = None) -> np.ndarray:
        """Distances from each source (a row each) to all nodes; inf where there is no path.

        Component by component, all sources of one at once. ``rounds`` bounds the ways that ``Climb`` may
        add a node; components beyond it are searched source by source.
        """
        out = np.full((len(sources), self.n), np.inf)
        for which, who, d in self.batches(sources, gone, rounds):
            out[np.ix_(which, who)] = d.T
        return out

    def batches(self, sources, gone=None, rounds=None, cells: int = 1 << 24):
        """(places in ``sources``, nodes, distances: a row a node, a column a source), a component and a batch of sources at a time."""
        sources = np.asarray(sources, np.int64)
        owner, place = np.full(self.n, -1), np.zeros(self.n, np.int64)
        parts = self.parts(gone)
        for k, part in enumerate(parts):
            owner[part[0]], place[part[0]] = k, np.arange(len(part[0]))
        of = owner[sources]
        by = np.argsort(of, kind="stable")
        for k in np.unique(of[of >= 0]).tolist():
            part, mine = parts[k], by[np.searchsorted(of[by], k) : np.searchsorted(of[by], k, side="right")]
            who = part[0]
            if len(who) == 1:
                yield mine, who, np.zeros((1, len(mine)))
                continue
            climb = self.climb(part) if rounds is None else Climb(len(who), *part[1:4], most=rounds)
            step = max(1, min(1024, cells // len(who)))
            for lo in range(0, len(mine), step):
                some = mine[lo : lo + step]
                if climb.built:
                    yield some, who[climb.order], climb.ranked(place[sources[some]])
                else:
                    yield some, who, np.array([np.array(self.from_source(int(s), gone)[0])[who] for s in sources[some]]).T

    def inverse_sum(self, sources, gone: np.ndarray | None = None, unit: float = 1.0) -> float:
        """Sum of unit/distance from the sources to all other nodes that they reach."""
        total = 0.0
        for _, _, d in self.batches(sources, gone, cells=CELLS):
            d[d == 0] = np.inf
            np.divide(unit, d, out=d)
            total += float(d.sum())
        return total

    def dependencies(self, source: int, gone: np.ndarray | None, node: np.ndarray, edge: dict[tuple[int, int], float] | None) -> None:
        """Add one source's share of node and edge betweenness (weighted dependency accumulation)."""
        _, _, order, before, count = self.from_source(source, gone)
        share = [0.0] * self.n
        for b in reversed(order):
            for a in before[b]:
                part = count[a] / count[b] * (1 + share[b])
                share[a] += part
                if edge is not None:
                    key = (a, b) if a < b else (b, a)
                    edge[key] = edge.get(key, 0.0) + part
            if b != source:
                node[b] += share[b]

    def node_betweenness(self, gone: np.ndarray | None = None, pivots: int | None = None, exact: int = 0) -> np.ndarray:
        """Normalised by (n-1)(n-2) over the nodes that are left.

        With ``pivots``, a graph of more than ``exact`` nodes uses so many sources, evenly by a hash
        of their ids, and scales up.
        """
        left, sources = self.pivots(gone, pivots, exact)
        score = np.zeros(self.n)
        for s in sources.tolist():
            self.dependencies(s, gone, score, None)
        return self.normalised(score, len(left), len(sources))

    def pivots(self, gone: np.ndarray | None, pivots: int | None, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that are left, and the sources of betweenness among them."""
        left = np.flatnonzero(~gone) if gone is not None else np.arange(self.n)
        if pivots and len(left) > exact and len(left) > pivots:
            mixed = (self.ids[left].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(42)
            return left, left[np.argsort(mixed, kind="stable")[:pivots]]
        return left, left

    @staticmethod
    def normalised(score: np.ndarray, n: int, sources: int) -> np.ndarray:
        score = score * (n / max(1, sources))
        return score / ((n - 1) * (n - 2)) if n > 2 else score

    def efficiency(self, n_ref: int, gone: np.ndarray | None = None, unit: float = 1.0) -> float:
        """Mean of unit/distance over ordered pairs of ``n_ref`` nodes; unreachable pairs add 0."""
        if self.n < 2 or n_ref < 2:
            return 0.0
        return self.inverse_sum(np.arange(self.n), gone, unit) / (n_ref * (n_ref - 1))

    def components(self, gone: np.ndarray | None = None) -> np.ndarray:
        """The least node position of each node's component; -1 for nodes that are gone."""
        if gone is None:
            return labels(self.n, self.u, self.v)
        open_ = ~(gone[self.u] | gone[self.v])
        label = labels(self.n, self.u[open_], self.v[open_])
        label[gone] = -1
        return label

    def largest(self, gone: np.ndarray | None = None) -> int:
        label = self.components(gone)
        return int(np.bincount(label[label >= 0]).max()) if (label >= 0).any() else 0


#: Sampled betweenness is exact up to so many nodes, and sampled from so many above.
EXACT_NODES, PIVOTS = 450, 350

#: A removal curve searches components of up to so many nodes source by source; larger ones are taken apart first.
WHOLE = 64


class _Piece:
    """A component in a removal curve; what was worked out of it stays good until a node of it goes."""

    def __init__(self, who: np.ndarray, graph: TileGraph, unit: float | None):
        self.who, self.graph = who, graph
        self.total = graph.inverse_sum(np.arange(graph.n), None, unit) if graph.n > 1 and unit else 0.0
        self.score: np.ndarray | None = None

    def scores(self) -> np.ndarray:
        """The pairs that each node of the component carries, from every source."""
        if self.score is None:
            g, self.score = self.graph, np.zeros(self.graph.n)
            if g.n > WHOLE:
                from meshwright.functions.centrality import carried  # which is built on this module

                self.score = carried(g)
            elif g.n > 2:
                for s in range(g.n):
                    g.dependencies(s, None, self.score, None)
        return self.score

    def split(self, unit: float | None, gone: np.ndarray | None = None) -> list[_Piece]:
        g = self.graph
        return [_Piece(self.who[who], TileGraph(g.ids[who], g.ids[who[u]], g.ids[who[v]], w), unit) for who, u, v, w, _ in g.parts(gone)]


def ablate(graph: TileGraph, top_k: int, unit: float | None = 1.0) -> list[tuple]:
    """Remove the most central node again and again: (step, removed, bc, R, efficiency, lcc share).

    Scores are exact at any size. Only the component that lost a node is worked out again. Without a ``unit`` the efficiencies are left at 0,
    as which node goes does not depend on them.
    """
    gone = np.zeros(graph.n, bool)
    every = _Piece.__new__(_Piece)
    every.who, every.graph = np.arange(graph.n), graph
    pieces = every.split(unit)
    mean = lambda: sum(p.total for p in pieces) / (graph.n * (graph.n - 1)) if graph.n > 1 else 0.0
    largest = lambda: max((len(p.who) for p in pieces), default=0)
    base, lcc = mean(), largest()
    out = [(0, None, None, 1.0, round(base, 6), 1.0)]
    for step in range(1, top_k + 1):
        if (~gone).sum() < 3:
            break
        left = int((~gone).sum())
        owner, place = np.full(graph.n, -1), np.zeros(graph.n, np.int64)
        bc = np.full(graph.n, -1.0)
        for k, p in enumerate(pieces):
            owner[p.who], place[p.who] = k, np.arange(len(p.who))
            bc[p.who] = np.round(p.scores(), 4)  # equal ones stay equal, the first of them goes
        bc = graph.normalised(bc, left, left)
        worst = int(np.argmax(bc))
        gone[worst] = True
        hit = pieces.pop(int(owner[worst]))
        pieces += hit.split(unit, np.arange(len(hit.who)) == place[worst])
        eff = mean()
        share = largest() / lcc if lcc else 0.0
        out.append((step, int(graph.ids[worst]), round(float(bc[worst]), 4), round(eff / base, 4) if base else 0.0, round(eff, 6), round(share, 4)))
    return out


def flood(graph: TileGraph, elev: np.ndarray, levels: int, low: float, high: float, unit: float = 1.0) -> list[tuple]:
    """Independent water levels: (step, level, share under water, R, lcc share).

    Step 0 stands for dry ground and carries the lowest of the ``levels``; each further level is a step.
    """
    base, lcc = graph.efficiency(graph.n, None, unit), graph.largest()
    water = np.linspace(np.percentile(elev, low), np.percentile(elev, high), levels)
    out = [(0, round(float(water[0]), 1), 0.0, 1.0, 1.0)]
    for k, level in enumerate(water[1:], 1):
        gone = elev <= level
        eff, left = graph.efficiency(graph.n, gone, unit), graph.largest(gone)
        out.append((k, round(float(level), 1), round(float(gone.mean()), 4), round(eff / base, 4) if base else 0.0, round(left / lcc, 4) if lcc else 0.0))
    return out
