"""F7 g_travel: every reachable pair is a route, not every k-th one."""

import numpy as np

from meshwright.functions.paths import TileGraph
from meshwright.operators import network as N
from meshwright.plans import network_queries as Q


def test_travel_counts_every_reachable_pair(spark, monkeypatch):
    lines = [(1, k, k + 1, 10) for k in range(1, 33)] + [(1, 16, 18, 25), (1, 40, 41, 7), (2, 16, 17, 3)]
    e = spark.createDataFrame(lines, "tile int, u long, v long, w long")
    monkeypatch.setattr(Q, "_graph", lambda *_: (N.linked_nodes(e), e))
    monkeypatch.setattr(N, "CELLS", 100)
    got = {r.tile: tuple(r)[1:] for r in Q.g_travel(spark, "").collect()}
    u, v, w = (np.array(c) for c in list(zip(*lines[:-1]))[1:])
    g = TileGraph([], u, v, w)
    d0, d1 = g.distances(range(g.n)), g.distances(range(g.n), g.ids % 17 == 0)
    pairs = [(a, b) for a in range(g.n) for b in range(a + 1, g.n) if np.isfinite(d0[a, b])]
    late = [d1[p] / d0[p] - 1 for p in pairs if np.isfinite(d1[p])]
    cut = len(pairs) - len(late)
    assert got == {1: (33 * 32 // 2 + 1, cut, int(100 * cut / len(pairs) + 0.5), round(float(np.mean(late)), 6)), 2: (1, 1, 100, 0.0)}
    assert sum(late) > 0
