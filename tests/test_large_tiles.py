"""What a query needs follows its components and is read once: one test a finding of the second review."""

import numpy as np
import pytest

from meshwright.functions.paths import Climb, TileGraph
from meshwright.operators import network as N

FOLDER = "/root/testdata/sf0.001"


def test_blocks_hold_their_component_only(spark):
    """two chains and a pair; a block of sources brings no node that its sources cannot reach, unless pieces are shared."""
    lines = [(1, k, k + 1, 7) for k in range(9)] + [(1, k, k + 1, 5) for k in range(20, 29)] + [(1, 40, 41, 3), (2, 1, 2, 4)]
    e = spark.createDataFrame(lines, "tile int, u long, v long, w long")

    def run(tile, sources, ids, edges):
        import pandas as pd

        return pd.DataFrame({"tile": [tile], "sources": [len(sources)], "ids": [len(ids)], "edges": [len(edges)]})

    got = N.per_source_block(N.linked_nodes(e), e, run, "tile int, sources int, ids int, edges int", 4).collect()
    assert sorted(map(tuple, got)) == sorted([(1, k, 10, 9) for k in (4, 4, 2) * 2] + [(1, 2, 2, 1), (2, 2, 2, 1)])


@pytest.mark.parametrize("shape", ["chain", "grid", "dense"])
def test_climb_equals_searches(shape):
    """deep graphs too, where a round for each edge of a path would be many; a graph that would fill up is not built."""
    if shape == "chain":
        pairs, n = [(k, k + 1) for k in range(299)], 300
    elif shape == "grid":
        pairs, n = [(k, k + s) for k in range(196) for s in (1, 14) if k + s < 196 and (s == 14 or k % 14 < 13)], 196
    else:
        pairs, n = [(a, b) for a in range(90) for b in range(a)], 90
    w = np.random.default_rng(1).integers(1, 9, len(pairs)).astype(float)
    u, v = np.array(pairs).T
    g = TileGraph(range(n), u, v, w)
    want = np.array([g.from_source(s)[0] for s in range(n)])
    assert (g.distances(np.arange(n)) == want).all() and (g.distances(np.arange(n), rounds=2) == want).all()
    assert g.inverse_sum(np.arange(n)) == pytest.approx((1 / want[want > 0]).sum())
    assert Climb(n, u, v, w).built and Climb(n, u, v, w, most=2).built == (shape == "chain")


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


#: Files scans that a query may plan; before, tables were planned again for every use of the graph.
SCANS = {"g_eff": 4, "g_khop": 8, "g_heal": 8, "g_conn_report": 10, "g_heal_counts": 8, "g_pairs": 6, "g_angle": 10, "g_tiers": 8, "g_service": 9, "g_whatif": 9, "g_cached_curve": 15, "whatif_resilience": 9, "g_od": 3, "g_travel": 9}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_tables_are_planned_once(spark, name):
    from __spark_entry__ import queries

    assert scans(queries()[name](spark, FOLDER)) <= SCANS[name]


def chain(n):
    return TileGraph(range(n), range(n - 1), range(1, n), [10.0] * (n - 1))


def test_levels_need_no_search_by_source(monkeypatch):
    """a chain has paths of 299 edges; every level comes from passes over batches of sources."""
    from meshwright.functions.paths import flood

    monkeypatch.setattr(TileGraph, "from_source", lambda *a: pytest.fail("searched source by source"))
    rows = flood(chain(300), np.arange(300.0), 6, 2, 88)
    assert [r[4] for r in rows] == [round((299 - int(r[1])) / 300, 4) if r[0] else 1.0 for r in rows]


def test_removal_works_out_the_hit_component_only(monkeypatch):
    """F16: three chains; the two that lose nothing are not searched again, and the curve is that of whole passes."""
    from meshwright.functions import paths as P

    sizes, at = (41, 21, 11), 0
    u, v = [], []
    for n in sizes:
        u += range(at, at + n - 1)
        v += range(at + 1, at + n)
        at += n
    make = lambda: TileGraph(range(at), u, v, [10.0] * len(u))
    asked, plain = [], TileGraph.dependencies
    monkeypatch.setattr(TileGraph, "dependencies", lambda g, s, *rest: (asked.append(g.n), plain(g, s, *rest)))
    got = P.ablate(make(), 2)
    assert len(asked) == sum(sizes) + 2 * 20 and asked.count(11) == 11
    g, gone = make(), np.zeros(at, bool)
    for step, removed, bc, r, *_ in got[1:]:
        score = g.node_betweenness(gone)
        score[gone] = -1
        assert removed == int(np.argmax(score)) and bc == round(float(score.max()), 4)
        gone[removed] = True
        assert r == round(g.efficiency(at, gone) / g.efficiency(at), 4)


def test_one_search_serves_all_ends(monkeypatch):
    """the same paths as one search an end, by one heap of searches; only paths that leave their window are searched again."""
    from meshwright.functions import raster_kernels as K

    rng, again = np.random.default_rng(0), []
    for k in range(8):
        prob = np.round(rng.random((64, 64)), 1) * (rng.random((64, 64)) < 0.6) if k else np.zeros((64, 64))
        a = tuple(rng.integers(-2, 66, 2).astype(float))
        ends = [tuple(np.array(a) + rng.integers(-30, 31, 2)) for _ in range(12)]
        want, plain = [K.cost_path(prob, a, b) for b in ends], K.cost_path
        with monkeypatch.context() as m:
            m.setattr(K, "cost_path", lambda *x: (again.append(x), plain(*x))[1])
            assert K.cost_paths(prob, a, ends) == want
    assert len(again) < 10
