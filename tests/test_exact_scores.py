"""Scores and removal curves from every source in tiles of any size: findings of the third review."""

import numpy as np
import pytest

from meshwright.functions import centrality as C
from meshwright.functions.paths import TileGraph, ablate
from meshwright.operators import network as N


def town(seed, n=520, reach=1.3):
    """A tile of over 450 nodes: places at most ``reach`` apart, some of the lengths equal."""
    rng = np.random.default_rng(seed)
    at = rng.random((n, 2)) * n**0.5
    d = np.hypot(*(at[:, None] - at).transpose(2, 0, 1))
    u, v = np.nonzero(np.triu(d <= reach, 1))
    return u, v, np.maximum(1, np.rint(d[u, v] * 10))


@pytest.mark.parametrize("small", [3, 40])
def test_taken_apart_as_from_every_source(small, monkeypatch):
    monkeypatch.setattr(C, "SMALL", small)
    for seed in range(2):
        g = TileGraph(range(520), *town(seed, reach=1.2 + 0.2 * seed))
        assert len(C.take_apart(g)[1]) > 5
        assert C.carried(g) / (519 * 518) == pytest.approx(g.node_betweenness(), abs=1e-12)
    grid = [(r * 9 + c, r * 9 + c + d) for r in range(9) for c in range(9) for d in (1, 9) if (c < 8 if d == 1 else r < 8)]
    g = TileGraph(range(81), *zip(*grid), [0.1] * len(grid))  # many equally short paths
    whole = TileGraph(range(81), *zip(*grid), [1.0] * len(grid))
    assert C.carried(g) / (80 * 79) == pytest.approx(whole.node_betweenness(), abs=1e-12)


def frames(spark):
    u, v, w = town(7)
    e = spark.createDataFrame([(1, int(a), int(b), int(c)) for a, b, c in zip(u, v, w)], "tile int, u long, v long, w long")
    n = spark.createDataFrame([(1, k, float(k)) for k in range(520)], "tile int, id long, x double")
    return TileGraph(range(520), u, v, w), n, e


@pytest.mark.parametrize("own", [0, 1 << 18])
def test_scores_of_a_large_tile(spark, own, monkeypatch):
    """F6 g_tiers: a tile of 520 nodes is not sampled, also where its blocks are spread over tasks."""
    monkeypatch.setattr(N, "OWN_PAIRS", own)
    monkeypatch.setattr(N, "BLOCK_PAIRS", 1 << 10)
    g, n, e = frames(spark)
    want = g.node_betweenness()
    got = {r.id: r.bc for r in N.node_betweenness(n, e).collect()}
    assert [got[k] for k in range(520)] == pytest.approx(list(want), abs=1e-12)
    high = np.percentile(want[want > 1e-9], 90)
    tiers = {r.id: r.tier for r in N.tiers(N.node_betweenness(n, e)).collect()}
    assert {k for k, t in tiers.items() if t == "critical"} == set(np.flatnonzero(want >= high - 1e-12).tolist())


def whole_scores(monkeypatch, spark):
    """The queries over the tile above instead of the customers."""
    from meshwright.plans import network_queries as Q

    g, n, e = frames(spark)
    monkeypatch.setattr(Q, "_graph", lambda *_: (n, e))
    return Q, g


def test_the_top_gatekeeper_of_a_large_tile(spark, monkeypatch):
    """F4 g_od: of a chain of 521 nodes the middle one is on top, whichever 350 sources a sample would take."""
    from meshwright.plans import network_queries as Q

    e = spark.createDataFrame([(1, k, k + 1, 10) for k in range(520)], "tile int, u long, v long, w long")
    monkeypatch.setattr(Q, "_graph", lambda *_: (N.linked_nodes(e), e))
    assert tuple(Q.g_od(spark, "").first()) == (1, 0, 520, 260, 5200)


def test_service_of_a_large_tile(spark, monkeypatch):
    """F5 g_service: scores do not turn into sampled ones as the tile grows."""
    Q, g = whole_scores(monkeypatch, spark)
    monkeypatch.setattr(N, "road_density", lambda n, e: n.selectExpr("tile", "id", "1 + id % 3 as demand"))
    bc = np.round(g.node_betweenness(), 8) * ((1 + np.arange(520) % 3) / 3)
    got = {r.id: r.svc for r in Q.g_service(spark, "").collect()}
    assert [got[k] for k in range(520)] == pytest.approx(list(np.round(bc / bc.max(), 4)), abs=1.01e-4)


def test_removals_of_a_large_tile():
    """F3 g_ablate, F8 snk_web, F9 snk_web_geo: each node that goes is the most central by every source left."""
    g, gone = TileGraph(range(520), *town(7)), np.zeros(520, bool)
    for _, removed, bc, *_ in ablate(g, 4, None)[1:]:
        score = g.node_betweenness(gone)
        score[gone] = -1
        assert removed == int(np.argmax(score)) and bc == round(float(score.max()), 4)
        gone[removed] = True


def test_the_curve_of_a_document(spark):
    """F8 snk_web: the removals that a document lists, as the documents ask for them."""
    g, n, e = frames(spark)
    score = g.node_betweenness()
    first = N.ablation(n.select("tile", "id"), e, top_k=1, unit=1.0).filter("step = 1").first()
    assert (first.removed, first.betweenness) == (int(np.argmax(score)), round(float(score.max()), 4))
