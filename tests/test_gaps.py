"""F1 g_heal_prob: gaps are pairs of loose ends, far too many to write; bridges come out the same."""

import itertools

import numpy as np
import pytest

from meshwright.operators import heal as H


def strokes(seed, n=20):
    """Single edges crowded on a small raster, so that each loose end has most others in reach."""
    rng = np.random.default_rng(seed)
    at = {k: tuple(map(float, rng.integers(0, 64, 2))) for k in range(2 * n)}
    prob = np.round(rng.random((64, 64)), 1) * (rng.random((64, 64)) < 0.7)
    return at, [(2 * k, 2 * k + 1) for k in range(n)], prob


def gaps(at, reach):
    every = ((float(np.sqrt((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2)), a, b) for a, b in itertools.combinations(at, 2) if a // 2 != b // 2)
    return sorted(g for g in every if g[0] <= reach)


@pytest.mark.parametrize("held", [40, 1 << 21])
def test_rings_list_every_gap_in_order(held, monkeypatch):
    monkeypatch.setattr(H, "PAIRS", held)
    at, _, _ = strokes(1)
    ids = np.array(list(at))
    assert list(H._gaps_by_rings(ids, np.array([at[k] for k in at]), lambda: ids // 2, 30.0)) == gaps(at, 30.0)


@pytest.mark.parametrize("seed", range(3))
def test_bridges_without_listing_the_gaps(seed, monkeypatch):
    at, edges, prob = strokes(seed)
    gates = H.Gates(max_gap=30.0, angle=50.0)
    want = H.bridge(at, edges, gaps(at, 30.0), gates, H.Evidence(prob=prob))
    asked, plain = [], H.cost_paths
    monkeypatch.setattr(H, "cost_paths", lambda *x: (asked.append(1), plain(*x))[1])
    got = H.along_raster(at, edges, prob, gates)
    assert [r[:5] for r in got] == [(m["u"], m["v"], m["weight"], m["heal_kind"], m["conf"]) for m in want] and len(got) > 5
    assert [r[6] and [tuple(map(int, p)) for p in r[6]] for r in got] == [m["pts"] for m in want]
    assert len(asked) < len(gaps(at, 30.0)) / 2


def test_no_gap_is_written(spark, monkeypatch):
    at, edges, prob = strokes(0)
    n = spark.createDataFrame([(1, k, int(x), int(y)) for k, (x, y) in at.items()], "tile int, id long, x long, y long")
    e = spark.createDataFrame([(1, u, v, 10) for u, v in edges], "tile int, u long, v long, w long")
    p = spark.createDataFrame([(1, y, x, float(prob[y, x])) for y in range(64) for x in range(64)], "tile int, y int, x int, p double")
    monkeypatch.setattr(H, "materialise", lambda *_: pytest.fail("gaps are written"))
    gates = H.Gates(max_gap=30.0, angle=50.0)
    want = H.bridge(at, edges, gaps(at, 30.0), gates, H.Evidence(prob=prob))
    assert {(r.u, r.v, r.heal_kind) for r in H.heal(n, e, gates, p, 64).collect()} == {(m["u"], m["v"], m["heal_kind"]) for m in want}
