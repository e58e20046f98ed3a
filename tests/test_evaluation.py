"""Losses, ensembles and thresholds against plain definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import loss_kernels as L
from meshwright.plans import evaluation_queries as E
from meshwright.plans.raster_queries import _THR, by_threshold


def test_pooling_by_hand():
    a = np.random.default_rng(1).random((7, 9))
    for h, w in ((3, 1), (1, 3), (3, 3), (5, 5)):
        for low in (False, True):
            pick = min if low else max
            want = [[pick(a[i, j] for i in range(max(0, y - h // 2), min(7, y + h // 2 + 1)) for j in range(max(0, x - w // 2), min(9, x + w // 2 + 1))) for x in range(9)] for y in range(7)]
            assert (L.pooled(a, h, w, low) == np.array(want)).all()


def test_losses_of_perfect_and_opposite_masks():
    g = np.zeros((32, 32))
    g[14:17] = 1
    best, worst = L.all_losses(g, g), L.all_losses(1 - g, g)
    assert best["dice"] == best["connectivity"] == 0 and best["centre_line"] == pytest.approx(0) and best["lovasz"] == 0 and best["bce"] == 0
    assert all(worst[k] > 0.5 for k in ("dice", "lovasz", "bce"))
    assert best["combined"] < 0.01 and L.all_losses(g * 0.9, g)["combined"] < worst["combined"]


def test_a_snapped_road_costs_the_centre_line():
    g = np.zeros((32, 32))
    g[14:17] = 1
    cut = g.copy()
    cut[:, 15:17] = 0
    assert L.soft_skeleton(g)[15, 5:27].min() == 1 and L.soft_skeleton(g)[14].max() == 0
    assert L.centre_line_loss(cut, g) > 0.02


def test_lovasz_by_definition():
    """The extension at 0/1 errors is the Jaccard loss of the wrong set."""
    rng = np.random.default_rng(2)
    g = (rng.random(20) < 0.4).astype(float)
    wrong = rng.random(20) < 0.3
    logits = np.where(wrong, 0.0, 1.0) * (2 * g - 1)  # hinge errors 1 where wrong, else 0
    said = np.where(wrong, 1 - g, g)
    union = np.maximum(said, g).sum()
    assert L.lovasz_loss(logits, g) == pytest.approx(1 - np.minimum(said, g).sum() / union)


def test_counts_of_all_thresholds(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[k % 2], float(p), bool(t)) for k, (p, t) in enumerate(zip(rng.choice([*_THR, 0.0, 1.0, 0.33], 200), rng.random(200) < 0.5))]
    got = {(r["n"], r["thr"]): (r["tp"], r["fp"], r["fn"]) for r in by_threshold(spark.createDataFrame(rows, "n string, p double, g boolean"), "n").collect()}
    for name, thr in itertools.product("ab", _THR):
        mine = [(p > thr, g) for n, p, g in rows if n == name]
        assert got[name, thr] == (sum(a and g for a, g in mine), sum(a and not g for a, g in mine), sum(g and not a for a, g in mine))


def test_greedy_joins_on_strict_gain(spark):
    rng = np.random.default_rng(4)
    g = rng.random(400) < 0.3
    base = np.where(g, 0.6, 0.3)
    noise = [np.clip(base + rng.normal(0, 0.2, 400), 0, 1) for _ in range(2)]
    members = [noise[0], noise[1], rng.random(400)]
    df = spark.createDataFrame([(*map(float, m), bool(t)) for *m, t in zip(*members, g)], "`0` double, `1` double, `2` double, g boolean")

    def best(chosen):
        p = sum(members[m] for m in chosen) / len(chosen)
        return max((((p > t) & g).sum() / (((p > t) | g).sum() + 1e-6), -t) for t in _THR)

    chosen = [max(range(3), key=lambda m: best([m])[0])]
    while len(chosen) < 3:
        top = max((m for m in range(3) if m not in chosen), key=lambda m: best([*chosen, m])[0])
        if best([*chosen, top])[0] <= best(chosen)[0]:
            break
        chosen.append(top)
    got = E.greedy(df, [0, 1, 2])
    assert [h[1] for h in got] == chosen and len(chosen) == 2
    assert got[-1][2] == pytest.approx(best(chosen)[0]) and got[-1][4] == pytest.approx(-best(chosen)[1])


def test_wide_regions_grow_from_seeds(spark):
    from meshwright.operators import raster as R

    px = spark.createDataFrame([(1, 0, x, p) for x, p in enumerate([0.9, 0.5, 0.5, 0.1, 0.5])], "tile int, y int, x int, p double")
    got = {r.x for r in R.grown(px, 8, F.col("p") >= 0.8, F.col("p") >= 0.4).collect()}
    assert got == {0, 1, 2}
