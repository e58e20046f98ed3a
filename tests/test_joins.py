"""Joins of two growing sides keep off the driver: tables this small would all be broadcast."""

import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

FOLDER = "/root/testdata/sf0.001"

#: Findings F1 to F20 of the second round, by query.
NAMES = ["g_khop", "g_angle", "g_conn_report", "g_pairs", "g_heal_counts", "g_tiers", "g_service", "whatif_resilience", "g_whatif", "g_cached_curve", "g_travel", "g_od"]


@pytest.mark.parametrize("name", NAMES)
def test_no_growing_side_is_broadcast(spark, monkeypatch, name):
    """Neither in what the query writes on its way nor in its result; joins by the tile alone have a row a tile."""
    from __spark_entry__ import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: (plans.append(plan(w._df)), write(w, path, *a, **k))[1])
    plans.append(plan(queries()[name](spark, FOLDER)))
    assert len(plans) > 1
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*,", "\n".join(plans))


def test_removal_curve_spreads_its_sums(spark, monkeypatch):
    """the curve is that of one task; but a tile's task only picks, and the sums come by blocks of sources."""
    from meshwright.functions.paths import TileGraph, ablate
    from meshwright.operators import network as N

    rng, asked, plain = np.random.default_rng(3), [], N.per_source_block
    lines = [("a", k, k + 1, 0.1 * int(rng.integers(1, 90))) for k in range(40)] + [("a", 50 + k, 51 + k, 2.5) for k in range(9)] + [("b", 1, 2, 0.7), ("b", 2, 3, 1.1), ("b", 3, 4, 0.3)]
    e = spark.createDataFrame(lines, "tile string, u long, v long, w double")
    n = N.linked_nodes(e).unionByName(spark.createDataFrame([("b", 9), *[("c", k) for k in range(4)]], "tile string, id long"))
    monkeypatch.setattr(N, "per_source_block", lambda *a: (asked.append(1), plain(*a, 16))[1])
    got = {}
    for r in N.ablation(n, e, unit=1.0).collect():
        got.setdefault(r.tile, []).append(tuple(r)[1:])
    for tile, ids in {"a": [*range(41), *range(50, 60)], "b": [1, 2, 3, 4, 9], "c": [*range(4)]}.items():
        u, v, w = zip(*[x[1:] for x in lines if x[0] == tile]) if tile != "c" else ([], [], [])
        assert sorted(got[tile]) == ablate(TileGraph(ids, u, v, w), 8)
    assert asked
