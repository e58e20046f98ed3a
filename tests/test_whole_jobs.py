"""Operators do the whole job of the reference: one test a finding of the first review."""

from meshwright.operators import heal as H

FOLDER = "/root/testdata/sf0.001"


def test_heal_under_canopy(spark):
    """Two collinear roads 28 apart, 1.4 times the gap: bridged under canopy only, unless the scene is saturated."""

    def made(green, gap=28, canopy=True, prob=None):
        x = [0, 10, 10 + gap, 20 + gap]
        nodes = spark.createDataFrame([(1, k, v, 32) for k, v in enumerate(x)], "tile int, id long, x long, y long")
        edges = spark.createDataFrame([(1, 0, 1, 10), (1, 2, 3, 10)], "tile int, u long, v long, w long")
        cells = spark.createDataFrame([(1, y, c, green, 28 <= y < 36) for y in range(64) for c in range(64)], "tile int, y int, x int, green_frac double, dense boolean")
        return [(r.u, r.v, r.heal_kind, r.conf, r.canopy_frac) for r in H.heal(nodes, edges, H.Gates(max_gap=20.0), prob, 64, cells if canopy else None).collect()]

    assert made(0.3, canopy=False) == []
    assert made(0.3) == [(1, 2, "canopy", "low", 1.0)]
    assert made(0.7) == [] and made(0.7, 24) == [(1, 2, "canopy", "vlow", 1.0)]
    soft = spark.createDataFrame([(1, 32, c, 0.3) for c in range(64)], "tile int, y int, x int, p double")
    assert made(0.3, prob=soft) == [(1, 2, "canopy", "low", 1.0)]
    assert made(0.3, prob=soft, canopy=False) == []


def test_canopy_reaches_the_counts(spark):
    """The test rasters are noise (22 % dense), so few spans are half canopy; every span is measured, though."""
    from meshwright.plans.pipeline_queries import _canopy_healed, g_heal_counts

    rows = _canopy_healed(spark, FOLDER).collect()
    assert any(r.canopy_frac > 0 for r in rows)
    assert sum(r.canopy for r in g_heal_counts(spark, FOLDER).collect()) == sum(r.heal_kind == "canopy" for r in rows)


def test_whole_documents(spark):
    """Contents of the documents against the tables, taken apart in plain Python."""
    import json

    from meshwright.plans import pipeline_queries as P

    read = lambda t: [r.asDict() for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").collect()]
    nodes, edges = {}, {}
    for r in sorted(read("web_nodes"), key=lambda r: r["exported_at"]):
        if r["stem"] is not None:
            nodes.setdefault(r["stem"], {})[r["id"]] = r
    for r in read("web_edges"):
        known = nodes.get(r["stem"], {})
        if r["u"] in known and r["v"] in known and r["u"] != r["v"]:
            edges.setdefault(r["stem"], set()).add((min(r["u"], r["v"]), max(r["u"], r["v"])))
    got = {r.stem: json.loads(r.document) for r in P.snk_web_geo(spark, FOLDER).collect()}
    plain = P._documents(spark, FOLDER, False).collect()
    assert got.keys() == nodes.keys() == {r.stem for r in plain} and edges
    ok = lambda b: b is not None and 0 <= b <= 1
    for stem, d in got.items():
        mine = nodes[stem]
        assert [x["id"] for x in d["nodes"]] == sorted(mine) and all(x.get("svc") == mine[x["id"]]["svc"] for x in d["nodes"])
        assert [(x["u"], x["v"]) for x in d["edges"]] == sorted(edges.get(stem, ())) and all(len(x["pts"]) >= 2 and len(x["ll"]) >= 2 for x in d["edges"])
        best = sorted((-round(r["bc"], 4), k) for k, r in mine.items() if ok(r["bc"]))[:10]
        assert [(-g["bc"], g["id"]) for g in d["gatekeepers"]] == best
        assert len(mine) < 4 or [s["step"] for s in d["resilience"]] == list(range(min(9, len(mine) - 1)))
    assert any(d["osm_lines"] for d in got.values()) and any("conf" in x for d in got.values() for x in d["edges"])
    assert all(len(r.edges) == len(edges.get(r.stem, ())) and r.gatekeepers is not None and r.resilience is not None for r in plain)


def test_benchmark_pairs(spark):
    """Drawn again one by one, as the reference does, over distances of its own."""
    import numpy as np

    from meshwright.functions.paths import TileGraph
    from meshwright.plans import pipeline_queries as P

    n = 40
    truth, e, thin = (df.toPandas() for df in P._benchmark(spark, FOLDER))
    got = {r.tile: r for r in P.agg_ple(spark, FOLDER, n).collect()}
    pairs = {}
    for r in P.g_pairs(spark, FOLDER, n).collect():
        pairs.setdefault(r.tile, set()).add((r.k, r.s, r.t))
    assert got.keys() == set(e.tile)
    for tile, row in got.items():
        nd, full, cut = (df[df.tile == tile] for df in (truth.sort_values("id"), e, thin))
        at = dict(zip(nd.id, zip(nd.x, nd.y)))
        a, b = (TileGraph(nd.id, g.u, g.v, g.w) for g in (full, cut))
        model = sorted(set(cut.u) | set(cut.v))
        near = {k: min(((at[m][0] - p[0]) ** 2 + (at[m][1] - p[1]) ** 2, m) for m in model) if model else (1e9, 0) for k, p in at.items()}
        rng, kept, sampled, errs = np.random.default_rng(42), set(), 0, []
        d = lambda g, s, t: g.from_source(int(np.searchsorted(g.ids, s)))[0][int(np.searchsorted(g.ids, t))]
        for k in range(6 * n):
            if len(kept) >= n:
                break
            s, t = map(int, rng.choice(nd.id.to_numpy(), 2, replace=False))
            d0 = d(a, s, t)
            if not 0 < d0 < float("inf"):
                continue
            sampled += 1
            if max(near[s][0], near[t][0]) > 45**2:
                continue
            kept.add((k, s, t))
            d1 = d(b, near[s][1], near[t][1])
            if 0 < d1 < float("inf"):
                errs.append(abs(d1 - d0) / d0 * 100)
        assert pairs.get(tile, set()) == kept and row.pairs == len(kept)
        assert abs(row.routing_success - len(errs) / max(1, len(kept))) < 1e-4 and abs(row.gap_rate - (sampled - len(kept)) / max(1, sampled)) < 1e-4
        assert row.mean_error_pct is None if not errs else abs(row.mean_error_pct - np.mean(errs)) < 0.011
        assert row.km > 0 and (row.median_error_pct is None) == (not errs)
    assert max(map(len, pairs.values())) > 30


def test_betweenness_is_exact_in_small_tiles(spark):
    import pytest

    from meshwright.operators import network as N
    from meshwright.plans.network_queries import g_bc_sampled, g_node_bc

    folder = FOLDER.replace("0.001", "0.01")  # tiles of about 60 nodes
    scores = lambda df: {(r.tile, r.id): r.bc for r in df.collect()}
    assert scores(g_bc_sampled(spark, folder)) == pytest.approx(scores(g_node_bc(spark, folder)))
    lines = [(t, k, k + 1, 10) for t, n in ((1, 6), (2, 12)) for k in range(n - 1)]
    edges = spark.createDataFrame(lines, "tile int, u long, v long, w long")
    whole, part = (scores(N.betweenness(N.linked_nodes(edges), edges, **how)[0]) for how in ({}, {"pivots": 4, "exact": 6}))
    assert all(part[k] == pytest.approx(whole[k]) for k in part if k[0] == 1) and any(abs(part[k] - whole[k]) > 1e-6 for k in part if k[0] == 2)


def test_cheapest_script_whatever_the_names():
    """A free text under the name hk gives way to the kind of healing under another name."""
    from meshwright.operators import schema_drift as S

    record = {"u": 1, "v": 2, "w": 3.5, "hk": "checked by hand, nothing to report", "heal_kind": "canopy"}
    paths = S.field_paths(record)
    assert paths["hk"] == ("heal_kind", "canopy") and paths["u"][0] == "u" and paths["w"][0] == "w"
    assert S.field_paths({"u": 1, "v": 2, "hk": "canopy", "heal_kind": "checked by hand"})["hk"][0] == "hk"
