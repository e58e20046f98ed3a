"""Invariants of tracing, healing, resilience and benchmarks, and kernels against brute force."""

import itertools

import numpy as np
import pytest

from meshwright.functions import raster_kernels as K
from meshwright.functions.paths import TileGraph, ablate, flood
from meshwright.operators import heal as H, network as N, raster as R
from meshwright.streaming import closures


def gap_mask(gap):
    m = np.zeros((128, 128), bool)
    m[63:66, 4 : 64 - gap // 2] = True
    m[63:66, 64 + gap // 2 : 124] = True
    return m


def traced(gap):
    at, edges = K.trace(K.skeleton(gap_mask(gap)))
    return dict(enumerate(at)), [(u, v) for u, v, _, _ in edges], edges


def gaps(at, edges, limit):
    g = TileGraph(list(at), [e[0] for e in edges], [e[1] for e in edges], [1.0] * len(edges))
    comp = g.components()
    tips = [k for k in at if sum(k in e for e in edges) == 1]
    out = []
    for a, b in itertools.combinations(tips, 2):
        d = float(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]))
        if comp[a] != comp[b] and d <= limit:
            out.append((d, a, b))
    return out


def healed(gap, max_gap, angle=35.0, prob=None):
    at, edges, _ = traced(gap)
    return H.bridge(at, edges, gaps(at, edges, max_gap), H.Gates(max_gap=max_gap, angle=angle), H.Evidence(prob=prob))


def line(n, step=10.0):
    return TileGraph(range(n), range(n - 1), range(1, n), [step] * (n - 1))


def test_mask_to_graph():
    at, edges, full = traced(20)
    g = TileGraph(list(at), [e[0] for e in edges], [e[1] for e in edges], [e[2] for e in full])
    assert len(np.unique(g.components())) == 2 and len(at) >= 2 and all(e[2] > 0 for e in full)


def test_heal_bridges_a_collinear_gap():
    made = healed(20, 40)
    assert len(made) >= 1 and all(m["heal_kind"] in ("canopy", "geom") and m["weight"] > 0 for m in made)


def test_heal_respects_the_gap_and_components():
    assert healed(60, 30) == []
    at = {0: (0, 0), 1: (50, 0), 2: (100, 0)}
    assert gaps(at, [(0, 1), (1, 2)], 500) == []


def test_evidence_traces_and_vetoes():
    prob = np.zeros((128, 128))
    assert healed(20, 40, prob=prob) == []
    prob[62:67] = 0.4
    made = healed(30, 50, prob=prob)
    assert any(m["heal_kind"] == "trace" and m["pts"] and 0 <= m["evidence"] <= 1 for m in made)


def test_efficiency_falls_as_nodes_go():
    g = line(5)
    gone = np.zeros(5, bool)
    values = [g.efficiency(5)]
    for k in (2, 1):
        gone[k] = True
        values.append(g.efficiency(5, gone))
    assert values == pytest.approx([0.0641666667, 0.02, 0.01])
    assert g.node_betweenness() == pytest.approx([0, 0.5, 2 / 3, 0.5, 0])


def test_ablation_on_a_grid():
    ids = {(r, c): r * 4 + c for r in range(4) for c in range(4)}
    pairs = [(ids[r, c], ids[r + dr, c + dc]) for (r, c) in ids for dr, dc in ((0, 1), (1, 0)) if (r + dr, c + dc) in ids]
    g = TileGraph(range(16), [a for a, _ in pairs], [b for _, b in pairs], [10.0] * len(pairs))
    curve = [row[3] for row in ablate(g, 5)]
    assert curve[0] == 1 and all(0 <= r <= 1 for r in curve) and curve == sorted(curve, reverse=True)
    wet = flood(g, np.arange(16.0), 12, 2, 88)
    # the dry step stands for the lowest of the 12 levels
    assert len(wet) == 12 and wet[0][3] == 1 and wet[-1][2] > wet[1][2]
    levels = np.linspace(np.percentile(np.arange(16.0), 2), np.percentile(np.arange(16.0), 88), 12)
    assert [r[1] for r in wet] == [round(float(x), 1) for x in levels]


def test_betweenness_by_enumeration():
    rng = np.random.default_rng(5)
    n = 8
    pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.45]
    w = rng.integers(1, 4, len(pairs)).astype(float)
    g = TileGraph(range(n), [a for a, _ in pairs], [b for _, b in pairs], w)
    near = {**{p: x for p, x in zip(pairs, w)}, **{p[::-1]: x for p, x in zip(pairs, w)}}
    score = np.zeros(n)
    for s, t in itertools.permutations(range(n), 2):
        paths, best = [], float("inf")
        stack = [([s], 0.0)]
        while stack:
            path, d = stack.pop()
            if path[-1] == t:
                if d < best:
                    paths, best = [], d
                if d == best:
                    paths.append(path)
                continue
            stack += [([*path, b], d + near[path[-1], b]) for b in range(n) if b not in path and (path[-1], b) in near and d + near[path[-1], b] <= best]
        for path in paths:
            for k in path[1:-1]:
                score[k] += 1 / len(paths)
    assert g.node_betweenness() == pytest.approx(score / ((n - 1) * (n - 2)))


def random_graph(seed, n=40, share=0.08):
    rng = np.random.default_rng(seed)
    pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < share]
    return TileGraph(range(n), [a for a, _ in pairs], [b for _, b in pairs], rng.integers(1, 9, len(pairs)).astype(float))


@pytest.mark.parametrize("seed", range(6))
def test_distances_of_all_sources_at_once(seed):
    g = random_graph(seed)
    gone = np.random.default_rng(seed).random(g.n) < 0.2
    for closed in (None, gone):
        want = np.array([g.from_source(s, closed)[0] for s in range(g.n)])
        assert (g.distances(np.arange(g.n), closed) == want).all()
        assert (g.distances(np.arange(g.n), closed, rounds=2) == want).all()
    assert TileGraph([1, 2], [], [], []).distances([0]).tolist() == [[0.0, float("inf")]]


def test_sampled_betweenness_scales_up():
    g = random_graph(3, 60, 0.15)
    assert g.node_betweenness(None, 20, 100) == pytest.approx(list(g.node_betweenness()))
    assert np.corrcoef(g.node_betweenness(None, 40, 10), g.node_betweenness())[0, 1] > 0.8


def test_stride_pairs(spark):
    edges = [(1, k, k + 1, 1) for k in range(14)] + [(1, 20, 21, 1), (2, 0, 1, 1), (3, 5, 6, 1)]
    e = spark.createDataFrame(edges, "tile int, u long, v long, w long")
    n = N.linked_nodes(e).unionByName(spark.createDataFrame([(2, 9)], "tile int, id long"))
    got = sorted(map(tuple, N.stride_pairs(n, e, 10).collect()))
    every = [(1, s, t) for s in range(15) for t in range(s + 1, 15)] + [(1, 20, 21)]
    assert got == sorted(every[:: max(1, len(every) // 10)] + [(2, 0, 1), (3, 5, 6)])


def test_coverage_perfect_and_disjoint(spark):
    rows = [(1, y, x) for y in range(30, 33) for x in range(64)]
    far = [(1, y, x) for y in range(50, 53) for x in range(64)]
    a, b = (spark.createDataFrame(r, R.PX) for r in (rows, far))
    wide = R.dilate(a, K.ellipse(2))
    assert a.join(wide, ["tile", "y", "x"], "left_semi").count() == len(rows)
    assert b.join(wide, ["tile", "y", "x"], "left_semi").count() == 0


def test_drawing(spark):
    px = R.draw(spark.createDataFrame([(1, 10, 10, 50, 10)], "tile int, x0 int, y0 int, x1 int, y1 int"))
    assert px.count() == 41


def test_morphology_agrees_with_dense_kernels(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((32, 32)) < 0.3
    df = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], R.PX)
    for pairs in (K.ellipse(2), K.square(3)):
        got = {(r.y, r.x) for r in R.close(df, pairs, 32).collect()}
        assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(K.close(mask, pairs)))))


def test_structuring_elements():
    widths = lambda r: [sum(1 for dy, _ in K.ellipse(r) if dy == k) for k in range(-r, r + 1)]
    assert widths(2) == [1, 5, 5, 5, 1] and widths(3) == [1, 5, 7, 7, 7, 5, 1]


def test_conn_report_counts(spark):
    nodes = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 10, 0)], "tile int, id long, x long, y long")
    none = spark.createDataFrame([], "tile int, u long, v long, w long")
    one = spark.createDataFrame([(1, 0, 1, 10)], none.schema)
    assert N.components(nodes, none).select("comp").distinct().count() == 2
    assert N.components(nodes, one).select("comp").distinct().count() == 1
    assert N.efficiency(N.all_pairs(nodes, none), nodes).first().eff == 0


def test_blocks_of_sources_add_up(spark):
    rng = np.random.default_rng(4)
    pairs = sorted({tuple(sorted(map(int, rng.choice(30, 2, replace=False)))) for _ in range(60)})
    edges = spark.createDataFrame([(1, a, b, int(rng.integers(1, 9))) for a, b in pairs], "tile int, u long, v long, w long").cache()
    nodes = N.linked_nodes(edges)
    g = TileGraph([], *(np.array(c) for c in zip(*[(r.u, r.v, r.w) for r in edges.collect()])))
    N.BLOCK = 7
    got = {r.id: r.bc for r in N.betweenness(nodes, edges)[0].collect()}
    assert [got[int(k)] for k in g.ids] == pytest.approx(list(g.node_betweenness()))


def test_hidden_stream(spark):
    folder = "/root/testdata/sf0.001"
    try:
        stream = closures.closed_per_window(closures.closure_events(spark, folder))
    except Exception:
        pytest.skip("no test tables")
    total = closures.drain(stream, "closed").agg({"closures": "sum"}).first()[0]
    assert total == spark.read.parquet(f"{folder}/events.parquet").count()
