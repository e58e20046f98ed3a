"""distances of all pairs leave their blocks in batches, and a component is worked out once for all its blocks."""

import pickle

import pytest

from meshwright.functions.paths import TileGraph
from meshwright.operators import network as N


@pytest.mark.parametrize("some", [False, True])
def test_blocks_share_what_their_piece_found(spark, monkeypatch, some):
    lines = [(1, k, k + 1, 7 + k % 3) for k in range(39)] + [(1, 0, 20, 2), (1, 50, 51, 3), (1, 60, 61, 4), (2, 1, 2, 4)]
    lines += [(3, a, b, 1 + a * b % 5) for a in range(90) for b in range(a)]  # would fill up, so it is searched source by source
    e = spark.createDataFrame(lines, "tile int, u long, v long, w long")
    n = N.linked_nodes(e).unionByName(spark.createDataFrame([(1, 99), (4, 7)], "tile int, id long"))
    if some:
        n = n.withColumn("active", N.F.expr("id % 3 = 0"))
    kept, plain = [], N.materialise
    monkeypatch.setattr(N, "materialise", lambda df, label: (kept.append(plain(df, label)), kept[-1])[1])
    for name, value in (("BLOCK", 16), ("PAIRS", 200), ("BATCH", 50)):
        monkeypatch.setattr(N, name, value)
    out = N.all_pairs(n, e)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got, want = sorted(map(tuple, out.collect())), []
    for tile, ids in {1: [*range(40), 50, 51, 60, 61, 99], 2: [1, 2], 3: [*range(90)], 4: [7]}.items():
        own = [x[1:] for x in lines if x[0] == tile]
        g = TileGraph(ids, *(zip(*own) if own else ([], [], [])))
        for s in ids:
            if not some or s % 3 == 0:
                want += [(tile, s, i, int(d)) for i, d in zip(ids, g.from_source(ids.index(s))[0]) if d < float("inf")]
    assert got == sorted(want)

    pieces = {}
    for tile, piece, blocks in kept[0].collect():
        g, sources = pickle.loads(piece)
        pieces.setdefault(tile, []).append((len(g.ids), blocks, all(p[4] for p in g.parts() if len(p[0]) > 1)))
        assert blocks <= len(sources)
    assert sorted(pieces[1]) == ([(1 + 2 * 2, 1, True), (40, 2, True)] if some else [(5, 1, True), (40, 8, True)])
    assert pieces[3] == [(90, 13 if some else 40, True)]
