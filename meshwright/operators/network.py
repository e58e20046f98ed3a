"""Network analytics over tiles. A tile is one image, so its graph is bounded by the image size
and fits a task; work spreads over tiles and, for all-pairs work, over blocks of sources in the
components, as no path leaves one."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from meshwright.functions.centrality import take_apart
from meshwright.functions.paths import TileGraph, ablate, flood, labels
from meshwright.operators.ranges import within
from meshwright.planning.joins import merged
from meshwright.planning.lineage import materialise

#: Sources of one component that one task takes; smaller components share a task up to so many nodes.
BLOCK = 2048

#: Pairs that a block of ``all_pairs`` hands out, and a batch of them.
PAIRS, BATCH = 1 << 23, 1 << 19


#: Pairs inside a network's blocks that one task searches, at most so many tasks a block; blocks with fewer pairs stay in their tile's task.
BLOCK_PAIRS, BLOCK_TASKS, OWN_PAIRS = 1 << 22, 48, 1 << 18


#: Distances that a block of ``trips`` holds at a time.
CELLS = 1 << 21


def ends(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: tile, a, b, w."""
    one = edges.select("tile", F.col("u").alias("a"), F.col("v").alias("b"), "w")
    return one.unionByName(edges.select("tile", F.col("v").alias("a"), F.col("u").alias("b"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("tile", F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def linked_nodes(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("tile", "id")


def per_tile(nodes: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    """``run(tile, nodes, edges)`` for every tile that has nodes, as pandas frames; tiles are spread, as work grows faster than bytes."""

    def both(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return run(key[0], n.sort_values("id"), e)

    return _spread(_own(nodes), "tile").groupBy("tile").cogroup(_spread(_own(edges), "tile").groupBy("tile")).applyInPandas(both, schema)


def _own(df: DataFrame) -> DataFrame:
    """The same columns under fresh identities: both sides may stem from one frame."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together (without keys: in turn), in so many partitions that few heavy ones stay apart; their bytes do not tell how heavy they are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def _placed(nodes: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """The active nodes' blocks: tile, id, and the piece of the tile that holds the node, its number of blocks and the node's own.

    A piece is a component, or several small ones with up to ``block`` nodes. Nodes that are not
    active have the block -1; pieces without an active node are left out.
    """
    mark = ["mark"] if "mark" in nodes.columns else []
    kind = nodes.schema["tile"].dataType.simpleString()
    marks = f"mark {nodes.schema['mark'].dataType.simpleString()}, " if mark else ""

    def run(tile, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids = n.id.to_numpy()
        label = labels(len(ids), np.searchsorted(ids, e.u), np.searchsorted(ids, e.v))
        size = np.bincount(label, minlength=len(ids))[label]
        by = np.lexsort((label, size))  # small ones first
        first = np.r_[True, label[by][1:] != label[by][:-1]]
        before = np.arange(len(by))[first]
        shared = np.cumsum(np.r_[True, (before[1:] // block != before[:-1] // block) | (size[by][first][1:] > block)]) - 1
        piece = np.empty(len(ids), np.int64)
        piece[by] = shared[np.cumsum(first) - 1]
        active = n.active.to_numpy(bool)
        own = np.full(len(ids), -1)
        at = np.flatnonzero(active)[np.argsort(piece[active], kind="stable")]
        own[at] = (np.arange(len(at)) - np.searchsorted(piece[at], piece[at])) // block
        blocks = -(-np.bincount(piece[active], minlength=piece.max() + 1) // block)[piece]
        out = pd.DataFrame({"tile": tile, "id": ids, **{c: n[c].to_numpy() for c in mark}, "piece": piece, "home": own, "blocks": blocks})
        return out[blocks > 0]

    base = nodes if "active" in nodes.columns else nodes.withColumn("active", F.lit(True))
    placed = per_tile(base.select("tile", "id", "active", *mark), edges, run, f"tile {kind}, id long, {marks}piece long, home long, blocks long")
    return materialise(placed, "pieces")


def per_source_block(nodes: DataFrame, edges: DataFrame, run, schema: str, block: int | None = None) -> DataFrame:
    """``run(tile, sources, ids, edges)`` for every block of sources of a piece of a tile; see ``_placed``.

    Each block gets the nodes and edges of its piece only, as nothing else can be reached. A
    boolean column ``active`` of ``nodes`` limits the sources; with a column ``mark`` the piece's
    marked nodes (neither false nor 0) and their marks are a fifth argument. ``nodes`` holds the ends of all edges.
    """
    mark = ["mark"] if "mark" in nodes.columns else []
    placed = _placed(nodes, edges, block or BLOCK)
    copies = lambda df: _spread(df.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks"), "tile", "piece", "b")

    def both(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("id")
        return run(key[0], n.id[n.home == key[2]].tolist(), n.id.to_numpy(), e, *([{k: m for k, m in zip(n.id.tolist(), n.mark.tolist()) if m}] if mark else []))

    home = placed.select("tile", F.col("id").alias("u"), "piece", "blocks")
    lines = copies(_own(edges.select("tile", "u", "v", "w")).join(merged(home), ["tile", "u"]))
    return copies(_own(placed)).groupBy("tile", "piece", "b").cogroup(lines.groupBy("tile", "piece", "b")).applyInPandas(both, schema)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile, id, comp): the least node of each node's component."""

    def run(tile, n, e):
        ids = np.unique(np.concatenate([n.id, e.u, e.v]).astype(np.int64))
        return pd.DataFrame({"tile": tile, "id": ids, "comp": ids[labels(len(ids), np.searchsorted(ids, e.u), np.searchsorted(ids, e.v))]})

    return per_tile(nodes, edges, run, "tile int, id long, comp long")


def all_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile, s, n, d) of every ordered pair with a path, s itself included (of the active sources only).

    A tile's task works out each component once; blocks of about ``PAIRS`` pairs then share what it found, and hand
    their pairs out in batches, so that no task holds a block's pairs. ``nodes`` holds the ends of all edges.
    """

    def pieces(tile, n, e):
        g = TileGraph(n.id, e.u, e.v, e.w)
        active = n.active.to_numpy(bool)
        held, size, rows = [], 0, []
        parts = sorted((p for p in g.parts() if active[p[0]].any()), key=lambda p: len(p[0]))  # small ones first, they share a piece
        for k, part in enumerate(parts):
            held.append(part[0])
            size += len(part[0])
            if k + 1 == len(parts) or size + len(parts[k + 1][0]) > BLOCK:
                own = g.part(np.sort(np.concatenate(held)))
                sources = np.flatnonzero(active[np.searchsorted(g.ids, own.ids)])
                rows.append((tile, pickle.dumps((own, sources)), min(len(sources), max(1, len(sources) * size // PAIRS))))
                held, size = [], 0
        return pd.DataFrame(rows, columns=["tile", "piece", "blocks"])

    def run(batches):
        rows, count = [], 0
        for batch in batches:
            for at in batch.to_pylist():
                g, sources = pickle.loads(at["piece"])
                lo, hi = (len(sources) * k // at["blocks"] for k in (at["b"], at["b"] + 1))
                for which, who, d in g.batches(sources[lo:hi]):
                    from_, to = g.ids[sources[lo:hi][which]], g.ids[who]
                    step = max(1, BATCH // len(who))
                    for j in range(0, len(which), step):
                        far = d[:, j : j + step].T.astype(np.int64).ravel()
                        rows.append((np.full(len(far), at["tile"], np.int32), np.repeat(from_[j : j + step], len(who)), np.tile(to, len(far) // len(who)), far))
                        count += len(far)
                        if count >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["tile", "s", "n", "d"])
                            rows, count = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["tile", "s", "n", "d"])

    base = nodes if "active" in nodes.columns else nodes.withColumn("active", F.lit(True))
    found = materialise(per_tile(base.select("tile", "id", "active"), edges.select("tile", "u", "v", "w"), pieces, "tile int, piece binary, blocks long"), "pieces")
    return _spread(found.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))).mapInArrow(run, "tile int, s long, n long, d long")


def inverse_sums(nodes: DataFrame, edges: DataFrame, unit: float = 1000.0) -> DataFrame:
    """(tile, t): the sum of ``unit`` / distance over ordered pairs with a path; one row leaves a block of sources."""

    def run(tile, sources, ids, e):
        g = TileGraph(ids, e.u, e.v, e.w)
        return pd.DataFrame({"tile": [tile], "part": [g.inverse_sum(np.searchsorted(g.ids, sources), None, unit)]})

    parts = per_source_block(nodes, edges, run, "tile int, part double")
    return parts.groupBy("tile").agg(F.sum("part").alias("t"))


def mean_inverse(nodes: DataFrame, edges: DataFrame, unit: float = 1000.0) -> DataFrame:
    """(tile, n, eff): mean inverse distance over ordered pairs of the tile's nodes."""
    return _mean(nodes, inverse_sums(nodes, edges, unit))


def _mean(nodes: DataFrame, total: DataFrame) -> DataFrame:
    size = nodes.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.coalesce("t", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)))
    return size.join(total, "tile", "left").select("tile", "n", value.alias("eff"))


def efficiency(pairs: DataFrame, nodes: DataFrame, unit: float = 1000.0) -> DataFrame:
    """(tile, n, eff) from the distances of all pairs, where those are at hand anyway."""
    return _mean(nodes, pairs.filter("d > 0").groupBy("tile").agg(F.sum(F.lit(unit) / F.col("d")).alias("t")))


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: int | None = None, seed: int = 42, exact: int = 0) -> tuple[DataFrame, DataFrame]:
    """Node (tile, id, bc) and edge (tile, u, v, bc) betweenness.

    Each task adds up its block's sources; sums over blocks are plain aggregates. With ``pivots``
    only so many sources of a tile of more than ``exact`` nodes are used, chosen by hash, and scores scaled up.
    """
    sources = nodes.select("tile", "id")

    def run(tile, block, ids, e):
        g = TileGraph(ids, e.u, e.v, e.w)
        node, edge = np.zeros(g.n), {}
        for s in block:
            g.dependencies(int(np.searchsorted(g.ids, s)), None, node, edge)
        rows = pd.DataFrame({"tile": tile, "u": g.ids, "v": -1, "part": node, "used": 0})
        if edge:
            k = np.array(list(edge))
            rows = pd.concat([rows, pd.DataFrame({"tile": tile, "u": g.ids[k[:, 0]], "v": g.ids[k[:, 1]], "part": list(edge.values()), "used": 0})])
        return rows

    if pivots:
        order = F.row_number().over(W.partitionBy("tile").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
        count = F.count(F.lit(1)).over(W.partitionBy("tile"))
        sources = sources.withColumn("active", (count <= exact) | (order <= pivots))
    parts = per_source_block(sources, edges, run, "tile int, u long, v long, part double, used long", min(BLOCK, 64))
    size = sources.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    scale = F.lit(1.0) if not pivots else F.when(F.col("n") <= exact, 1.0).otherwise(F.col("n") / F.least(F.col("n"), F.lit(pivots)))
    sums = parts.groupBy("tile", "u", "v").agg(F.sum("part").alias("t")).join(size, "tile")
    node = sums.filter("v < 0").select(
        "tile", F.col("u").alias("id"), (F.col("t") * scale / F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)).alias("bc")
    )
    edge = sums.filter("v >= 0").select("tile", "u", "v", (F.col("t") * scale / (F.col("n") * (F.col("n") - 1))).alias("bc"))
    return node, edge


def node_betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(tile, id, bc), exact at any size: every node is a source and a target.

    A tile's task takes its graph apart and works out the small blocks (see ``functions/centrality.py``); large ones are
    spread by their sources. ``nodes`` holds the ends of all edges.
    """

    def pieces(tile, n, e):
        g = TileGraph(n.id, e.u, e.v, e.w)
        score, blocks = take_apart(g)
        rows = []
        for block in blocks:
            size, sources = len(block.who), np.arange(len(block.who))
            if size * size <= OWN_PAIRS:
                score[block.who] += block.carried(sources)
            else:
                block.carried(sources[:0])  # the way it is searched goes along
                rows.append((tile, g.n, pickle.dumps((g.ids[block.who], block)), min(BLOCK_TASKS, -(-size * size // BLOCK_PAIRS))))
        return pd.DataFrame([(tile, g.n, pickle.dumps((g.ids, score)), 1), *rows], columns=["tile", "n", "piece", "tasks"])

    def run(batches):
        for batch in batches:
            for at in batch.to_pylist():
                ids, part = pickle.loads(at["piece"])
                if not isinstance(part, np.ndarray):
                    lo, hi = (len(ids) * k // at["tasks"] for k in (at["b"], at["b"] + 1))
                    part = part.carried(np.arange(lo, hi))
                rows = [pa.array(np.full(len(ids), at["tile"], np.int32)), pa.array(ids), pa.array(part), pa.array(np.full(len(ids), at["n"], np.int64))]
                yield pa.RecordBatch.from_arrays(rows, names=["tile", "id", "part", "n"])

    found = per_tile(nodes.select("tile", "id"), edges.select("tile", "u", "v", "w"), pieces, "tile int, n long, piece binary, tasks long")
    found = materialise(found, "blocks")
    every = _spread(found.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))).mapInArrow(run, "tile int, id long, part double, n long")
    n = F.max("n")
    return every.groupBy("tile", "id").agg((F.sum("part") / F.when(n > 2, (n - 1) * (n - 2)).otherwise(1)).alias("bc"))


def tiers(scores: DataFrame) -> DataFrame:
    """critical from the 90th percentile of the non-zero scores, important from the 75th, else normal."""
    cuts = scores.filter("bc > 1e-9").groupBy("tile").agg(F.percentile("bc", F.array(F.lit(0.75), F.lit(0.9))).alias("p"))
    tier = F.when((F.col("bc") > 1e-9) & (F.col("bc") >= F.col("p")[1]), "critical").when((F.col("bc") > 1e-9) & (F.col("bc") >= F.col("p")[0]), "important")
    return scores.join(cuts, "tile", "left").select("tile", "id", "bc", tier.otherwise("normal").alias("tier"))


def road_density(nodes: DataFrame, edges: DataFrame, radius: float = 150.0) -> DataFrame:
    """(tile, id, demand): length of the edges whose midpoint lies within ``radius`` of the node."""
    at = nodes.select("tile", "id", "x", "y")
    a = at.select("tile", F.col("id").alias("u"), F.col("x").alias("xu"), F.col("y").alias("yu"))
    b = at.select("tile", F.col("id").alias("v"), F.col("x").alias("xv"), F.col("y").alias("yv"))
    mid = edges.join(merged(a), ["tile", "u"]).join(merged(b), ["tile", "v"]).select(
        "tile", ((F.col("xu") + F.col("xv")) / 2).alias("x"), ((F.col("yu") + F.col("yv")) / 2).alias("y"), "w"
    )
    near = within(at, ["tile"], radius, mid).groupBy("tile", F.col("id_a").alias("id")).agg(F.sum("w_b").alias("total"))
    return at.select("tile", "id").join(merged(near), ["tile", "id"], "left").select("tile", "id", F.coalesce("total", F.lit(0)).alias("demand"))


def service(scores: DataFrame, demand: DataFrame) -> DataFrame:
    """(tile, id, demand, svc): score weighed by demand, both by the tile's maximum (a zero maximum counts as 1)."""
    w = W.partitionBy("tile")
    top = lambda c: F.when(F.max(c).over(w) > 0, F.max(c).over(w)).otherwise(1)
    raw = scores.join(merged(demand), ["tile", "id"]).withColumn("raw", F.col("bc") * (F.col("demand") / top("demand")))
    return raw.select("tile", "id", "demand", F.round(F.col("raw") / top("raw"), 4).alias("svc"))


def k_hops(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(tile, id, near): every node at most ``hops`` edges away, the start too."""
    beyond = ends(edges).groupBy("tile", F.col("a").alias("near")).agg(F.collect_list("b").alias("beyond"))
    seen = starts.select("tile", "id", F.col("id").alias("near"))
    for _ in range(hops):  # a node stands for itself and its neighbours, so a hop reads the one before once
        step = F.explode(F.concat(F.array("near"), F.coalesce("beyond", F.array().cast("array<long>"))))
        seen = seen.join(merged(_own(beyond)), ["tile", "near"], "left").select("tile", "id", step.alias("near")).distinct()
    return seen


def directions(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(tile, id, angle): principal direction of the neighbourhood in degrees, [0, 180); null if it has none."""
    at = nodes.select("tile", F.col("id").alias("near"), "x", "y")
    s = k_hops(edges, starts, hops).join(merged(at), ["tile", "near"]).groupBy("tile", "id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"),
    )
    cross = 2 * (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"))
    diff = (F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")) - (F.col("n") * F.col("yy") - F.col("sy") * F.col("sy"))
    angle = F.pmod(F.degrees(F.atan2(cross.cast("double"), diff.cast("double"))) / 2, F.lit(180.0))
    return s.select("tile", "id", F.when((cross != 0) | (diff != 0), angle).alias("angle"))


def gap_pairs(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Endpoint pairs of different components at most ``radius`` apart: tile, a, b, d2."""
    tips = degrees(edges).filter("degree = 1").select("tile", "id")
    known = nodes.select("tile", "id", "x", "y").join(merged(tips), ["tile", "id"], "left_semi")
    known = known.join(merged(components(linked_nodes(edges), edges)), ["tile", "id"])
    d2 = (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b")) + (F.col("y_a") - F.col("y_b")) * (F.col("y_a") - F.col("y_b"))
    return within(known, ["tile"], radius).filter("id_a < id_b and comp_a <> comp_b").select(
        "tile", F.col("id_a").alias("a"), F.col("id_b").alias("b"), d2.alias("d2")
    )


def stats(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """Per tile: nodes, edges, components, largest component and its share, total length."""
    sizes = comps.groupBy("tile", "comp").agg(F.count(F.lit(1)).alias("c"))
    whole = sizes.groupBy("tile").agg(F.sum("c").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("c").alias("lcc_nodes"))
    length = edges.groupBy("tile").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("w"))
    return whole.join(length, "tile").select(
        "tile", "nodes", "edges", "components", "lcc_nodes", F.round(F.col("lcc_nodes") / F.col("nodes"), 4).alias("lcc_fraction"),
        F.round(F.col("w") / 1000.0, 1).alias("total_length"),
    )


def ablation(nodes: DataFrame, edges: DataFrame, top_k: int = 8, unit: float = 1000.0) -> DataFrame:
    """The removal curve of each tile; see ``paths.ablate``.

    A tile's task only picks the nodes; the efficiencies, nearly all of the work in a large component, follow by blocks of sources.
    """
    kind = nodes.schema["tile"].dataType.simpleString()

    def pick(tile, n, e):
        rows = ablate(TileGraph(n.id, e.u, e.v, e.w), top_k, None)
        out = pd.DataFrame([(r[0], r[1], r[2], r[5]) for r in rows], columns=["step", "removed", "betweenness", "lcc_fraction"])
        out.insert(0, "tile", tile)
        out["removed"] = out["removed"].astype("Int64")
        return out.assign(n=len(n))

    def sums(tile, sources, ids, e, steps):
        g = TileGraph(ids, e.u, e.v, e.w)
        at, gone = np.searchsorted(g.ids, sources), np.zeros(g.n, bool)
        part = [g.inverse_sum(at, None, unit)]
        for step in range(1, top_k + 1):
            hit = [k for k, s in steps.items() if s == step]
            gone[np.searchsorted(g.ids, hit)] = True
            part.append(g.inverse_sum(at, gone, unit) if hit else part[-1])
        return pd.DataFrame({"tile": tile, "step": range(top_k + 1), "part": part})

    def curve(key, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        p, total, n = p.sort_values("step"), dict(zip(t.step, t.t)), int(p.n.iloc[0])
        eff = [total[s] / (n * (n - 1)) if n > 1 else 0.0 for s in p.step]
        base = eff[0]
        ratio = [1.0 if not s else round(x / base, 4) if base else 0.0 for s, x in zip(p.step, eff)]
        return p.assign(resilience_index=ratio, global_efficiency=[round(x, 6) for x in eff])[["tile", "step", "removed", "betweenness", "resilience_index", "global_efficiency", "lcc_fraction"]]

    picked = materialise(per_tile(nodes, edges, pick, f"tile {kind}, step int, removed long, betweenness double, lcc_fraction double, n long"), "removals")
    gone = picked.filter("removed is not null").select("tile", F.col("removed").alias("id"), F.col("step").alias("mark"))
    marked = nodes.select("tile", "id").join(merged(gone), ["tile", "id"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    parts = per_source_block(marked, edges, sums, f"tile {kind}, step int, part double")
    totals = parts.groupBy("tile", "step").agg(F.sum("part").alias("t"))
    schema = f"tile {kind}, step int, removed long, betweenness double, resilience_index double, global_efficiency double, lcc_fraction double"
    return _own(picked).groupBy("tile").cogroup(_own(totals).groupBy("tile")).applyInPandas(curve, schema)


def flooding(nodes: DataFrame, edges: DataFrame, levels: int = 12, low: float = 2, high: float = 88) -> DataFrame:
    """The flood curve of each tile; ``nodes`` brings ``elev``; see ``paths.flood``."""

    def run(tile, n, e):
        g = TileGraph(n.id, e.u, e.v, e.w)
        rows = flood(g, n.elev.to_numpy(), levels, low, high, 1000.0)
        out = pd.DataFrame(rows, columns=["step", "water_level", "submerged_frac", "resilience_index", "lcc_fraction"])
        out.insert(0, "tile", tile)
        return out

    return per_tile(nodes, edges, run, "tile int, step int, water_level double, submerged_frac double, resilience_index double, lcc_fraction double")


def without(edges: DataFrame, disabled: DataFrame) -> DataFrame:
    """Edges with neither end among the disabled (tile, id)."""
    for end in ("u", "v"):
        edges = edges.join(merged(disabled.select("tile", F.col("id").alias(end)).distinct()), ["tile", end], "left_anti")
    return edges.select("tile", "u", "v", "w")


def what_if(nodes: DataFrame, edges: DataFrame, disabled: DataFrame) -> DataFrame:
    """Per tile: efficiency before and after closing nodes, and their ratio (0 where there was none)."""
    left = nodes.join(merged(disabled.select("tile", "id").distinct()), ["tile", "id"], "left_anti")
    base = mean_inverse(nodes, edges).select("tile", "n", F.col("eff").alias("base"))
    after = inverse_sums(left, without(edges, disabled))
    eff = F.when(F.col("n") > 1, F.coalesce("t", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    out = base.join(after, "tile", "left").withColumn("eff", eff)
    return out.select("tile", F.round("base", 8).alias("base_eff"), F.round("eff", 8).alias("eff"), F.round(F.when(F.col("base") > 0, F.col("eff") / F.col("base")).otherwise(0.0), 3).alias("r"))


def stride_pairs(nodes: DataFrame, edges: DataFrame, samples: int = 40) -> DataFrame:
    """(tile, s, t): every k-th of a tile's reachable pairs s < t in order, k a ``samples``-th of their number.

    Pairs are counted, never listed: a source has as many as its component has later nodes.
    """

    def run(tile, n, e):
        g = TileGraph(n.id, e.u, e.v, e.w)
        comp = g.components()
        members = {c: np.flatnonzero(comp == c) for c in np.unique(comp)}
        rank = np.empty(g.n, np.int64)
        later = np.empty(g.n, np.int64)
        for who in members.values():
            rank[who] = np.arange(len(who))
            later[who] = len(who) - 1 - np.arange(len(who))
        ends = np.cumsum(later)
        total = int(ends[-1]) if g.n else 0
        picked = np.arange(0, total, max(1, total // samples))
        s = np.searchsorted(ends, picked, side="right")
        nth = picked - (ends[s] - later[s])
        t = [members[comp[a]][rank[a] + 1 + k] for a, k in zip(s.tolist(), nth.tolist())]
        return pd.DataFrame({"tile": tile, "s": g.ids[s], "t": g.ids[np.array(t, np.int64)]})

    return per_tile(nodes, edges, run, "tile int, s long, t long")


def trips(nodes: DataFrame, edges: DataFrame, disabled: DataFrame) -> DataFrame:
    """(tile, routes, severed, delay): all reachable pairs s < t, those cut by closing nodes, and the sum of the others' relative delays.

    A block of sources hands out its sums only.
    """
    shut = disabled.select("tile", "id").distinct().withColumn("mark", F.lit(True))
    marked = nodes.select("tile", "id").join(merged(shut), ["tile", "id"], "left").withColumn("mark", F.coalesce("mark", F.lit(False)))

    def run(tile, sources, ids, e, closed):
        g = TileGraph(ids, e.u, e.v, e.w)
        left = e[~(e.u.isin(closed.keys()) | e.v.isin(closed.keys()))]
        after = TileGraph(ids, left.u, left.v, left.w)
        at, routes, severed, delay = np.searchsorted(g.ids, sources), 0, 0, 0.0
        step = max(1, CELLS // max(1, g.n))
        for lo in range(0, len(at), step):
            s = at[lo : lo + step]
            d0, d1 = g.distances(s), after.distances(s)
            on = np.isfinite(d0) & (np.arange(g.n) > s[:, None])
            open_ = on & np.isfinite(d1)
            routes, severed = routes + int(on.sum()), severed + int(on.sum() - open_.sum())
            delay += float((d1[open_] / d0[open_] - 1).sum())
        return pd.DataFrame({"tile": [tile], "routes": [routes], "severed": [severed], "delay": [delay]})

    parts = per_source_block(marked, edges, run, "tile int, routes long, severed long, delay double")
    return parts.groupBy("tile").agg(*[F.sum(c).alias(c) for c in ("routes", "severed", "delay")])


def longest_through(nodes: DataFrame, edges: DataFrame, through: DataFrame) -> DataFrame:
    """(tile, src, dst, through, length): the longest shortest path over each tile's node in ``through`` (tile, id).

    Of equal ones that with the least ends. A block hands out its best pair only.
    """
    marked = nodes.select("tile", "id").join(merged(through.select("tile", "id").withColumn("mark", F.lit(True))), ["tile", "id"], "left")
    columns = ["tile", "src", "dst", "through", "length"]

    def run(tile, sources, ids, e, over):
        g = TileGraph(ids, e.u, e.v, e.w)
        rows = []
        for gate in over:
            k = int(np.searchsorted(g.ids, gate))
            to_gate = g.distances([k])[0]
            owner = g.components()
            reach = [s for s in np.searchsorted(g.ids, sources).tolist() if owner[s] == owner[k]]
            for lo in range(0, len(reach), 64):
                s = np.array(reach[lo : lo + 64])
                d = g.distances(s)
                on = np.isfinite(d) & (d[:, [k]] + to_gate == d) & (np.arange(g.n) > s[:, None])
                on[:, k] = False
                on[s == k] = False
                if on.any():
                    top = np.where(on, d, -1)
                    i, j = np.unravel_index(int(np.argmax(top)), top.shape)  # the first in order of source, then end
                    rows.append((tile, g.ids[s[i]], g.ids[j], gate, int(d[i, j])))
        rows = sorted(rows, key=lambda r: (-r[4], r[1], r[2]))[:1]
        return pd.DataFrame(rows, columns=columns)

    best = per_source_block(marked.withColumn("mark", F.coalesce("mark", F.lit(False))), edges, run, "tile int, src long, dst long, through long, length long")
    first = F.min(F.struct((-F.col("length")).alias("k"), "src", "dst", "through", "length")).alias("m")
    return best.groupBy("tile").agg(first).select("tile", "m.src", "m.dst", "m.through", "m.length")
