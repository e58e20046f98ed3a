"""Bridging gaps between loose ends of a network, shortest gaps first.

What can be said of a candidate by itself is said in columns: how long it is, how much of it lies
under canopy, how well the probability raster shows a road along it, and which gates it therefore
has to pass. Only what depends on bridges made before (whether both ends are still apart, and
which way they face) is left to an ordered pass over the tile's remaining candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from meshwright.functions.raster_kernels import cost_path, cost_paths
from meshwright.operators.network import _own, _spread, gap_pairs, linked_nodes
from meshwright.planning.joins import merged
from meshwright.planning.lineage import materialise


@dataclass(frozen=True)
class Gates:
    """Limits of healing. Fixed values, so that decisions come out the same."""

    max_gap: float = 60.0
    angle: float = 35.0
    hops: int = 3
    corridor: float = 16.0
    overlap: float = 0.5
    saturation: float = 0.6
    trace: float = 0.22
    veto: float = 0.04
    firm: float = 0.35
    stretch: float = 1.8
    canopy_gap: float | None = None
    canopy_angle: float | None = None

    @property
    def wide(self) -> tuple[float, float]:
        """Gap and angle under canopy."""
        gap = 1.6 * self.max_gap if self.canopy_gap is None else self.canopy_gap
        return gap, min(self.angle + 20, 70) if self.canopy_angle is None else self.canopy_angle

    @property
    def throttled(self) -> tuple[float, float]:
        """Gap and angle under canopy where the scene is saturated with it."""
        gap, angle = self.wide
        return min(gap, 1.25 * self.max_gap), min(angle, self.angle + 10)


def _where(condition, yes, no):
    """A choice for columns and for arrays alike."""
    if isinstance(condition, Column):
        return F.when(condition, yes).otherwise(no)
    return np.where(condition, yes, no)


def classify(gates: Gates, dist, over, green, evidence, walked) -> dict:
    """What a candidate is by itself, for columns and for arrays.

    ``over`` is the share of its span under canopy, -1 without a canopy raster; ``evidence`` the mean
    probability along its cheapest path of length ``walked``, -1 without a probability raster.
    ``traced`` candidates need no direction, ``plain`` ones must face each other within ``angle``,
    all others are out.
    """
    full = green >= gates.saturation
    gap, angle = (_where(full, a, b) for a, b in zip(gates.throttled, gates.wide))
    covered = over >= _where(full, max(gates.overlap, 0.65), gates.overlap)
    floor = _where(dist > 4.0, dist, 4.0)
    in_reach = dist <= _where((over >= 0) & (gap > gates.max_gap), gap, gates.max_gap)
    traced = in_reach & (evidence >= gates.trace) & (walked <= floor * gates.stretch)
    shown = covered | (evidence < 0) | (evidence >= gates.veto)
    plain = in_reach & ~traced & shown & (dist <= _where(covered, gap, gates.max_gap))
    return {
        "traced": traced,
        "plain": plain,
        "angle": _where(covered, angle, gates.angle),
        "weight": _where(traced, walked, dist),
        "heal_kind": _where(covered, "canopy", _where(traced, "trace", "geom")),
        "conf": _where(traced, _where(evidence >= gates.firm, "med", "low"), _where(covered, _where(full, "vlow", "low"), "med")),
    }


class _Ends:
    """The network of one tile while bridges are added: who is joined, and which way an end faces."""

    def __init__(self, at: dict[int, tuple[float, float]]):
        self.at = at
        self.near: dict[int, list[int]] = {k: [] for k in at}
        self.group: dict[int, set[int]] = {k: {k} for k in at}

    def add(self, a: int, b: int) -> None:
        self.near[a].append(b)
        self.near[b].append(a)
        large, small = sorted((self.group[a], self.group[b]), key=len, reverse=True)
        if large is not small:
            large |= small
            self.group.update(dict.fromkeys(small, large))

    def apart(self, a: int, b: int) -> bool:
        return self.group[a] is not self.group[b]

    def bridged(self, a: int, b: int, traced: bool, angle: float, gates: Gates) -> bool:
        """Join two ends that are apart, if they may be: traced, or facing each other."""
        p, q = self.at[a], self.at[b]
        if not traced and not _face_each_other(p, q, self.facing(a, gates.hops), self.facing(b, gates.hops), angle, gates.corridor):
            return False
        self.add(a, b)
        return True

    def facing(self, node: int, hops: int) -> float | None:
        """Principal axis of the places within ``hops`` edges, in [0, 180); null if there is none."""
        seen, rim = {node}, [node]
        for _ in range(hops):
            rim = list(dict.fromkeys(b for a in rim for b in self.near[a] if b not in seen))
            seen.update(rim)
        xy = np.array([self.at[k] for k in sorted(seen)], float)
        off = xy - xy.mean(axis=0)
        if len(seen) < 2 or np.allclose(off, 0):
            return None
        (xx, xy_), (_, yy) = off.T @ off
        return math.degrees(math.atan2(2 * xy_, xx - yy)) / 2 % 180


def _face_each_other(p, q, a: float | None, b: float | None, tolerance: float, corridor: float) -> bool:
    """Straight on at both ends, or both ends inside a common corridor; a missing direction agrees."""
    vx, vy = q[0] - p[0], q[1] - p[1]
    way = math.degrees(math.atan2(vy, vx))
    ends = [math.radians(x) for x in (a, b) if x is not None]
    turns = [abs((math.degrees(x) - way + 90) % 180 - 90) for x in ends]
    offsets = [abs(vx * math.sin(x) - vy * math.cos(x)) for x in ends]
    return all(t <= tolerance for t in turns) or all(o <= corridor for o in offsets)


def settle(at: dict, edges: list[tuple[int, int]], rows: list[tuple[float, int, int, bool, float]], gates: Gates) -> list[tuple[int, int]]:
    """The ordered pass: which of ``(dist, a, b, traced, angle)`` become bridges, in order."""
    net = _Ends(at)
    for u, v in edges:
        net.add(u, v)
    return [(a, b) for _, a, b, traced, angle in sorted(rows) if net.apart(a, b) and net.bridged(a, b, traced, angle, gates)]


@dataclass
class Evidence:
    """Rasters of one tile, for ``bridge``: dense canopy, share of green, road probability."""

    canopy: np.ndarray | None = None
    green: float = 0.0
    prob: np.ndarray | None = None


def bridge(at: dict, edges: list[tuple[int, int]], gaps: list[tuple[float, int, int]], gates: Gates, seen: Evidence) -> list[dict]:
    """The bridges of one tile held in memory; ``gaps`` holds (distance, a, b)."""
    if not gaps:
        return []
    walks = [cost_path(seen.prob, at[a], at[b]) if seen.prob is not None else (None, -1.0, 0.0) for _, a, b in gaps]
    over = np.array([_share(at[a], at[b], seen.canopy) if seen.canopy is not None else -1.0 for _, a, b in gaps])
    dist, evidence, walked = np.array([g[0] for g in gaps]), np.array([w[1] for w in walks]), np.array([w[2] for w in walks])
    facts = classify(gates, dist, over, np.full(len(gaps), seen.green), evidence, walked)
    place = {(a, b): k for k, (_, a, b) in enumerate(gaps)}
    rows = [(d, a, b, bool(facts["traced"][k]), float(facts["angle"][k])) for k, (d, a, b) in enumerate(gaps) if facts["traced"][k] or facts["plain"][k]]
    out = []
    for a, b in settle(at, edges, rows, gates):
        k = place[a, b]
        out.append({
            "u": a, "v": b, "weight": float(facts["weight"][k]), "heal_kind": str(facts["heal_kind"][k]), "conf": str(facts["conf"][k]), "canopy_frac": round(max(float(over[k]), 0.0), 3),
            "evidence": None if evidence[k] < 0 else round(float(evidence[k]), 3), "pts": walks[k][0] if facts["traced"][k] else None,
        })
    return out


#: Places at which a span is held against the canopy.
SAMPLES = 32


def _share(p, q, canopy: np.ndarray) -> float:
    y, x = (np.clip(np.linspace(p[k], q[k], SAMPLES).astype(int), 0, canopy.shape[1 - k] - 1) for k in (1, 0))
    return float(canopy[y, x].mean())


def span_overlap(spans: DataFrame, dense: DataFrame, size: int, wrap: bool = False) -> DataFrame:
    """``(tile, a, b, over)``: the share of ``SAMPLES`` places along each span that are dense pixels.

    ``spans`` has tile, a, b and the ends' places xa, ya, xb, yb; ``dense`` tile, y, x. Places beyond
    the raster are cut to its rim; with ``wrap`` it repeats instead.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))

    def at(c: str) -> Column:
        p, q = F.col(f"{c}a"), F.col(f"{c}b")
        along = F.when(F.col("i") == SAMPLES - 1, q).otherwise(p + F.col("i") * ((q - p) / (SAMPLES - 1)))
        pixel = along.cast("int")
        return (F.pmod(pixel, F.lit(size)) if wrap else F.least(F.greatest(pixel, F.lit(0)), F.lit(size - 1))).alias(c)

    places = spans.withColumn("i", step).select("tile", "a", "b", at("y"), at("x"))
    marked = dense.select("tile", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(1.0).alias("on")).distinct()
    return places.join(merged(marked), ["tile", "y", "x"], "left").groupBy("tile", "a", "b").agg(F.avg(F.coalesce("on", F.lit(0.0))).alias("over"))


def span_paths(spans: DataFrame, prob: DataFrame, size: int) -> DataFrame:
    """``(tile, a, b, evidence, walked, pts)``: the cheapest path of each span through its tile's raster."""

    def run(key, s: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        raster = np.zeros((size, size))
        raster[px.y, px.x] = px.p
        rows = []
        for a, own in s.groupby("a"):
            found = cost_paths(raster, (own.xa.iloc[0], own.ya.iloc[0]), list(zip(own.xb, own.yb)))
            rows += [(key[0], a, b, evidence, walked, [[float(y), float(x)] for y, x in pts]) for b, (pts, evidence, walked) in zip(own.b, found)]
        return pd.DataFrame(rows, columns=["tile", "a", "b", "evidence", "walked", "pts"])

    pixels = prob.select("tile", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("p").cast("double").alias("p"))
    kind = spans.schema["tile"].dataType.simpleString()
    schema = f"tile {kind}, a long, b long, evidence double, walked double, pts array<array<double>>"
    return _spread(_own(spans), "tile").groupBy("tile").cogroup(_spread(_own(pixels), "tile").groupBy("tile")).applyInPandas(run, schema)


#: Distances by which a tile's gaps are looked for, ring by ring, and pairs of loose ends that are held at a time.
RINGS, PAIRS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0), 1 << 21


def _gaps_by_rings(ids: np.ndarray, xy: np.ndarray, group, reach: float):
    """Gaps (distance, a, b) between ends of different groups, a < b, by distance, then a and b.

    ``group()`` tells the ends' groups as they are by now: those joined before a ring is reached are not listed in it, as
    none of them can become a bridge any more. A ring of more than ``PAIRS`` gaps is cut into thinner ones.
    """
    low, tops = -1.0, sorted({r for r in RINGS if r < reach} | {reach}, reverse=True)
    while tops:
        own, top = group(), tops[-1]
        _, which, size = np.unique(own, return_inverse=True, return_counts=True)
        few = np.flatnonzero(which != size.argmax()) if len(size) else []  # every gap has an end outside the largest group
        if not len(few):
            return
        thin = top - max(low, 0.0) > 1e-6
        found, count = [], 0
        for lo in range(0, len(few), step := max(1, PAIRS // len(ids))):
            i = few[lo : lo + step]
            dx, dy = xy[i, 0][:, None] - xy[:, 0], xy[i, 1][:, None] - xy[:, 1]
            d = np.sqrt(dx * dx + dy * dy)
            k, j = np.nonzero((d > low) & (d <= top) & (own[i][:, None] != own))
            found.append((d[k, j], np.minimum(ids[i[k]], ids[j]), np.maximum(ids[i[k]], ids[j])))
            count += len(k)
            if count > PAIRS and thin:
                break
        if count > PAIRS and thin:
            tops.append((max(low, 0.0) + top) / 2)
            continue
        d, a, b = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((b, a, d))
        d, a, b = d[by], a[by], b[by]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        yield from zip(d[once].tolist(), a[once].tolist(), b[once].tolist())
        low = tops.pop()


def along_raster(at: dict, edges: list[tuple[int, int]], raster: np.ndarray, gates: Gates) -> list[tuple]:
    """The bridges of one tile by a probability raster: (a, b, weight, kind, conf, evidence, points or None).

    A gap's path is searched only when its turn comes and its ends are still apart; all others stay unbridged whatever their path.
    """
    net, degree = _Ends(at), dict.fromkeys(at, 0)
    for u, v in edges:
        net.add(u, v)
        degree[u] += 1
        degree[v] += 1
    tips = np.array(sorted(k for k, n in degree.items() if n == 1), np.int64)
    xy = np.array([at[k] for k in tips.tolist()], float).reshape(-1, 2)
    made = []
    for d, a, b in _gaps_by_rings(tips, xy, lambda: np.array([id(net.group[k]) for k in tips.tolist()]), gates.max_gap):
        if not net.apart(a, b):
            continue
        pts, evidence, walked = cost_paths(raster, at[a], [at[b]])[0]
        facts = {k: v.item() for k, v in classify(gates, *(np.array([x]) for x in (d, -1.0, 0.0, evidence, walked))).items()}
        if (facts["traced"] or facts["plain"]) and net.bridged(a, b, facts["traced"], facts["angle"], gates):
            points = [[float(y), float(x)] for y, x in pts] if facts["traced"] else None
            made.append((a, b, float(facts["weight"]), facts["heal_kind"], facts["conf"], evidence, points))
    return made


def _healed_along(nodes: DataFrame, edges: DataFrame, gates: Gates, prob: DataFrame, size: int) -> DataFrame:
    """``heal`` with a probability raster alone: gaps are as many as pairs of loose ends, so none is written before it is a bridge."""
    nothing = lambda kind: F.lit(None).cast(kind)
    at = nodes.join(merged(linked_nodes(edges)), ["tile", "id"], "left_semi")
    pool = at.select("tile", F.col("id").alias("a"), nothing("long").alias("b"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).unionByName(
        edges.select("tile", F.col("u").alias("a"), F.col("v").alias("b"), nothing("double").alias("x"), nothing("double").alias("y"))
    )
    pixels = prob.select("tile", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("p").cast("double").alias("p"))
    kind = nodes.schema["tile"].dataType.simpleString()

    def run(key, p: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        raster = np.zeros((size, size))
        raster[px.y, px.x] = px.p
        n, e = p[p.b.isna()].sort_values("a"), p[p.b.notna()]
        rows = along_raster(dict(zip(n.a, zip(n.x, n.y))), sorted(zip(e.a, e.b.astype("int64"))), raster, gates)
        out = pd.DataFrame(rows, columns=["u", "v", "weight", "heal_kind", "conf", "evidence", "pts"])
        out.insert(0, "tile", key[0])
        return out

    schema = f"tile {kind}, u long, v long, weight double, heal_kind string, conf string, evidence double, pts array<array<double>>"
    made = _spread(_own(pool), "tile").groupBy("tile").cogroup(_spread(_own(pixels), "tile").groupBy("tile")).applyInPandas(run, schema)
    return made.select(
        "tile", "u", "v", "weight", "heal_kind", "conf", F.lit(0.0).alias("canopy_frac"), F.when(F.col("evidence") >= 0, F.round("evidence", 3)).alias("evidence"), "pts"
    )


def candidates(nodes: DataFrame, edges: DataFrame, gates: Gates, prob: DataFrame | None, size: int, canopy: DataFrame | None, wrap: bool) -> DataFrame:
    """Gaps that may become bridges, with all that can be said of them before any is made."""
    reach = gates.max_gap if canopy is None else max(gates.max_gap, gates.wide[0])
    place = lambda end: nodes.select("tile", F.col("id").alias(end), F.col("x").cast("double").alias(f"x{end}"), F.col("y").cast("double").alias(f"y{end}"))
    spans = gap_pairs(nodes, edges, reach).select("tile", "a", "b", F.sqrt(F.col("d2").cast("double")).alias("dist"))
    spans = spans.join(merged(place("a")), ["tile", "a"]).join(merged(place("b")), ["tile", "b"])
    out, keys = spans, ["tile", "a", "b"]
    if canopy is None:
        out = out.withColumns({"over": F.lit(-1.0), "green": F.lit(0.0)})
    else:
        green = canopy.groupBy("tile").agg(F.max("green_frac").alias("green"))
        out = out.join(merged(span_overlap(spans, canopy.filter("dense"), size, wrap)), keys).join(green, "tile", "left")
        # a tile that the canopy table lacks stays strict
        out = out.withColumns({"over": F.when(F.col("green").isNull(), -1.0).otherwise(F.col("over")), "green": F.coalesce("green", F.lit(0.0))})
    if prob is None:
        out = out.withColumns({"evidence": F.lit(-1.0), "walked": F.lit(0.0), "pts": F.lit(None).cast("array<array<double>>")})
    else:
        out = out.join(merged(span_paths(spans, prob, size)), keys)
    return out.withColumns(classify(gates, *map(F.col, ("dist", "over", "green", "evidence", "walked")))).filter("traced or plain")


def heal(
    nodes: DataFrame, edges: DataFrame, gates: Gates = Gates(), prob: DataFrame | None = None, size: int = 0, canopy: DataFrame | None = None, wrap: bool = False
) -> DataFrame:
    """Bridges of every tile: ``nodes`` tile, id, x, y; ``edges`` tile, u, v, w; ``prob`` tile, y, x, p;
    ``canopy`` tile, y, x, green_frac, dense (as ``ras_canopy`` gives them). Rasters are ``size`` wide and high.

    Result: tile, u, v, weight, heal_kind, conf, canopy_frac, evidence, pts. Tiles without a candidate
    give no row. Without ``prob`` and ``canopy`` the decision is geometric. Candidates reach to the
    wider gap where there is canopy; a tile that ``canopy`` lacks stays strict.
    """
    if prob is not None and canopy is None:
        return _healed_along(nodes, edges, gates, prob, size)
    found = materialise(candidates(nodes, edges, gates, prob, size, canopy, wrap), "gaps")  # read by the pass and by its result
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = found.select("tile", F.lit("g").alias("t"), "a", "b", F.col("dist").alias("x"), F.col("angle").alias("y"), "traced")
    at = nodes.join(merged(linked_nodes(edges)), ["tile", "id"], "left_semi").select(
        "tile", F.lit("n").alias("t"), F.col("id").alias("a"), nothing("long").alias("b"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), nothing("boolean").alias("traced")
    )
    lines = edges.select("tile", F.lit("e").alias("t"), F.col("u").alias("a"), F.col("v").alias("b"), nothing("double").alias("x"), nothing("double").alias("y"), nothing("boolean").alias("traced"))
    kind = nodes.schema["tile"].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in pdf.groupby("t")}
        made = []
        if "g" in part:
            n, e, g = part["n"], part["e"], part["g"]
            ordered = list(zip(g.x, g.a, g.b.astype("int64"), g.traced.astype(bool), g.y))
            made = settle(dict(zip(n.a, zip(n.x, n.y))), list(zip(e.a, e.b.astype("int64"))), ordered, gates)
        return pd.DataFrame({"tile": [key[0]] * len(made), "a": [m[0] for m in made], "b": [m[1] for m in made]})

    tiles = _own(found.select("tile").distinct())
    pool = _own(rows).unionByName(at.unionByName(lines).join(tiles, "tile", "left_semi"))
    made = pool.groupBy("tile").applyInPandas(run, f"tile {kind}, a long, b long")
    return _own(found).join(merged(_own(made)), ["tile", "a", "b"]).select(
        "tile", F.col("a").alias("u"), F.col("b").alias("v"), "weight", "heal_kind", "conf", F.round(F.greatest("over", F.lit(0.0)), 3).alias("canopy_frac"),
        F.when(F.col("evidence") >= 0, F.round("evidence", 3)).alias("evidence"), F.when(F.col("traced"), F.col("pts")).alias("pts"),
    )
