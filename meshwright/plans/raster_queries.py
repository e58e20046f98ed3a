"""Raster and quality-metric queries over rasters derived from order lines."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from meshwright.functions import raster_kernels as K
from meshwright.functions.scalars import hann_weight
from meshwright.operators import raster as R
from meshwright.plans.fixtures import GT_SQL, NODES_SQL, PX_SQL, nodes, probability, truth

QUERIES, SQL = {}, {}
SIZE, THR = 64, 0.5
_P, _PG = f"WITH {PX_SQL}", f"WITH {PX_SQL}, {GT_SQL}"
_M = f"{_P}, m AS (SELECT tile, y, x FROM px WHERE p > 0.55)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _values(pairs) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in pairs) + ") o(dy, dx)"


def _mask(spark, folder):
    return probability(spark, folder).filter("p > 0.55").select("tile", "y", "x")


_RGB = "(x*37+y*11)%256 AS r, (x*91+y*53)%256 AS g, (x*13+y*29)%256 AS b"
_COLOUR = f"SELECT tile, y, x, p, 2*g-r-b AS exg FROM (SELECT *, {_RGB} FROM px)"


@query("ras_thresh", _P + " SELECT tile, y, x FROM px WHERE p > 0.5")
def ras_thresh(spark, folder):
    return probability(spark, folder).filter(F.col("p") > THR).select("tile", "y", "x")


_WIN = f"w AS (SELECT wy, wx FROM (VALUES {', '.join(f'({o})' for o in R.windows(64, 32, 28))}) a(wy), (VALUES {', '.join(f'({o})' for o in R.windows(64, 32, 28))}) b(wx))"


def _windowed(spark, folder):
    at = R.windows(SIZE, 32, 28)
    p = probability(spark, folder)
    inside = lambda c: F.filter(F.array(*map(F.lit, at)), lambda o: (F.col(c) >= o) & (F.col(c) < o + 32))
    return p.withColumn("wy", F.explode(inside("y"))).withColumn("wx", F.explode(inside("x")))


@query("ras_window", f"{_P}, {_WIN} SELECT tile, wy, wx, count(*) AS cells, round(sum(p), 6) AS mass FROM px JOIN w ON y BETWEEN wy AND wy+31 AND x BETWEEN wx AND wx+31 GROUP BY 1, 2, 3")
def ras_window(spark, folder):
    """Overlapping windows, the last flush with the edge."""
    return _windowed(spark, folder).groupBy("tile", "wy", "wx").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("p"), 6).alias("mass"))


_HN = "(0.5-0.5*cos(2*pi()*({0})/31))*(0.5-0.5*cos(2*pi()*({1})/31))/power(0.5-0.5*cos(2*pi()*15/31), 2) + 0.001"


@query("ras_blend", f"{_P}, {_WIN} SELECT tile, y, x, round(sum((p + wy*0.001 + wx*0.002)*k)/greatest(sum(k), 1e-6), 6) AS p FROM (SELECT *, {_HN.format('y-wy', 'x-wx')} AS k FROM px JOIN w ON y BETWEEN wy AND wy+31 AND x BETWEEN wx AND wx+31) GROUP BY 1, 2, 3")
def ras_blend(spark, folder):
    """Windows' predictions blended by Hann weights (each window's prediction shifted to tell them apart)."""
    k = hann_weight(F.col("y") - F.col("wy"), F.col("x") - F.col("wx"), 32) + 1e-3
    w = _windowed(spark, folder).withColumn("k", k).withColumn("v", F.col("p") + F.col("wy") * 0.001 + F.col("wx") * 0.002)
    return w.groupBy("tile", "y", "x").agg(F.round(F.sum(F.col("v") * F.col("k")) / F.greatest(F.sum("k"), F.lit(1e-6)), 6).alias("p"))


def _views(spark, folder, maps):
    p = probability(spark, folder).withColumn("m", F.lit(SIZE - 1))
    arr = F.array(*[F.struct(F.expr(a).cast("int").alias("y"), F.expr(b).cast("int").alias("x")) for a, b in maps])
    v = p.select("tile", F.explode(arr).alias("o"), "p").select("tile", "o.y", "o.x", "p")
    return v.groupBy("tile", "y", "x").agg(F.round(F.avg("p"), 8).alias("p"))


def _views_sql(maps):
    parts = " UNION ALL ".join(f"SELECT tile, {a.replace('m', '63')} AS y, {b.replace('m', '63')} AS x, p FROM px" for a, b in maps)
    return f"{_P} SELECT tile, y, x, round(avg(p), 8) AS p FROM ({parts}) GROUP BY 1, 2, 3"


@query("ras_tta8", _views_sql(R.DIHEDRAL))
def ras_tta8(spark, folder):
    """Mean over the eight dihedral views."""
    return _views(spark, folder, R.DIHEDRAL)


@query("ras_tta4", _views_sql(R.DIHEDRAL[:4]))
def ras_tta4(spark, folder):
    return _views(spark, folder, R.DIHEDRAL[:4])


_MEMBERS = "mb AS (SELECT tile, y, x, k, CASE k WHEN 0 THEN p WHEN 1 THEN least(1.0, p*p*1.5) ELSE sqrt(p) END AS p FROM px, (VALUES (0), (1), (2)) v(k))"


def _members(spark, folder):
    """Three members' probabilities of each pixel, as rows."""
    p = F.col("p")
    arr = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("p")) for k, v in enumerate((p, F.least(F.lit(1.0), p * p * 1.5), F.sqrt(p)))])
    return probability(spark, folder).select("tile", "y", "x", F.explode(arr).alias("m")).select("tile", "y", "x", "m.k", "m.p")


@query("ras_softvote", f"{_P}, {_MEMBERS} SELECT tile, y, x, round(avg(p), 6) AS p FROM mb GROUP BY 1, 2, 3")
def ras_softvote(spark, folder):
    return _members(spark, folder).groupBy("tile", "y", "x").agg(F.round(F.avg("p"), 6).alias("p"))


@query("ras_canopy", f"{_P}, c AS ({_COLOUR}), s AS (SELECT tile, round(avg(CASE WHEN exg > 12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS green_frac, greatest(12.0::DOUBLE, quantile_cont(exg, 0.78)) AS thr FROM c GROUP BY 1) SELECT tile, y, x, green_frac, thr, exg > thr AS dense FROM c JOIN s USING (tile)")
def ras_canopy(spark, folder):
    """Share of green pixels, the density threshold, and dense pixels of each tile."""
    c = probability(spark, folder).selectExpr("*", *_RGB.split(", ")).withColumn("exg", F.expr("2*g-r-b"))
    s = c.groupBy("tile").agg(F.round(F.avg((F.col("exg") > 12).cast("double")), 6).alias("green_frac"), F.greatest(F.lit(12.0), F.percentile("exg", F.lit(0.78))).alias("thr"))
    return c.join(s, "tile").select("tile", "y", "x", "green_frac", "thr", (F.col("exg") > F.col("thr")).alias("dense"))


_D = "d AS (SELECT DISTINCT tile, y+dy AS y, x+dx AS x FROM m, {0} WHERE y+dy BETWEEN 0 AND 63 AND x+dx BETWEEN 0 AND 63)"


@query("ras_dilate", f"{_M}, {_D.format(_values(K.ellipse(3)))} SELECT * FROM d")
def ras_dilate(spark, folder):
    """Dilation by the 7 x 7 ellipse."""
    return R.dilate(_mask(spark, folder), K.ellipse(3), SIZE)


_CL = "c AS (SELECT tile, y-dy AS y, x-dx AS x FROM d, {0} GROUP BY 1, 2, 3 HAVING count(*) = {1})"


#: A pixel stays unless one of its offsets is an unset place of the raster: the border takes nothing away.
_OPEN_RIM = "c AS (SELECT DISTINCT tile, y, x FROM d EXCEPT SELECT d.tile, d.y, d.x FROM d, {0} LEFT JOIN d e ON e.tile = d.tile AND e.y = d.y+dy AND e.x = d.x+dx WHERE d.y+dy BETWEEN 0 AND 63 AND d.x+dx BETWEEN 0 AND 63 AND e.tile IS NULL)"


@query("ras_close", f"{_M}, {_D.format(_values(K.ellipse(2)))}, {_OPEN_RIM.format(_values(K.ellipse(2)))} SELECT * FROM c")
def ras_close(spark, folder):
    """Closing by the 5 x 5 ellipse; the border is neutral, so the mask is kept up to its rim."""
    return R.close(_mask(spark, folder), K.ellipse(2), SIZE, keep_rim=True)


_SPARSE = f"{_P}, m AS (SELECT tile, y, x FROM px WHERE p > 0.72)"
_REG = """, n4 AS (SELECT a.tile, a.y AS y, a.x AS x, b.y AS y2, b.x AS x2 FROM {0} a JOIN {0} b ON a.tile = b.tile AND abs(a.y-b.y)+abs(a.x-b.x) = 1),
reg(tile, y, x, lab) USING KEY (tile, y, x) AS (SELECT tile, y, x, y*64+x FROM {0} UNION SELECT g.tile, g.y, g.x, g.lab FROM (SELECT n4.tile, n4.y2 AS y, n4.x2 AS x, min(lab) AS lab FROM reg JOIN n4 USING (tile, y, x) GROUP BY 1, 2, 3) g
 JOIN recurring.reg q ON q.tile = g.tile AND q.y = g.y AND q.x = g.x WHERE g.lab < q.lab)"""


def _sparse(spark, folder):
    return probability(spark, folder).filter("p > 0.72").select("tile", "y", "x")


@query("flt_sub_large", _SPARSE.replace("WITH", "WITH RECURSIVE", 1) + _REG.format("m") + " SELECT tile, y, x FROM reg JOIN (SELECT tile, lab FROM reg GROUP BY 1, 2 HAVING count(*) >= 3) USING (tile, lab)")
def flt_sub_large(spark, folder):
    """4-connected regions of at least three pixels."""
    return R.without_small(_sparse(spark, folder), SIZE, 3)


_SQ = K.square(3)


@query("ras_postproc", _SPARSE.replace("WITH", "WITH RECURSIVE", 1) + f", {_D.format(_values(_SQ))}, {_CL.format(_values(_SQ), 9)}" + _REG.format("c") + " SELECT tile, y, x FROM reg JOIN (SELECT tile, lab FROM reg GROUP BY 1, 2 HAVING count(*) >= 20) USING (tile, lab)")
def ras_postproc(spark, folder):
    """Closing by a 3 x 3 square, then small regions out."""
    return R.without_small(R.close(_sparse(spark, folder), _SQ, SIZE), SIZE, 20)


#: Seed and growth thresholds, and the growth threshold under canopy.
_HIGH, _LOW = 0.45, 0.23
_CANOPY_LOW = round(max(0.08, _LOW - 0.08), 2)
_CANOPY = f"c0 AS ({_COLOUR}), s0 AS (SELECT tile, greatest(12.0::DOUBLE, quantile_cont(exg, 0.78)) AS thr FROM c0 GROUP BY 1)"


@query("ras_hyst", f"WITH RECURSIVE {PX_SQL}, {_CANOPY}, m AS (SELECT tile, y, x FROM c0 JOIN s0 USING (tile) WHERE p >= {_LOW} OR (p >= {_CANOPY_LOW} AND exg > thr))" + _REG.format("m") + f" SELECT tile, y, x FROM reg WHERE (tile, lab) IN (SELECT reg.tile, lab FROM reg JOIN px USING (tile, y, x) WHERE p >= {_HIGH})")
def ras_hyst(spark, folder):
    """Weak pixels, weaker ones under canopy, of 4-connected regions that hold a strong one."""
    dense = ras_canopy(spark, folder).select("tile", "y", "x", "dense")
    p = probability(spark, folder).join(dense, ["tile", "y", "x"])
    return R.grown(p, SIZE, F.col("p") >= _HIGH, (F.col("p") >= _LOW) | ((F.col("p") >= _CANOPY_LOW) & F.col("dense")))


@query("ras_skel")
def ras_skel(spark, folder):
    return R.skeletons(_mask(spark, folder), SIZE)


@query("g_build")
def g_build(spark, folder):
    """Edges traced from the skeletons of the sparser masks."""
    return R.graph_edges(R.skeletons(_sparse(spark, folder), SIZE, 4, 3), SIZE, 3.0).drop("pts")


@query("ras_shift", f"{_M}, {GT_SQL}, s AS (SELECT dy, dx FROM range(-6, 7) a(dy), range(-6, 7) b(dx)), k AS (SELECT m.tile, dy, dx, count(*) AS n FROM m, s, gt WHERE gt.tile = m.tile AND gt.y = (m.y+dy+64)%64 AND gt.x = (m.x+dx+64)%64 GROUP BY 1, 2, 3) SELECT tile, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, n FROM k QUALIFY row_number() OVER (PARTITION BY tile ORDER BY n DESC, dy, dx) = 1")
def ras_shift(spark, folder):
    """The shift of a 13 x 13 grid with the greatest wrapped overlap; the first wins ties."""
    step = [(dy, dx) for dy in range(-6, 7) for dx in range(-6, 7)]
    m = _mask(spark, folder).select("tile", "y", "x", R._offsets(step).alias("o"))
    m = m.select("tile", F.pmod(F.col("y") + F.col("o.dy"), F.lit(SIZE)).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.lit(SIZE)).alias("x"), "o.dy", "o.dx")
    n = m.join(truth(spark, folder), ["tile", "y", "x"]).groupBy("tile", "dy", "dx").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(W.partitionBy("tile").orderBy(F.desc("n"), "dy", "dx"))).filter("k = 1").drop("k")


@query("ras_crop", _P + " SELECT tile, y-16 AS y, x-16 AS x, p FROM px WHERE y BETWEEN 16 AND 47 AND x BETWEEN 16 AND 47")
def ras_crop(spark, folder):
    return probability(spark, folder).filter("y between 16 and 47 and x between 16 and 47").selectExpr("tile", "y-16 AS y", "x-16 AS x", "p")


@query("ras_occlude", _P + " SELECT tile, y, x, CASE WHEN y BETWEEN (tile*7)%48 AND (tile*7)%48+15 AND x BETWEEN (tile*13)%48 AND (tile*13)%48+15 THEN 0 ELSE p END AS p, y BETWEEN (tile*7)%48 AND (tile*7)%48+15 AND x BETWEEN (tile*13)%48 AND (tile*13)%48+15 AS hidden FROM px")
def ras_occlude(spark, folder):
    """One rectangle of each tile blacked out, and where."""
    hidden = F.expr("y between (tile*7)%48 and (tile*7)%48+15 and x between (tile*13)%48 and (tile*13)%48+15")
    return probability(spark, folder).select("tile", "y", "x", F.when(hidden, 0.0).otherwise(F.col("p")).alias("p"), hidden.alias("hidden"))


@query("ras_resize", _P + " SELECT tile, y//4 AS y, x//4 AS x, round(sum(p)/16, 10) AS p FROM px GROUP BY 1, 2, 3")
def ras_resize(spark, folder):
    """A quarter of the size by area means, absent pixels as 0."""
    return probability(spark, folder).groupBy("tile", F.expr("y div 4").cast("int").alias("y"), F.expr("x div 4").cast("int").alias("x")).agg(F.round(F.sum("p") / 16, 10).alias("p"))


@query("ras_aug", _P + " SELECT tile, CASE WHEN tile%2=0 THEN x ELSE y END AS y, CASE WHEN tile%2=0 THEN 63-y ELSE x END AS x, round(least(1.0, p*1.1), 6) AS p FROM px")
def ras_aug(spark, folder):
    """A quarter turn for even tiles and a brightness gain."""
    turn = F.expr("tile%2=0")
    return probability(spark, folder).select("tile", F.when(turn, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(turn, 63 - F.col("y")).otherwise(F.col("x")).alias("x"), F.round(F.least(F.lit(1.0), F.col("p") * 1.1), 6).alias("p"))


_SEG = f"WITH {NODES_SQL}, sg AS (SELECT tile, id, x%64 AS x0, y%64 AS y0, (x*7)%64 AS x1, (y*5)%64 AS y1 FROM nd)"


def _segments(spark, folder):
    return nodes(spark, folder).selectExpr("tile", "id", "x%64 AS x0", "y%64 AS y0", "(x*7)%64 AS x1", "(y*5)%64 AS y1")


_DDA = "dl AS (SELECT DISTINCT tile, CAST(floor(y0+(y1-y0)*i/n::DOUBLE+0.5) AS INTEGER) AS y, CAST(floor(x0+(x1-x0)*i/n::DOUBLE+0.5) AS INTEGER) AS x FROM (SELECT *, unnest(range(0, n+1)) AS i FROM (SELECT *, greatest(abs(x1-x0), abs(y1-y0), 1) AS n FROM sg)))"


@query("ras_polyline", f"{_SEG}, {_DDA} SELECT * FROM dl")
def ras_polyline(spark, folder):
    return R.draw(_segments(spark, folder))


@query("ras_polywide", f"{_SEG}, {_DDA} SELECT DISTINCT tile, y+dy AS y, x+dx AS x FROM dl, {_values(K.ellipse(2))} WHERE y+dy BETWEEN 0 AND 63 AND x+dx BETWEEN 0 AND 63")
def ras_polywide(spark, folder):
    """Polylines with a stroke of five pixels."""
    return R.dilate(R.draw(_segments(spark, folder)), K.ellipse(2), SIZE)


@query("ras_sample", f"{_P}, {NODES_SQL} SELECT nd.tile, id, px.p FROM nd LEFT JOIN px ON px.tile = 1995 + nd.tile % 7 AND px.y = least(greatest(nd.y, 0), 63) AND px.x = least(greatest(nd.x, 0), 63)")
def ras_sample(spark, folder):
    """The value of each tile's raster at each of its nodes' clipped pixel (seven years serve the tiles in turn)."""
    p = probability(spark, folder).withColumnRenamed("tile", "year")
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(SIZE - 1)).cast("int").alias(c)
    at = nodes(spark, folder).select("tile", (F.col("tile") % 7 + 1995).alias("year"), "id", clip("y"), clip("x"))
    return at.join(p, ["year", "y", "x"], "left").select("tile", "id", "p")


@query("ras_overlap", f"{_SEG}, {PX_SQL}, smp AS (SELECT tile, id, CAST(trunc(x0+(x1-x0)*i/31.0::DOUBLE) AS INTEGER) AS x, CAST(trunc(y0+(y1-y0)*i/31.0::DOUBLE) AS INTEGER) AS y FROM (SELECT *, unnest(range(0, 32)) AS i FROM sg)) SELECT smp.tile, id, round(avg(CASE WHEN p > 0.55 THEN 1.0::DOUBLE ELSE 0 END), 6) AS overlap FROM smp LEFT JOIN px ON px.tile = 1995 + smp.tile % 7 AND px.y = smp.y AND px.x = smp.x GROUP BY 1, 2")
def ras_overlap(spark, folder):
    """Share of 32 samples along a segment that lie on its tile's mask."""
    m = _mask(spark, folder).select(F.col("tile").alias("year"), "y", "x", F.lit(1.0).alias("on"))
    s = _segments(spark, folder).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(31))))
    at = lambda a, b: (F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / 31.0).cast("int")
    s = s.select("tile", (F.col("tile") % 7 + 1995).alias("year"), "id", at("x0", "x1").alias("x"), at("y0", "y1").alias("y")).join(m, ["year", "y", "x"], "left")
    return s.groupBy("tile", "id").agg(F.round(F.avg(F.coalesce("on", F.lit(0.0))), 6).alias("overlap"))


# ---- quality metrics -----------------------------------------------------------------------------
_CELL = f"{_PG}, cell AS (SELECT coalesce(px.tile, gt.tile) AS tile, coalesce(p, 0) AS p, gt.tile IS NOT NULL AS g FROM px FULL JOIN gt ON px.tile = gt.tile AND px.y = gt.y AND px.x = gt.x)"
_EPS = 1e-6


def _cells(spark, folder):
    t = truth(spark, folder).withColumn("g", F.lit(True))
    return probability(spark, folder).join(t, ["tile", "y", "x"], "full").select("tile", "y", "x", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("g", F.lit(False)).alias("g"))


def _counts(on):
    g = F.col("g")
    return F.count_if(on & g).alias("tp"), F.count_if(on & ~g).alias("fp"), F.count_if(~on & g).alias("fn")


_CNT = "count(*) FILTER (WHERE {0} AND g) AS tp, count(*) FILTER (WHERE {0} AND NOT g) AS fp, count(*) FILTER (WHERE NOT ({0}) AND g) AS fn"
_RATIO = "round(tp/(tp+fp+fn+1e-6), 6) AS iou, round(2*tp/(2*tp+fp+fn+1e-6), 6) AS dice"


def _ratios(df, *keys):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select(*keys, F.round(tp / (tp + fp + fn + _EPS), 6).alias("iou"), F.round(2 * tp / (2 * tp + fp + fn + _EPS), 6).alias("dice"))


@query("agg_confusion", f"{_CELL} SELECT *, round(tp/(tp+fn+1e-6), 6) AS recall, round(tp/(tp+fp+1e-6), 6) AS precision FROM (SELECT {_CNT.format('p > 0.5')} FROM cell)")
def agg_confusion(spark, folder):
    """Counts over all tiles, then the ratios."""
    c = _cells(spark, folder).agg(*_counts(F.col("p") > THR))
    return c.withColumns({"recall": F.round(F.col("tp") / (F.col("tp") + F.col("fn") + _EPS), 6), "precision": F.round(F.col("tp") / (F.col("tp") + F.col("fp") + _EPS), 6)})


@query("agg_iou_dice", f"{_CELL} SELECT round((tp+1e-6)/(tp+fp+fn+1e-6), 6) AS iou, round((2*tp+1e-6)/(2*tp+fp+fn+1e-6), 6) AS dice FROM (SELECT {_CNT.format('p > 0.5')} FROM cell)")
def agg_iou_dice(spark, folder):
    c = _cells(spark, folder).agg(*_counts(F.col("p") > THR))
    u = F.col("fp") + F.col("fn") + _EPS
    return c.select(F.round((F.col("tp") + _EPS) / (F.col("tp") + u), 6).alias("iou"), F.round((2 * F.col("tp") + _EPS) / (2 * F.col("tp") + u), 6).alias("dice"))


@query("agg_tile_iou", f"{_CELL} SELECT tile, {_RATIO} FROM (SELECT tile, {_CNT.format('p > 0.5')} FROM cell GROUP BY 1)")
def agg_tile_iou(spark, folder):
    return _ratios(_cells(spark, folder).groupBy("tile").agg(*_counts(F.col("p") > THR)), "tile")


_THR = [round(0.2 + 0.025 * k, 3) for k in range(21)]
_SWEEP = f"{_CELL}, sw AS (SELECT thr, {_RATIO} FROM (SELECT thr, {_CNT.format('p > thr')} FROM cell, (VALUES {', '.join(f'({t}::DOUBLE)' for t in _THR)}) t(thr) GROUP BY 1))"


def by_threshold(scored, *keys):
    """Counts tp, fp, fn of ``p`` > thr against ``g`` for every threshold: each pixel is counted once, by how
    many thresholds lie below it, and the few counts are summed from above."""
    above = F.size(F.filter(F.array(*map(F.lit, _THR)), lambda t: F.col("p") > t))
    n = scored.groupBy(*keys, above.alias("above")).agg(F.count_if("g").alias("on"), F.count_if(~F.col("g")).alias("off"))
    rows = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(_THR) - 1)))).withColumn("thr", F.element_at(F.array(*map(F.lit, _THR)), F.col("k") + 1))
    over = F.col("above") > F.col("k")
    pick = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    return rows.groupBy(*keys, "thr").agg(pick("on", over).alias("tp"), pick("off", over).alias("fp"), pick("on", ~over).alias("fn"))


def _sweep(spark, folder):
    return _ratios(by_threshold(_cells(spark, folder)), "thr")


@query("agg_sweep", _SWEEP + " SELECT * FROM sw")
def agg_sweep(spark, folder):
    """IoU and Dice at 21 thresholds in one pass."""
    return _sweep(spark, folder)


@query("agg_argmax", _SWEEP + " SELECT * FROM sw ORDER BY iou DESC, thr LIMIT 1")
def agg_argmax(spark, folder):
    return _sweep(spark, folder).orderBy(F.desc("iou"), "thr").limit(1)


_REL = f"{_PG}, pr AS (SELECT tile, y, x FROM px WHERE p > 0.55), se AS (SELECT * FROM {_values(K.ellipse(3))}), dp AS (SELECT DISTINCT tile, y+dy AS y, x+dx AS x FROM pr, se), dg AS (SELECT DISTINCT tile, y+dy AS y, x+dx AS x FROM gt, se)"


@query("agg_relaxed", _REL + " SELECT tp, fp, fn, round(tp/(tp+fp+fn+1e-6), 6) AS iou FROM (SELECT (SELECT count(*) FROM pr JOIN dg USING (tile, y, x)) AS tp, (SELECT count(*) FROM pr ANTI JOIN dg USING (tile, y, x)) AS fp, (SELECT count(*) FROM gt ANTI JOIN dp USING (tile, y, x)) AS fn)")
def agg_relaxed(spark, folder):
    """Counts with three pixels of slack."""
    p, t, k = _mask(spark, folder), truth(spark, folder), ["tile", "y", "x"]
    dp, dt = R.dilate(p, K.ellipse(3)).withColumn("near", F.lit(1)), R.dilate(t, K.ellipse(3)).withColumn("near", F.lit(1))
    a = p.join(dt, k, "left").agg(F.count("near").alias("tp"), F.count_if(F.col("near").isNull()).alias("fp"))
    b = t.join(dp, k, "left").agg(F.count_if(F.col("near").isNull()).alias("fn"))
    return a.join(b).select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + _EPS), 6).alias("iou"))


@query("agg_cover", _REL.replace("VALUES", "VALUES") + " SELECT round(r, 4) AS recall, round(c, 4) AS precision, round(CASE WHEN r+c > 0 THEN 2*r*c/(r+c) ELSE 0 END, 4) AS f1 FROM (SELECT (SELECT count(*) FROM gt SEMI JOIN dp USING (tile, y, x))/greatest(1, (SELECT count(*) FROM gt)) AS r, (SELECT count(*) FROM pr SEMI JOIN dg USING (tile, y, x))/greatest(1, (SELECT count(*) FROM pr)) AS c)")
def agg_cover(spark, folder):
    """Completeness, correctness and F1 within a buffer."""
    p, t, k = _mask(spark, folder), truth(spark, folder), ["tile", "y", "x"]
    dp, dt = R.dilate(p, K.ellipse(3)).withColumn("near", F.lit(1)), R.dilate(t, K.ellipse(3)).withColumn("near", F.lit(1))
    share = lambda a, b, n: a.join(b, k, "left").agg((F.count("near") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias(n))
    r, c = F.col("r"), F.col("c")
    both = share(t, dp, "r").join(share(p, dt, "c"))
    return both.select(F.round(r, 4).alias("recall"), F.round(c, 4).alias("precision"), F.round(F.when(r + c > 0, 2 * r * c / (r + c)).otherwise(0.0), 4).alias("f1"))


_HID = "y BETWEEN 10 AND 30 AND x BETWEEN 10 AND 30"


@query("agg_occ_recall", f"{_PG} SELECT round(count(*) FILTER (WHERE p > 0.5)/(count(*)+1e-6), 6) AS recall FROM gt LEFT JOIN px USING (tile, y, x) WHERE {_HID}")
def agg_occ_recall(spark, folder):
    """Recall inside the hidden region."""
    c = _cells(spark, folder).filter(f"g and {_HID}")
    return c.agg(F.round(F.count_if(F.col("p") > THR) / (F.count(F.lit(1)) + _EPS), 6).alias("recall"))


@query("agg_hist", _P + " SELECT CAST(least(floor(p*20), 19) AS INTEGER) AS bin, count(*) AS n FROM px WHERE p BETWEEN 0 AND 1 GROUP BY 1")
def agg_hist(spark, folder):
    """Twenty bins on [0, 1]."""
    return probability(spark, folder).filter("p between 0 and 1").groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_running", f"{_CELL} SELECT round(sum(iou*k)/greatest(sum(k), 1), 6) AS mean FROM (SELECT tile, tp/(tp+fp+fn+1e-6) AS iou, k FROM (SELECT tile, count(*) AS k, {_CNT.format('p > 0.5')} FROM cell GROUP BY 1))")
def agg_running(spark, folder):
    """Mean weighted by the number of cells."""
    t = _cells(spark, folder).groupBy("tile").agg(F.count(F.lit(1)).alias("k"), *_counts(F.col("p") > THR))
    iou = F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + _EPS)
    return t.agg(F.round(F.sum(iou * F.col("k")) / F.greatest(F.sum("k"), F.lit(1)), 6).alias("mean"))


@query("set_union", f"{_PG} SELECT tile, y, x FROM px WHERE p > 0.55 UNION SELECT * FROM gt")
def set_union(spark, folder):
    return _mask(spark, folder).union(truth(spark, folder)).distinct()


@query("set_intersect", f"{_PG} SELECT tile, y, x FROM px WHERE p > 0.55 INTERSECT SELECT * FROM gt")
def set_intersect(spark, folder):
    return _mask(spark, folder).intersect(truth(spark, folder))


@query("set_except", f"{_PG} SELECT tile, y, x FROM px WHERE p > 0.55 EXCEPT SELECT * FROM gt")
def set_except(spark, folder):
    return _mask(spark, folder).join(truth(spark, folder), ["tile", "y", "x"], "left_anti")


@query("lst_repeat", f"{_PG} SELECT gt.*, CAST(k AS INTEGER) AS copy FROM gt, range(3) r(k)")
def lst_repeat(spark, folder):
    return truth(spark, folder).withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))


@query("win_norm", _P + " SELECT tile, y, x, round(p/CASE WHEN max(p) OVER w > 0 THEN max(p) OVER w ELSE 1 END, 6) AS share FROM px WINDOW w AS (PARTITION BY tile)")
def win_norm(spark, folder):
    """Values over their tile's maximum; the maximum is an aggregate joined back, one row a tile."""
    p = probability(spark, folder)
    top = p.groupBy("tile").agg(F.max("p").alias("m"))
    return p.join(top, "tile").select("tile", "y", "x", F.round(F.col("p") / F.when(F.col("m") > 0, F.col("m")).otherwise(1), 6).alias("share"))
