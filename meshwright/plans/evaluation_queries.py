"""Evaluation of predictions: losses, validation, quality buckets, ensembles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W, functions as F

from meshwright.functions import raster_kernels as K
from meshwright.functions.loss_kernels import all_losses
from meshwright.operators import raster as R
from meshwright.plans import raster_queries as Q
from meshwright.plans.fixtures import GT_SQL, PX_SQL, probability, truth
from meshwright.plans.raster_queries import SIZE, THR, _CELL, _CNT, _EPS, _MEMBERS, _RATIO, _SQ, _THR, _cells, _counts, _members, _ratios, _values, by_threshold

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# ---- losses ---------------------------------------------------------------------------------------
_POOL = "SELECT tile, y+dy AS y, x+dx AS x, max({0}) AS v FROM cell, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE y+dy BETWEEN 0 AND 63 AND x+dx BETWEEN 0 AND 63 GROUP BY 1, 2, 3"
_LOSS = f"""WITH {PX_SQL}, {GT_SQL}, cell AS (SELECT tile, y, x, coalesce(p, 0) AS p, CAST(gt.tile IS NOT NULL AS INTEGER) AS g FROM (SELECT DISTINCT tile FROM px) t CROSS JOIN (SELECT unnest(range(0, 64)) AS y) CROSS JOIN (SELECT unnest(range(0, 64)) AS x)
 LEFT JOIN px USING (tile, y, x) LEFT JOIN gt USING (tile, y, x)),
a AS (SELECT tile, 1-(2*sum(p*g)+1)/(sum(p)+sum(g)+1) AS dice, -avg(CASE WHEN g = 1 THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1-p, 1e-6)) END) AS bce FROM cell GROUP BY 1),
b AS (SELECT tile, 1-(2*sum(q.v*h.v)+1)/(sum(q.v)+sum(h.v)+1) AS connectivity FROM ({_POOL.format("p")}) q JOIN ({_POOL.format("g")}) h USING (tile, y, x) GROUP BY 1)
"""


def _tile_losses(spark, folder):
    """Every loss of each tile; a tile is a batch. Pixels without a value are 0."""
    t = truth(spark, folder).withColumn("g", F.lit(2.0))
    p = probability(spark, folder)
    # p below 1, the mask as 2 on top: one value a pixel
    both = p.join(t, ["tile", "y", "x"], "left").select("tile", "y", "x", (F.col("p") / 2 + F.coalesce("g", F.lit(0.0))).alias("v"))

    def run(tile, a):
        g = (a >= 2).astype(float)
        return pd.DataFrame([{"tile": tile, **all_losses(2 * (a - 2 * g), g)}])

    names = ["dice", "bce", "connectivity", "centre_line", "lovasz", "plain_dice", "combined", "centre_line_combined", "lovasz_combined"]
    return R.per_tile_raster(both, SIZE, run, "tile int, " + ", ".join(f"{n} double" for n in names), "v")


@query("losses", _LOSS + "SELECT tile, round(dice, 6) AS dice, round(bce, 6) AS bce, round(connectivity, 6) AS connectivity, round(0.5*dice + 0.3*bce + 0.2*connectivity, 6) AS combined FROM a JOIN b USING (tile)")
def losses(spark, folder):
    """Overlap, cross entropy, overlap of the dilated maps, and their weighted sum."""
    return _tile_losses(spark, folder).select("tile", *[F.round(c, 6).alias(c) for c in ("dice", "bce", "connectivity", "combined")])


@query("losses_topology")
def losses_topology(spark, folder):
    """Overlap of soft centre lines (ten rounds), Lovasz hinge, and the two weighted sums with them."""
    return _tile_losses(spark, folder).select("tile", *[F.round(c, 6).alias(c) for c in ("centre_line", "lovasz", "centre_line_combined", "lovasz_combined")])


# ---- validation -----------------------------------------------------------------------------------
_ONE = f"{_CELL} SELECT round(-avg(CASE WHEN g THEN ln(greatest(p, 1e-6)) ELSE ln(greatest(1-p, 1e-6)) END), 6) AS loss, {_RATIO.replace('tp', 'any_value(tp)').replace('fp', 'any_value(fp)').replace('fn', 'any_value(fn)')} FROM cell, (SELECT {_CNT.format('p > 0.5')} FROM cell)"


@query("agg_validate", f"SELECT loss, o.iou, dice, r.iou AS relaxed_iou, recall AS occ_recall FROM ({_ONE}) o, ({Q.SQL['agg_relaxed'].replace('p > 0.55', 'p > 0.5')}) r, ({Q.SQL['agg_occ_recall']}) h")
def agg_validate(spark, folder):
    """Loss, overlap, overlap with slack and recall in the hidden region, in one row."""
    p = F.col("p")
    loss = F.when(F.col("g"), F.log(F.greatest(p, F.lit(1e-6)))).otherwise(F.log(F.greatest(1 - p, F.lit(1e-6))))
    one = _ratios(_cells(spark, folder).agg(*_counts(p > THR), F.round(-F.avg(loss), 6).alias("loss")), "loss")
    slack = _relaxed(probability(spark, folder).filter(p > THR).select("tile", "y", "x"), truth(spark, folder)).select(F.col("iou").alias("relaxed_iou"))
    return one.join(slack).join(Q.agg_occ_recall(spark, folder).select(F.col("recall").alias("occ_recall")))  # three single rows


def _relaxed(on, wanted):
    """Overlap with three pixels of slack, as one row."""
    k = ["tile", "y", "x"]
    near = lambda df: R.dilate(df, K.ellipse(3)).withColumn("near", F.lit(1))
    a = on.join(near(wanted), k, "left").agg(F.count("near").alias("tp"), F.count_if(F.col("near").isNull()).alias("fp"))
    b = wanted.join(near(on), k, "left").agg(F.count_if(F.col("near").isNull()).alias("fn"))
    return a.join(b).select(F.round(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + _EPS), 6).alias("iou"))


#: The half-open quality buckets and the rules of tiles without roads.
_BUCKET = "CASE WHEN iou >= 0.7 THEN 'Excellent (>=0.70)' WHEN iou >= 0.55 THEN 'Good (0.55-0.70)' WHEN iou >= 0.4 THEN 'Fair (0.40-0.55)' ELSE 'Poor (<0.40)' END"
_EMPTY, _CLEAN, _SHOWN = 4, 0.005, 3
_BLOCKS = _CELL.replace("AS tile, coalesce(p", "AS tile, coalesce(px.y, gt.y)//8 AS ty, coalesce(px.x, gt.x)//8 AS tx, coalesce(p")
_TILES = f"""{_BLOCKS}, t AS (SELECT tile, ty, tx, tp+fn AS road, fp, {_RATIO} FROM (SELECT tile, ty, tx, {_CNT.format('p > 0.7')} FROM cell GROUP BY 1, 2, 3)),
 k AS (SELECT *, CASE WHEN road < {_EMPTY} THEN 'No-road' ELSE {_BUCKET} END AS bucket, fp/64.0::DOUBLE < {_CLEAN} AS clean FROM t)"""


def _blocks(spark, folder):
    """Blocks of 8 x 8 pixels stand for tiles: a bucket, and whether hardly anything is predicted."""
    c = _cells(spark, folder).withColumns({"ty": F.expr("y div 8"), "tx": F.expr("x div 8")})
    c = c.groupBy("tile", "ty", "tx").agg(*_counts(F.col("p") > 0.7))
    t = _ratios(c, "tile", "ty", "tx", (F.col("tp") + F.col("fn")).alias("road"), "fp")
    return t.withColumns({"bucket": F.when(F.col("road") < _EMPTY, "No-road").otherwise(F.expr(_BUCKET)), "clean": F.col("fp") / 64.0 < _CLEAN})


@query("agg_buckets", f"{_TILES} SELECT bucket, count(*) AS n, round(100.0::DOUBLE*count(*)/greatest(1, CASE WHEN bucket = 'No-road' THEN count(*) ELSE (SELECT count(*) FROM k WHERE bucket <> 'No-road') END), 4) AS pct, round(100.0::DOUBLE*count(*) FILTER (WHERE clean)/count(*), 4) AS clean_pct, round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou FROM k GROUP BY 1")
def agg_buckets(spark, folder):
    """Tiles by quality: share of the tiles with roads, and of each bucket's tiles those predicted (nearly) empty."""
    k = _blocks(spark, folder)
    n = k.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if("clean") / F.count(F.lit(1)), 4).alias("clean_pct"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.median("iou"), 6).alias("median_iou")
    )
    road = F.sum(F.when(F.col("bucket") != "No-road", F.col("n")).otherwise(0)).over(W.partitionBy(F.lit(1)))  # five rows
    whole = F.greatest(F.lit(1), F.when(F.col("bucket") == "No-road", F.col("n")).otherwise(road))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / whole, 4)).select("bucket", "n", "pct", "clean_pct", "mean_iou", "median_iou")


@query("agg_bucket_samples", f"{_TILES} SELECT tile, ty, tx, bucket FROM k QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY tile, ty, tx) <= {_SHOWN}")
def agg_bucket_samples(spark, folder):
    """The first three tiles of each bucket (a gallery)."""
    w = W.partitionBy("bucket").orderBy("tile", "ty", "tx")
    return _blocks(spark, folder).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= _SHOWN).select("tile", "ty", "tx", "bucket")


# ---- ensembles ------------------------------------------------------------------------------------
_KEY = ["tile", "y", "x"]


def _wide(spark, folder):
    """Each pixel's probability by every member, and the truth."""
    t = truth(spark, folder).withColumn("g", F.lit(True))
    m = _members(spark, folder).groupBy(*_KEY).pivot("k", [0, 1, 2]).agg(F.first("p")).join(t, _KEY, "left")
    return m.withColumn("g", F.coalesce("g", F.lit(False)))


def _vote(chosen):
    return sum((F.col(str(m)) for m in chosen), F.lit(0.0)) / len(chosen)


def _best(wide, groups: dict):
    """Best threshold of the mean of each group of members: {name: (iou, dice, thr)}, in one pass over the pixels."""
    arr = F.array(*[F.struct(F.lit(name).alias("name"), _vote(members).alias("p")) for name, members in groups.items()])
    scored = wide.select("g", F.explode(arr).alias("m")).select("g", "m.name", "m.p")
    out = {}
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = by_threshold(scored, "name").select("name", "thr", (tp / (tp + fp + fn + _EPS)).alias("iou"), (2 * tp / (2 * tp + fp + fn + _EPS)).alias("dice")).collect()
    for r in sorted(rows, key=lambda r: (-r["iou"], r["thr"])):  # 21 rows a group
        out.setdefault(r["name"], (r["iou"], r["dice"], r["thr"]))
    return out


def greedy(wide, members: list[int]) -> list[tuple[int, int, float, float, float]]:
    """(step, member, iou, dice, thr): the best member first, then whichever adds most, each at its best threshold.

    A member joins only on a strict gain. The loop is over members; each step is one pass.
    """
    solo = _best(wide, {str(m): [m] for m in members})
    order = sorted(members, key=lambda m: (-solo[str(m)][0], m))
    chosen, history = [order[0]], [(1, order[0], *solo[str(order[0])])]
    while len(chosen) < len(order):
        tries = _best(wide, {str(m): [*chosen, m] for m in order if m not in chosen})
        top = max((m for m in order if m not in chosen), key=lambda m: tries[str(m)][0])
        if tries[str(top)][0] <= history[-1][2]:
            break
        chosen.append(top)
        history.append((len(chosen), top, *tries[str(top)]))
    return history


@query("agg_greedy")
def agg_greedy(spark, folder):
    """Forward selection of members, each candidate at its own best threshold."""
    rows = [(s, m, round(i, 6), round(d, 6), t) for s, m, i, d, t in greedy(_wide(spark, folder).cache(), [0, 1, 2])]
    return spark.createDataFrame(rows, "step int, member int, iou double, dice double, thr double")


_GRID = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _THR) + ") g(thr)"
_VOTES = f"WITH {PX_SQL}, {GT_SQL}, {_MEMBERS}, ens AS (SELECT 'solo_' || k AS name, tile, y, x, p FROM mb UNION ALL SELECT 'vote', tile, y, x, avg(p) FROM mb GROUP BY tile, y, x), sc AS (SELECT name, p, gt.tile IS NOT NULL AS g FROM ens LEFT JOIN gt USING (tile, y, x))"


@query("agg_ensemble", f"{_VOTES} SELECT name, thr, {_RATIO} FROM (SELECT name, thr, {_CNT.format('p > thr')} FROM sc, {_GRID} GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY name ORDER BY tp/(tp+fp+fn+1e-6) DESC, thr) = 1")
def agg_ensemble(spark, folder):
    """Each member alone and the vote of all, each at its best threshold, on the cells they score."""
    m = _members(spark, folder)
    every = m.select(F.concat(F.lit("solo_"), F.col("k")).alias("name"), *_KEY, "p").unionByName(m.groupBy(*_KEY).agg(F.avg("p").alias("p")).select(F.lit("vote").alias("name"), *_KEY, "p"))
    c = every.join(truth(spark, folder).withColumn("g", F.lit(True)), _KEY, "left").withColumn("g", F.coalesce("g", F.lit(False)))
    n = by_threshold(c, "name").withColumn("u", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + _EPS))
    n = n.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("u"), "thr"))).filter("r = 1")
    return _ratios(n, "name", "thr")


@query("agg_ensemble_report")
def agg_ensemble_report(spark, folder):
    """Baseline (first member at one half), the greedy vote, the same cleaned up, and the gains over the baseline in points."""
    wide, t = _wide(spark, folder).cache(), truth(spark, folder)
    history = greedy(wide, [0, 1, 2])
    thr, chosen = history[-1][4], [h[1] for h in history]
    on = wide.filter(_vote(chosen) > thr).select(*_KEY)
    clean = R.without_small(R.close(on, _SQ, SIZE), SIZE, 80)
    rows = []
    for name, mask in (("baseline", wide.filter(F.col("0") > 0.5).select(*_KEY)), ("greedy", on), ("cleaned", clean)):
        hit = mask.join(t.withColumn("g", F.lit(1)), _KEY, "left").agg(F.count("g").alias("tp"), F.count_if(F.col("g").isNull()).alias("fp")).join(t.agg(F.count(F.lit(1)).alias("all")))
        row = _ratios(hit.withColumn("fn", F.col("all") - F.col("tp"))).join(_relaxed(mask, t).select(F.col("iou").alias("relaxed")))
        rows.append(row.select(F.lit(name).alias("name"), "iou", "dice", "relaxed"))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2])
    base = rows[0].select(F.col("iou").alias("i0"), F.col("relaxed").alias("r0"))
    return out.join(base).select("name", "iou", "dice", "relaxed", F.round(100 * (F.col("iou") - F.col("i0")), 4).alias("gain_iou_pts"), F.round(100 * (F.col("relaxed") - F.col("r0")), 4).alias("gain_relaxed_pts"))
