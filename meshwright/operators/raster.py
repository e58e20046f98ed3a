"""Sparse raster operators: a mask is the set of its pixels (tile, y, x)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meshwright.functions import raster_kernels as K

#: The eight dihedral maps of a square of side n: (row, column) as expressions of y, x and m = n - 1.
DIHEDRAL = [("y", "x"), ("y", "m-x"), ("m-y", "x"), ("m-y", "m-x"), ("x", "y"), ("x", "m-y"), ("m-x", "y"), ("m-x", "m-y")]


def _offsets(pairs) -> F.Column:
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in pairs]))


def dilate(px: DataFrame, pairs, size: int | None = None) -> DataFrame:
    """Pixels reached from any pixel by an offset, inside a raster of side ``size`` if given."""
    out = px.select("tile", "y", "x", _offsets(pairs).alias("o")).select("tile", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    if size:
        out = out.filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
    return out.distinct()


def erode(px: DataFrame, pairs, size: int | None = None) -> DataFrame:
    """Pixels all of whose offsets are set. Outside is empty, or, with ``size``, set: then only the
    offsets inside the raster count, and a mask keeps its rim."""
    pairs = list(pairs)
    hits = px.select("tile", "y", "x", _offsets(pairs).alias("o")).select("tile", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"))
    needed = F.lit(len(pairs))
    if size:
        hits = hits.filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
        inside = lambda dy, dx: (F.col("y") + dy).between(0, size - 1) & (F.col("x") + dx).between(0, size - 1)
        needed = sum((inside(dy, dx).cast("int") for dy, dx in pairs), F.lit(0))
    return hits.groupBy("tile", "y", "x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == needed).select("tile", "y", "x")


def close(px: DataFrame, pairs, size: int | None = None, keep_rim: bool = False) -> DataFrame:
    return erode(dilate(px.select("tile", "y", "x"), pairs, size), pairs, size if keep_rim else None)


def windows(size: int, window: int, step: int) -> list[int]:
    """Window origins along a side: every ``step``, the last flush with the edge."""
    last = max(0, size - window)
    return sorted({*range(0, last + 1, step), last})


def per_tile_raster(px: DataFrame, size: int, run, schema: str, value: str | None = None) -> DataFrame:
    """``run(tile, dense array)`` for each tile; absent pixels are 0. A tile is one image of bounded size."""

    def dense(key, pdf: pd.DataFrame) -> pd.DataFrame:
        arr = np.zeros((size, size), np.float64 if value else bool)
        arr[pdf.y, pdf.x] = pdf[value] if value else True
        return run(key[0], arr)

    return px.groupBy("tile").applyInPandas(dense, schema)


def pixels(tile, mask: np.ndarray) -> pd.DataFrame:
    y, x = np.nonzero(mask)
    return pd.DataFrame({"tile": tile, "y": y.astype(np.int32), "x": x.astype(np.int32)})


PX = "tile int, y int, x int"


def hysteresis(px: DataFrame, size: int, high: float, low: float) -> DataFrame:
    return per_tile_raster(px, size, lambda t, a: pixels(t, K.hysteresis(a, high, low)), PX, "p")


def grown(px: DataFrame, size: int, seed, may) -> DataFrame:
    """Pixels where ``may`` holds, of 4-connected regions that hold one where ``seed`` does too (conditions on ``px``)."""
    coded = px.filter(may).select("tile", "y", "x", F.when(seed, 2.0).otherwise(1.0).alias("p"))
    return hysteresis(coded, size, 2.0, 1.0)


def skeletons(px: DataFrame, size: int, least: int = 80, square: int = 5) -> DataFrame:
    return per_tile_raster(px, size, lambda t, a: pixels(t, K.skeleton(a, least, square)), PX)


def without_small(px: DataFrame, size: int, least: int) -> DataFrame:
    return per_tile_raster(px, size, lambda t, a: pixels(t, K.drop_small(a, least)), PX)


def graph_edges(skel: DataFrame, size: int, spur: float = 12.0) -> DataFrame:
    """Edges traced from skeletons: tile, u, v, places of both ends, weight, points."""

    def run(tile, a):
        at, edges = K.trace(a, spur)
        rows = [(tile, u, v, *at[u], *at[v], w, [[float(r), float(c)] for r, c in line]) for u, v, w, line in edges]
        return pd.DataFrame(rows, columns=["tile", "u", "v", "xu", "yu", "xv", "yv", "weight", "pts"])

    return per_tile_raster(skel, size, run, "tile int, u long, v long, xu double, yu double, xv double, yv double, weight double, pts array<array<double>>")


def draw(lines: DataFrame) -> DataFrame:
    """One-pixel polylines: ``lines`` has tile and the ends x0, y0, x1, y1 of straight pieces."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1))
    step = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") + 0.5).cast("int")
    return step.select("tile", at("y0", "y1").alias("y"), at("x0", "x1").alias("x")).distinct()
