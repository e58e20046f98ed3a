"""Consolidating pairwise matches into groups, on a two-dimensional grid of vertex blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from meshwright.llm.contraction import CELL_LINKS, block, contract
from meshwright.planning.lineage import materialise
from meshwright.planning.skew import look_up

#: Names of scopes are broadcast up to this many (a few MB); beyond, they are looked up in a shuffle.
FEW_SCOPES = 100_000


def _grid(cell_links: int):
    """Cells of a round: block of one end by block of the other, sized by the links there are.

    Each cell is a partition of its own. A vertex with a third of all links shares its row of the
    grid with all column blocks, so a cell of n links in all gets a ``side``-th of it at most.
    """

    def spread(frame: DataFrame, n: int, turn: int) -> DataFrame:
        side = max(1, math.ceil(math.sqrt(n / cell_links)))
        if side == 1:
            return frame.coalesce(1)
        return frame.repartitionById(side * side, block("a", turn, side) * side + block("b", turn, side))

    return spread


def _scopes(clean: DataFrame) -> tuple[DataFrame, int, int]:
    """``(x, s)``: the scopes with a number each, how many there are, and the seed that tells all apart."""
    for seed in range(42, 142):
        named = clean.groupBy(F.xxhash64("s", F.lit(seed)).alias("x")).agg(F.min("s").alias("s"), F.max("s").alias("t"))
        named = materialise(named, "groups-scopes")
        sizes = named.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") != F.col("t")).alias("bad")).first()
        if not sizes["bad"]:
            return named.select("x", "s"), sizes["n"], seed
    raise RuntimeError("no seed tells the scopes apart")


def match_groups(
    pairs: DataFrame, scope: str, left: str, right: str, cell_links: int = CELL_LINKS
) -> DataFrame:
    """``(scope, node_id, group_id)``: every linked vertex with the least id of its group.

    ``left`` and ``right`` are ids within ``scope``; the same id in two scopes is two vertices.
    A row with a null in any of the three, or with equal ends, links nothing, and its vertices
    do not come out unless another row links them. Repeated and reversed pairs count once. An
    empty table gives an empty result; other columns of ``pairs`` are ignored.
    """
    clean = pairs.select(
        F.col(scope).cast("string").alias("s"), F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")
    ).filter("s is not null and l is not null and r is not null and l <> r")
    scopes, few, seed = _scopes(clean)
    x = F.xxhash64("s", F.lit(seed))
    links = clean.select(x.alias("ax"), F.col("l").alias("an"), x.alias("bx"), F.col("r").alias("bn"))
    rooted, most = contract(links, _grid(cell_links), "groups", pairs.count(), cell_links)
    rooted = materialise(rooted, "groups-rooted")
    least = rooted.groupBy("rx", "rn").agg(F.min("vn").alias("group_id"))
    found = look_up(rooted, least, ["rx", "rn"], ["vx", "vn"], most=most).select(F.col("vx").alias("x"), "vn", "group_id")
    named = found.join(F.broadcast(scopes), "x") if few <= FEW_SCOPES else look_up(found, scopes, "x", "vn", most=most)
    return named.select(F.col("s").alias(scope), F.col("vn").alias("node_id"), "group_id")
