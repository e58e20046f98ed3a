"""Train, validation and test splits that keep tied records together."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from meshwright.llm.contraction import CELL_LINKS, contract
from meshwright.planning.lineage import materialise
from meshwright.planning.ranking import buckets_for, spread_rank
from meshwright.planning.skew import look_up

#: Spellings that stand for a missing scene id.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "none", "null", "nan", "nil", "unknown", "missing", "undefined", "tbd", "todo", "x", "xxx", "0"]
SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))
#: Levels of the hierarchical merge join this many local forests into one.
FAN_IN = 8


def sample_name(tile: Column) -> Column:
    """A tile's sample, however it is spelled: folder, case, separators, ending dropped."""
    bare = F.lower(F.trim(F.regexp_replace(tile, r"^.*[/\\]", "")))
    bare = F.regexp_replace(bare, r"\.(?:jpe?g|png|tiff?|webp|bmp|npy|json)$", "")
    bare = F.regexp_replace(bare, r"[\s_\-.]*(?:sat|mask)$", "")
    bare = F.regexp_replace(bare, r"[\s_\-.]+", "_")
    return F.regexp_replace(bare, r"^_+|_+$", "")


def real_scene(scene: Column) -> Column:
    """The scene id, or null for a missing, empty or placeholder one."""
    text = F.trim(scene)
    return F.when(~F.lower(text).isin(PLACEHOLDERS) & text.rlike(r"[\p{L}\p{N}]"), text)


def _levels(cell_links: int):
    """Cells of a round: each link goes to a leaf by its hash, and leaves merge ``FAN_IN`` to one a level."""
    leaves: list[int] = []

    def spread(frame: DataFrame, n: int, turn: int) -> DataFrame:
        need = max(1, math.ceil(n / cell_links))
        if not leaves:
            leaves.append(need)
        else:  # one level up, but never more links to a cell than it is sized for
            leaves.append(max(need, math.ceil(leaves[-1] / FAN_IN)))
        return frame.repartitionById(leaves[-1], F.pmod(F.xxhash64("ax", "an", "bx", "bn"), F.lit(leaves[-1])).cast("int"))

    return spread


def _ties(sites: DataFrame, key: str, tiles: str, scene: str) -> DataFrame:
    """Links of sites (0, key) to what they name: two hashes of kind and name, 127 bits, the first one odd."""
    base = sites.select(F.col(key).cast("long").alias("k"), F.col(tiles).alias("tiles"), F.col(scene).alias("scene"))
    base = base.filter(F.col("k").isNotNull()).distinct()
    by_tile = base.select("k", F.explode("tiles").alias("t")).select("k", F.lit("t").alias("kind"), sample_name(F.col("t")).alias("n")).filter("n <> ''")
    by_scene = base.select("k", F.lit("s").alias("kind"), real_scene(F.col("scene")).alias("n"))
    named = by_tile.unionByName(by_scene).filter("n is not null")
    return named.select(
        F.lit(0).cast("long").alias("ax"), F.col("k").alias("an"),
        F.xxhash64("kind", "n", F.lit(1)).bitwiseOR(F.lit(1)).alias("bx"), F.xxhash64("kind", "n", F.lit(2)).alias("bn"),
    )


def tied_groups(sites: DataFrame, key: str, tiles: str, scene: str, cell_links: int = CELL_LINKS) -> DataFrame:
    """``(key, group_key, size)`` of every site that names a sample or a real scene.

    Sites link to what they name, so a sample or scene shared by a third of all sites is a
    vertex with many links, never a set of pairs. A null key is dropped; null, empty and
    placeholder names tie nothing; repeated rows count once; two rows of one key are one site
    with the names of both. ``group_key`` is the least key of the group.
    """
    links = materialise(_ties(sites, key, tiles, scene), "splits-ties")
    rooted, most = contract(links, _levels(cell_links), "splits", links.count(), cell_links)
    own = materialise(rooted.filter("vx = 0").select(F.col("vn").alias(key), "rx", "rn"), "splits-rooted")
    groups = own.groupBy("rx", "rn").agg(F.min(key).alias("group_key"), F.count(F.lit(1)).alias("size"))
    return look_up(own, groups, ["rx", "rn"], [key, key], most=most).select(key, "group_key", "size")


def fill_splits(sizes: list[tuple[int, int]], shares=SHARES) -> list[tuple[int, int, int, str]]:
    """Greedy, largest first: each group goes to the split furthest below its target.

    ``sizes`` holds ``(size, number of groups)``. Equal groups are interchangeable, so a size
    is one run of decisions, given as ``(size, first rank, end rank, split)``. Ties go to the
    split named first. Many equal groups are handed out at once, down to the common shortfall
    at which greedy would arrive, and the last few one by one.
    """
    total = sum(s * n for s, n in sizes)
    lack = {name: share * total for name, share in shares}
    names = [name for name, _ in shares]
    plan: list[tuple[int, int, int, str]] = []

    def give(size: int, at: int, n: int, name: str) -> int:
        if n:
            if plan and plan[-1][0] == size and plan[-1][3] == name and plan[-1][2] == at:
                plan[-1] = (size, plan[-1][1], at + n, name)
            else:
                plan.append((size, at, at + n, name))
            lack[name] -= n * size
        return at + n

    for size, count in sorted(sizes, reverse=True):
        at = 0
        if count > len(names):
            # greedy hands equal groups out until all shortfalls it touches are level: go there at once
            order = sorted(lack.values(), reverse=True)
            level = max((sum(order[:k]) - count * size) / k for k in range(1, len(order) + 1))
            for m in names:
                at = give(size, at, min(count - at, max(0, math.floor((lack[m] - level) / size))), m)
        while at < count:
            at = give(size, at, 1, max(names, key=lambda m: (lack[m], -names.index(m))))
    return plan


def assign_splits(sites: DataFrame, key: str, tiles: str, scene: str, shares=SHARES, cell_links: int = CELL_LINKS) -> DataFrame:
    """``(key, group_key, split)`` for every site with a key, tied or not.

    What goes to the driver is the number of groups of each size: at most the square root of
    twice the number of sites. Groups of one size are told apart by an exact rank.
    """
    everyone = sites.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    tied = tied_groups(sites, key, tiles, scene, cell_links)
    full = materialise(
        everyone.join(tied, key, "left").select(
            key, F.coalesce("group_key", key).alias("group_key"), F.coalesce("size", F.lit(1)).cast("long").alias("size")
        ),
        "splits-groups",
    )
    groups = full.filter(F.col(key) == F.col("group_key")).select("group_key", "size")
    histogram = [(int(r["size"]), int(r["count"])) for r in groups.groupBy("size").count().collect()]
    spark = sites.sparkSession
    runs = fill_splits(histogram, shares)
    plan = spark.createDataFrame(runs, "psize long, first long, end long, split string")
    ranked = spread_rank(groups, ["size"], "group_key", buckets=buckets_for(sum(n for _, n in histogram)))
    # at most one run a size and split: 3 sqrt(2 n) short rows, 20 MB for ten billion sites
    chosen = ranked.join(
        F.broadcast(plan) if len(runs) <= 1_000_000 else plan, (F.col("size") == F.col("psize")) & (F.col("rank0") >= F.col("first")) & (F.col("rank0") < F.col("end"))
    ).select("group_key", "split")
    return look_up(full.select(key, "group_key"), chosen, "group_key", key, most=full.count())
