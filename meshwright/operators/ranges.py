"""Range and nearest-neighbour joins in the plane, as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshwright.planning.joins import merged


def within(points: DataFrame, keys: list[str], radius: float, others: DataFrame | None = None) -> DataFrame:
    """Ordered pairs of points with equal ``keys`` at most ``radius`` apart, a point with itself too.

    Both frames have ``keys``, ``x``, ``y`` and more columns, which come out with ``_a`` and
    ``_b``. The second side is copied to the nine cells around its own, the first stays in one.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    name = lambda df, s: df.withColumnsRenamed({c: f"{c}{s}" for c in df.columns if c not in keys})
    a = name(points, "_a").withColumns({"__cx": cell("x_a"), "__cy": cell("y_a")})
    b = name(points if others is None else others, "_b")
    around = F.array(*[F.struct((cell("x_b") + i).alias("cx"), (cell("y_b") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = b.withColumn("__c", F.explode(around)).withColumns({"__cx": F.col("__c.cx"), "__cy": F.col("__c.cy")}).drop("__c")
    near = (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b")) + (F.col("y_a") - F.col("y_b")) * (F.col("y_a") - F.col("y_b"))
    return a.join(merged(b), [*keys, "__cx", "__cy"]).filter(near <= radius * radius).drop("__cx", "__cy")


def nearest(points: DataFrame, keys: list[str], radius: float, others: DataFrame, other_id: str, point_id: str) -> DataFrame:
    """Each point's nearest other within ``radius`` (ties: the least id): keys, point, other, distance."""
    d2 = (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b")) + (F.col("y_a") - F.col("y_b")) * (F.col("y_a") - F.col("y_b"))
    pairs = within(points, keys, radius, others).select(*keys, f"{point_id}_a", f"{other_id}_b", d2.alias("d2"))
    best = pairs.groupBy(*keys, f"{point_id}_a").agg(F.min(F.struct("d2", f"{other_id}_b")).alias("m"))
    return best.select(
        *keys, F.col(f"{point_id}_a").alias(point_id), F.col(f"m.{other_id}_b").alias("nearest"), F.sqrt(F.col("m.d2").cast("double")).alias("distance")
    )


#: Levels of cells for boxes, as powers of two.
LEVELS = (-30, 10)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a ``left`` and a ``right`` box (columns south, north, west, east) that overlap; touching does not.

    The other columns must differ by name; the boxes themselves are left out. A box lies in the at
    most four cells of the level that is as wide as its longer side, and is also entered in the
    cells of the coarser levels that are in use. Two boxes meet on the level of the larger one, so
    many small boxes in one place never meet through a coarse cell that only holds small ones.
    """
    edges = ["south", "north", "west", "east"]
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(2.0 ** LEVELS[0]))
    level = F.least(F.ceil(F.log2(side)), F.lit(LEVELS[1])).cast("int")
    a, b = (df.filter(" and ".join(f"{c} is not null" for c in edges)).withColumn("__own", level) for df in (left, right))
    used = sorted({r[0] for df in (a, b) for r in df.select("__own").distinct().collect()})  # at most as many as LEVELS has

    def entered(df: DataFrame, tag: str) -> DataFrame:
        on = df.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, used)).cast("array<int>"), lambda k: k >= F.col("__own"))))
        cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("__level")))
        on = on.withColumn("__cy", F.explode(F.sequence(cell("south"), cell("north")))).withColumn("__cx", F.explode(F.sequence(cell("west"), cell("east"))))
        return on.withColumnsRenamed({c: f"{tag}{c}" for c in [*edges, "__own"]})

    x, y = entered(a, "__a"), entered(b, "__b")
    keys = ["__level", "__cy", "__cx"]
    home = lambda df, tag: df.filter(F.col(f"{tag}__own") == F.col("__level"))
    above = lambda df, tag: df.filter(F.col(f"{tag}__own") < F.col("__level"))
    met = home(x, "__a").join(y, keys).unionByName(above(x, "__a").join(home(y, "__b"), keys))
    met = met.filter("__awest < __beast and __bwest < __aeast and __asouth < __bnorth and __bsouth < __anorth")
    return met.select(*[c for c in [*left.columns, *right.columns] if c not in edges]).distinct()
