"""Points near other points, by grid cells of the radius' size and an exact check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

RADIUS_M = 6_371_000.0
#: Cell height in radii: higher cells copy fewer points to neighbours but verify more pairs.
CELL_RADII = 3.0


def is_location(lat: Column, lng: Column) -> Column:
    """Both values there, not NaN, in range, and not (0, 0)."""
    return (
        lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
        & (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~((lat == 0) & (lng == 0))
    )


def great_circle(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two places, by the haversine."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


class Grid:
    """Bands of equal latitude, each cut into whole cells of about equal width round the globe."""

    def __init__(self, metres: float, radii: float = CELL_RADII):
        self.reach = math.degrees(metres / RADIUS_M) * (1 + 1e-9) + 1e-12
        self.height = self.reach * radii
        self.bands = max(1, math.ceil(180.0 / self.height))

    def band(self, lat: Column) -> Column:
        return F.least(F.floor((lat + 90.0) / self.height), F.lit(self.bands - 1)).cast("long")

    def around(self, band: Column) -> Column:
        """Cells of a band: as many as keep each at least ``height`` wide on its equator side, at least one."""
        near = F.least(F.abs(band * self.height - 90.0), F.abs((band + 1) * self.height - 90.0))
        return F.greatest(F.floor(F.lit(360.0 / self.height) * F.cos(F.radians(F.least(near, F.lit(90.0))))), F.lit(1)).cast("long")

    def cell(self, lat: Column, lng: Column) -> Column:
        """The hash of the one cell that holds the place."""
        band = self.band(lat)
        n = self.around(band)
        return F.xxhash64(band, F.pmod(F.floor((lng + 180.0) / 360.0 * n).cast("long"), n))

    def cells_in_reach(self, lat: Column, lng: Column) -> Column:
        """The hashes of all cells with a place within the radius, over the date line and the poles too."""
        bands = F.sequence(
            self.band(F.greatest(lat - self.reach, F.lit(-90.0))), self.band(F.least(lat + self.reach, F.lit(90.0)))
        )
        top = F.radians(F.abs(lat)) + math.radians(self.reach)
        spread = F.when(top >= math.pi / 2, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(F.lit(math.sin(math.radians(self.reach))) / F.cos(F.radians(lat)), F.lit(1.0))))
            + 1e-12
        )

        def of_band(band: Column) -> Column:
            n = self.around(band)
            west = F.floor((lng - spread + 180.0) / 360.0 * n).cast("long")
            east = F.floor((lng + spread + 180.0) / 360.0 * n).cast("long")
            steps = F.sequence(west, F.least(east, west + n - 1))
            return F.transform(steps, lambda c: F.xxhash64(band, F.pmod(c, n)))

        return F.flatten(F.transform(bands, of_band))


def near_pairs(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """All pairs of a ``left`` and a ``right`` row at most ``metres`` apart, with their distance.

    Both sides bring ``lat`` and ``lng``, which the result leaves out; the other columns must
    differ by name. Rows whose place is no location (see ``is_location``) match nothing. The
    right side is copied to every cell within reach (1.8 on average), the left side to its own,
    so each pair meets in exactly one cell.
    """
    grid = Grid(metres)
    on_left = left.filter(is_location(F.col("lat"), F.col("lng"))).withColumnsRenamed({"lat": "lat_l", "lng": "lng_l"})
    on_left = on_left.withColumn("__cell", grid.cell(F.col("lat_l"), F.col("lng_l")))
    on_right = right.filter(is_location(F.col("lat"), F.col("lng"))).withColumnsRenamed({"lat": "lat_r", "lng": "lng_r"})
    on_right = on_right.withColumn("__cell", F.explode(grid.cells_in_reach(F.col("lat_r"), F.col("lng_r"))))
    metres_apart = great_circle(F.col("lat_l"), F.col("lng_l"), F.col("lat_r"), F.col("lng_r"))
    apart = F.abs(F.col("lat_l") - F.col("lat_r")) <= grid.reach  # cheap, before the exact check
    return (
        on_left.join(on_right, "__cell").filter(apart).withColumn("metres", metres_apart).filter(F.col("metres") <= metres)
        .drop("__cell", "lat_l", "lng_l", "lat_r", "lng_r")
    )


def _located(nodes: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    """``(k, lat, lng)``: the distinct places of each key, locations only."""
    places = nodes.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    return places.filter(F.col("k").isNotNull() & is_location(F.col("lat"), F.col("lng"))).distinct()


def _as_place(df: DataFrame, tag: str) -> DataFrame:
    """The place twice: for the search, and as ``<tag>lat``, ``<tag>lng`` in its result."""
    return df.select("lat", "lng", F.col("lat").alias(f"{tag}lat"), F.col("lng").alias(f"{tag}lng"))


def _members(located: DataFrame, met: DataFrame, tag: str, name: str) -> DataFrame:
    """Rows of ``met`` with every key that lies at its place ``tag``, as ``name``."""
    own = located.select(F.col("k").alias(name), F.col("lat").alias(f"{tag}lat"), F.col("lng").alias(f"{tag}lng"))
    return met.join(own, [f"{tag}lat", f"{tag}lng"]).drop(f"{tag}lat", f"{tag}lng")


def near_nodes(nodes: DataFrame, key: str, lat: str, lng: str, metres: float) -> DataFrame:
    """``(key_a, key_b)``: two different keys with rows at most ``metres`` apart, the smaller first.

    Repeated rows count once; a key with several places is near what any of them is near. Rows
    with a null key or without a location match nothing; an empty table gives an empty result.

    Places are searched, not keys: a cell holds each place once, however many keys lie there, so
    coordinates of d decimals bound a cell at ``(height 10^d)^2`` rows. Only places that met
    another, or that hold several keys, are then given back to their keys.
    """
    located = _located(nodes, key, lat, lng)
    places = located.groupBy("lat", "lng").agg((F.min("k") < F.max("k")).alias("several"))
    first, second = F.struct("alat", "alng"), F.struct("blat", "blng")
    met = near_pairs(_as_place(places, "a"), _as_place(places, "b"), metres).filter(first < second).drop("metres")
    alone = places.filter("several").select(*[F.col(c[1:]).alias(c) for c in ("alat", "alng", "blat", "blng")])
    both = _members(located, _members(located, met.unionByName(alone), "a", "x"), "b", "y").filter("x <> y")
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def vertices(docs: DataFrame, key: str, lines: str) -> DataFrame:
    """``(doc, lat, lng)``: each distinct location that a document's nested lines pass through.

    Null and empty arrays at any level, points with fewer than two values and points that are no
    location give no row.
    """
    points = docs.select(F.col(key).alias("doc"), F.explode(F.flatten(F.filter(lines, lambda l: l.isNotNull()))).alias("p"))
    points = points.select("doc", F.try_element_at("p", F.lit(1)).alias("lat"), F.try_element_at("p", F.lit(2)).alias("lng"))
    return points.filter(F.col("doc").isNotNull() & is_location(F.col("lat"), F.col("lng"))).distinct()


def nodes_near_lines(
    nodes: DataFrame, key: str, lat: str, lng: str, docs: DataFrame, doc_key: str, lines: str, metres: float
) -> DataFrame:
    """``(key_a, key_b)``: nodes and the documents with a line vertex at most ``metres`` away.

    Places of nodes and vertices of lines are searched once each, however many nodes and documents
    share them, and only what met is given back to its nodes and documents.
    """
    located = _located(nodes, key, lat, lng)
    of_docs = vertices(docs, doc_key, lines)
    once, places = (_as_place(df.select("lat", "lng").distinct(), tag) for df, tag in ((of_docs, "v"), (located, "a")))
    met = _members(located, near_pairs(places, once, metres).drop("metres"), "a", "key_a").distinct()
    owners = of_docs.select(F.col("doc").alias("key_b"), F.col("lat").alias("vlat"), F.col("lng").alias("vlng"))
    return met.join(owners, ["vlat", "vlng"]).select("key_a", "key_b").distinct()


#: Levels of cells, as powers of two of a degree: from a tenth of a millimetre to half the globe.
LEVELS = (-30, 8)


#: Points of one cell that one task should hold.
HOT_CELL = 200_000


def in_regions(points: DataFrame, regions: DataFrame, cell_degrees: float | None = None, hot: int = HOT_CELL) -> DataFrame:
    """Pairs of a point and a polygon that holds it (even-odd rule, edges on the west and south in).

    ``points`` brings ``lat``, ``lng`` and keys; ``regions`` a key and ``ring`` (array of
    ``struct<lat, lng>``, closed or not, not across the date line). A ring with fewer than three
    vertices, or null, holds nothing; points that are no location lie nowhere.

    A region is entered in the cells of its bounding box on the level of cells as wide as its
    longer side: four cells at most, whatever its size. A point looks in its cell on every level
    that has regions (``LEVELS`` bounds their number); the ring decides. With ``cell_degrees`` all
    cells are of that size. Cells with more than ``HOT_CELL`` points, of which there are at most
    levels x points / ``HOT_CELL``, are split by a hash of the place, and their regions repeated.
    """
    boxed = regions.filter(F.size("ring") >= 3).withColumns(
        {
            "__s": F.array_min(F.transform("ring", lambda p: p["lat"])), "__n": F.array_max(F.transform("ring", lambda p: p["lat"])),
            "__w": F.array_min(F.transform("ring", lambda p: p["lng"])), "__e": F.array_max(F.transform("ring", lambda p: p["lng"])),
        }
    )
    side = F.greatest(F.col("__n") - F.col("__s"), F.col("__e") - F.col("__w"), F.lit(2.0 ** LEVELS[0]))
    level = F.least(F.ceil(F.log2(side)), F.lit(LEVELS[1])).cast("int")
    boxed = boxed.withColumn("__level", level if cell_degrees is None else F.lit(0))
    base = F.pow(F.lit(2.0), F.col("__level")) if cell_degrees is None else F.lit(float(cell_degrees))
    cell = lambda c: F.floor(F.col(c) / base)
    tiles = boxed.withColumn("__cy", F.explode(F.sequence(cell("__s"), cell("__n")))).withColumn("__cx", F.explode(F.sequence(cell("__w"), cell("__e"))))
    used = sorted(r[0] for r in boxed.select("__level").distinct().collect())  # at most as many as LEVELS has
    here = points.filter(is_location(F.col("lat"), F.col("lng"))).withColumn("__level", F.explode(F.array(*map(F.lit, used)).cast("array<int>")))
    here = here.withColumns({"__cy": cell("lat"), "__cx": cell("lng")})
    keys = ["__level", "__cy", "__cx"]
    dense = here.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot).select(*keys, F.ceil(F.col("__n") / hot).alias("__k"))
    pieces = F.coalesce("__k", F.lit(1))
    here = here.join(F.broadcast(dense), keys, "left").withColumn("__z", F.pmod(F.xxhash64("lat", "lng"), pieces)).drop("__k")
    tiles = tiles.join(F.broadcast(dense), keys, "left").withColumn("__z", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("__k")
    n = F.size("ring")
    crossings = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda total, k: total + _crosses(F.element_at("ring", k), F.element_at("ring", F.pmod(k, n) + 1)),
    )
    return (
        here.join(tiles, [*keys, "__z"])
        .filter(F.col("lat").between(F.col("__s"), F.col("__n")) & F.col("lng").between(F.col("__w"), F.col("__e")))
        .filter(crossings % 2 == 1)
        .drop(*keys, "__z", "__s", "__n", "__w", "__e", "ring")
    )


def _crosses(a: Column, b: Column) -> Column:
    """1 if the eastward ray from the point crosses the edge a-b."""
    spans = (a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))
    at = (b["lng"] - a["lng"]) * (F.col("lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lng"]
    return F.when(spans & (F.col("lng") < at), 1).otherwise(0)
