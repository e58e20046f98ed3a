"""Images, mosaics, map documents and settings: written to the shared folder as files, read by the sources.

The files are made from the star-schema tables, so that SQL over the same tables tells what must come
back. Writing happens when a query is built; the files are deleted when the process ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from meshwright.functions import raster_kernels as K
from meshwright.functions.geo import elevation
from meshwright.operators import maps, raster as R
from meshwright.planning.lineage import new_path
from meshwright.plans.fixtures import GT_SQL, PX_SQL, probability, truth
from meshwright.sources import files, tiles
from meshwright.sources.png import encode_png
from meshwright.sources.tables import table

QUERIES, SQL = {}, {}
SIDE = 64


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _write_images(spark, pixels, path: str, name: str) -> None:
    """One PNG a tile of ``pixels`` (tile, y, x, r, g, b); ``name`` has a place for the tile."""
    jvm_path = path.removeprefix("file://")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        image = np.zeros((SIDE, SIDE, 3), np.uint8)
        image[pdf.y, pdf.x] = pdf[["r", "g", "b"]].to_numpy(np.uint8)
        os.makedirs(jvm_path, exist_ok=True)
        with open(os.path.join(jvm_path, name.format(key[0])), "wb") as f:
            f.write(encode_png(image))
        return pd.DataFrame({"n": [len(pdf)]})

    pixels.groupBy("tile").applyInPandas(run, "n long").count()


def _grey(spark, folder):
    return probability(spark, folder).select("tile", "y", "x", F.least(F.floor(F.col("p") * 255), F.lit(255)).cast("int").alias("v"))


_GREY = f"WITH {PX_SQL}, {GT_SQL}, gy AS (SELECT tile, y, x, CAST(least(floor(p*255), 255) AS INTEGER) AS v FROM px), at AS (SELECT CAST(range AS INTEGER) AS i FROM range(64)), cells AS (SELECT t.tile, a.i AS y, b.i AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT tile FROM px) t CROSS JOIN at a CROSS JOIN at b LEFT JOIN gy ON gy.tile = t.tile AND gy.y = a.i AND gy.x = b.i)".replace(" at AS", " grid AS").replace("JOIN at ", "JOIN grid ")


@query("src_image", _GREY + " SELECT 'i' || c.tile AS stem, c.y, c.x, v AS r, 255 - v AS g, (v * 7) % 256 AS b, gt.tile IS NOT NULL AS road FROM cells c LEFT JOIN gt USING (tile, y, x) WHERE c.tile IN (SELECT tile FROM gt)")
def src_image(spark, folder):
    """Pixels of image and mask files paired by name; the mask counts above its threshold."""
    path = new_path(spark, "images")
    every = spark.range(SIDE).select(F.col("id").cast("int").alias("y")).join(spark.range(SIDE).select(F.col("id").cast("int").alias("x")))  # 64 x 64 places
    g = _grey(spark, folder)
    full = g.select("tile").distinct().join(every).join(g, ["tile", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    _write_images(spark, full.select("tile", "y", "x", F.col("v").alias("r"), (255 - F.col("v")).alias("g"), (F.col("v") * 7 % 256).alias("b")), path, "i{}_sat.png")
    road = truth(spark, folder)
    _write_images(spark, road.select("tile", "y", "x", F.lit(255).alias("r"), F.lit(255).alias("g"), F.lit(255).alias("b")), path, "i{}_mask.png")
    return files.sample_pixels(spark, path)


#: Where the mosaic stands: zoom, north-west tile and tiles a side. The last row of tiles is missing.
_ZOOM, _X0, _Y0, _GRID = 10, 732, 473, 3
_PLACES = [(year, i % _GRID, i // _GRID) for i, year in enumerate(range(1995, 2001))]


def _tile_files(spark, folder) -> str:
    """Six years' rasters as tiles of a mosaic three wide; its third row is not there."""
    path = new_path(spark, "tiles")
    names = spark.createDataFrame([(y, f"{_X0 + i}_{_Y0 + j}") for y, i, j in _PLACES], "tile int, name string")
    g = _grey(spark, folder).join(names, "tile")
    _write_images(spark, g.select(F.col("name").alias("tile"), "y", "x", *[F.col("v").alias(c) for c in "rgb"]), path, "{}.png")
    return path + "/{x}_{y}.png"


def _template(path: str) -> str:
    return path if "://" in path else "file://" + path


def _read_tiles(spark, template: str, **options):
    tiles.register(spark)
    read = spark.read.format("xyz_tiles").option("template", _template(template)).option("zoom", _ZOOM).option("grid", _GRID).option("pause", 0)
    for key, value in options.items():
        read = read.option(key, value)
    return read.load()


_NORTH = "degrees(atan(sinh(pi()*(1 - 2*{0}/1024.0::DOUBLE))))"


@query("src_mosaic", f"SELECT {_X0} AS x0, {_Y0} AS y0, 192 AS img_w, 192 AS img_h, round({_NORTH.format(_Y0)}, 9) AS north, round({_NORTH.format(_Y0 + 3)}, 9) AS south, round({_X0 + 3}/1024.0::DOUBLE*360 - 180, 9) AS east, round({_X0}/1024.0::DOUBLE*360 - 180, 9) AS west, CAST(9 AS BIGINT) AS tiles, CAST(3 AS BIGINT) AS failures, (SELECT count(*) FROM (SELECT unnest([1995, 1996, 1997, 1998, 1999, 2000])) ) * 4096 AS pixels")
def src_mosaic(spark, folder):
    """The tiles around a place laid side by side: bounds, size, and how many could not be had."""
    template = _tile_files(spark, folder)
    cells = _read_tiles(spark, template, lat=12.97, lng=77.7)
    f = tiles.frame_of(cells, _ZOOM, SIDE)
    n = tiles.mosaic(cells, SIDE).agg(F.count(F.lit(1)).alias("pixels"))
    return f.join(n).select("x0", "y0", "img_w", "img_h", *[F.round(c, 9).alias(c) for c in ("north", "south", "east", "west")], "tiles", "failures", "pixels")


_CASE = " ".join(f"WHEN {y} THEN {{{k}}}" for k, (y, _, _) in enumerate(_PLACES))


@query("src_refetch", _GREY + ", p(tile, i, j) AS (VALUES " + ", ".join(f"({y}, {i}, {j})" for y, i, j in _PLACES) + ") SELECT CAST(y + 64*j AS INTEGER) AS y, CAST(x + 64*i AS INTEGER) AS x, v AS r, v AS g, v AS b FROM cells JOIN p USING (tile)")
def src_refetch(spark, folder):
    """The same mosaic again from its stored origin, pixel by pixel."""
    return tiles.mosaic(_read_tiles(spark, _tile_files(spark, folder), x0=_X0, y0=_Y0), SIDE)


@query("src_tiles_xyz", f"SELECT CAST({_X0} + i AS INTEGER) AS x, CAST({_Y0} + j AS INTEGER) AS y, CAST(i AS INTEGER) AS col, CAST(j AS INTEGER) AS row, j < 2 AS had FROM range(3) a(i), range(3) b(j)")
def src_tiles_xyz(spark, folder):
    """One partition a tile; after all tries a tile that is not there is null."""
    return _read_tiles(spark, _tile_files(spark, folder), x0=_X0, y0=_Y0).select("x", "y", "col", "row", F.col("data").isNotNull().alias("had"))


QUERIES["src_http_retry"], SQL["src_http_retry"] = src_tiles_xyz, SQL["src_tiles_xyz"]

#: Sites of the batch and their origins: in the middle of the tiles, at the missing row, and beyond all.
_SITES = [("whole", _X0, _Y0), ("edge", _X0, _Y0 + 1), ("far", _X0 + 50, _Y0)]


@query("batch_bake", "SELECT * FROM (VALUES ('whole', 4::BIGINT, 0::BIGINT, 'kept', 4*4096::BIGINT), ('edge', 4, 2, 'skipped', 0), ('far', 4, 4, 'skipped', 0)) t(stem, tiles, failures, status, pixels)")
def batch_bake(spark, folder, most_failures: float = 0.15):
    """Many sites in one go: what fails is counted, and sites with too many failures are skipped, not fatal."""
    sites = spark.createDataFrame(_SITES, "stem string, x0 int, y0 int")
    cells = tiles.fetch_sites(sites, _template(_tile_files(spark, folder)), _ZOOM, 2, pause=0)
    f = tiles.frame_of(cells, _ZOOM, SIDE).select("stem", "tiles", "failures")
    f = f.withColumn("status", F.when(F.col("failures") > F.col("tiles") * most_failures, "skipped").otherwise("kept"))
    n = tiles.mosaic(cells, SIDE).groupBy("stem").agg(F.count(F.lit(1)).alias("pixels"))
    return f.join(n, "stem", "left").select("stem", "tiles", "failures", "status", F.when(F.col("status") == "kept", F.col("pixels")).otherwise(0).alias("pixels"))


#: Pixels of the crop, and the size that it is brought to.
_CROP, _SIZE = (5.3, 50.7), 32
_AXIS = "SELECT CAST(range AS INTEGER) AS o, least(greatest((range + 0.5::DOUBLE)*46/32 - 0.5, 0), 45) AS v FROM range(32)"


@query("src_dem_grid", _GREY + f""", m AS (SELECT tile, y - 5 AS y, x - 5 AS x, v*256.0::DOUBLE + v + (v*7%256)/256.0::DOUBLE - 32768.0::DOUBLE AS e FROM cells WHERE y BETWEEN 5 AND 50 AND x BETWEEN 5 AND 50),
 ax AS (SELECT o, CAST(floor(v) AS INTEGER) AS lo, least(CAST(floor(v) AS INTEGER) + 1, 45) AS hi, v - floor(v) AS f FROM ({_AXIS}))
 SELECT a.tile, yy.o AS y, xx.o AS x, round((a.e*(1-yy.f) + c.e*yy.f)*(1-xx.f) + (b.e*(1-yy.f) + d.e*yy.f)*xx.f, 4) AS metres FROM ax yy CROSS JOIN ax xx
 JOIN m a ON a.y = yy.lo AND a.x = xx.lo JOIN m b ON b.tile = a.tile AND b.y = yy.lo AND b.x = xx.hi JOIN m c ON c.tile = a.tile AND c.y = yy.hi AND c.x = xx.lo JOIN m d ON d.tile = a.tile AND d.y = yy.hi AND d.x = xx.hi""")
def src_dem_grid(spark, folder):
    """Terrain colours decoded, cut to a fractional window and brought to another size, linearly between pixels."""
    g = _grey(spark, folder)
    low, high = K.crop_window(*_CROP)
    # colours that are not there are black
    metres = g.select("tile", "y", "x", (elevation(F.col("v"), F.col("v"), F.col("v") * 7 % 256) + 32768.0).alias("e"))

    def run(tile, a):
        small = K.resize_bilinear(a[low:high, low:high] - 32768.0, _SIZE, _SIZE)
        y, x = (v.ravel() for v in np.indices(small.shape))
        return pd.DataFrame({"tile": tile, "y": y, "x": x, "metres": small.ravel().round(9)})

    out = R.per_tile_raster(metres, SIDE, run, "tile int, y int, x int, metres double", "e")
    return out.select("tile", "y", "x", F.round("metres", 4).alias("metres"))


# ---- map documents --------------------------------------------------------------------------------
_KINDS = [*maps.ROAD_TYPES, "footway", "service"]
_WAYS = "wy AS (SELECT o_custkey AS doc, o_orderkey AS way, ([" + ", ".join(f"'{k}'" for k in _KINDS) + f"])[CAST(o_orderkey % {len(_KINDS)} AS BIGINT) + 1] AS highway, CASE WHEN o_orderkey % 11 = 0 THEN 'yes' WHEN o_orderkey % 13 = 0 THEN 'building_passage' WHEN o_orderkey % 5 = 0 THEN 'no' END AS tunnel FROM orders), rf AS (SELECT o_custkey AS doc, l_orderkey AS way, l_partkey AS ref, l_linenumber AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _map_documents(spark, folder):
    """A JSON document per customer: orders are ways, parts their nodes; every 17th part has no node element."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey")
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    nothing = lambda kind: F.lit(None).cast(kind)
    highway = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % len(_KINDS)).cast("int") + 1)
    tunnel = F.when(F.col("o_orderkey") % 11 == 0, "yes").when(F.col("o_orderkey") % 13 == 0, "building_passage").when(F.col("o_orderkey") % 5 == 0, "no")
    pairs = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("tunnel"), tunnel), lambda _, v: v.isNotNull())
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"])
    ways = li.groupBy("doc", "o_orderkey").agg(in_order.alias("nodes")).select("doc", F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("id"), nothing("double").alias("lat"), nothing("double").alias("lon"), "nodes", pairs.alias("tags")).alias("e"))
    part = li.filter("l_partkey % 17 <> 0").select("doc", "l_partkey").distinct()
    lat, lon = F.col("l_partkey") % 170 / 2.0 - 42, F.col("l_partkey") % 350 - 175.0
    nodes = part.select("doc", F.struct(F.lit("node").alias("type"), F.col("l_partkey").alias("id"), lat.alias("lat"), lon.alias("lon"), nothing("array<long>").alias("nodes"), nothing("map<string, string>").alias("tags")).alias("e"))
    docs = ways.unionByName(nodes).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("e.type", "e.id", "e.lat", "e.lon", "e.nodes", F.map_entries("e.tags").alias("tags")))).alias("l"))
    whole = F.transform("l", lambda e: F.struct(e["type"].alias("type"), e["id"].alias("id"), e["lat"].alias("lat"), e["lon"].alias("lon"), e["nodes"].alias("nodes"), F.map_from_entries(e["tags"]).alias("tags")))
    path = new_path(spark, "maps")
    docs.select(F.to_json(F.struct("doc", whole.alias("elements"))).alias("value")).write.text(path)
    text = spark.read.schema("value string").text(path)
    return maps.elements(text.select(F.get_json_object("value", "$.doc").cast("long").alias("doc"), "value"), "doc", "value")


@query("src_osm", f"WITH {_WAYS} SELECT doc, way AS id, 'way' AS type, highway, tunnel, (SELECT count(*) FROM rf WHERE rf.way = wy.way) AS refs FROM wy WHERE way IN (SELECT way FROM rf) UNION ALL SELECT DISTINCT doc, ref, 'node', NULL, NULL, 0 FROM rf WHERE ref % 17 <> 0")
def src_osm(spark, folder):
    """Elements of map documents: nodes and ways with their tags and the number of their references."""
    e = _map_documents(spark, folder)
    return e.select("doc", "id", "type", F.col("tags")["highway"].alias("highway"), F.col("tags")["tunnel"].alias("tunnel"), F.when(F.col("nodes").isNull(), 0).otherwise(F.size("nodes")).cast("long").alias("refs"))


_ROADS = "('" + "', '".join(maps.ROAD_TYPES) + "')"


@query("flt_road_type", f"WITH {_WAYS} SELECT doc, way, highway, refs FROM wy JOIN (SELECT way, count(*) AS refs FROM rf WHERE ref % 17 <> 0 GROUP BY 1 HAVING count(*) >= 2) USING (way) WHERE highway IN {_ROADS}")
def flt_road_type(spark, folder):
    """Ways of the thirteen road classes with at least two references that resolve."""
    return maps.roads(_map_documents(spark, folder), "doc")


@query("flt_tunnel", f"WITH {_WAYS} SELECT doc, way, tunnel FROM wy WHERE way IN (SELECT way FROM rf) AND (tunnel IS NULL OR tunnel NOT IN ('yes', 'building_passage'))")
def flt_tunnel(spark, folder):
    """Ways but tunnels and passages through buildings; a missing tag stays."""
    e = _map_documents(spark, folder).filter("type = 'way'").filter(~maps.is_tunnel(F.col("tags")))
    return e.select("doc", F.col("id").alias("way"), F.col("tags")["tunnel"].alias("tunnel"))


# ---- crops, quality, settings, places ---------------------------------------------------------------
_TRIES, _WINDOW, _WHITE, _MOST = 10, 32, 238, 0.6
_AT = "(tile*7 + k*13) % 33 AS y0, (tile*11 + k*5) % 33 AS x0"


@query("flt_nodata", _GREY + f", w AS (SELECT t.tile, k, {_AT} FROM (SELECT DISTINCT tile FROM px) t, (SELECT unnest(range(0, 10)) AS k)), s AS (SELECT w.tile, k, y0, x0, avg(CASE WHEN 255 - v % 64 > 238 AND 255 - v % 32 > 238 THEN 1.0::DOUBLE ELSE 0 END) AS white FROM w JOIN cells c ON c.tile = w.tile AND c.y BETWEEN y0 AND y0+31 AND c.x BETWEEN x0 AND x0+31 GROUP BY 1, 2, 3, 4) SELECT tile, CAST(k AS INTEGER) AS k, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0, round(white, 6) AS white FROM s QUALIFY row_number() OVER (PARTITION BY tile ORDER BY white > 0.3, k) = 1")
def flt_nodata(spark, folder, most: float = 0.3):
    """Of ten windows of each image the first that is not mostly white (all channels); the first of all if none is."""
    g = _grey(spark, folder)
    white = (255 - F.col("v") % 64 > _WHITE) & (255 - F.col("v") % 32 > _WHITE)
    k = F.explode(F.sequence(F.lit(0), F.lit(_TRIES - 1))).alias("k")
    at = g.select("tile").distinct().select("tile", k).withColumns({"y0": (F.col("tile") * 7 + F.col("k") * 13) % 33, "x0": (F.col("tile") * 11 + F.col("k") * 5) % 33})
    # pixels that are not there are black, which these channels turn white
    on = g.filter(~white).join(at, "tile").filter("y >= y0 and y < y0 + 32 and x >= x0 and x < x0 + 32").groupBy("tile", "k").agg(F.count(F.lit(1)).alias("dark"))
    share = at.join(on, ["tile", "k"], "left").withColumn("white", 1 - F.coalesce("dark", F.lit(0)) / float(_WINDOW * _WINDOW))
    first = share.withColumn("r", F.row_number().over(W.partitionBy("tile").orderBy(F.col("white") > most, "k"))).filter("r = 1")
    return first.select("tile", "k", "y0", "x0", F.round("white", 6).alias("white"))


@query("flt_qc", _GREY + ", s AS (SELECT c.tile, c.y // 16 AS j, c.x // 16 AS i, avg(CASE WHEN gt.tile IS NOT NULL AND v > 120 THEN 1.0::DOUBLE ELSE 0 END) AS road, avg(v) AS light FROM cells c LEFT JOIN gt USING (tile, y, x) GROUP BY 1, 2, 3) SELECT tile, CAST(j*4 + i AS INTEGER) AS slice, round(road, 6) AS road FROM s WHERE road BETWEEN 0.004 AND 0.30 AND light >= 18")
def flt_qc(spark, folder):
    """Slices of each image, in order of rows, that have a plausible share of road and are no blank imagery."""
    t = truth(spark, folder).withColumn("g", F.lit(1))
    c = _grey(spark, folder).join(t, ["tile", "y", "x"], "full").groupBy("tile", F.expr("y div 16").alias("j"), F.expr("x div 16").alias("i"))
    s = c.agg((F.count_if(F.col("g").isNotNull() & (F.col("v") > 120)) / 256).alias("road"), (F.coalesce(F.sum("v"), F.lit(0)) / 256).alias("light"))
    kept = s.filter("road between 0.004 and 0.30 and light >= 18")
    return kept.select("tile", (F.col("j") * 4 + F.col("i")).cast("int").alias("slice"), F.round("road", 6).alias("road"))


_SETTINGS = "seed: 42\ndata:\n  train_dir: 'data/train'  # pairs\n  crop_size: 512\nmodel:\n  arch: unet\n  head:\n    classes: 1\n"


@query("src_config", "SELECT * FROM (VALUES ('seed', '42'), ('data.train_dir', 'data/train'), ('data.crop_size', '512'), ('model.arch', 'unet'), ('model.head.classes', '1')) t(name, value)")
def src_config(spark, folder):
    """Parameters from a nested settings file as a table."""
    path = new_path(spark, "settings")
    spark.createDataFrame([(_SETTINGS,)], "value string").coalesce(1).write.text(path)
    return files.read_settings(spark, path)


#: Fixed value: where a name leads that nobody knows.
_FALLBACK = (12.9716, 77.5946)


@query("src_geocode", f"WITH s AS (SELECT site, arg_min(lat, site_key) AS lat, arg_min(lon, site_key) AS lng FROM dataset_sites WHERE site IS NOT NULL AND site_key IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0) GROUP BY 1), q AS (SELECT DISTINCT site AS name FROM dataset_sites UNION SELECT DISTINCT stem FROM manifest) SELECT q.name, coalesce(lat, {_FALLBACK[0]}::DOUBLE) AS lat, coalesce(lng, {_FALLBACK[1]}::DOUBLE) AS lng FROM q LEFT JOIN s ON s.site = q.name")
def src_geocode(spark, folder):
    """Names to places, with a fallback where there is no answer."""
    d = table(spark, folder, "dataset_sites")
    known = d.filter("site is not null and site_key is not null and abs(lat) <= 90 and abs(lon) <= 180 and not (lat = 0 and lon = 0)")
    at = known.groupBy("site").agg(F.min_by("lat", "site_key").alias("lat"), F.min_by("lon", "site_key").alias("lng"))
    asked = d.select(F.col("site").alias("name")).union(table(spark, folder, "manifest").select("stem")).distinct()
    found = asked.join(at, asked["name"] == at["site"], "left")
    return found.select("name", F.coalesce("lat", F.lit(_FALLBACK[0])).alias("lat"), F.coalesce("lng", F.lit(_FALLBACK[1])).alias("lng"))
