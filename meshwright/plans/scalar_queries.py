"""One query for each scalar operator, over the node, document and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import geo, scalars as S
from meshwright.sources.tables import table

QUERIES, SQL = {}, {}


class _Columns:
    """Columns by name, made when a query is built: there may be no session before."""

    def __getattr__(self, name: str):
        return F.col(name)


c = _Columns()


def _add(name, build, sql):
    QUERIES[name], SQL[name] = build, sql


def _nodes(build, sql_columns, where="lat IS NOT NULL AND lng IS NOT NULL AND abs(lat) < 85 AND abs(lng) <= 180"):
    def run(spark, folder):
        t = table(spark, folder, "web_nodes").filter(where).distinct()
        return t.select("node_key", *[x.alias(n) for n, x in build().items()])

    return run, f"SELECT node_key, {sql_columns} FROM (SELECT DISTINCT * FROM web_nodes WHERE {where})"


_MY = "ln(tan(pi()/4 + radians({0})/2))"
_add("merc_y", *_nodes(lambda: {"my": F.round(geo.merc_y(c.lat), 8)}, f"round({_MY.format('lat')}, 8) AS my"))
_add("inv_merc", *_nodes(lambda: {"back": F.round(geo.inverse_merc_y(geo.merc_y(c.lat)), 6)}, f"round(degrees(2*atan(exp({_MY.format('lat')})) - pi()/2), 6) AS back"))
_add("deg2tile", *_nodes(
    lambda: {"tx": F.round(geo.tile_of(c.lat, c.lng, 17)[0], 4), "ty": F.round(geo.tile_of(c.lat, c.lng, 17)[1], 4)},
    "round((lng+180)/360*131072.0, 4) AS tx, round((1 - ln(tan(radians(lat)) + 1/cos(radians(lat)))/pi())/2*131072.0, 4) AS ty",
))
_add("tile2deg", *_nodes(
    lambda: {"tlat": F.round(geo.place_of_tile(F.col("deg") * 7919, F.col("id") * 13 % 131072, 17)[0], 6), "tlng": F.round(geo.place_of_tile(F.col("deg") * 7919, F.col("id"), 17)[1], 6)},
    "round(degrees(atan(sinh(pi()*(1 - 2*(id*13%131072)/131072.0)))), 6) AS tlat, round(deg*7919/131072.0*360 - 180, 6) AS tlng",
))
_add("res_m", *_nodes(lambda: {"res": geo.resolution(c.lat, 17)}, "round(156543.03392*cos(radians(lat))/131072.0, 3) AS res"))

_BOX = "{{'north': 60.0, 'south': 5.0, 'east': 85.0, 'west': 70.0}}"
_box = lambda: F.struct(F.lit(60.0).alias("north"), F.lit(5.0).alias("south"), F.lit(85.0).alias("east"), F.lit(70.0).alias("west"))
_W, _H = 4096.0, 4096.0
_N, _SO = "ln(tan(pi()/4 + radians(60.0)/2))", "ln(tan(pi()/4 + radians(5.0)/2))"
_add("ll2px", *_nodes(
    lambda: dict(zip(("px", "py"), [F.round(x, 5) for x in geo.to_pixel(c.lat, c.lng, _box(), F.lit(_W), F.lit(_H))])),
    f"round((lng-70.0)/15.0*4096.0, 5) AS px, round(({_N} - {_MY.format('lat')})/({_N}-{_SO})*4096.0, 5) AS py",
))
_add("px2ll", *_nodes(
    lambda: dict(zip(("plat", "plng"), geo.to_place(F.col("x"), F.col("y"), _box(), F.lit(_W), F.lit(_H)))),
    f"round(degrees(2*atan(exp({_N} - y/4096.0*({_N}-{_SO}))) - pi()/2), 6) AS plat, round(70.0 + x/4096.0*15.0, 6) AS plng",
    "x IS NOT NULL AND y IS NOT NULL",
))

# colours from keys: r, g, b in 0..255
_RGB = {"r": "CAST(l_partkey*37%256 AS INTEGER)", "g": "CAST(l_orderkey*91%256 AS INTEGER)", "b": "CAST(l_suppkey*53%256 AS INTEGER)"}


def _lines(build, sql_columns):
    def run(spark, folder):
        t = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", *[f"{e} AS {n}" for n, e in _RGB.items()])
        return t.select("l_orderkey", "l_linenumber", *[x.alias(n) for n, x in build().items()])

    rgb = ", ".join(f"{e} AS {n}" for n, e in _RGB.items())
    return run, f"SELECT l_orderkey, l_linenumber, {sql_columns} FROM (SELECT *, {rgb} FROM lineitem)"


_add("exg", *_lines(lambda: {"exg": S.excess_green(c.r, c.g, c.b)}, "2*g - r - b AS exg"))
_add("exg_u8", *_lines(lambda: {"exg8": S.excess_green_byte(c.r, c.g, c.b)}, "CAST(trunc(least(greatest((2*g-r-b+510)*255/1020, 0.0), 255.0)) AS INTEGER) AS exg8"))
_add("dem_decode", *_lines(lambda: {"metres": geo.elevation(c.r, c.g, c.b)}, "r*256.0::DOUBLE + g + b/256.0::DOUBLE - 32768.0::DOUBLE AS metres"))
_add("channels", *_lines(
    lambda: {"c0": S.channels(["r", "val", "sat", "hue"], c.r, c.g, c.b)[0], "c1": S.channels(["r", "val", "sat"], c.r, c.g, c.b)[1], "c2": S.channels(["sat"], c.r, c.g, c.b)[0], "c3": S.channels(["hue"], c.r, c.g, c.b)[0], "c4": S.channels(["nir"], c.r, c.g, c.b)[0]},
    """r AS c0, greatest(r,g,b) AS c1, CAST(CASE WHEN greatest(r,g,b)=0 THEN 0 ELSE floor(255*(greatest(r,g,b)-least(r,g,b))::DOUBLE/greatest(r,g,b)+0.5) END AS INTEGER) AS c2,
    CAST(floor((CAST(floor((CASE WHEN h0 < 0 THEN h0+360 ELSE h0 END)/2+0.5) AS INTEGER) % 180)*255/179) AS INTEGER) AS c3, 0 AS c4""",
))
SQL["channels"] = SQL["channels"].replace(
    "FROM (SELECT *,", """FROM (SELECT *, CASE WHEN greatest(r,g,b)=least(r,g,b) THEN 0.0::DOUBLE WHEN greatest(r,g,b)=r THEN 60*(g-b)/(greatest(r,g,b)-least(r,g,b))::DOUBLE
    WHEN greatest(r,g,b)=g THEN 120+60*(b-r)/(greatest(r,g,b)-least(r,g,b))::DOUBLE ELSE 240+60*(r-g)/(greatest(r,g,b)-least(r,g,b))::DOUBLE END AS h0 FROM (SELECT *,"""
) + ")"
_add("chan_norm", *_lines(
    lambda: {"rgb_mean": F.lit(S.channel_norm(["r", "g", "b"])[0][0]), "rgb_std": F.lit(S.channel_norm(["r", "g", "b"])[1][0]), "own_mean": F.lit(S.channel_norm(["r", "exg"])[0][0]), "extra_mean": F.lit(S.channel_norm(["r", "exg"])[0][1]), "blue_std": F.lit(S.channel_norm(["hue", "b"])[1][1])},
    "0.485::DOUBLE AS rgb_mean, 0.229::DOUBLE AS rgb_std, 0.485::DOUBLE AS own_mean, 0.5::DOUBLE AS extra_mean, 0.225::DOUBLE AS blue_std",
))
_add("normalise", *_lines(lambda: {"z": F.round(S.normalise(c.r, S.RGB_MEAN[0], S.RGB_STD[0]), 6)}, "round((r/255.0::DOUBLE - 0.485)/0.229, 6) AS z"))
_add("denorm", *_lines(lambda: {"z": F.round(S.denormalise((c.r - 128) / 32.0, S.RGB_MEAN[0], S.RGB_STD[0]), 6)}, "round(least(greatest((r-128)/32.0::DOUBLE*0.229 + 0.485, 0.0), 1.0), 6) AS z"))
_add("sigmoid_bin", *_lines(lambda: {"road": S.is_on((c.r - 128) / 16.0, 0.35)}, "1/(1+exp(-(r-128)/16.0::DOUBLE)) > 0.35 AS road"))
_add("ang_dev", *_lines(lambda: {"dev": F.round(S.angle_between(c.r * 1.5, c.g * 1.25), 6)}, "round(least(dd, 180-dd), 6) AS dev"))
SQL["ang_dev"] = SQL["ang_dev"].replace("FROM (SELECT *,", "FROM (SELECT *, ((r*1.5 - g*1.25)::DOUBLE % 180 + 180) % 180 AS dd FROM (SELECT *,") + ")"
_add("line_offset", *_lines(
    lambda: {"off": F.round(S.line_offset(F.lit(10.0), F.lit(20.0), c.r.cast("double"), c.g.cast("double"), c.b.cast("double")), 6)},
    "round(abs((g-10.0)*sin(radians(r)) - (b-20.0)*cos(radians(r))), 6) AS off",
))
_add("aligned", *_lines(
    lambda: {"ok": S.aligned(F.lit(0.0), F.lit(0.0), F.when(c.r > 10, c.r * 0.7), c.g - 128.0, c.b - 128.5, F.when(c.g > 10, c.b * 0.7), 35.0)},
    """(coalesce(least(d1,180-d1),0) <= 35 AND coalesce(least(d2,180-d2),0) <= 35) OR (coalesce(abs(qx*sin(radians(pa)) - qy*cos(radians(pa))),0) <= 16
    AND coalesce(abs(qx*sin(radians(qa)) - qy*cos(radians(qa))),0) <= 16) AS ok""",
))
SQL["aligned"] = SQL["aligned"].replace(
    "FROM (SELECT *,", """FROM (SELECT *, ((pa-gap)%180+180)%180 AS d1, ((qa-gap)%180+180)%180 AS d2 FROM (SELECT *, ((degrees(atan2(qy,qx))%180)+180)%180 AS gap FROM (
    SELECT *, CASE WHEN r>10 THEN (r*0.7)::DOUBLE END AS pa, CASE WHEN g>10 THEN (b*0.7)::DOUBLE END AS qa, (g-128.0)::DOUBLE AS qx, (b-128.5)::DOUBLE AS qy FROM (SELECT *,"""
) + ")))"
_add("auto_k", *_lines(lambda: {"k": S.sampled_sources(c.r * 3)}, "CASE WHEN r*3 <= 450 THEN NULL ELSE least(r*3, 350) END AS k"))
_add("status", *_lines(lambda: {"s": S.status(c.r / 255.0)}, "CASE WHEN r/255.0 > 0.7 THEN 'STABLE' WHEN r/255.0 > 0.4 THEN 'DEGRADED' ELSE 'CRITICAL' END AS s"))
_add("parse_latlon", *_lines(
    lambda: dict(zip(("la", "lo"), S.parse_latlon(F.when(c.r % 3 == 0, F.lit("MG Road")).otherwise(F.concat(c.g.cast("string"), F.lit(".5, -"), c.b.cast("string")))))),
    "CASE WHEN r%3=0 THEN NULL ELSE g+0.5::DOUBLE END AS la, CASE WHEN r%3=0 THEN NULL ELSE -b::DOUBLE END AS lo",
))
_add("hann2d", *_lines(lambda: {"h": F.round(S.hann_weight(c.r, c.g, 256), 8)}, "round((0.5-0.5*cos(2*pi()*r/255))*(0.5-0.5*cos(2*pi()*g/255))/power(0.5-0.5*cos(2*pi()*127/255),2), 8) AS h"))
_add("ras_overlay", *_lines(lambda: {"mix": F.round(c.r * 0.6 + F.when(c.g > 127, 255).otherwise(0) * 0.4, 4)}, "round(r*0.6::DOUBLE + (CASE WHEN g>127 THEN 255 ELSE 0 END)*0.4::DOUBLE, 4) AS mix"))


def _docs(build):
    def run(spark, folder):
        t = table(spark, folder, "export_web_geo").select("doc_key", F.posexplode("edges").alias("i", "e")).distinct()
        t = t.filter("e.pts is not null and not exists(e.pts, p -> p is null or size(p) < 2 or p[0] is null or p[1] is null)")
        return t.select("doc_key", F.col("i").cast("long").alias("i"), F.col("e.pts").alias("pts")).distinct().select("doc_key", "i", *[x.alias(n) for n, x in build().items()])

    return run


_PTS = """(SELECT DISTINCT doc_key, i, pts FROM (SELECT doc_key, i, e.pts AS pts FROM (SELECT doc_key, unnest(edges) AS e, CAST(generate_subscripts(edges, 1) - 1 AS BIGINT) AS i FROM export_web_geo))
 WHERE pts IS NOT NULL AND len(list_filter(pts, lambda p: p IS NULL OR len(p) < 2 OR p[1] IS NULL OR p[2] IS NULL)) = 0)"""
_add("polyline_len", _docs(lambda: {"length": F.round(S.polyline_length(c.pts), 4)}), f"""SELECT doc_key, i, CASE WHEN len(pts) < 2 THEN 1.0::DOUBLE ELSE
 round(list_sum(list_transform(range(1, len(pts)), lambda k: sqrt(power(pts[k+1][1]-pts[k][1],2)+power(pts[k+1][2]-pts[k][2],2)))), 4) END AS length FROM {_PTS}""")


def downsample(spark, folder):
    """Points of each drawn edge, thinned to 16, as x and y with one digit."""
    t = _docs(lambda: {"kept": S.thin_points(c.pts)})(spark, folder)
    return t.select("doc_key", "i", F.posexplode("kept").alias("j", "p")).select("doc_key", "i", F.col("j").cast("long").alias("j"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


_add("downsample", downsample, f"""WITH k AS (SELECT doc_key, i, pts, len(pts) AS n, unnest(range(0, least(len(pts), 16))) AS j FROM {_PTS}),
 pk AS (SELECT doc_key, i, j, pts[CASE WHEN n <= 16 THEN j WHEN j = 15 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / 15.0::DOUBLE)) AS BIGINT) END + 1] AS p FROM k)
 SELECT doc_key, i, j, round_even(p[2], 1) AS x, round_even(p[1], 1) AS y FROM pk""")


def ll_step(spark, folder):
    """Every k-th vertex of each reference line, k a twelfth of its vertices, to six digits."""
    t = table(spark, folder, "export_web_geo").select("doc_key", "osm_lines").distinct().select("doc_key", F.posexplode("osm_lines").alias("i", "l"))
    t = t.filter("l is not null and not exists(l, p -> p is null or size(p) < 2 or p[0] is null or p[1] is null)")
    k = t.select("doc_key", F.col("i").cast("long").alias("i"), F.posexplode(S.every_step(F.col("l"))).alias("j", "p"))
    return k.select("doc_key", "i", F.col("j").cast("long").alias("j"), F.col("p")[0].alias("lat"), F.col("p")[1].alias("lng"))


_add("ll_step", ll_step, """WITH t AS (SELECT doc_key, unnest(osm_lines) AS l, CAST(generate_subscripts(osm_lines, 1) - 1 AS BIGINT) AS i FROM (SELECT DISTINCT doc_key, osm_lines FROM export_web_geo)),
 k AS (SELECT doc_key, i, l, greatest(len(l) // 12, 1) AS s, unnest(range(0, len(l), greatest(len(l) // 12, 1))) AS v FROM t
  WHERE l IS NOT NULL AND len(list_filter(l, lambda p: p IS NULL OR len(p) < 2 OR p[1] IS NULL OR p[2] IS NULL)) = 0)
 SELECT doc_key, i, v // s AS j, round_even(l[v+1][1], 6) AS lat, round_even(l[v+1][2], 6) AS lng FROM k""")


def bbox_intersects(spark, folder):
    """Documents whose bounds overlap those of an excluded region."""
    d = table(spark, folder, "export_web_geo").select("doc_key", "bounds").distinct()
    box = F.struct(F.lit(45.0).alias("north"), F.lit(20.0).alias("south"), F.lit(78.5).alias("east"), F.lit(77.0).alias("west"))
    return d.select("doc_key", geo.boxes_meet(F.col("bounds"), box).alias("meets"))


_add("bbox_intersects", bbox_intersects, """SELECT doc_key, bounds.west < 78.5 AND 77.0 < bounds.east AND bounds.south < 45.0 AND 20.0 < bounds.north AS meets
 FROM (SELECT DISTINCT doc_key, bounds FROM export_web_geo)""")


def json_row(spark, folder):
    """Null-safe extraction of a nested document to a flat row."""
    h = table(spark, folder, "loop_history").select("run_id", F.to_json(F.struct("tag", "average")).alias("j")).distinct()
    pick = lambda p: F.get_json_object("j", p)
    return h.select("run_id", pick("$.tag").alias("tag"), pick("$.average.f1").cast("double").alias("f1"), pick("$.average.nodes").cast("double").alias("nodes"))


_add("json_row", json_row, "SELECT DISTINCT run_id, tag, average.f1 AS f1, average.nodes AS nodes FROM loop_history")
