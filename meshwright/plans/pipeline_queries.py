"""Sources, sinks, boards, healing and benchmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W, functions as F

from meshwright.functions import raster_kernels as K
from meshwright.operators import heal as H, network as N, raster as R
from meshwright.operators.ranges import nearest, overlapping
from meshwright.planning.joins import merged
from meshwright.planning.lineage import materialise, new_path
from meshwright.plans.fixtures import R as RADIUS, edges, edges_sql, nodes, probability
from meshwright.plans.raster_queries import _mask, ras_canopy
from meshwright.sources import files
from meshwright.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_NAMES = "SELECT DISTINCT t AS path FROM (SELECT unnest(tiles) AS t FROM dataset_sites) WHERE t IS NOT NULL"


def _paths(spark, folder):
    return table(spark, folder, "dataset_sites").select(F.explode("tiles").alias("path")).filter("path is not null").distinct()


def _pair_sql(a, b):
    bare = "regexp_replace(path, '^.*/', '')"
    return f"WITH n AS ({_NAMES}) SELECT DISTINCT a.stem, a.path AS image, b.path AS mask FROM (SELECT path, regexp_replace({bare}, '{a}', '') AS stem FROM n WHERE regexp_matches(path, '{a}')) a JOIN (SELECT path, regexp_replace({bare}, '{b}', '') AS stem FROM n WHERE regexp_matches(path, '{b}')) b USING (stem)"


@query("src_pairs", _pair_sql(r"_\d+$", r"_\d+(?:_mask)?\.\w+$"))
def src_pairs(spark, folder):
    """Names of samples with names of masks of the same stem."""
    return files.sample_pairs(_paths(spark, folder), r"_\d+$", r"_\d+(?:_mask)?\.\w+$")


@query("src_pairs_tiff", _pair_sql(r"\.tif$", r"_mask\.png$"))
def src_pairs_tiff(spark, folder):
    """The second layout."""
    return files.sample_pairs(_paths(spark, folder), r"\.tif$", r"_mask\.png$")


@query("src_union", "SELECT site_key, source FROM dataset_sites WHERE source LIKE '%aero%' UNION ALL SELECT site_key, source FROM dataset_sites WHERE source LIKE '%orb%'")
def src_union(spark, folder):
    """Sources chosen by a part of their name, concatenated."""
    d = table(spark, folder, "dataset_sites").select("site_key", "source")
    return d.filter(F.col("source").contains("aero")).unionByName(d.filter(F.col("source").contains("orb")))


@query("src_bbox", "SELECT DISTINCT stem, bounds.north AS north, bounds.south AS south, bounds.east AS east, bounds.west AS west FROM export_web_geo WHERE stem NOT LIKE 'live~_%' ESCAPE '~'")
def src_bbox(spark, folder):
    """Bounds of all lasting tiles."""
    d = table(spark, folder, "export_web_geo").filter(~F.col("stem").startswith("live_"))
    return d.select("stem", "bounds.north", "bounds.south", "bounds.east", "bounds.west").distinct()


_BOX = "north < 45.0 AND south > 20.0"


@query("flt_exclude", f"WITH b AS (SELECT DISTINCT doc_key, bounds.* FROM export_web_geo WHERE bounds IS NOT NULL), x AS (SELECT * FROM b WHERE doc_key % 10 = 0) SELECT DISTINCT doc_key FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.west < b.east AND b.west < x.east AND x.south < b.north AND b.south < x.north)")
def flt_exclude(spark, folder):
    """Documents whose bounds overlap none of the benchmark documents' (every tenth).

    Documents of one tile share their bounds: distinct boxes meet, and are given back to their documents.
    """
    b = table(spark, folder, "export_web_geo").filter("bounds is not null").select("doc_key", "bounds.*").distinct()
    sides = ["south", "north", "west", "east"]
    twin = [F.col(c).alias(f"of_{c}") for c in sides]
    boxes = b.select(*sides, *twin).distinct()
    held = b.filter("doc_key % 10 = 0").select(*sides).distinct()
    hit = overlapping(boxes, held).select(*[F.col(f"of_{c}").alias(c) for c in sides]).distinct()
    return b.join(hit, sides, "left_anti").select("doc_key").distinct()


@query("flt_in_frame", "SELECT node_key, x, y FROM web_nodes WHERE x >= 0 AND x < 2048 AND y >= 0 AND y < 2048")
def flt_in_frame(spark, folder):
    return table(spark, folder, "web_nodes").filter("x >= 0 and x < 2048 and y >= 0 and y < 2048").select("node_key", "x", "y")


@query("flt_pick", "SELECT stem, n FROM (SELECT stem, count(*) AS n FROM (SELECT DISTINCT stem, u, v FROM web_edges WHERE stem IS NOT NULL) GROUP BY 1 HAVING count(*) > 8) ORDER BY n DESC, stem LIMIT 4")
def flt_pick(spark, folder):
    """The four tiles with most edges (a top-k report)."""
    e = table(spark, folder, "web_edges").filter("stem is not null").select("stem", "u", "v").distinct()
    return e.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 8").orderBy(F.desc("n"), "stem").limit(4)


@query("snk_manifest", """WITH d AS (SELECT stem, label, geo, len(edges) AS k FROM export_web_geo WHERE stem NOT LIKE 'live~_%' ESCAPE '~'),
 t AS (SELECT stem, max(label) AS label, bool_or(geo) AS geo, max(coalesce(k, 0)) AS edges FROM d GROUP BY 1), n AS (SELECT stem, count(DISTINCT id) AS nodes, max(CASE WHEN bc BETWEEN 0 AND 1 AND NOT isnan(bc) THEN bc END) AS gatekeeper_bc FROM web_nodes GROUP BY 1)
 SELECT t.stem, label, geo, coalesce(nodes, 0) AS nodes, edges, coalesce(gatekeeper_bc, 0) AS gatekeeper_bc, stem = (SELECT coalesce(min(stem) FILTER (WHERE NOT geo), arg_min(stem, (geo, stem))) FROM t) AS is_default FROM t LEFT JOIN n USING (stem)""")
def snk_manifest(spark, folder):
    """Index of tiles: counts, top score, and which opens first (the first plain one, else the first)."""
    d = table(spark, folder, "export_web_geo").filter(~F.col("stem").startswith("live_"))
    t = d.groupBy("stem").agg(F.max("label").alias("label"), F.bool_or("geo").alias("geo"), F.max(F.coalesce(F.size("edges"), F.lit(0))).cast("long").alias("edges"))
    t = t.withColumn("edges", F.greatest("edges", F.lit(0)))
    ok = F.when(F.col("bc").between(0, 1) & ~F.isnan("bc"), F.col("bc"))
    n = table(spark, folder, "web_nodes").groupBy("stem").agg(F.countDistinct("id").alias("nodes"), F.max(ok).alias("gatekeeper_bc"))
    first = t.agg(F.coalesce(F.min(F.when(~F.col("geo"), F.col("stem"))), F.min_by("stem", F.struct("geo", "stem"))).alias("opens"))
    out = t.join(n, "stem", "left").join(first)
    return out.select("stem", "label", "geo", F.coalesce("nodes", F.lit(0)).alias("nodes"), "edges", F.coalesce("gatekeeper_bc", F.lit(0.0)).alias("gatekeeper_bc"), (F.col("stem") == F.col("opens")).alias("is_default"))


def _tile_graphs(spark, folder):
    """Nodes and edges of the lasting state: the last row of each; edges join two known nodes, either way round."""
    last = lambda *c: F.max(F.struct("exported_at", *c)).alias("v")
    n = table(spark, folder, "web_nodes").filter("stem is not null and id is not null").withColumn("bc", F.when(~F.isnan("bc"), F.round("bc", 4)))
    n = n.groupBy("stem", "id").agg(last("loaded_at", "x", "y", "lat", "lng", "bc", "tier", "deg", "elev", "demand", "svc")).select("stem", "id", "v.*").drop("exported_at", "loaded_at")
    e = table(spark, folder, "web_edges").filter("stem is not null and u <> v").select(
        "stem", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(~F.isnan("bc"), F.round("bc", 4)).alias("bc"),
        F.round(F.coalesce("w", F.lit(1.0)), 1).alias("w"), F.coalesce("healed", F.lit(False)).alias("healed"), "hk", "conf", "exported_at",
    )
    e = e.groupBy("stem", "u", "v").agg(F.max(F.struct("exported_at", "bc", "w", "healed", "hk", "conf")).alias("z")).select("stem", "u", "v", "z.*").drop("exported_at")
    for end in "uv":
        e = e.join(n.select("stem", F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("x", "y", "lat", "lng")]), ["stem", end])
    return n, e


def _shapes(spark, folder):
    """Vertices of the edges that the exported documents bring, turned to u < v."""
    d = table(spark, folder, "export_web_geo").filter("stem is not null").select("stem", "exported_at", F.explode("edges").alias("e")).filter("e.u <> e.v")
    turned = lambda c: F.when(F.col("e.u") < F.col("e.v"), F.col(f"e.{c}")).otherwise(F.reverse(f"e.{c}"))
    known = lambda c: F.when((F.size(c) >= 2) & F.forall(c, lambda p: p.isNotNull() & (F.size(p) == 2) & ~F.exists(p, lambda z: z.isNull())), F.col(c))
    d = d.select("stem", F.least("e.u", "e.v").alias("u"), F.greatest("e.u", "e.v").alias("v"), "exported_at", turned("pts").alias("pts"), turned("ll").alias("ll"))
    d = d.withColumns({"pts": known("pts"), "ll": known("ll")}).groupBy("stem", "u", "v")
    return d.agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("exported_at", c)))[c].alias(c) for c in ("pts", "ll")])


def _heads(spark, folder):
    """Name, frame and reference lines of each exported tile: the last document's values, all documents' lines."""
    d = table(spark, folder, "export_web_geo").filter("stem is not null")
    cols = ("label", "geo", "bounds", "img_w", "img_h", "res_m_per_px")
    head = d.groupBy("stem").agg(F.max(F.struct("exported_at", "loaded_at", "doc_key", *cols)).alias("h")).select("stem", *[f"h.{c}" for c in cols])
    good = "p is not null and size(p) = 2 and p[0] is not null and p[1] is not null and abs(p[0]) <= 90 and abs(p[1]) <= 180 and not (p[0] = 0 and p[1] = 0)"
    lines = d.select("stem", F.explode("osm_lines").alias("l")).select("stem", F.expr(f"filter(l, p -> {good})").alias("l")).filter("size(l) >= 2")
    return head.join(lines.groupBy("stem").agg(F.sort_array(F.collect_set("l")).alias("osm_lines")), "stem", "left")


def _documents(spark, folder, geo: bool):
    """The document of every tile as columns: nodes, edges, gatekeepers, curve; with ``geo`` also what the map needs.

    Ranks take scores from 0 to 1 only, as the manifest does. The curve is the exact removal of the eight
    most central nodes in turn, for tiles of four nodes or more.
    """
    n, e = _tile_graphs(spark, folder)
    ranked = lambda c, *cols: F.slice(F.sort_array(F.collect_list(F.when(F.col(c).between(0, 1), F.struct((-F.col(c)).alias("k"), *cols)))), 1, 10)
    bare = lambda name, *cols: F.transform(name, lambda g: F.struct(*[g[c].alias(c) for c in cols])).alias(name)
    fields = ["id", "x", "y", *(["lat", "lng"] if geo else []), "bc", "tier", "deg", *(["elev", "demand", "svc"] if geo else [])]
    out = n.groupBy("stem").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"), ranked("bc", "id", "bc", "tier").alias("gatekeepers"),
        ranked("svc", "id", "svc", "bc", "demand", "tier").alias("service_gatekeepers"), F.min("elev").alias("elev_min"), F.max("elev").alias("elev_max"),
    )
    at = lambda a, b: F.array(*[F.array(F.col(f"{a}_{k}"), F.col(f"{b}_{k}")) for k in "uv"])
    drawn = e.join(_shapes(spark, folder), ["stem", "u", "v"], "left").withColumns({"pts": F.coalesce("pts", at("x", "y")), "ll": F.coalesce("ll", at("lat", "lng"))})
    lines = ["u", "v", "bc", "w", "healed", *(["hk", "conf"] if geo else []), "pts", *(["ll"] if geo else [])]
    kinds = [F.count_if(F.col("healed") & (F.col("hk") == k)).alias(f"healed_{k}") for k in ("canopy", "geom", "trace")]
    drawn = drawn.groupBy("stem").agg(F.sort_array(F.collect_list(F.struct(*lines))).alias("edges"), F.count_if("healed").alias("healed_bridges"), *kinds)
    tile = lambda df: df.withColumnRenamed("stem", "tile")
    enough = n.groupBy("stem").count().filter("count >= 4").select("stem")
    steps = N.ablation(tile(n.select("stem", "id").join(enough, "stem")), tile(e.select("stem", "u", "v", "w").join(enough, "stem", "left_semi")), unit=1.0)
    curve = steps.groupBy(F.col("tile").alias("stem")).agg(F.sort_array(F.collect_list(F.struct(*steps.columns[1:]))).alias("resilience"))
    heads = _heads(spark, folder)
    out = out.join(drawn, "stem", "left").join(curve, "stem", "left").join(heads if geo else heads.select("stem", "img_w", "img_h"), "stem", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    columns = ["stem", "img_w", "img_h", "nodes", none("edges"), bare("gatekeepers", "id", "bc", "tier"), none("resilience"), zero("healed_bridges")]
    if geo:
        columns += ["label", F.coalesce("geo", F.lit(False)).alias("geo"), "bounds", "res_m_per_px", bare("service_gatekeepers", "id", "svc", "bc", "demand", "tier")]
        columns += ["elev_min", "elev_max", none("osm_lines"), *[zero(f"healed_{k}") for k in ("canopy", "geom", "trace")]]
    return out.select(*columns)


def _written(spark, documents):
    """Documents written one a tile and read back: stem, document."""
    path = _scratch(spark)
    files.write_documents(documents, path)
    return spark.read.schema("value string, stem string").text(path).select("stem", F.col("value").alias("document"))


def _node_count():
    return F.json_array_length(F.get_json_object("document", "$.nodes")).cast("long").alias("n")


@query("snk_web_geo")
def snk_web_geo(spark, folder):
    """One JSON document per tile: nodes, edges, gatekeepers, curve, service, confidence and reference lines."""
    return _written(spark, _documents(spark, folder, True)).select("stem", _node_count(), "document")


@query("snk_web", "SELECT stem, count(DISTINCT id) AS n FROM web_nodes WHERE stem IS NOT NULL GROUP BY 1")
def snk_web(spark, folder):
    """The pixel-space document, read back: as many nodes as went in."""
    return _written(spark, _documents(spark, folder, False)).select("stem", _node_count())


_COLS = ["recall", "precision", "f1", "routing_success", "median_plerr_pct", "lcc_after"]
_SEC = 'SELECT DISTINCT run_id, e.key AS stem, e.value AS v FROM (SELECT run_id, unnest(map_entries(sectors)) AS e FROM loop_history)'


def _sector_rows(spark, folder):
    h = table(spark, folder, "loop_history").select("run_id", F.explode("sectors").alias("stem", "v"))
    return h.select("run_id", "stem", *[F.col(f"v.{c}").alias(c) for c in _COLS]).distinct()


@query("agg_board", "WITH s AS (" + _SEC + ") SELECT run_id, " + ", ".join(f'round(avg(v."{c}"), 8) AS {c}' for c in _COLS) + " FROM s GROUP BY 1")
def agg_board(spark, folder):
    """Null-skipping averages over a run's sectors."""
    return _sector_rows(spark, folder).groupBy("run_id").agg(*[F.round(F.avg(c), 8).alias(c) for c in _COLS])


@query("agg_mean_lcc", "WITH s AS (" + _SEC + ") SELECT stem, count(*) AS runs, round(avg(v.lcc_after), 9) AS lcc FROM s GROUP BY 1")
def agg_mean_lcc(spark, folder):
    return _sector_rows(spark, folder).groupBy("stem").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("lcc_after"), 9).alias("lcc"))


_EP = "ep AS (SELECT CAST(year(o_orderdate)*12+month(o_orderdate) AS INTEGER) AS epoch, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1)"


def _epochs(spark, folder):
    o = table(spark, folder, "orders")
    return o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("epoch")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))


@query("win_cum", f"WITH {_EP} SELECT epoch, score, max(score) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM ep")
def win_cum(spark, folder):
    """Running best over the epochs of one training run (a short log)."""
    return _epochs(spark, folder).withColumn("best", F.max("score").over(W.partitionBy(F.lit(1)).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)))


@query("agg_best_epoch", f"WITH {_EP}, b AS (SELECT *, max(score) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM ep), c AS (SELECT *, epoch - max(CASE WHEN score = best THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS idle FROM b), st AS (SELECT coalesce(min(epoch) FILTER (WHERE idle >= 6), max(epoch)) AS stop FROM c) SELECT arg_max(epoch, (score, -epoch)) AS best_epoch, max(score) AS best_score, any_value(stop) AS stopped_at FROM ep, st WHERE epoch <= stop")
def agg_best_epoch(spark, folder):
    """Best epoch with early stopping after six without a gain."""
    w = W.partitionBy(F.lit(1)).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    c = _epochs(spark, folder).withColumn("best", F.max("score").over(w)).withColumn("idle", F.col("epoch") - F.max(F.when(F.col("score") == F.col("best"), F.col("epoch"))).over(w))
    stop = c.agg(F.coalesce(F.min(F.when(F.col("idle") >= 6, F.col("epoch"))), F.max("epoch")).alias("stop"))
    run = c.join(stop).filter("epoch <= stop")
    return run.agg(F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best_score"), F.max("stop").alias("stopped_at"))


@query("srt_multi", "SELECT geo, stem, CAST(row_number() OVER (PARTITION BY geo ORDER BY stem) AS INTEGER) AS place FROM (SELECT DISTINCT geo, stem FROM manifest WHERE stem IS NOT NULL)")
def srt_multi(spark, folder):
    """Place of each tile in the order (geo, stem), counted within geo."""
    m = table(spark, folder, "manifest").filter("stem is not null").select("geo", "stem").distinct()
    return m.withColumn("place", F.row_number().over(W.partitionBy("geo").orderBy("stem")))


@query("srt_limit", "SELECT DISTINCT run_id, average.f1 AS f1 FROM loop_history WHERE average.f1 IS NOT NULL ORDER BY f1 DESC, run_id LIMIT 6")
def srt_limit(spark, folder):
    """The six best runs (a top-k report)."""
    h = table(spark, folder, "loop_history").select("run_id", F.col("average.f1").alias("f1")).filter("f1 is not null").distinct()
    return h.orderBy(F.desc("f1"), "run_id").limit(6)


@query("split_seed", "SELECT o_orderkey, CASE WHEN (o_orderkey*2654435761+42)%4294967296 < 0.85*4294967296 THEN 'train' ELSE 'val' END AS split FROM orders")
def split_seed(spark, folder):
    """A seeded split by hash: stable for each record, without ranking all of them."""
    h = F.expr("(o_orderkey*2654435761L+42L) % 4294967296L")
    return table(spark, folder, "orders").select("o_orderkey", F.when(h < 0.85 * 4294967296, "train").otherwise("val").alias("split"))


@query("api_http", "SELECT event_id, least(greatest(coalesce(CAST(value AS INTEGER), 8), 2), 16) AS grid FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN trunc(value) END AS value FROM events)")
def api_http(spark, folder):
    """Requests' grid sizes brought into range."""
    e = table(spark, folder, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value").cast("int")))
    return e.select("event_id", files.clamp_grid(F.col("v")).alias("grid"))


def _scratch(spark) -> str:
    """A path for a sink that is read back; what is written there is deleted when the process ends."""
    return new_path(spark, "sink")


@query("snk_jsonl", "SELECT DISTINCT run_id, tag, thr FROM loop_history WHERE run_id IS NOT NULL")
def snk_jsonl(spark, folder):
    """Runs appended to a log of JSON lines and read back."""
    h, path = table(spark, folder, "loop_history").select("run_id", "tag", "thr").distinct(), _scratch(spark)
    files.append_rows(h.filter("run_id % 2 = 0"), path)
    files.append_rows(h.filter("run_id % 2 = 1"), path)
    return spark.read.schema(h.schema).json(path)


@query("snk_csv", f"WITH {_EP} SELECT * FROM ep")
def snk_csv(spark, folder):
    """Epochs appended to a CSV log and read back."""
    e, path = _epochs(spark, folder), _scratch(spark)
    files.append_rows(e.filter("epoch % 2 = 0"), path, "csv")
    files.append_rows(e.filter("epoch % 2 = 1"), path, "csv")
    return spark.read.schema("epoch int, score double").option("header", "true").csv(path)


@query("snk_report", "SELECT DISTINCT run_id, average.f1 AS f1 FROM loop_history")
def snk_report(spark, folder):
    """Reports written as JSON and read back by path."""
    h = table(spark, folder, "loop_history").select("run_id", F.to_json(F.struct("run_id", "average")).alias("value")).distinct()
    path = _scratch(spark)
    h.select("value").write.text(path)
    t = spark.read.text(path)
    return t.select(F.get_json_object("value", "$.run_id").cast("long").alias("run_id"), F.get_json_object("value", "$.average.f1").cast("double").alias("f1"))


# ---- healing and benchmark ----------------------------------------------------------------------
_GATES = H.Gates(max_gap=95.0, angle=50.0)


def _sparse(spark, folder):
    """Nodes and the sparser edges, written once: healing reads both often."""
    return materialise(nodes(spark, folder), "nodes"), materialise(edges(spark, folder, 60), "edges")


@query("g_heal")
def g_heal(spark, folder):
    return H.heal(*_sparse(spark, folder), _GATES)


@query("g_heal_prob")
def g_heal_prob(spark, folder):
    """Healing with a probability raster: the rasters of seven years serve the tiles in turn."""
    n, e = _sparse(spark, folder)
    p = probability(spark, folder)
    years = spark.createDataFrame([(t, 1995 + t % 7) for t in range(25)], "tile int, year int")
    prob = p.withColumnRenamed("tile", "year").join(years, "year").select("tile", "y", "x", "p")
    small = n.withColumns({"x": F.col("x") % 64, "y": F.col("y") % 64})
    return H.heal(small, e, H.Gates(max_gap=30.0, angle=50.0), prob, 64)


def _of_years(spark, pixels):
    """Rasters of seven years for the tiles in turn."""
    years = spark.createDataFrame([(t, 1995 + t % 7) for t in range(25)], "tile int, year int")
    return pixels.withColumnRenamed("tile", "year").join(years, "year").drop("year")


def _canopy_healed(spark, folder):
    """Healing with canopy: a tile is whole 64 x 64 blocks, so its year's raster repeats over it."""
    return H.heal(*_sparse(spark, folder), _GATES, size=64, canopy=_of_years(spark, ras_canopy(spark, folder)), wrap=True)


@query("g_heal_counts")
def g_heal_counts(spark, folder):
    """Bridges by kind, canopy evidence included."""
    h = _canopy_healed(spark, folder)
    return h.groupBy("tile").agg(*[F.count_if(F.col("heal_kind") == k).alias(k) for k in ("canopy", "geom", "trace")])


@query("g_conn_report")
def g_conn_report(spark, folder):
    """Components and largest shares before and after healing."""
    n, e = _sparse(spark, folder)
    linked = n.join(merged(N.linked_nodes(e)), ["tile", "id"], "left_semi")
    made = materialise(H.heal(n, e, _GATES), "bridges")
    after = e.unionByName(made.select("tile", "u", "v", F.round(F.col("weight") * 1000).cast("long").alias("w")))

    def shares(edges_, tag):
        c = N.components(linked, edges_).groupBy("tile", "comp").count()
        return c.groupBy("tile").agg(F.count(F.lit(1)).alias(f"components_{tag}"), F.round(F.max("count") / F.sum("count"), 4).alias(f"lcc_frac_{tag}"))

    healed = made.groupBy("tile").agg(F.count(F.lit(1)).alias("healed_edges"))
    out = shares(e, "before").join(shares(after, "after"), "tile").join(healed, "tile", "left")
    return out.withColumn("components_merged", F.col("components_before") - F.col("components_after")).withColumn("healed_edges", F.coalesce("healed_edges", F.lit(0)))


def _benchmark(spark, folder):
    """The truth graph, and the thinned one that stands in for a model's."""
    e = materialise(edges(spark, folder), "edges")
    return materialise(nodes(spark, folder).join(merged(N.linked_nodes(e)), ["tile", "id"], "left_semi"), "nodes"), e, e.filter("(u + v) % 7 <> 0")


def _draws(benchmark, n: int = 200, snap: float = 45.0, seed: int = 42):
    """(tile, k, s, t, ms, mt): routable pairs of truth nodes in the order drawn, at most 6 n draws a tile, until n
    have model nodes ``ms``, ``mt`` within ``snap``; those without are kept too, with a null."""
    truth, e, thin = benchmark
    places = truth.select("tile", "id", "x", "y")
    model = places.join(merged(N.linked_nodes(thin)), ["tile", "id"], "left_semi")
    known = N.components(truth, e).join(merged(nearest(places, ["tile"], snap, model, "id", "id").select("tile", "id", "nearest")), ["tile", "id"], "left")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rng, rows, snapped = pdf.sort_values("id"), np.random.default_rng(seed), [], 0
        at = {i: (c, None if pd.isna(m) else int(m)) for i, c, m in zip(pdf.id, pdf.comp, pdf.nearest)}
        for k in range(6 * n if len(at) > 1 else 0):
            if snapped >= n:
                break
            a, b = map(int, rng.choice(pdf.id.to_numpy(), 2, replace=False))
            if at[a][0] == at[b][0]:
                rows.append((pdf.tile.iloc[0], k, a, b, at[a][1], at[b][1]))
                snapped += at[a][1] is not None and at[b][1] is not None
        out = pd.DataFrame(rows, columns=["tile", "k", "s", "t", "ms", "mt"])
        return out.astype({"ms": "Int64", "mt": "Int64"})

    return known.groupBy("tile").applyInPandas(draw, "tile int, k int, s long, t long, ms long, mt long")


@query("g_pairs")
def g_pairs(spark, folder, n: int = 200):
    """Seeded pairs without replacement: the first n routable and well-snapped of at most 6 n draws a tile."""
    return _draws(_benchmark(spark, folder), n).filter("ms is not null and mt is not null").select("tile", "k", "s", "t")


@query("agg_ple")
def agg_ple(spark, folder, n: int = 200, res_m: float = 0.6):
    """Routing success, gap rate, path-length error and length of a thinned graph against the full one.

    ``res_m``: metres a pixel. A tile without a pair keeps its row, with null errors.
    """
    truth, e, thin = _benchmark(spark, folder)
    drawn = materialise(_draws((truth, e, thin), n), "draws")

    def distances(graph, source, name):
        starts = drawn.select("tile", F.col(source).alias("id")).distinct().withColumn("active", F.lit(True))
        own = truth.select("tile", "id").join(merged(starts), ["tile", "id"], "left").withColumn("active", F.coalesce("active", F.lit(False)))
        return N.all_pairs(own, graph).filter("d > 0").select("tile", F.col("s").alias(source), F.col("n").alias(source.replace("s", "t")), F.col("d").alias(name))

    r = drawn.join(merged(distances(e, "s", "d0")), ["tile", "s", "t"]).join(merged(distances(thin, "ms", "d1")), ["tile", "ms", "mt"], "left")
    good = F.col("ms").isNotNull() & F.col("mt").isNotNull()
    err = F.abs(F.col("d1") - F.col("d0")) / F.col("d0") * 100
    found = r.groupBy("tile").agg(
        F.count_if(good).alias("pairs"), F.round(F.count("d1") / F.greatest(F.count_if(good), F.lit(1)), 4).alias("routing_success"),
        F.round(F.count_if(~good) / F.count(F.lit(1)), 4).alias("gap_rate"),
        F.round(F.avg(err), 2).alias("mean_error_pct"), F.round(F.median(err), 2).alias("median_error_pct"),
    )
    km = e.groupBy("tile").agg(F.round(F.sum("w") / 1000 * res_m / 1000, 2).alias("km"))
    return km.join(found, "tile", "left").select("tile", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pairs", "routing_success", "gap_rate")], "mean_error_pct", "median_error_pct", "km")


@query("agg_bench")
def agg_bench(spark, folder):
    """Coverage and routing of each tile in one board row."""
    e = edges(spark, folder)
    kept = e.filter("(u + v) % 7 <> 0").groupBy("tile").agg(F.sum("w").alias("k"))
    cover = e.groupBy("tile").agg(F.sum("w").alias("w")).join(kept, "tile", "left")
    return cover.select("tile", F.round(F.coalesce("k", F.lit(0)) / F.col("w"), 4).alias("recall")).join(agg_ple(spark, folder), "tile")


@query("ras_costpath")
def ras_costpath(spark, folder):
    """Cheapest path between two corners' neighbourhoods through each year's raster."""

    def run(tile, a):
        pts, evidence, length = K.cost_path(a, (4, 4), (58, 52))
        return pd.DataFrame([(tile, len(pts), round(evidence, 6), round(length, 6))], columns=["tile", "points", "evidence", "length"])

    return R.per_tile_raster(probability(spark, folder), 64, run, "tile int, points int, evidence double, length double", "p")


@query("ras_forward", "SELECT CAST(year(l_shipdate) AS INTEGER) AS tile, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, round(1/(1+exp(-(round(avg(l_discount), 6)*10-0.5)*8)), 6) AS p FROM lineitem GROUP BY 1, 2, 3")
def ras_forward(spark, folder):
    """A predictor as a vectorised function over pixels: the plug point, with a logistic stand-in."""

    @F.pandas_udf("double")
    def predict(v: pd.Series) -> pd.Series:
        return 1 / (1 + np.exp(-(v - 0.5) * 8))

    return probability(spark, folder).select("tile", "y", "x", F.round(predict("p"), 6).alias("p"))


@query("heat_color", "SELECT DISTINCT node_key, CASE WHEN tier = 'critical' THEN 'red' WHEN tier = 'important' THEN 'orange' ELSE 'grey' END AS colour FROM web_nodes")
def heat_color(spark, folder):
    """A styling column from the tier."""
    tier = F.col("tier")
    return table(spark, folder, "web_nodes").select("node_key", F.when(tier == "critical", "red").when(tier == "important", "orange").otherwise("grey").alias("colour")).distinct()


@query("snk_dataset", "SELECT site_key, t AS tile, lower(trim(split)) AS split FROM (SELECT DISTINCT site_key, split, unnest(tiles) AS t FROM dataset_sites WHERE error_note IS NULL AND split IS NOT NULL) WHERE t IS NOT NULL")
def snk_dataset(spark, folder):
    """Samples of sites without a failure, written partitioned by split and read back."""
    d = table(spark, folder, "dataset_sites").filter("error_note is null and split is not null")
    rows = d.select("site_key", "split", F.explode("tiles").alias("tile")).filter("tile is not null").distinct()
    path = _scratch(spark)
    rows.select("site_key", "tile", F.lower(F.trim("split")).alias("split")).write.partitionBy("split").parquet(path)
    return spark.read.schema("site_key long, tile string, split string").parquet(path)


@query("src_dem", "WITH px AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS tile, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x, round(avg(l_discount), 6)*10 AS p FROM lineitem GROUP BY 1, 2, 3) SELECT tile, y, x, CAST(floor(p*255) AS INTEGER)*256.0::DOUBLE + (x*3) - 32768.0::DOUBLE AS metres FROM px")
def src_dem(spark, folder):
    """Terrain colours of each pixel decoded to metres."""
    from meshwright.functions.geo import elevation

    p = probability(spark, folder)
    return p.select("tile", "y", "x", elevation(F.floor(F.col("p") * 255).cast("int"), F.col("x") * 3, F.lit(0)).alias("metres"))
