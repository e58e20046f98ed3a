"""Queries over the raw and nested tables: schema drift, nested records, proximity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwright.operators import proximity, schema_drift, shred
from meshwright.sources.tables import table

NEAR_M = 5.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.drift_report(table(spark, folder, "web_raw"))


def p1_edges(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.consistent_edges(table(spark, folder, "web_raw"))


def _children(frame: DataFrame, source: str, key: str, child: str, child_key) -> DataFrame:
    return frame.filter(shred.FILLED).select(
        F.lit(source).alias("src"), F.col(key).cast("long").alias("parent_id"), F.lit(child).alias("child"), child_key.alias("child_key")
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = shred.shred(table(spark, folder, "loop_history"), "run_id", ["sectors", "average"])
    docs = shred.shred(table(spark, folder, "export_web_geo"), "doc_key", ["edges"])
    sectors, average = runs["sectors", "{}"], runs["average",]
    edges, vertices = docs["edges", "[]"], docs["edges", "[]", "ll", "[]"]
    edge_position = F.element_at(F.split(F.col(shred.PARENT), r"\."), -1)
    out = (
        _children(sectors, "loop_history", "run_id", "sectors", F.col(shred.MAP_KEY))
        .unionByName(_children(average, "loop_history", "run_id", "average", F.lit("average")))
        .unionByName(_children(edges, "export_web_geo", "doc_key", "edges", F.col(shred.ORDINAL).cast("string")))
        .unionByName(
            _children(vertices, "export_web_geo", "doc_key", "ll", F.concat_ws(".", edge_position, F.col(shred.ORDINAL).cast("string")))
        )
    )
    return out.distinct()


P2_SQL = """
WITH s AS (SELECT DISTINCT run_id, e.key AS k, e.value AS v FROM (SELECT run_id, unnest(map_entries(sectors)) AS e FROM loop_history)),
e AS (SELECT doc_key, unnest(edges) AS x, generate_subscripts(edges, 1) - 1 AS i FROM export_web_geo),
l AS (SELECT doc_key, i, unnest(x.ll) AS p, generate_subscripts(x.ll, 1) - 1 AS j FROM e WHERE x.ll IS NOT NULL)
SELECT DISTINCT * FROM (
  SELECT 'loop_history' AS src, run_id AS parent_id, 'sectors' AS child, k AS child_key FROM s
  WHERE coalesce(v.recall, v."precision", v.f1, v.routing_success, v.median_plerr_pct, v.lcc_after, CAST(v.nodes AS DOUBLE)) IS NOT NULL
  UNION ALL
  SELECT 'loop_history', run_id, 'average', 'average' FROM loop_history
  WHERE coalesce(average.recall, average."precision", average.f1, average.routing_success, average.median_plerr_pct, average.lcc_after, average.nodes) IS NOT NULL
  UNION ALL
  SELECT 'export_web_geo', doc_key, 'edges', CAST(i AS VARCHAR) FROM e
  WHERE x.u IS NOT NULL OR x.v IS NOT NULL OR x.bc IS NOT NULL OR x.w IS NOT NULL OR x.healed IS NOT NULL OR x.hk IS NOT NULL OR x.conf IS NOT NULL
     OR len(list_filter(flatten(x.pts), lambda q: q IS NOT NULL)) > 0 OR len(list_filter(flatten(x.ll), lambda q: q IS NOT NULL)) > 0
  UNION ALL
  SELECT 'export_web_geo', doc_key, 'll', i || '.' || j FROM l WHERE len(list_filter(p, lambda q: q IS NOT NULL)) > 0)
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes, docs = table(spark, folder, "web_nodes"), table(spark, folder, "export_web_geo")
    pairs = proximity.near_nodes(nodes, "node_key", "lat", "lng", NEAR_M)
    lines = proximity.nodes_near_lines(nodes, "node_key", "lat", "lng", docs, "doc_key", "osm_lines", NEAR_M)
    return pairs.select(F.lit("node").alias("near"), "key_a", "key_b").unionByName(
        lines.select(F.lit("line").alias("near"), "key_a", "key_b")
    )


#: Candidates by bands of latitude a little higher than the radius, then the same distance.
P3_SQL = """
WITH n AS (SELECT DISTINCT node_key AS k, lat, lng, CAST(floor(lat / 0.0001) AS BIGINT) AS band FROM web_nodes
  WHERE node_key IS NOT NULL AND abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)),
wide AS (SELECT k, lat, lng, unnest([band - 1, band, band + 1]) AS band FROM n),
l AS (SELECT doc_key, unnest(osm_lines) AS l FROM (SELECT DISTINCT doc_key, osm_lines FROM export_web_geo)),
v AS (SELECT DISTINCT doc_key AS k, p[1] AS lat, p[2] AS lng, CAST(floor(p[1] / 0.0001) AS BIGINT) AS band FROM (SELECT doc_key, unnest(l) AS p FROM l)
  WHERE abs(p[1]) <= 90 AND abs(p[2]) <= 180 AND NOT (p[1] = 0 AND p[2] = 0)),
c AS (SELECT 'node' AS near, a.k AS key_a, b.k AS key_b, a.lat AS y1, a.lng AS x1, b.lat AS y2, b.lng AS x2 FROM wide a JOIN n b ON a.band = b.band AND a.k < b.k AND abs(a.lng - b.lng) < 0.01
  UNION ALL SELECT 'line', a.k, v.k, a.lat, a.lng, v.lat, v.lng FROM wide a JOIN v ON a.band = v.band AND abs(a.lng - v.lng) < 0.01)
SELECT DISTINCT near, key_a, key_b FROM c WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(y2 - y1) / 2), 2)
  + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2)))) <= 5
"""

def p3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Each located node with every tile whose exported bounds hold it."""
    nodes = table(spark, folder, "web_nodes").select("node_key", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).filter("node_key is not null").distinct()
    tiles = table(spark, folder, "export_web_geo").select("stem", "bounds.*").filter("stem is not null").dropna().distinct()
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lng"))
    ring = F.array(corner("south", "west"), corner("south", "east"), corner("north", "east"), corner("north", "west"))
    return proximity.in_regions(nodes, tiles.select("stem", ring.alias("ring"))).select("node_key", "stem").distinct()


P3_REGIONS_SQL = """
WITH r AS (SELECT DISTINCT stem, bounds.north AS n, bounds.south AS s, bounds.east AS e, bounds.west AS w FROM export_web_geo WHERE stem IS NOT NULL),
p AS (SELECT DISTINCT node_key, lat, lng FROM web_nodes WHERE node_key IS NOT NULL AND abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0))
SELECT DISTINCT node_key, stem FROM p JOIN r ON lat >= s AND lat < n AND lng >= w AND lng < e
"""

QUERIES = {"p1_found": p1_found, "p1_edges": p1_edges, "p2_found": p2_found, "p3_found": p3_found, "p3_regions": p3_regions}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_regions": P3_REGIONS_SQL}
