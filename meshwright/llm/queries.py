"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwright.llm import bpe, groups, leakage, packing, residue, splits, topn
from meshwright.sources.tables import table

LEAK_M = 75.0


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.match_groups(table(spark, folder, "web_edges"), "stem", "u", "v")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tied = splits.tied_groups(table(spark, folder, "dataset_sites"), "site_key", "tiles", "scene_id")
    return tied.filter("size > 1").select("site_key", "group_key")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "dataset_sites"), "site_key", "tiles", "scene_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = leakage.cross_split_pairs(table(spark, folder, "dataset_sites"), "site_key", "lat", "lon", "split", "source", LEAK_M)
    return pairs.select(
        F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")
    ).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.overlap_report(table(spark, folder, "dataset_sites"), "site_key", "lat", "lon", "split", "source", LEAK_M)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes, tiles = table(spark, folder, "web_nodes"), table(spark, folder, "manifest")
    wanted = tiles.select("stem").filter("stem is not null").distinct()
    latest = (
        nodes.select("stem", "id", "bc", "exported_at").filter("stem is not null and id is not null")
        .groupBy("stem", "id").agg(F.max_by("bc", F.struct("exported_at", F.coalesce("bc", F.lit(-1.0)))).alias("bc"))
    )
    return topn.top_items(latest.join(wanted, "stem", "left_semi"), "stem", "id", "bc").select("stem", "id", "rnk")


P7_SQL = """
WITH ranked AS (SELECT stem, id, bc, row_number() OVER (PARTITION BY stem, id ORDER BY exported_at DESC NULLS LAST, coalesce(bc, -1.0) DESC) AS k
  FROM web_nodes WHERE stem IS NOT NULL AND id IS NOT NULL)
SELECT stem, id, CAST(rnk AS INTEGER) AS rnk FROM (
  SELECT stem, id, row_number() OVER (PARTITION BY stem ORDER BY bc DESC, id) AS rnk FROM ranked
  WHERE k = 1 AND bc IS NOT NULL AND NOT isnan(bc) AND bc BETWEEN 0 AND 1 AND stem IN (SELECT stem FROM manifest WHERE stem IS NOT NULL))
WHERE rnk <= 10
"""

#: Distances by the same haversine; the places of val and test sites against those of train sites.
P6_SQL = """
WITH s AS (SELECT DISTINCT site_key, lat, lon, CASE WHEN n IN ('train', 'training', 'trn', 'tr') THEN 'train'
    WHEN n IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN n IN ('test', 'testing', 'tst', 'eval') THEN 'test' END AS side
  FROM (SELECT *, trim(lower(split)) AS n FROM dataset_sites)
  WHERE site_key IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0))
SELECT DISTINCT least(a.site_key, b.site_key) AS key_a, greatest(a.site_key, b.site_key) AS key_b
FROM s a JOIN s b ON a.side = 'train' AND b.side IN ('val', 'test') AND a.site_key <> b.site_key AND abs(a.lat - b.lat) < 0.001
WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 75
"""

P6_REPORT_SQL = """
WITH s AS (SELECT DISTINCT site_key, lat, lon, coalesce(lower(trim(source)), '') AS source, CASE WHEN n IN ('train', 'training', 'trn', 'tr') THEN 'train'
    WHEN n IN ('val', 'valid', 'validation', 'dev') THEN 'val' WHEN n IN ('test', 'testing', 'tst', 'eval') THEN 'test' END AS side
  FROM (SELECT *, trim(lower(split)) AS n FROM dataset_sites)
  WHERE site_key IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)),
d AS (SELECT a.site_key AS t, b.site_key AS e, b.side, a.source AS ts, b.source AS es, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS m
  FROM s a JOIN s b ON a.side = 'train' AND b.side IN ('val', 'test') AND a.site_key <> b.site_key AND abs(a.lat - b.lat) < 0.001),
r AS (SELECT e, side, es, bool_or(m = 0) AS exact, count(*) AS pairs FROM (SELECT DISTINCT t, e, side, ts, es, m = 0 AS z, m FROM d WHERE m <= 75) GROUP BY 1, 2, 3)
SELECT side AS eval_split, es AS eval_source, count(*) AS records, CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS exact_records, CAST(sum(pairs) AS BIGINT) AS pairs FROM r GROUP BY 1, 2
"""

#: Labels spread along links until none gets smaller.
P4_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT stem, u, v FROM web_edges WHERE stem IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL AND u <> v),
b AS (SELECT stem, u, v FROM l UNION SELECT stem, v, u FROM l),
g(stem, id, k) USING KEY (stem, id) AS (
  SELECT stem, u, least(u, min(v)) FROM b GROUP BY 1, 2
  UNION
  SELECT x.stem, x.id, x.k FROM (SELECT g.stem, b.v AS id, min(g.k) AS k FROM g JOIN b ON g.stem = b.stem AND g.id = b.u GROUP BY 1, 2) x
  JOIN recurring.g q ON q.stem = x.stem AND q.id = x.id WHERE x.k < q.k)
SELECT stem, id AS node_id, k AS group_id FROM g
"""


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_room(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of ``p9_containers`` are, against the fewest that any packing needs."""
    packed = packing.pack_texts(table(spark, folder, "documents"), "doc_id", "text").filter("piece_size > 0")
    n, used = F.countDistinct("container_id"), F.sum("piece_size")
    return packed.agg(n.alias("containers"), used.alias("tokens"), F.ceil(used / packing.CAPACITY).alias("fewest"), (n * packing.CAPACITY - used).alias("unused")).withColumn(
        "unused_share", F.round(F.col("unused") / (F.col("containers") * packing.CAPACITY), 6)
    )


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    marked = residue.mark_residue(table(spark, folder, "documents"), "doc_id", "text")
    return marked.filter("residue").select("doc_id").distinct()


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    marked = residue.mark_residue(table(spark, folder, "documents"), "doc_id", "text")
    return marked.filter("not residue").select("doc_id").distinct()


def p10_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = residue.validate(table(spark, folder, "documents"), "doc_id", "text", "applicant", labelled=residue.LABEL_TEXTS, new=True)
    schema = (
        "fold int, texts long, units long, residue long, recall double, precision double, accuracy double, residue_texts long, text_recall double, "
        "text_precision double, new_residue long, new_recall double, new_texts long, new_text_recall double"
    )
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


QUERIES = {
    "p4_found": p4_found, "p5_found": p5_found, "p5_splits": p5_splits, "p6_found": p6_found, "p6_report": p6_report,
    "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_room": p9_room, "p10_found": p10_found, "p10_clean": p10_clean,
    "p10_validation": p10_validation,
}
SQL = {"p4_found": P4_SQL, "p6_found": P6_SQL, "p6_report": P6_REPORT_SQL, "p7_found": P7_SQL}
