"""Graphs and rasters derived from the star-schema tables, in Spark and as SQL.

The same integer arithmetic on both sides: customers are nodes at hashed places, a nation is a
tile, an edge joins nodes of a tile at most R apart and weighs its length in thousandths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meshwright.operators.ranges import within
from meshwright.sources.tables import table

R = 75


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """``(tile, id, x, y, elev)``."""
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("tile"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("elev"))
    width = c.groupBy("tile").agg((F.lit(64) * F.ceil(F.sqrt(F.count(F.lit(1))))).cast("long").alias("w"))
    place = lambda e: F.expr(f"(({e}) % 4294967296L div 2048L) % w")
    return c.join(F.broadcast(width), "tile").select(  # one row a nation: 25, whatever the scale
        "tile", "id", place("id * 2654435761L").alias("x"), place("id * 2246822519L + 374761393L").alias("y"), "elev"
    )


def edges(spark: SparkSession, folder: str, radius: int = R) -> DataFrame:
    """``(tile, u, v, w)`` with ``u < v``."""
    n = nodes(spark, folder)
    d2 = (F.col("x_a") - F.col("x_b")) * (F.col("x_a") - F.col("x_b")) + (F.col("y_a") - F.col("y_b")) * (F.col("y_a") - F.col("y_b"))
    pairs = within(n.select("tile", "id", "x", "y"), ["tile"], radius).withColumn("d2", d2)
    return pairs.filter("id_a < id_b and d2 >= 1").select(
        "tile", F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.round(1000 * F.sqrt("d2")).cast("long").alias("w")
    )


NODES_SQL = """
nd AS (SELECT c_nationkey AS tile, c_custkey AS id, c_acctbal AS elev,
  ((c_custkey * 2654435761) % 4294967296 // 2048) % w AS x, ((c_custkey * 2246822519 + 374761393) % 4294967296 // 2048) % w AS y
  FROM customer JOIN (SELECT c_nationkey AS t, CAST(64 * ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer GROUP BY 1) ON t = c_nationkey)"""


def edges_sql(radius: int = R) -> str:
    return f"""{NODES_SQL},
ed AS (SELECT tile, u, v, CAST(round(1000 * sqrt(d2)) AS BIGINT) AS w FROM (
  SELECT a.tile, a.id AS u, b.id AS v, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) AS d2 FROM nd a JOIN nd b ON a.tile = b.tile AND a.id < b.id)
  WHERE d2 BETWEEN 1 AND {radius * radius})"""


#: Distances between all pairs of a tile that have a path, and components, after ``ed``.
APSP_SQL = """,
e2 AS (SELECT tile, u, v, w FROM ed UNION ALL SELECT tile, v, u, w FROM ed),
ap(s, n, d) USING KEY (s, n) AS (
  SELECT DISTINCT u, u, CAST(0 AS BIGINT) FROM e2
  UNION
  SELECT x.s, x.v, x.d FROM (SELECT ap.s, e2.v, min(ap.d + e2.w) AS d FROM ap JOIN e2 ON ap.n = e2.u GROUP BY ap.s, e2.v) x
  LEFT JOIN recurring.ap q ON q.s = x.s AND q.n = x.v WHERE q.d IS NULL OR x.d < q.d)"""


def probability(spark: SparkSession, folder: str) -> DataFrame:
    """``(tile, y, x, p)``: 64 x 64 cells a year."""
    li = table(spark, folder, "lineitem")
    return li.groupBy(
        F.year("l_shipdate").alias("tile"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")
    ).agg((F.round(F.avg("l_discount"), 6) * 10).alias("p"))


PX_SQL = """
px AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS tile, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x,
  round(avg(l_discount), 6) * 10 AS p FROM lineitem GROUP BY 1, 2, 3)"""


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """``(tile, y, x)``: cells with a returned item."""
    li = table(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    return li.select(
        F.year("l_shipdate").alias("tile"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")
    ).distinct()


GT_SQL = """
gt AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS tile, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x
  FROM lineitem WHERE l_returnflag = 'R')"""
