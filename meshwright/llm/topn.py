"""Top N items of every group, by a threshold from score histograms and an exact rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from meshwright.planning.lineage import materialise
from meshwright.planning.skew import look_up

#: Score buckets of a group's histogram.
BUCKETS = 1024
#: Rows of one group that one task should rank.
PIECE_ROWS = 500_000


def top_items(
    items: DataFrame, group: str, item: str, score: str, n: int = 10, lowest: float = 0.0, highest: float = 1.0,
    buckets: int = BUCKETS, piece_rows: int = PIECE_ROWS, salts: int | None = None,
) -> DataFrame:
    """``(group, item, score, rnk)``: ranks 1 to ``n`` by score descending, then item ascending.

    ``(group, item)`` must be unique. Items with a null group, or a score that is null, NaN or
    outside ``[lowest, highest]``, are not ranked; a group without ranked items gives no rows;
    an empty table gives none.

    1. The items' groups, ids and scores are written once; everything below reads those columns.
    2. A histogram per group (at most ``buckets`` counts each, pre-aggregated before the
       shuffle) gives the highest bucket down to which at least ``n`` items lie.
    3. Rows below that bucket go. Thresholds are looked up with hot groups set apart
       (``planning.skew``), so a group with a third of all rows is no single task.
    4. Survivors are ranked exactly, first inside pieces, then among the pieces' winners: also
       when millions share one score, no task ranks more than about ``piece_rows`` of them
       (``salts`` sets the number of pieces instead).
    """
    kept_columns = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"))
    ranked = materialise(kept_columns.filter(F.col("g").isNotNull() & ~F.isnan("s") & F.col("s").between(lowest, highest)), "top-items")
    rows = ranked.count()
    width = (highest - lowest) / buckets
    bucket = F.least(F.floor((F.col("s") - lowest) / width), F.lit(buckets - 1)).cast("int")
    cut = (
        ranked.groupBy("g", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
        .withColumn("above", F.sum("c").over(W.partitionBy("g").orderBy(F.desc("b"))) - F.col("c"))
        .filter(F.col("above") < n)
        .groupBy("g").agg(F.min("b").alias("least"))
    )
    spread = F.col("i").cast(ranked.schema["g"].dataType).alias("z")
    kept = look_up(ranked.select("g", "i", "s", spread), cut, "g", "z", most=rows).filter(bucket >= F.col("least"))
    pieces = salts or max(1, -(-rows // piece_rows))
    order = [F.desc("s"), F.asc("i")]
    piece = F.pmod(F.xxhash64("i"), F.lit(pieces))
    winners = kept.withColumn("p", piece).withColumn("r", F.row_number().over(W.partitionBy("g", "p").orderBy(*order))).filter(F.col("r") <= n)
    return (
        winners.withColumn("rnk", F.row_number().over(W.partitionBy("g").orderBy(*order)))
        .filter(F.col("rnk") <= n)
        .select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rnk")
    )
