"""Exact ranks inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Rows that one task should rank.
BUCKET_ROWS = 500_000


def buckets_for(rows: int, least: int = 64) -> int:
    """Buckets a group so that even a group of all rows gives each task its share."""
    return max(least, -(-rows // BUCKET_ROWS))


def spread_rank(df: DataFrame, by: list[str], key: str, out: str = "rank0", buckets: int = 64) -> DataFrame:
    """Add ``out``: the 0-based position of a row among the rows with equal ``by`` columns.

    The position follows ``(hash bucket of key, key)``, a fixed order that does not depend on
    how rows are spread over tasks. A group holding a third of all rows is ranked by
    ``buckets`` tasks: each ranks its own bucket, and bucket offsets come from a count per
    (group, bucket), which has at most ``buckets`` rows a group. ``key`` must be unique.
    """
    salted = df.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = salted.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        *[F.col(c).alias(f"__g_{c}") for c in by],
        F.col("__b").alias("__gb"),
        F.coalesce(
            F.sum("__n").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__off"),
    )
    inner = F.row_number().over(W.partitionBy(*by, "__b").orderBy(key)) - 1
    match: Column = F.col("__b") == F.col("__gb")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return (
        salted.withColumn("__r", inner)
        .join(offsets, match, "inner")
        .withColumn(out, (F.col("__r") + F.col("__off")).cast("long"))
        .drop("__b", "__r", "__gb", "__off", *[f"__g_{c}" for c in by])
    )
