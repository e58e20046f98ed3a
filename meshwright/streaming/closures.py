"""An extension beyond the batch pipeline: road closures arriving as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def closure_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of closures: event time, tile and node."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).cast("int").alias("tile"), F.col("user_id").alias("node")
    )


def closed_per_window(closures: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Closures and distinct closed nodes (approximately) of each tile and window; late rows within the watermark count."""
    return (
        closures.withWatermark("ts", late).groupBy(F.window("ts", window), "tile")
        .agg(F.count(F.lit(1)).alias("closures"), F.approx_count_distinct("node").alias("nodes"))
        .select(F.col("window.start").alias("day"), "tile", "closures", "nodes")
    )


def drain(frame: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and give its complete result."""
    query = frame.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
