"""Joins whose sides both grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that shuffles and merges, however small its table looks.

    A Parquet table of a million rows takes a few MB as a file, so by that size it counts as small enough
    to broadcast; the driver would then hold it as objects, several times as large, once for each join.
    """
    return df.hint("merge")
