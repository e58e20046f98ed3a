"""Spark-native analytics over tiled road networks and the tables around them."""

__version__ = "0.1.0"
