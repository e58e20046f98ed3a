"""Map elements as tables: nodes, ways and what they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The road classes that count, and the tunnels that imagery does not show.
ROAD_TYPES = [
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link",
]
TUNNELS = ["yes", "building_passage"]
ELEMENTS = "elements array<struct<type: string, id: long, lat: double, lon: double, nodes: array<long>, tags: map<string, string>>>"


def elements(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per element of each map document: key, type, id, lat, lon, nodes, tags. Broken documents give none."""
    parsed = documents.select(F.col(key), F.explode(F.from_json(text, ELEMENTS).getField("elements")).alias("e"))
    return parsed.filter("e.id is not null").select(key, "e.*")


def way_refs(found: DataFrame, key: str) -> DataFrame:
    """(key, way, place, ref, lat, lon): the references of each way in order, with places where they resolve."""
    refs = found.filter("type = 'way'").select(key, F.col("id").alias("way"), F.posexplode("nodes").alias("place", "ref"))
    at = found.filter("type = 'node' and lat is not null and lon is not null").select(key, F.col("id").alias("ref"), "lat", "lon").dropDuplicates([key, "ref"])
    return refs.join(at, [key, "ref"], "left").select(key, "way", "place", "ref", "lat", "lon")


def roads(found: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, way, highway, refs): ways of a road class with at least ``least`` references that resolve."""
    known = way_refs(found, key).filter("lat is not null").groupBy(key, "way").agg(F.count(F.lit(1)).alias("refs")).filter(F.col("refs") >= least)
    ways = found.filter("type = 'way'").select(key, F.col("id").alias("way"), F.col("tags")["highway"].alias("highway"))
    return ways.filter(F.col("highway").isin(ROAD_TYPES)).join(known, [key, "way"])


def is_tunnel(tags: Column) -> Column:
    """A missing tag is no tunnel."""
    return F.coalesce(tags["tunnel"].isin(TUNNELS), F.lit(False))
