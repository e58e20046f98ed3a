"""Schema drift, nested records and proximity on small fixtures and by brute force."""

import json
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meshwright.operators import proximity, schema_drift, shred

RAW = "file_id long, feed string, line_no int, written_at timestamp_ntz, body string, extra string"


def raw(spark, files):
    rows = []
    for fid, feed, day, records in files:
        for i, r in enumerate(records):
            body = r if isinstance(r, str) or r is None else json.dumps(r)
            rows.append((fid, feed, i, datetime(2025, 1, 1) + timedelta(days=day), body, None))
    return spark.createDataFrame(rows, RAW)


def edge(**more):
    return {"stem": "a", "u": 1, "v": 2, "bc": 0.5, "w": 3.5, "healed": True, "conf": "low", **more}


def test_drift_of_names_types_and_presence(spark):
    ll = [[50.1, 70.2], [50.2, 70.3]]
    files = [
        (9, "f", 0, [edge(geo=True, ll=ll, hk="geom"), edge(geo=True, ll=ll, hk=None), "{broken", None]),
        (3, "f", 1, [edge(is_geo=1, ll="50.1 70.2;50.2 70.3", hk=None, rev=2, ll_count=8), edge(is_geo=0, ll="50.1 70.2", hk=None)]),
        (5, "f", 2, [edge(is_geo=1, line={"ll": ll}, heal={"hk": ["geom"]}), edge(is_geo=1, line={"ll": ll}, heal={"hk": ["trace"]}), edge(geo=True, ll=ll, hk="geom")]),
        (7, "f", 30, ["{nothing"]),
        (1, "g", 0, [edge(geo=True)]),
    ]
    got = {tuple(r) for r in schema_drift.drift_report(raw(spark, files)).collect()}
    assert got == {
        (3, "geo", "renamed"), (3, "geo", "retyped"), (3, "ll", "retyped"), (3, "hk", "removed"),
        (5, "ll", "renamed"), (5, "ll", "retyped"), (5, "hk", "added"),
        (7, "geo", "removed"), (7, "ll", "removed"), (7, "hk", "removed"),
    }


def test_drift_counts_a_repeated_line_once(spark):
    twice = [edge(geo=True, w=1.0)] * 3 + [edge(is_geo=True, w=2.0), edge(is_geo=True, w=3.0)]
    got = schema_drift.drift_report(raw(spark, [(1, "f", 0, [edge(is_geo=True)]), (2, "f", 1, twice)])).collect()
    assert got == []


def test_drift_of_nothing(spark):
    assert schema_drift.drift_report(raw(spark, [])).collect() == []
    assert schema_drift.consistent_edges(raw(spark, [])).collect() == []


def test_consistent_table_reads_every_spelling(spark):
    shapes = [edge(GEO="yes", LL=[50.1, 70.2, 50.2, 70.3], HK=["geom"]), edge(meta={"geo": 1}, line={"ll": [{"lat": 50.1, "lng": 70.2}, {"lat": 50.2, "lng": 70.3}]}, heal_kind="geom", note="x" * 50_000)]
    rows = schema_drift.consistent_edges(raw(spark, [(1, "f", 0, shapes)])).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.geo is True and r.ll == [[50.1, 70.2], [50.2, 70.3]] and r.hk == "geom" and r.u == 1 and r.w == 3.5


def test_edit_script_prefers_keeping():
    shape = tuple(sorted(((k,), schema_drift.content_class(v)) for k, v in edge(geo=True, geo_src="mosaic", ll=[[1.5, 2.5]], ll_count=2, hk=2, rev=3).items()))
    cost, steps = schema_drift.edit_script(shape)
    kept = {f: p for op, f, p in steps if op == "keep"}
    assert kept["geo"] == "geo" and kept["ll"] == "ll" and kept["hk"] == "hk"
    assert {p for op, _, p in steps if op == "add"} == {"geo_src", "ll_count", "rev"}


def test_shred_labels_lead_back_to_parents(spark):
    rows = [(1, [([[1.0, 2.0], None, [None, None]], "a"), None, (None, None)], {"k": (1,), "e": None}), (2, [], {}), (3, None, None)]
    schema = "key long, edges array<struct<ll: array<array<double>>, label: string>>, m map<string, struct<n: int>>"
    tables = shred.shred(spark.createDataFrame(rows, schema), "key", ["edges", "m"])
    edges = tables["edges", "[]"].collect()
    assert [(r.key, r.ordinal, r.filled, r.field_label) for r in sorted(edges, key=lambda r: r.ordinal)] == [(1, 0, True, "a"), (1, 1, False, None), (1, 2, False, None)]
    points = tables["edges", "[]", "ll", "[]"].collect()
    assert sorted((r.ordinal, r.filled, r.value) for r in points if r.filled) == [(0, True, [1.0, 2.0])]
    assert {r.parent_label for r in points} <= {r.label for r in edges}
    cut = tables["edges", "[]", "ll", "[]"].select(shred.parent_of(F.col("label"), 2).alias("p"), "parent_label").collect()
    assert all(r.p == r.parent_label for r in cut)
    assert {(r.map_key, r.filled) for r in tables["m", "{}"].collect()} == {("k", True), ("e", False)}


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


def test_near_nodes_by_brute_force(spark):
    rng = random.Random(1)
    spots = [(50, 70), (-33.9, 179.99995), (-33.9, -179.99995), (89.99999, 0), (0.00001, 0)]
    points = []
    for k in range(300):
        lat, lng = rng.choice(spots)
        lat, lng = min(90.0, lat + rng.uniform(-1, 1) * 2e-4), float(lng) + rng.uniform(-1, 1) * (2e-4 if lat < 80 else 180)
        points.append((k, lat, (lng + 180) % 360 - 180))
    odd = [(900, None, 1.0), (901, float("nan"), 1.0), (902, 0.0, 0.0), (903, 95.0, 1.0), (904, 1.0, 200.0), (None, 50.0, 70.0)]
    df = spark.createDataFrame(points + points[:20] + odd, "key long, lat double, lng double").withColumn("__cell", F.lit(1)).withColumn("key_a", F.lit("x"))
    for metres in (5, 60):
        want = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and haversine(a[1:], b[1:]) <= metres}
        got = [tuple(r) for r in proximity.near_nodes(df, "key", "lat", "lng", metres).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_lines_and_empty_tables(spark):
    nodes = spark.createDataFrame([(1, 50.0, 70.0), (2, 50.1, 70.0)], "k long, lat double, lng double")
    docs = spark.createDataFrame([(7, [[[50.0, 70.00001], [None, 1.0], [1.0], None], None]), (8, []), (9, None), (7, [[[50.0, 70.00001]]])], "d long, l array<array<array<double>>>")
    assert [tuple(r) for r in proximity.nodes_near_lines(nodes, "k", "lat", "lng", docs, "d", "l", 5).collect()] == [(1, 7)]
    assert proximity.near_nodes(nodes.limit(0), "k", "lat", "lng", 5).collect() == []
    assert proximity.nodes_near_lines(nodes, "k", "lat", "lng", docs.limit(0), "d", "l", 5).collect() == []


def test_points_in_regions(spark):
    rng = random.Random(2)
    ring = [(10.0, 20.0), (14.0, 20.5), (12.5, 22.0), (15.0, 24.0), (10.5, 23.0)]
    pts = [(k, rng.uniform(9, 16), rng.uniform(19, 25)) for k in range(400)]

    def inside(y, x):
        hit = False
        for (ay, ax), (by, bx) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    points = spark.createDataFrame(pts, "k long, lat double, lng double")
    regions = spark.createDataFrame([("r", ring), ("line", ring[:2]), ("none", None)], "name string, ring array<struct<lat: double, lng: double>>")
    got = {(r["k"], r["name"]) for r in proximity.in_regions(points, regions).collect()}
    assert got == {(k, "r") for k, y, x in pts if inside(y, x)} and got


def test_regions_of_any_size_take_four_cells(spark):
    rng = random.Random(8)
    boxes = [(k, y, x, y + h, x + h * rng.uniform(0.2, 3)) for k in range(40) for y, x, h in [(rng.uniform(-80, 60), rng.uniform(-170, 100), 10 ** rng.uniform(-5, 1.2))]]
    pts = [(k, rng.uniform(s, n), rng.uniform(w, e)) for k in range(200) for _, s, w, n, e in [rng.choice(boxes)]] + [(900, None, 1.0), (901, 0.0, 0.0), (902, 95.0, 1.0)]
    rows = [(k, [(s, w), (s, e), (n, e), (n, w)]) for k, s, w, n, e in boxes]
    regions = spark.createDataFrame(rows, "name int, ring array<struct<lat: double, lng: double>>")
    points = spark.createDataFrame(pts, "k long, lat double, lng double")
    got = {(r.k, r.name) for r in proximity.in_regions(points, regions).collect()}
    assert got == {(k, b[0]) for k, y, x in pts[:200] for b in boxes if b[1] <= y < b[3] and b[2] <= x < b[4]}
    assert {(r.k, r.name) for r in proximity.in_regions(points, regions, hot=7).collect()} == got
    assert proximity.in_regions(points, regions.limit(0)).collect() == [] and proximity.in_regions(points.limit(0), regions).collect() == []


def test_keys_of_one_place(spark):
    spots = [(1, 50.0, 70.0), (2, 50.0, 70.0), (3, 50.0, 70.00001), (4, 51.0, 70.0), (5, 51.0, 70.0), (5, 51.0, 70.0), (6, 52.0, 70.0), (1, 52.0, 70.0)]
    df = spark.createDataFrame(spots, "k long, lat double, lng double")
    assert sorted(map(tuple, proximity.near_nodes(df, "k", "lat", "lng", 5).collect())) == [(1, 2), (1, 3), (1, 6), (2, 3), (4, 5)]
