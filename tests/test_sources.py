"""Images, tiles, logs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.sources import files, tiles
from meshwright.sources.png import encode_png


def test_pairs_of_images_and_masks(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb, mask = rng.integers(0, 256, (5, 7, 3)), (rng.random((5, 7)) < 0.5) * 255
    (tmp_path / "a_sat.png").write_bytes(encode_png(rgb))
    (tmp_path / "a_mask.png").write_bytes(encode_png(mask))
    (tmp_path / "lonely_sat.png").write_bytes(encode_png(rgb))
    rows = files.sample_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 35 and {r.stem for r in rows} == {"a"}
    for r in rows:
        assert (r.r, r.g, r.b) == tuple(rgb[r.y, r.x]) and r.road == (mask[r.y, r.x] > 127)


def test_xyz_tiles(spark, tmp_path):
    tiles.register(spark)
    x0, y0 = (int(v) - 1 for v in tiles.tile_xy(12.97, 77.59, 5))
    (tmp_path / f"{x0}_{y0}.bin").write_bytes(b"north-west")
    read = spark.read.format("xyz_tiles").option("template", f"file://{tmp_path}/{{x}}_{{y}}.bin").option("zoom", 5).option("grid", 2).option("pause", 0)
    first = read.option("lat", 12.97).option("lng", 77.59).load()
    assert first.count() == 4 and first.filter("data is null").count() == 3
    again = read.option("x0", x0).option("y0", y0).load().filter("col = 0 and row = 0").first()
    assert bytes(again.data) == b"north-west"


def test_logs_only_grow(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.col("id") / 2)
    for form in ("json", "csv"):
        path = str(tmp_path / form)
        files.append_rows(df, path, form)
        files.append_rows(df, path, form)
        back = spark.read.schema(df.schema).option("header", "true")
        assert (back.csv(path) if form == "csv" else back.json(path)).count() == 6
    files.write_documents(df.withColumn("stem", F.lit("t")), str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).count() == 3


@pytest.mark.parametrize("asked, given", [(None, 8), (0, 2), (99, 16), (5, 5)])
def test_grid_limits(spark, asked, given):
    assert spark.range(1).select(files.clamp_grid(F.lit(asked).cast("int")).alias("g")).first().g == given


def test_png_filters_of_every_kind():
    """A file written with each line filter by hand comes back as its pixels."""
    import struct
    import zlib

    from meshwright.sources.png import decode_png

    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (10, 6, 3)).astype(int)
    h, w, bands = pixels.shape
    flat, rows = pixels.reshape(h, -1), b""
    for y in range(h):
        rule, line = y % 5, []
        for i in range(w * bands):
            a = flat[y, i - bands] if i >= bands else 0
            b = flat[y - 1, i] if y else 0
            c = flat[y - 1, i - bands] if y and i >= bands else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, best)[rule]) % 256)
        rows += bytes([rule, *map(int, line)])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"0000"
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (decode_png(content) == pixels).all()
    with pytest.raises(ValueError):
        decode_png(b"not a picture")


def test_mosaic_with_missing_and_broken_tiles(spark, tmp_path):
    tiles.register(spark)
    image = np.arange(8 * 8 * 3).reshape(8, 8, 3) % 256
    (tmp_path / "10_20.png").write_bytes(encode_png(image))
    (tmp_path / "11_20.png").write_bytes(b"broken")
    cells = tiles.fetch_sites(spark.createDataFrame([("s", 10, 20), ("empty", 50, 50)], "stem string, x0 int, y0 int"), f"file://{tmp_path}/{{x}}_{{y}}.png", 6, 2, pause=0)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in tiles.mosaic(cells, 8).collect()}
    assert got == {(y, x): tuple(map(int, image[y, x])) for y in range(8) for x in range(8)}
    frames = {r.stem: r for r in tiles.frame_of(cells, 6, 8).collect()}
    assert (frames["s"].failures, frames["s"].tiles, frames["s"].img_w) == (3, 4, 16) and frames["empty"].failures == 4
    lat, lng = (frames["s"].north + frames["s"].south) / 2, (frames["s"].east + frames["s"].west) / 2
    assert [int(v) for v in tiles.tile_xy(lat, lng, 6)] == [11, 21] or [int(v) for v in tiles.tile_xy(lat + 1e-9, lng - 1e-9, 6)] == [10, 20]


def test_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# top\na: 1\nb:\n  c: 'x: y'  # note\n  d:\n    e: 2.5\n\nf: \"z\"\n")
    got = {r["name"]: r["value"] for r in files.read_settings(spark, str(tmp_path)).collect()}
    assert got == {"a": "1", "b.c": "x: y", "b.d.e": "2.5", "f": "z"}


def test_map_elements(spark):
    import json

    from meshwright.operators import maps

    node = lambda k: {"type": "node", "id": k, "lat": 1.0 * k, "lon": 2.0}
    way = lambda k, nodes, **tags: {"type": "way", "id": k, "nodes": nodes, "tags": tags}
    doc = {"elements": [node(1), node(2), way(7, [1, 2, 9], highway="primary", tunnel="yes"), way(8, [1, 9], highway="primary"), way(9, [1, 2], highway="footway"), {"type": "way", "id": 10}]}
    df = spark.createDataFrame([("d", json.dumps(doc)), ("broken", "{"), ("none", None)], "doc string, text string")
    e = maps.elements(df, "doc", "text")
    assert e.count() == 6 and [(r.way, r.refs) for r in maps.roads(e, "doc").collect()] == [(7, 2)]
    assert [(r.place, r.ref, r.lat) for r in maps.way_refs(e, "doc").filter("way = 7").orderBy("place").collect()] == [(0, 1, 1.0), (1, 2, 2.0), (2, 9, None)]
    kept = {r.id for r in e.filter("type = 'way'").filter(~maps.is_tunnel(F.col("tags"))).collect()}
    assert kept == {8, 9, 10}


def test_bilinear_resize_by_hand():
    from meshwright.functions import raster_kernels as K

    a = np.array([[0.0, 10.0], [20.0, 30.0]])
    assert K.resize_bilinear(a, 2, 2).tolist() == a.tolist()
    assert K.resize_bilinear(a, 4, 4)[0].tolist() == [0.0, 2.5, 7.5, 10.0] and K.resize_bilinear(a, 4, 4)[:, 0].tolist() == [0.0, 5.0, 15.0, 20.0]
    assert K.resize_bilinear(a, 1, 1).tolist() == [[15.0]] and K.crop_window(5.3, 50.7) == (5, 51) and K.crop_window(3.2, 3.3) == (3, 4)
