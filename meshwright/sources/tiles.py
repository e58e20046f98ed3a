"""XYZ tiles as a Spark data source: one input partition per tile, retries inside the reader."""

from __future__ import annotations

import math
import time
import urllib.request
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meshwright.functions.geo import EQUATOR_RES, place_of_tile
from meshwright.sources.png import decode_png

TRIES, PAUSE = 4, 0.6


def fetch(url: str, tries: int = TRIES, pause: float = PAUSE, timeout: float = 20.0) -> bytes | None:
    """The content behind a URL (http or file), after ``tries`` with a pause growing by ``pause``; null if all fail."""
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read()
        except (OSError, ValueError):
            if k < tries:
                time.sleep(pause * k)
    return None


def tile_xy(lat: float, lng: float, zoom: int) -> tuple[float, float]:
    n = 2**zoom
    rad = math.radians(lat)
    return (lng + 180) / 360 * n, (1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * n


class _Tile(InputPartition):
    def __init__(self, x: int, y: int):
        super().__init__((x, y))
        self.x, self.y = x, y


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.template, self.zoom = options["template"], int(options["zoom"])
        self.grid, self.pause = int(options.get("grid", 8)), float(options.get("pause", PAUSE))
        if "x0" in options:  # a stored origin: the same tiles again
            self.x0, self.y0 = int(options["x0"]), int(options["y0"])
        else:
            x, y = tile_xy(float(options["lat"]), float(options["lng"]), self.zoom)
            self.x0, self.y0 = int(x) - self.grid // 2, int(y) - self.grid // 2

    def partitions(self) -> list[InputPartition]:
        return [_Tile(self.x0 + i, self.y0 + j) for j in range(self.grid) for i in range(self.grid)]

    def read(self, partition: _Tile) -> Iterator[tuple]:
        url = self.template.format(z=self.zoom, x=partition.x, y=partition.y)
        yield partition.x, partition.y, partition.x - self.x0, partition.y - self.y0, fetch(url, pause=self.pause)


class XyzTiles(DataSource):
    """``spark.read.format("xyz_tiles")`` with ``template`` (``{z}``, ``{x}``, ``{y}``), ``zoom``, ``grid`` and a
    place (``lat``, ``lng``) or a stored origin (``x0``, ``y0``). A tile that cannot be had has null data."""

    @classmethod
    def name(cls) -> str:
        return "xyz_tiles"

    def schema(self) -> str:
        return "x int, y int, col int, row int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XyzTiles)


def _decoded(data: bytes | None, side: int) -> np.ndarray | None:
    """Pixels of a tile, or null if there are none of that size."""
    try:
        pixels = decode_png(data) if data else None
    except Exception:  # a broken file is a missing tile
        return None
    return pixels if pixels is not None and pixels.shape[:2] == (side, side) else None


def mosaic(cells: DataFrame, side: int = 256) -> DataFrame:
    """``(..., y, x, r, g, b)``: the pixels of tiles laid side by side; a tile that failed is left out.

    ``cells`` has col, row and data, and may have a key ``stem`` that tells mosaics apart.
    """
    keys = [c for c in ("stem",) if c in cells.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pixels = _decoded(r["data"], side)
                if pixels is None:
                    continue
                y, x = np.divmod(np.arange(side * side), side)
                columns = [pa.array([r[k]] * side * side) for k in keys]
                columns += [pa.array((v).astype(np.int32)) for v in (y + r["row"] * side, x + r["col"] * side, *pixels.reshape(-1, 3).T)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "y", "x", "r", "g", "b"])

    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} int" for c in ("y", "x", "r", "g", "b")])
    return cells.select(*keys, "col", "row", "data").mapInArrow(run, schema)


def frame_of(cells: DataFrame, zoom: int, side: int = 256) -> DataFrame:
    """Bounds, size, resolution at the middle and number of failed tiles of each mosaic of ``cells``.

    From the north-west corner of the first tile to that of the one past the last.
    """
    keys = [c for c in ("stem",) if c in cells.columns]

    @F.pandas_udf("boolean")
    def usable(data: pd.Series) -> pd.Series:
        return data.map(lambda content: _decoded(content, side) is not None)

    f = cells.select(*keys, "x", "y", usable("data").alias("ok")).groupBy(*keys).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count(F.lit(1)).alias("tiles"), F.count_if(~F.col("ok")).alias("failures")
    )
    north, west = place_of_tile(F.col("x0"), F.col("y0"), zoom)
    south, east = place_of_tile(F.col("x1"), F.col("y1"), zoom)
    out = f.select(*keys, "x0", "y0", ((F.col("x1") - F.col("x0")) * side).alias("img_w"), ((F.col("y1") - F.col("y0")) * side).alias("img_h"), north.alias("north"), south.alias("south"), east.alias("east"), west.alias("west"), "tiles", "failures")
    middle = F.radians((F.col("north") + F.col("south")) / 2)
    return out.withColumn("res_m_per_px", F.round(F.lit(EQUATOR_RES * 256 / side) * F.cos(middle) / float(2**zoom), 3))


def fetch_sites(sites: DataFrame, template: str, zoom: int, grid: int, pause: float = PAUSE) -> DataFrame:
    """``(stem, x, y, col, row, data)``: the tiles of many sites at once, one row a tile, whatever fails.

    ``sites`` has stem and either the origin x0, y0 or a place lat, lng. Tiles are spread over tasks first.
    """
    if "x0" not in sites.columns:
        n = float(2**zoom)
        rad = F.radians("lat")
        x, y = (F.col("lng") + 180) / 360 * n, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n
        sites = sites.select("stem", (F.floor(x) - grid // 2).cast("int").alias("x0"), (F.floor(y) - grid // 2).cast("int").alias("y0"))
    step = F.sequence(F.lit(0), F.lit(grid - 1))
    cells = sites.select(F.col("stem").cast("string").alias("stem"), "x0", "y0", F.explode(step).alias("row")).withColumn("col", F.explode(step))
    cells = cells.select("stem", (F.col("x0") + F.col("col")).cast("int").alias("x"), (F.col("y0") + F.col("row")).cast("int").alias("y"), "col", "row").repartition("stem", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [fetch(template.format(z=zoom, x=x, y=y), pause=pause) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "data"])

    return cells.mapInArrow(run, "stem string, x int, y int, col int, row int, data binary")
