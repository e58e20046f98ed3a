"""Web-Mercator and tile arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Fixed value: metres a pixel at zoom 0 on the equator for 256-pixel tiles.
EQUATOR_RES = 156543.03392


def merc_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def inverse_merc_y(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y)) - F.lit(math.pi / 2))


def to_pixel(lat: Column, lng: Column, b: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Pixel (x, y) of a place in an image with ``bounds`` struct ``b``; y grows southwards."""
    top, bottom = merc_y(b["north"]), merc_y(b["south"])
    return (lng - b["west"]) / (b["east"] - b["west"]) * w, (top - merc_y(lat)) / (top - bottom) * h


def to_place(x: Column, y: Column, b: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(lat, lng) of a pixel, to 6 decimals."""
    top, bottom = merc_y(b["north"]), merc_y(b["south"])
    lat = inverse_merc_y(top - y / h * (top - bottom))
    return F.round(lat, 6), F.round(b["west"] + x / w * (b["east"] - b["west"]), 6)


def tile_of(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional XYZ tile of a place."""
    n = float(2**zoom)
    rad = F.radians(lat)
    return (lng + 180) / 360 * n, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n


def place_of_tile(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """North-west corner of a tile."""
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n)))), x / n * 360 - 180


def resolution(lat: Column, zoom: int) -> Column:
    return F.round(F.lit(EQUATOR_RES) * F.cos(F.radians(lat)) / float(2**zoom), 3)


def elevation(r: Column, g: Column, b: Column) -> Column:
    """Metres from a terrain tile's colour."""
    return r * 256.0 + g + b / 256.0 - 32768.0


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounds overlap; touching is not overlapping."""
    return (a["west"] < b["east"]) & (b["west"] < a["east"]) & (a["south"] < b["north"]) & (b["south"] < a["north"])
