"""Scalar operators on pixels, angles, polylines and metrics, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Channel means and deviations of the usual RGB normalisation.
RGB_MEAN, RGB_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def excess_green_byte(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.greatest((excess_green(r, g, b) + 510) * 255 / 1020, F.lit(0.0)), F.lit(255.0)).cast("int")


def hue_sat_val(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 180), saturation and value in [0, 255], as 8-bit images carry them."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    raw = (
        F.when(span == 0, 0.0)
        .when(top == r, 60 * (g - b) / span)
        .when(top == g, 120 + 60 * (b - r) / span)
        .otherwise(240 + 60 * (r - g) / span)
    )
    hue = F.floor(F.when(raw < 0, raw + 360).otherwise(raw) / 2 + 0.5).cast("int") % 180
    sat = F.when(top == 0, 0).otherwise(F.floor(255 * span / top + 0.5)).cast("int")
    return hue, sat, top


def channel(name: str, r: Column, g: Column, b: Column, nir: Column | None = None) -> Column:
    """One channel of a stack by name; an unknown name is an error, a missing nir is 0."""
    hue, sat, val = hue_sat_val(r, g, b)
    known = {
        "r": r, "g": g, "b": b, "hue": F.floor(hue * 255 / 179).cast("int"), "sat": sat, "val": val,
        "exg": excess_green_byte(r, g, b), "nir": F.lit(0) if nir is None else nir,
    }
    if name not in known:
        raise ValueError(f"unknown channel: {name}")
    return known[name]


def channels(spec: list[str], r: Column, g: Column, b: Column, nir: Column | None = None) -> Column:
    return F.array(*[channel(c, r, g, b, nir).cast("int") for c in spec])


def channel_norm(spec: list[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Mean and deviation of each channel: that of its colour for r, g and b, a half for any other."""
    known = {c: (m, d) for c, m, d in zip("rgb", RGB_MEAN, RGB_STD)}
    pairs = [known.get(c, (0.5, 0.5)) for c in spec]
    return tuple(m for m, _ in pairs), tuple(d for _, d in pairs)


def normalise(v: Column, mean: float, std: float) -> Column:
    return (v / 255.0 - mean) / std


def denormalise(v: Column, mean: float, std: float) -> Column:
    return F.least(F.greatest(v * std + mean, F.lit(0.0)), F.lit(1.0))


def is_on(logit: Column, threshold: float) -> Column:
    """Strictly above the threshold after the sigmoid."""
    return 1 / (1 + F.exp(-logit)) > threshold


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two undirected directions, at most 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180 - d)


def line_offset(px: Column, py: Column, angle: Column, qx: Column, qy: Column) -> Column:
    """Distance of q from the line through p at ``angle`` degrees."""
    t = F.radians(angle)
    return F.abs((qx - px) * F.sin(t) - (qy - py) * F.cos(t))


def aligned(px, py, pa, qx, qy, qa, tolerance: float, corridor: float = 16.0) -> Column:
    """Whether two directed ends face each other: straight on, or inside a common corridor.

    A missing direction has no objection.
    """
    gap = F.pmod(F.degrees(F.atan2(qy - py, qx - px)), F.lit(180.0))
    straight = (F.coalesce(angle_between(pa, gap), F.lit(0.0)) <= tolerance) & (
        F.coalesce(angle_between(qa, gap), F.lit(0.0)) <= tolerance
    )
    inside = (F.coalesce(line_offset(px, py, pa, qx, qy), F.lit(0.0)) <= corridor) & (
        F.coalesce(line_offset(qx, qy, qa, px, py), F.lit(0.0)) <= corridor
    )
    return straight | inside


def polyline_length(points: Column) -> Column:
    """Length through an array of [a, b] points; 1 for fewer than two."""
    n = F.size(points)
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda p, q: F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])),
    )
    return F.when(n < 2, F.lit(1.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def thin_points(points: Column, most: int = 16) -> Column:
    """At most ``most`` points, evenly by index, first and last kept, from (row, column) to [x, y] with one digit."""
    n = F.size(points)
    step = (n - 1) / F.lit(float(most - 1))
    index = lambda i: F.when(i == most - 1, n - 1).otherwise(F.floor(i * step).cast("int"))
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(points, index(i) + 1))
    kept = F.when(n <= most, points).otherwise(picked)
    return F.transform(kept, lambda p: F.array(F.bround(p[1], 1), F.bround(p[0], 1)))


def every_step(points: Column, parts: int = 12) -> Column:
    """Every k-th [lat, lng] vertex to six digits, k being a twelfth of the count, at least 1."""
    step = F.greatest(F.floor(F.size(points) / parts), F.lit(1))
    return F.transform(F.filter(points, lambda p, i: i % step == 0), lambda p: F.array(F.bround(p[0], 6), F.bround(p[1], 6)))


def sampled_sources(n: Column) -> Column:
    """How many sources betweenness samples: null (all) up to 450 nodes, at most 350 beyond."""
    return F.when(n <= 450, F.lit(None)).otherwise(F.least(n, F.lit(350)))


def status(r: Column) -> Column:
    return F.when(r > 0.7, "STABLE").when(r > 0.4, "DEGRADED").otherwise("CRITICAL")


def parse_latlon(text: Column) -> tuple[Column, Column]:
    """(lat, lng) of a text like ``12.9, 77.6``; nulls for anything else."""
    pattern = r"^\s*(-?\d+(?:\.\d+)?)\s*[, ]\s*(-?\d+(?:\.\d+)?)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("double")
    return part(1), part(2)


def hann_weight(y: Column, x: Column, n: int) -> Column:
    """Cell of an n x n outer-product Hann window scaled to a maximum of 1."""
    one = lambda i: 0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))
    top = max(one(i) for i in range(n)) ** 2
    at = lambda c: 0.5 - 0.5 * F.cos(F.lit(2 * math.pi) * c / (n - 1))
    return at(y) * at(x) / top
