"""Camera, raster and polygon arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(row: Sequence[Column], point: Sequence[Column]) -> Column:
    return sum((a * b for a, b in zip(row[1:], point[1:], strict=True)), row[0] * point[0])


def world_to_pixel(p: Sequence[Column], point: Sequence[Column], offset: Sequence[float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column]:
    """(u, v) of a world point by a 3 x 4 matrix given row by row; null where the depth is 0."""
    at = [*(v - F.lit(float(o)) for v, o in zip(point, offset, strict=True)), F.lit(1.0)]
    u, v, depth = (_dot(p[4 * k : 4 * k + 4], at) for k in range(3))
    return u / F.nullif(depth, F.lit(0.0)), v / F.nullif(depth, F.lit(0.0))


def inverse3(m: Sequence[Column]) -> list[Column]:
    """Inverse of a 3 x 3 matrix by its adjugate; null where the determinant is 0."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cof = (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)
    return [x / F.nullif(det, F.lit(0.0)) for x in cof]


def ray_point(inv: Sequence[Column], p4: Sequence[Column], u: Column, v: Column, mu: Column, offset: Sequence[float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """inv . ([u, v, 1] mu - p4) + offset."""
    side = (u * mu - p4[0], v * mu - p4[1], mu - p4[2])
    return tuple(_dot(inv[3 * k : 3 * k + 3], side) + F.lit(float(offset[k])) for k in range(3))


def utm_to_raster(v: Column, origin: float, size: float, scale: float = 1.0) -> Column:
    """Raster index, truncated toward zero; null and NaN give null."""
    return F.when(~F.isnan(v), ((v - F.lit(float(origin))) / F.lit(float(size)) * F.lit(float(scale))).cast("long"))


def raster_to_utm(r: Column, origin: float, size: float) -> Column:
    return r * F.lit(float(size)) + F.lit(float(origin))


def compose(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Product of two affine maps given as (m00, m01, m02, m10, m11, m12)."""
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + (a[3 * r + 2] if c == 2 else F.lit(0.0)) for r in range(2) for c in range(3)]


def polygon_bounds_area(points: Column) -> list[Column]:
    """x, y, w, h and area (by cross products, the ring closed) of an array of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, turned, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys), area]


def spaced(n: Column, k: Column) -> Column:
    """k indices evenly over n, the end left out; where n < 2 k, half as many as n."""
    m = F.when(n < 2 * k, F.floor(n / 2)).otherwise(k).cast("long")
    return F.when(m > 0, F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: (i * n / m).cast("long"))).otherwise(F.array().cast("array<bigint>"))
