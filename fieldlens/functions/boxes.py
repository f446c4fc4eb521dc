"""Box geometry as column expressions. A box is (x, y, w, h) or (x1, y1, x2, y2); all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: positions of the 17 person key points after a left-right flip
FLIP = (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15)


def corners(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, w, h) to (x1, y1, x2, y2)."""
    return x, y, x + w, y + h


def sized(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column]:
    """(x1, y1, x2, y2) to (x, y, w, h)."""
    return x1, y1, x2 - x1, y2 - y1


def clip(v: Column, limit: Column | float) -> Column:
    return F.greatest(F.lit(0), F.least(v, limit if isinstance(limit, Column) else F.lit(limit)))


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two xywh boxes share."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    dx = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    dy = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((dx > 0) & (dy > 0), dx * dy).otherwise(0)


def iou(a: Sequence[Column], b: Sequence[Column], crowd: Column | None = None) -> Column:
    """Shared area by that of both; against a crowd region b, by the area of a alone."""
    shared = overlap(a, b)
    union = a[2] * a[3] + b[2] * b[3] - shared
    whole = union if crowd is None else F.when(crowd == 1, a[2] * a[3]).otherwise(union)
    return shared.cast("double") / whole


def polygon(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners from the upper left, clockwise, truncated to integers."""
    return F.array(*[v.cast("long") for v in (x, y, x + w, y, x + w, y + h, x, y + h)])


def scaled(v: Column, s: float) -> Column:
    return (v * F.lit(s)).cast("long")


def resize_ratio(w: Column, h: Column, least: float, most: float) -> Column:
    return F.least(F.lit(float(least)) / F.least(w, h), F.lit(float(most)) / F.greatest(w, h))


def flip_keypoints(points: Column, width: Column) -> Column:
    """Mirrors an array of (x, y, v) and swaps left and right; what isn't visible becomes (0, 0, 0)."""
    order = F.array(*[F.lit(i) for i in FLIP])

    def one(p: Column) -> Column:
        seen = p["v"] != 0
        return F.struct(*[F.when(seen, v).otherwise(F.lit(0)).alias(n) for n, v in (("x", width - p["x"]), ("y", p["y"]), ("v", p["v"]))])

    # bound to a variable, the array is made once and not for each of its elements
    return F.get(F.transform(F.array(points), lambda all_of: F.transform(order, lambda i: one(F.get(all_of, i)))), F.lit(0))


def oks(a: Column | list, b: Column | list, area: Column, spread: Sequence[float]) -> Column:
    """Object key-point similarity: mean over the visible points of b of exp(-d^2 / (2 area (2 spread)^2)).

    a and b are arrays of (x, y, v), or lists of such columns by name, of which no array is made.
    """
    if isinstance(a, list):
        far = lambda p, q: F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)
        terms = [F.when(q["v"] > 0, F.exp(-far(p, q) / (2 * area * F.pow(F.lit(2.0 * s), 2)))) for p, q, s in zip(a, b, spread, strict=True)]
        total, n = F.lit(0.0), F.lit(0)
        for t in terms:
            total, n = total + F.coalesce(t, F.lit(0.0)), n + t.isNotNull().cast("int")
        return F.when(n > 0, total / n)
    k = F.array(*[F.lit(float(s)) for s in spread])

    def similar(p: Column, q: Column) -> Column:
        far = lambda i: F.pow(F.get(p, i)["x"] - F.get(q, i)["x"], 2) + F.pow(F.get(p, i)["y"] - F.get(q, i)["y"], 2)
        terms = F.transform(F.sequence(F.lit(0), F.lit(len(spread) - 1)), lambda i: F.when(F.get(q, i)["v"] > 0, F.exp(-far(i) / (2 * area * F.pow(2 * F.get(k, i), 2)))))
        total = F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, t: F.when(t.isNull(), acc).otherwise(F.struct((acc["s"] + t).alias("s"), (acc["n"] + 1).alias("n"))))
        return F.aggregate(F.array(total), F.lit(None).cast("double"), lambda _, t: F.when(t["n"] > 0, t["s"] / t["n"]))

    # bound to variables, both arrays are made once
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: similar(s["a"], s["b"])), F.lit(0))
