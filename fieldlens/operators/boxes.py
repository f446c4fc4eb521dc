"""Operators on tables of boxes. Corner columns are x1, y1, x2, y2; sizes are x, y, w, h."""

from __future__ import annotations

import math

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import boxes as B
from fieldlens.operators.dataset import draw


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after another, as one plan."""
    return reduce(DataFrame.transform, steps, df)


def clip_boxes(df: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    return df.withColumns({c: B.clip(F.col(c), width if c[0] == "x" else height) for c in ("x1", "y1", "x2", "y2")})


def drop_degenerate(df: DataFrame) -> DataFrame:
    """Rows, with all their columns, whose boxes have a positive width and height."""
    return df.filter("x2 > x1 and y2 > y1")


def crop_boxes(df: DataFrame, left: Column, top: Column, width: int, height: int) -> DataFrame:
    moved = df.withColumns({"x1": F.col("x1") - left, "x2": F.col("x2") - left, "y1": F.col("y1") - top, "y2": F.col("y2") - top})
    return drop_degenerate(clip_boxes(moved, width, height))


def resize_boxes(df: DataFrame, ratio: Column) -> DataFrame:
    """Corners scaled as an image of (width, height) is whose sides are truncated after scaling."""
    sx, sy = ((F.col(s) * ratio).cast("long") / F.col(s) for s in ("width", "height"))
    return df.withColumns({"x1": F.col("x1") * sx, "y1": F.col("y1") * sy, "x2": F.col("x2") * sx, "y2": F.col("y2") * sy})


def scale_images(df: DataFrame, s: float) -> DataFrame:
    return df.withColumns({
        "width": F.ceil(F.col("width") * F.lit(s)).cast("long"), "height": F.ceil(F.col("height") * F.lit(s)).cast("long"),
        "file_name": F.concat(F.lit(f"scaled-{s}-"), F.col("file_name")),
    })


def confidence_band(df: DataFrame, low: float = 0.05, high: float = 0.5) -> DataFrame:
    return df.filter(F.col("score") >= low).withColumn("band", F.when(F.col("score") < high, "low").otherwise("high"))


def hflip_boxes(df: DataFrame, width: Column, flip: Column | bool = True) -> DataFrame:
    """Boxes mirrored in images of a width, where flip is true."""
    flipped = F.lit(flip) if isinstance(flip, bool) else flip
    return df.withColumns({"x1": F.when(flipped, width - F.col("x2")).otherwise(F.col("x1")), "x2": F.when(flipped, width - F.col("x1")).otherwise(F.col("x2"))})


def jitter_boxes(df: DataFrame, jitter: Column, width: int, height: int) -> DataFrame:
    """Boxes resized as their image (width, height) is that is made to fit a size, times jitter."""
    return resize_boxes(df, F.least(F.lit(float(height)) / F.col("height"), F.lit(float(width)) / F.col("width")) * jitter)


def crop_start(v1: Column, v2: Column, size: Column, crop: int, u: Column, buffer: int = 200) -> Column:
    """Where a crop starts that holds the stretch v1..v2 with a buffer, at the share u between the least and the most.

    0 where the crop is as large as the image; null where it is larger.
    """
    room = size - crop
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(0.999), v.cast("double") / room))
    least, most = inside(v2 - crop + buffer), inside(v1 - buffer)
    return F.when(room == 0, F.lit(0).cast("long")).when(room > 0, ((least + u * (most - least)) * room).cast("long"))


def box_crops(df: DataFrame, crop_w: int, crop_h: int, u: Column, *, buffer: int = 200) -> DataFrame:
    """df (x1, y1, x2, y2, and its image's width and height) with crop_left and crop_top of a crop that holds the box, and
    too_large where the crop is larger than the image; then both are null."""
    side = lambda a, b, size, crop: crop_start(F.col(a), F.col(b), F.col(size), crop, u, buffer)
    out = df.withColumns({"crop_left": side("x1", "x2", "width", crop_w), "crop_top": side("y1", "y2", "height", crop_h)})
    large = F.col("crop_left").isNull() | F.col("crop_top").isNull()
    return out.withColumn("too_large", large).withColumns({c: F.when(~F.col("too_large"), F.col(c)) for c in ("crop_left", "crop_top")})


def crop_plan(df: DataFrame, crop_w: int, crop_h: int, *, seed: int, spread: float | None = None, tries: int = 64) -> DataFrame:
    """A crop for each image that is large enough, at a place drawn from the image's id.

    Places are drawn evenly; with a spread, around the middle, as a normal deviate of so many times the room there is, drawn
    anew until it is inside (after so many tries in vain it is the middle). An image as large as the crop gets place 0.
    """

    def place(side: str, crop: int, salt: str) -> Column:
        room = F.greatest(F.col(side) - crop, F.lit(1))
        if spread is None:
            return F.floor(draw(seed, F.lit(salt), "image_id") * room)
        one = lambda k: F.sqrt(-2 * F.log(1 - draw(seed, F.lit(f"{salt}r"), "image_id", k))) * F.cos(2 * math.pi * draw(seed, F.lit(f"{salt}a"), "image_id", k))
        drawn = lambda k: F.floor(room * (0.5 + spread * one(k)))
        inside = lambda v: (v >= 0) & (v < room)
        # most need no more than the first few tries, and what follows in a coalesce is made only where all before is null
        first = [F.when(inside(drawn(F.lit(k))), drawn(F.lit(k))) for k in range(1, min(tries, 3) + 1)]
        rest = [F.get(F.filter(F.transform(F.sequence(F.lit(4), F.lit(tries)), drawn), inside), F.lit(0))] if tries > 3 else []
        return F.coalesce(*first, *rest, F.floor(room / 2))

    large = df.filter((F.col("width") >= crop_w) & (F.col("height") >= crop_h))
    return large.withColumns({"crop_top": place("height", crop_h, "t"), "crop_left": place("width", crop_w, "l")})


def iou_crop(df: DataFrame, trials: DataFrame, least: float) -> DataFrame:
    """Boxes of each image's first valid crop (image_id, k, cl, ct, cr, cb), shifted and clipped.

    A box counts if its centre is strictly inside; the crop is valid if one of these boxes overlaps it by at least least.
    """
    on = df.join(trials, "image_id")
    cx, cy = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")
    inside = on.filter((cx > 2 * F.col("cl")) & (cx < 2 * F.col("cr")) & (cy > 2 * F.col("ct")) & (cy < 2 * F.col("cb")))
    crop = [F.col("cl"), F.col("ct"), F.col("cr") - F.col("cl"), F.col("cb") - F.col("ct")]
    own = [F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")]
    by_crop, by_image = Window.partitionBy("image_id", "k"), Window.partitionBy("image_id")
    best = F.max(B.iou(own, crop)).over(by_crop)
    kept = inside.withColumn("best", best).filter(F.col("best") >= least).withColumn("first", F.min("k").over(by_image)).filter("k = first")
    out = kept.withColumns({"x1": F.col("x1") - F.col("cl"), "x2": F.col("x2") - F.col("cl"), "y1": F.col("y1") - F.col("ct"), "y2": F.col("y2") - F.col("ct")})
    return clip_boxes(out, F.col("cr") - F.col("cl"), F.col("cb") - F.col("ct"))


def _sides(a: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = a.select("image_id", "id", "x", "y", "w", "h")
    return tuple(cut.select("image_id", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "x", "y", "w", "h"))) for s in "ab")


def _touch() -> Column:
    c = F.col
    return (c("x_a") < c("x_b") + c("w_b")) & (c("x_b") < c("x_a") + c("w_a")) & (c("y_a") < c("y_b") + c("h_b")) & (c("y_b") < c("y_a") + c("h_a"))


def _pair_iou() -> Column:
    return B.iou(*([F.col(f"{c}_{s}") for c in "xywh"] for s in "ab"))


def self_pairs(df: DataFrame) -> DataFrame:
    """(image_id, id_a, id_b, iou) for every two boxes of an image that overlap, id_a below id_b."""
    a, b = _sides(df)
    on = a.join(b, "image_id").filter((F.col("id_a") < F.col("id_b")) & _touch())
    return on.select("image_id", "id_a", "id_b", _pair_iou().alias("iou"))


def self_pairs_grid(df: DataFrame, cell: int) -> DataFrame:
    """As self_pairs, for dense images: boxes meet in grid cells, and a pair counts in the cell of its overlap's corner."""
    a, b = _sides(df)

    def cells(side: DataFrame, s: str) -> DataFrame:
        span = lambda v, d: F.sequence(F.floor(F.col(f"{v}_{s}") / cell), F.floor((F.col(f"{v}_{s}") + F.col(f"{d}_{s}")) / cell))
        return side.withColumn("gx", F.explode(span("x", "w"))).withColumn("gy", F.explode(span("y", "h")))

    on = cells(a, "a").join(cells(b, "b"), ["image_id", "gx", "gy"]).filter((F.col("id_a") < F.col("id_b")) & _touch())
    corner = (F.floor(F.greatest("x_a", "x_b") / cell) == F.col("gx")) & (F.floor(F.greatest("y_a", "y_b") / cell) == F.col("gy"))
    return on.filter(corner).select("image_id", "id_a", "id_b", _pair_iou().alias("iou"))
