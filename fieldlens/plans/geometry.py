"""Camera and raster arithmetic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.operators.geo import segment_of
from fieldlens.plans.registry import query
from fieldlens.sources.shared import small


def matrix():
    return [F.col(f"p{r}{c}") for r in range(3) for c in range(4)]


_POINTS = (
    "SELECT t.obs_ind AS pid, c.*, t.col_px / 32.0::double AS wx, t.row_px / 48.0::double AS wy, (t.obs_ind % 7)::double AS wz FROM fx_tracks "
    "t JOIN fx_cameras c ON c.anchor_ind = t.obs_ind // 37"
)


def points(t):
    """Track points as world points, each with one of the cameras."""
    on = t.tracks.withColumn("camera", F.floor(F.col("obs_ind") / 37)).join(small(t.cameras), F.col("anchor_ind") == F.col("camera"))
    return on.select(
        F.col("obs_ind").alias("pid"), *t.cameras.columns, (F.col("col_px") / 32.0).alias("wx"), (F.col("row_px") / 48.0).alias("wy"),
        (F.col("obs_ind") % 7).cast("double").alias("wz"),
    )


_UV = (
    "(p00 * wx + p01 * wy + p02 * wz + p03) / nullif(p20 * wx + p21 * wy + p22 * wz + p23, 0) AS u, (p10 * wx + p11 * wy + p12 * wz + p13) "
    "/ nullif(p20 * wx + p21 * wy + p22 * wz + p23, 0) AS v"
)


@query("world_to_pixel", f"SELECT pid, round(u, 6) AS u, round(v, 6) AS v FROM (SELECT pid, {_UV} FROM ({_POINTS}))")
def world_to_pixel(t):
    u, v = G.world_to_pixel(matrix(), [F.col("wx"), F.col("wy"), F.col("wz")])
    return points(t).select("pid", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


_DEPTH = "p20 * wx + p21 * wy + p22 * wz + p23"
_BACK = "SELECT pid, u * mu - p03 AS a, v * mu - p13 AS b, mu - p23 AS c, p00, p11, p22, p02, p12 FROM (SELECT *, {} + 12.5 AS mu FROM (SELECT *, {} FROM ({})))".format(_DEPTH, _UV, _POINTS)


@query("ray_point",
    "SELECT pid, round((a - p02 * c / p22) / p00 + 3.5137, 3) + 0.0 AS rx, round((b - p12 * c / p22) / p11 - 2.2519, 3) + 0.0 AS ry, round(c "
    f"/ p22 + 0.1253, 3) + 0.0 AS rz FROM ({_BACK})")
def ray_point(t):
    """A world point to its pixel and, somewhat further off, back along the ray. The SQL solves the triangular matrix of the fixture by substitution."""
    at = points(t)
    u, v = G.world_to_pixel(matrix(), [F.col("wx"), F.col("wy"), F.col("wz")])
    p = matrix()
    mu = p[8] * F.col("wx") + p[9] * F.col("wy") + p[10] * F.col("wz") + p[11]
    inv = G.inverse3([p[4 * r + c] for r in range(3) for c in range(3)])
    back = G.ray_point(inv, [p[3], p[7], p[11]], u, v, mu + 12.5, (3.5137, -2.2519, 0.1253))
    return at.select("pid", *((F.round(b, 3) + 0.0).alias(n) for b, n in zip(back, ("rx", "ry", "rz"), strict=True)))


@query("utm_to_raster", "SELECT obs_ind, trunc((col_px - 100.0) / 2.5 * 2.0)::bigint AS xr, trunc((row_px - 50.0) / -2.5 * 2.0)::bigint AS yr FROM fx_tracks")
def utm_to_raster(t):
    return t.tracks.select("obs_ind", G.utm_to_raster(F.col("col_px"), 100, 2.5, 2).alias("xr"), G.utm_to_raster(F.col("row_px"), 50, -2.5, 2).alias("yr"))


@query("raster_to_utm", "SELECT xr, yr, xr * 2.5::double + 100.0 AS x_utm, yr * -2.5::double + 50.0 AS y_utm FROM fx_elevation")
def raster_to_utm(t):
    return t.elevation.select("xr", "yr", G.raster_to_utm(F.col("xr"), 100, 2.5).alias("x_utm"), G.raster_to_utm(F.col("yr"), 50, -2.5).alias("y_utm"))


@query("correct_pmatrix", "SELECT anchor_ind, step, p03 - m02 * 90.0 AS c0, p13 - m12 * 90.0 AS c1 FROM fx_cameras JOIN fx_warps ON segment = anchor_ind")
def correct(t):
    on = t.warps.join(small(t.cameras), F.col("segment") == F.col("anchor_ind"))
    return on.select("anchor_ind", "step", (F.col("p03") - F.col("m02") * 90.0).alias("c0"), (F.col("p13") - F.col("m12") * 90.0).alias("c1"))


@query("rotate_uv",
    "SELECT obs_ind, m00 * col_px + m01 * row_px AS ru, m10 * col_px + m11 * row_px AS rv FROM fx_tracks t JOIN (SELECT w.*, a.obs_ind "
    "+ w.step AS frame FROM fx_warps w JOIN fx_anchors a ON a.anchor_ind = w.segment) w ON w.frame = t.obs_ind")
def rotate(t):
    on = segment_of(t.tracks, t.anchors).join(small(t.warps), ["segment", "step"])
    return on.select(
        "obs_ind", (F.col("m00") * F.col("col_px") + F.col("m01") * F.col("row_px")).alias("ru"),
        (F.col("m10") * F.col("col_px") + F.col("m11") * F.col("row_px")).alias("rv"),
    )


@query("track_uv",
    "SELECT track_id, obs_ind, CASE WHEN obs_ind BETWEEN 10 AND 900 THEN col_px END AS u, CASE WHEN obs_ind BETWEEN 10 AND 900 THEN 480 "
    "- row_px END AS v FROM fx_tracks")
def track_uv(t):
    active = F.col("obs_ind").between(10, 900) & ~F.isnan("row_px") & ~F.isnan("col_px")
    return t.tracks.select("track_id", "obs_ind", F.when(active, F.col("col_px")).alias("u"), F.when(active, 480 - F.col("row_px")).alias("v"))


@query("track_active", "SELECT obs_ind, track_id FROM fx_tracks WHERE obs_ind BETWEEN 10 AND 900")
def track_active(t):
    return t.tracks.filter(F.col("obs_ind").between(10, 900)).select("obs_ind", "track_id")


@query("frame_index", "SELECT frame, least((frame - 3) // 2, 400) AS idx FROM fx_inliers WHERE frame >= 3")
def frame_index(t):
    return t.inliers.filter("frame >= 3").select("frame", F.least(F.floor((F.col("frame") - 3) / 2), F.lit(400)).alias("idx"))


_RING = "[{'x': x, 'y': y + id % 9}, {'x': x + w, 'y': y}, {'x': x + w - id % 7, 'y': y + h}, {'x': x + w // 2, 'y': y + h + id % 5}, {'x': x, 'y': y + h}]"
_CROSS = "list_sum(list_transform(range(1, 6), lambda i: ring[i].x * ring[i % 5 + 1].y - ring[i % 5 + 1].x * ring[i].y))"
_SIDE = "list_{}(list_transform(ring, lambda p: p.{}))"


@query("polygon_bounds_area",
    f"SELECT id, {_SIDE.format('min', 'x')} AS px, {_SIDE.format('min', 'y')} AS py, {_SIDE.format('max', 'x')} - {_SIDE.format('min', 'x')} "
    f"AS pw, {_SIDE.format('max', 'y')} - {_SIDE.format('min', 'y')} AS ph, abs({_CROSS})::double / 2 AS p_area FROM (SELECT id, {_RING} "
    "AS ring FROM fx_annotations)")
def polygon(t):
    """Of a ring of five corners about each box."""
    x, y, w, h, i = (F.col(c) for c in ("x", "y", "w", "h", "id"))
    corners = [(x, y + i % 9), (x + w, y), (x + w - i % 7, y + h), (x + F.floor(w / 2), y + h + i % 5), (x, y + h)]
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners])
    return t.annotations.select("id", *(c.alias(n) for c, n in zip(G.polygon_bounds_area(ring), ("px", "py", "pw", "ph", "p_area"), strict=True)))


@query("pseudo_anchor_inds",
    "SELECT image_id, i, (i * n // m)::bigint AS ind FROM (SELECT image_id, n, CASE WHEN n < 20 THEN n // 2 ELSE 10 END AS m FROM (SELECT "
    "image_id, 1 + image_id % 57 AS n FROM fx_images)), range(0, 10) r(i) WHERE i < m")
def pseudo_anchors(t):
    n = 1 + F.col("image_id") % 57
    return t.images.select("image_id", F.posexplode(G.spaced(n, F.lit(10))).alias("i", "ind")).withColumn("i", F.col("i").cast("long"))


@query("compose_warp",
    "SELECT a.segment, a.step, a.m00 * b.m00 + a.m01 * b.m10 AS c00, a.m00 * b.m01 + a.m01 * b.m11 AS c01, a.m00 * b.m02 + a.m01 * b.m12 "
    "+ a.m02 AS c02, a.m10 * b.m00 + a.m11 * b.m10 AS c10, a.m10 * b.m01 + a.m11 * b.m11 AS c11, a.m10 * b.m02 + a.m11 * b.m12 + a.m12 "
    "AS c12 FROM fx_warps a JOIN fx_warps b ON a.segment = b.segment AND b.step = a.step + 1")
def compose(t):
    names = ["m00", "m01", "m02", "m10", "m11", "m12"]
    a = t.warps.select("segment", "step", *(F.col(n).alias(f"a{n}") for n in names))
    b = t.warps.select("segment", (F.col("step") - 1).alias("step"), *(F.col(n).alias(f"b{n}") for n in names))
    out = G.compose([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])
    return a.join(b, ["segment", "step"]).select("segment", "step", *(c.alias(n.replace("m", "c")) for c, n in zip(out, names, strict=True)))
