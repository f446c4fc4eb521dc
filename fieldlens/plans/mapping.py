"""Mapping queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fieldlens.operators import geo as O
from fieldlens.plans.registry import query
from fieldlens.sources.shared import cut

_SPANS = "SELECT anchor_ind, obs_ind AS start, coalesce(lead(obs_ind) OVER (ORDER BY obs_ind), obs_ind + 1) AS stop FROM fx_anchors"
_SEG = f"SELECT t.*, s.anchor_ind AS segment, t.obs_ind - s.start AS step FROM fx_tracks t JOIN ({_SPANS}) s ON t.obs_ind >= s.start AND t.obs_ind < s.stop"
_LAST = "s.segment = (SELECT max(anchor_ind) FROM fx_anchors)"
_IDENTITY = ", ".join(f"coalesce({n}, CASE WHEN {_LAST} THEN {v}::double END) AS {n}" for n, v in O.IDENTITY.items())
_WARPED = f"SELECT s.*, {_IDENTITY} FROM ({_SEG}) s LEFT JOIN fx_warps w ON w.segment = s.segment AND w.step = s.step"


@query("segment_interval", _SPANS)
def intervals(t):
    return O.segment_intervals(t.anchors)


@query("segment_asof", f"SELECT obs_ind, track_id, segment FROM ({_SEG})")
def asof(t):
    return O.segment_of(t.tracks, t.anchors).select("obs_ind", "track_id", "segment")


@query("segment_asof_large", f"SELECT obs_ind, track_id, segment FROM ({_SEG})")
def asof_large(t):
    return O.segment_of(t.tracks, t.anchors, broadcast_rows=0).select("obs_ind", "track_id", "segment")


@query("segment_step", f"SELECT obs_ind, step FROM ({_SEG})")
def step(t):
    return O.segment_of(t.tracks, t.anchors).select("obs_ind", "step")


@query("warp_lookup", f"SELECT obs_ind, segment, step, m00, m02, m12 FROM ({_WARPED})")
def warp(t):
    return O.with_warp(O.segment_of(t.tracks, t.anchors), t.warps, t.anchors).select("obs_ind", "segment", "step", "m00", "m02", "m12")


@query("last_warp", "SELECT segment, max(step) AS step, arg_max(m02, step) AS m02, arg_max(m12, step) AS m12 FROM fx_warps GROUP BY 1")
def last_warp(t):
    return O.last_warp(t.warps).select("segment", "step", "m02", "m12")


@query("fill_nodata", "SELECT xr, yr, CASE WHEN elev = -10000 THEN (SELECT min(elev) FROM fx_elevation WHERE elev <> -10000) ELSE elev END AS elev FROM fx_elevation")
def fill(t):
    return O.fill_nodata(t.elevation)


@query("elevation_lookup",
    "SELECT p.obs_ind, e.elev FROM (SELECT obs_ind, greatest(0, least(col_px::bigint // 20 - 2, (SELECT max(xr) FROM fx_elevation))) AS "
    "xr, greatest(0, least(row_px::bigint // 4, (SELECT max(yr) FROM fx_elevation))) AS yr FROM fx_tracks) p LEFT JOIN fx_elevation e USING "
    "(xr, yr)")
def elevation(t):
    points = t.tracks.select("obs_ind", (F.floor(F.col("col_px") / 20) - 2).alias("xr"), F.floor(F.col("row_px") / 4).alias("yr"))
    return O.elevation_at(points, t.elevation).select("obs_ind", "elev")


_GRID = (
    "SELECT x.k AS xr, y.k AS yr, (x.k + 0.5) * s.w / 31 - 0.5 AS sx, (y.k + 0.5) * s.h / 45 - 0.5 AS sy, s.* FROM range(0, 31) x(k), range(0, "
    "45) y(k), (SELECT (max(xr) + 1)::double AS w, (max(yr) + 1)::double AS h FROM fx_elevation) s"
)


@query("raster_resample",
    "SELECT xr, yr, round(sum(wt * e.elev), 5) AS elev FROM (SELECT xr, yr, greatest(0, least(floor(sx) + i.k, w - 1)) AS cx, greatest(0, "
    "least(floor(sy) + j.k, h - 1)) AS cy, (CASE WHEN i.k = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j.k = 1 THEN "
    f"sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS wt FROM ({_GRID}), range(0, 2) i(k), range(0, 2) j(k)) g JOIN (SELECT xr AS cx, yr "
    "AS cy, elev FROM fx_elevation) e USING (cx, cy) GROUP BY 1, 2")
def resample(t):
    return O.resample(t.elevation, 31, 45).select(F.col("xr").cast("long").alias("xr"), F.col("yr").cast("long").alias("yr"), F.round("elev", 5).alias("elev"))


@query("anchor_obs_index",
    "SELECT anchor_ind, f.obs_ind FROM fx_anchors a JOIN (SELECT event_id AS obs_ind, concat('frame_', event_id, '.jpg') AS name FROM events) "
    "f ON f.name = a.image_name QUALIFY f.obs_ind >= max(f.obs_ind) OVER (ORDER BY anchor_ind ROWS UNBOUNDED PRECEDING)")
def anchor_index(t):
    """The frame with an anchor's name, not before that of an earlier anchor; names are unique."""
    path = F.concat(F.lit("flight/frame_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    frames = t.events.select(F.lit(0).alias("observation_id"), F.col("event_id").alias("frame_ind"), path.alias("path"))
    return O.anchor_frames(t.anchors.select(F.lit(0).alias("observation_id"), "anchor_ind", "image_name"), frames).drop("observation_id")


_NAMED = (
    "SELECT anchor_ind % 4 AS o, anchor_ind, CASE WHEN anchor_ind % 3 = 0 THEN concat('_', (anchor_ind * 13) % 50, '.jp') ELSE concat('frame_', "
    "(anchor_ind * 13) % 50, '.jpg') END AS name FROM fx_anchors"
)
_PATHS = "SELECT event_id % 4 AS o, event_id AS f, concat('flight/frame_', event_id % 50, '.jpg') AS path FROM events"


@query(
    "anchor_obs_index_repeated",
    f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY anchor_ind) AS k FROM ({_NAMED})), p AS ({_PATHS}),
c AS (SELECT a.o, a.k, a.anchor_ind, list(p.f ORDER BY p.f) AS fs FROM a JOIN p ON p.o = a.o AND contains(p.path, a.name) GROUP BY 1, 2, 3),
s AS (SELECT o, k, anchor_ind, coalesce(fs, []::bigint[]) AS fs FROM a LEFT JOIN c USING (o, k, anchor_ind)),
r AS (SELECT o, k, anchor_ind, fs[1] AS hit, coalesce(fs[1], -1) AS reached FROM s WHERE k = 1
  UNION ALL SELECT s.o, s.k, s.anchor_ind, list_filter(s.fs, lambda f: f >= r.reached)[1], coalesce(list_filter(s.fs, lambda f: f >= r.reached)[1], r.reached) FROM r JOIN s ON s.o = r.o AND s.k = r.k + 1)
SELECT o AS observation_id, anchor_ind, hit AS obs_ind FROM r WHERE hit IS NOT NULL""",
)
def anchor_index_repeated(t):
    """With names that many frames have, some of which are but a part of the frame's name."""
    number = ((F.col("anchor_ind") * 13) % 50).cast("string")
    name = F.when(F.col("anchor_ind") % 3 == 0, F.concat(F.lit("_"), number, F.lit(".jp"))).otherwise(F.concat(F.lit("frame_"), number, F.lit(".jpg")))
    anchors = t.anchors.select((F.col("anchor_ind") % 4).alias("observation_id"), "anchor_ind", name.alias("image_name"))
    path = F.concat(F.lit("flight/frame_"), (F.col("event_id") % 50).cast("string"), F.lit(".jpg"))
    frames = t.events.select((F.col("event_id") % 4).alias("observation_id"), F.col("event_id").alias("frame_ind"), path.alias("path"))
    return O.anchor_frames(anchors, frames)


def _truth_sql(used: str) -> str:
    found = "coalesce(a.obs_ind, b.obs_ind, CASE WHEN g.frame = (SELECT max(frame) FROM g) THEN (SELECT most FROM n) END)"
    return (
        "WITH f AS (SELECT event_id AS obs_ind FROM events WHERE event_id % 5 <> 3), n AS (SELECT max(obs_ind) AS most FROM f), g AS (SELECT "
        f"image_id AS frame FROM fx_images WHERE {used}) SELECT g.frame, {found} AS obs_ind FROM g LEFT JOIN f a ON a.obs_ind = g.frame LEFT "
        f"JOIN f b ON b.obs_ind = g.frame - 2 WHERE {found} IS NOT NULL"
    )


def _truth_frames(t, for_test: bool):
    frames = t.events.filter(F.col("event_id") % 5 != 3).select(F.col("event_id").alias("obs_ind"))
    log = t.images.select(F.col("image_id").alias("frame"), (F.col("image_id") % 3 == 0).alias("used_in_map"), (F.col("image_id") % 6 == 0).alias("test_frame"))
    return O.truth_frames(log, frames, for_test=for_test)


@query("groundtruth_obs_index", _truth_sql("image_id % 3 = 0"))
def groundtruth_index(t):
    return _truth_frames(t, False)


@query("groundtruth_obs_index_test", _truth_sql("image_id % 3 = 0 AND image_id % 6 <> 0"))
def groundtruth_index_test(t):
    return _truth_frames(t, True)


@query("clean_anchors", "SELECT anchor_ind FROM fx_anchors WHERE image_name IN (SELECT image_name FROM fx_cameras WHERE anchor_ind % 3 <> 0)")
def clean_anchors(t):
    return O.clean_anchors(t.anchors, t.cameras.filter(F.col("anchor_ind") % 3 != 0)).select("anchor_ind")


_KNOWN = "(event_id <= (SELECT max(anchor_ind) FROM fx_anchors) AND event_id % 3 <> 0)"


@query("clean_flight_log", f"SELECT event_id, event_id % 2 = 0 AND {_KNOWN} AS used_in_map, event_id % 4 = 0 AND {_KNOWN} AS test_frame FROM events")
def clean_log(t):
    return _clean_log(t).drop("frame_name")


@query("flight_log_cleared", f"SELECT count(*) AS cleared FROM events WHERE (event_id % 2 = 0 OR event_id % 4 = 0) AND NOT {_KNOWN}")
def cleared(t):
    """How many frames the cleaning cleared, counted in its own pass."""
    seen = Observation()
    cut(_clean_log(t, seen=seen), "flight-log")
    return t.spark.createDataFrame([(seen.get["cleared"],)], "cleared long")


def _clean_log(t, **options):
    name = F.concat(F.lit("frame_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    log = t.events.select("event_id", name.alias("frame_name"), (F.col("event_id") % 2 == 0).alias("used_in_map"), (F.col("event_id") % 4 == 0).alias("test_frame"))
    return O.clean_flight_log(log, t.cameras.filter(F.col("anchor_ind") % 3 != 0), **options)


@query("frames_per_flight",
    "SELECT flight, n, coalesce(sum(n) OVER (ORDER BY flight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM "
    "(SELECT video_id AS flight, count(*) AS n FROM fx_images GROUP BY 1)")
def per_flight(t):
    return O.frames_per_flight(t.images, "video_id")


@query("mean_mu", "SELECT obs_ind % 1000 AS frame, coalesce(round(avg(CASE WHEN value > 300 THEN value END), 6), 0) AS mu FROM fx_tracks GROUP BY 1")
def mean_mu(t):
    return O.mean_mu(t.tracks, F.col("obs_ind") % 1000, F.when(F.col("value") > 300, F.col("value"))).withColumn("mu", F.round("mu", 6))


@query("inliers_per_segment",
    "SELECT segment, min(n_inliers) AS least, round(avg(n_inliers), 6) AS mean, count_if(n_inliers < 100)::bigint AS low, count_if(n_inliers "
    "< 100) > 10 AS over_limit FROM fx_warps GROUP BY 1")
def inliers(t):
    return O.inliers_per_segment(t.warps, 100, 10).withColumn("mean", F.round("mean", 6))


@query("low_inlier_frames", "SELECT video_id, frame FROM fx_inliers WHERE n_inliers < 100")
def low_inliers(t):
    return t.inliers.filter("n_inliers < 100").select("video_id", "frame")


_SEL = (
    "SELECT video_id, frame, low_no, CASE WHEN rn = 1 THEN 'anchor' WHEN n_inliers < 100 AND low_no % 11 = 0 THEN 'promotes_previous' WHEN "
    "n_inliers < 100 THEN 'pseudo' ELSE 'plain' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS "
    "rn, (sum(CASE WHEN n_inliers < 100 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING))::bigint "
    "AS low_no FROM fx_inliers)"
)


@query("anchor_selection", _SEL)
def selection(t):
    return O.anchor_selection(t.inliers, 100, 10).select("video_id", "frame", "low_no", "kind")


@query("anchor_list",
    f"WITH s AS ({_SEL}) SELECT video_id, frame FROM s WHERE kind = 'anchor' UNION ALL SELECT video_id, frame - 1 FROM s WHERE kind = 'promotes_previous' "
    "UNION ALL SELECT video_id, max(frame) + 1 FROM s GROUP BY 1")
def anchor_list(t):
    return O.anchor_list(O.anchor_selection(t.inliers, 100, 10))


@query("pseudo_anchor_usage", f"SELECT video_id, low_no // 11 AS anchor_no, count_if(kind = 'pseudo')::bigint AS pseudo FROM ({_SEL}) GROUP BY 1, 2")
def usage(t):
    return O.pseudo_usage(O.anchor_selection(t.inliers, 100, 10), 10)


@query("warp_chain",
    "WITH RECURSIVE c AS (SELECT segment, step, m00, m01, m02, m10, m11, m12 FROM fx_warps WHERE step = (SELECT min(step) FROM fx_warps) "
    "UNION ALL SELECT w.segment, w.step, c.m00 * w.m00 + c.m01 * w.m10, c.m00 * w.m01 + c.m01 * w.m11, c.m00 * w.m02 + c.m01 * w.m12 + "
    "c.m02, c.m10 * w.m00 + c.m11 * w.m10, c.m10 * w.m01 + c.m11 * w.m11, c.m10 * w.m02 + c.m11 * w.m12 + c.m12 FROM c JOIN fx_warps w "
    "ON w.segment = c.segment AND w.step = c.step + 1) SELECT segment, step, m00 AS c00, m01 AS c01, m02 AS c02, m10 AS c10, m11 AS c11, "
    "m12 AS c12 FROM c")
def chain(t):
    return O.warp_chain(t.warps)


GUESS = 30.0
GEO = {"x_origin": 499990.137, "pixel_width": 1.7, "y_origin": 4100011.31, "pixel_height": -0.53, "offset": (500000.0, 4100000.0, 5.0371)}


def raster(t) -> O.Raster:
    return O.Raster(O.fill_nodata(t.elevation), **GEO)


def _rays(t):
    return O.track_rays(t.tracks, t.anchors, t.warps, t.cameras.drop("image_name"), GUESS)


_P = [f"p{r}{c}" for r in range(3) for c in range(3)]
_COFACTORS = (
    "p11*p22-p12*p21", "p02*p21-p01*p22", "p01*p12-p02*p11", "p12*p20-p10*p22", "p00*p22-p02*p20", "p02*p10-p00*p12", "p10*p21-p11*p20",
    "p01*p20-p00*p21", "p00*p11-p01*p10",
)
_DET = "p00*(p11*p22-p12*p21) - p01*(p10*p22-p12*p20) + p02*(p10*p21-p11*p20)"
_INVERSE = ", ".join(f"({c}) / ({_DET}) AS i{k // 3}{k % 3}" for k, c in enumerate(_COFACTORS))
_CELLS = (
    "filled AS (SELECT xr, yr, CASE WHEN elev = -10000 THEN (SELECT min(elev) FROM fx_elevation WHERE elev <> -10000) ELSE elev END AS "
    "elev FROM fx_elevation), ends AS (SELECT max(xr) AS mx, max(yr) AS my, min(elev) AS least FROM filled)"
)


def _ray_sql(points: str, camera: str) -> str:
    """Rays of points (key columns, row_px, col_px, m00 .. m12, mu0) by the camera of an expression."""
    turned = "m00*col_px + m01*(480 - row_px) AS u, m10*col_px + m11*(480 - row_px) AS v"
    return (
        f"SELECT p.*, {turned}, {_INVERSE}, p03 - m02*mu0 AS q0, p13 - m12*mu0 AS q1, p23 AS q2 FROM ({points}) p JOIN (SELECT * EXCLUDE (image_name) "
        f"FROM fx_cameras) c ON c.anchor_ind = {camera}"
    )


def _search_sql(name: str, rays: str, key: str) -> str:
    """CTEs that end in {name}, the rays' last looks: key, mu, gx, gy, found, elev. A row of {name}_s is a look."""
    x, y, z = (f"(i{k}0*(u*mu - q0) + i{k}1*(v*mu - q1) + i{k}2*(mu - q2) + {GEO['offset'][k]}::double)" for k in range(3))
    at = (
        f"greatest(0, least(trunc(({x} - {GEO['x_origin']}::double) / {GEO['pixel_width']}::double)::bigint, mx)) AS xr, greatest(0, least(trunc(({y} "
        f"- {GEO['y_origin']}::double) / {GEO['pixel_height']}::double)::bigint, my)) AS yr, {z} AS z"
    )
    look = lambda source: f"SELECT {key}, mu, low, high, n, xr, yr, coalesce(elev, least) AS elev, z + 1.0 - coalesce(elev, least) AS gap FROM (SELECT *, {at} FROM ({source}), ends) LEFT JOIN filled USING (xr, yr)"
    on = " AND ".join(f"r.{k} = s.{k}" for k in key.split(", "))
    first = f"SELECT r.*, mu0 AS mu, 0.0::double AS low, NULL::double AS high, 0 AS n FROM {name}_r r"
    moved = (
        "CASE WHEN gap > 0 AND s.high IS NULL THEN s.mu * 2 WHEN gap > 0 THEN (s.mu + s.high) / 2 ELSE (s.low + s.mu) / 2 END AS mu, CASE WHEN "
        "gap > 0 THEN s.mu ELSE s.low END AS low, CASE WHEN gap > 0 THEN s.high ELSE s.mu END AS high, s.n + 1 AS n"
    )
    then = f"SELECT r.*, {moved} FROM {name}_s s JOIN {name}_r r ON {on} WHERE s.n <= 50 AND abs(gap) > 0.1"
    place = f"xr * {GEO['pixel_width']}::double + {GEO['x_origin']}::double AS gx, yr * {GEO['pixel_height']}::double + {GEO['y_origin']}::double AS gy"
    last = f"SELECT {key}, mu, {place}, n <= 50 AND abs(gap) <= 0.1 AS found, elev FROM {name}_s QUALIFY n = max(n) OVER (PARTITION BY {key})"
    return f"{name}_r AS ({rays}), {name}_s AS ({look(first)} UNION ALL {look(then)}), {name} AS ({last})"


_GROUND = f"WITH RECURSIVE {_CELLS}, {_search_sql('g', _ray_sql(f'SELECT *, {GUESS}::double AS mu0 FROM ({_WARPED}) WHERE m00 IS NOT NULL', 'p.segment'), 'obs_ind, track_id, segment, step')}"
_FOUND = "SELECT obs_ind, track_id, segment, round(gx, 4) AS gx, round(gy, 4) AS gy, found, round(mu, 6) AS mu, elev AS elevation FROM g"


def _places(df):
    return df.select("obs_ind", "track_id", "segment", F.round("gx", 4).alias("gx"), F.round("gy", 4).alias("gy"), "found", F.round("mu", 6).alias("mu"), "elevation")


@query("ray_ground_search", f"{_GROUND} {_FOUND}")
def ground(t):
    return _places(O.ground_points(_rays(t), raster(t)))


@query("ray_ground_search_tiled", f"{_GROUND} {_FOUND}")
def ground_tiled(t):
    """The same with a raster that stays in tiles."""
    return _places(O.ground_points(_rays(t), raster(t), limit_cells=0, tile=16))


@query("position_utm", f"{_GROUND} SELECT obs_ind, track_id, round(gx, 4) AS x, round(gy, 4) AS y FROM g WHERE found")
def position(t):
    """The places of all tracks, without the correction of segments."""
    got = O.ground_points(_rays(t), raster(t))
    return got.filter("found").select("obs_ind", "track_id", F.round("gx", 4).alias("x"), F.round("gy", 4).alias("y"))


_ENDS = (
    "SELECT segment, arg_max(m00, step) AS m00, arg_max(m01, step) AS m01, arg_max(m02, step) AS m02, arg_max(m10, step) AS m10, arg_max(m11, "
    "step) AS m11, arg_max(m12, step) AS m12 FROM fx_warps GROUP BY 1"
)
_JUMP = "SELECT t.track_id, t.row_px, t.col_px, a.anchor_ind - 1 AS segment FROM fx_tracks t JOIN fx_anchors a USING (obs_ind) WHERE a.anchor_ind > 0"
_OLD = f"SELECT j.*, e.* EXCLUDE (segment) FROM ({_JUMP}) j JOIN ({_ENDS}) e USING (segment)"
_AHEAD = (
    f"SELECT j.*, {', '.join(f'coalesce(w.{n}, {v}::double) AS {n}' for n, v in O.IDENTITY.items())} FROM ({_JUMP}) j LEFT JOIN fx_warps "
    "w ON w.segment = j.segment + 1 AND w.step = 0"
)
_SEEDED = "SELECT p.*, d.mu0 FROM ({}) p JOIN (SELECT segment, avg(mu) AS mu0 FROM {} GROUP BY 1) d USING (segment)"
_JUMPS = ", ".join(
    [
        _search_sql("e1", _ray_sql(f"SELECT *, {GUESS}::double AS mu0 FROM ({_OLD})", "p.segment"), "segment, track_id"),
        _search_sql("e2", _ray_sql(_SEEDED.format(_OLD, "e1"), "p.segment"), "segment, track_id"),
        _search_sql("e3", _ray_sql(_SEEDED.format(_AHEAD, "e2"), "p.segment + 1"), "segment, track_id"),
        "errors AS (SELECT segment, track_id, e3.gx - e2.gx AS ex, e3.gy - e2.gy AS ey FROM e2 JOIN e3 USING (segment, track_id))",
        'biases AS (SELECT segment, track_id, ex / n AS bx, ey / n AS "by" FROM errors JOIN (SELECT segment, count(*) AS n FROM fx_warps GROUP BY 1) USING (segment) WHERE segment < (SELECT max(segment) FROM fx_warps))',
    ]
)


def _errors(t, ready=None):
    return O.segment_errors(t.tracks, t.anchors, t.warps, t.cameras.drop("image_name"), ready or raster(t), GUESS)


@query("segment_error", f"WITH RECURSIVE {_CELLS}, {_JUMPS} SELECT segment, track_id, round(ex, 4) + 0.0 AS ex, round(ey, 4) + 0.0 AS ey FROM errors")
def segment_error(t):
    return _errors(t).select("segment", "track_id", *((F.round(c, 4) + 0.0).alias(c) for c in ("ex", "ey")))


@query("step_bias", f'WITH RECURSIVE {_CELLS}, {_JUMPS} SELECT segment, track_id, round(bx, 6) + 0.0 AS bx, round("by", 6) + 0.0 AS "by" FROM biases')
def step_bias(t):
    return O.step_biases(_errors(t), t.warps).select("segment", "track_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("bx", "by")))


@query("tracks_to_utm",
    f'{_GROUND}, {_JUMPS} SELECT track_id, obs_ind, found, round(gx + coalesce(bx, 0) * step, 4) AS x, round(gy + coalesce("by", 0) * step, '
    '4) AS y FROM g LEFT JOIN biases USING (segment, track_id)')
def tracks_to_utm(t):
    """Every track point on the map, with its steps' share of the jump to the next anchor."""
    ready = O.pyramid(raster(t))  # made ready once for four searches
    got = O.with_bias(O.ground_points(_rays(t), ready), O.step_biases(_errors(t, ready), t.warps))
    return got.select("track_id", "obs_ind", "found", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _carry_sql() -> str:
    """Looks of each observation's rays, one ray after the other: where a ray is done, the next begins from its depth."""
    rays = _ray_sql(f"SELECT *, {GUESS}::double AS mu0 FROM ({_WARPED}) WHERE m00 IS NOT NULL", "p.segment").replace("p.*", "track_id, obs_ind, observation_id, p03, p13, m02, m12")
    x, y, z = (f"(i{k}0*(u*mu - (p03 - m02*mu0)) + i{k}1*(v*mu - (p13 - m12*mu0)) + i{k}2*(mu - q2) + {GEO['offset'][k]}::double)" for k in range(3))
    at = (
        f"greatest(0, least(trunc(({x} - {GEO['x_origin']}::double) / {GEO['pixel_width']}::double)::bigint, mx)) AS xr, greatest(0, least(trunc(({y} "
        f"- {GEO['y_origin']}::double) / {GEO['pixel_height']}::double)::bigint, my)) AS yr, {z} AS z"
    )
    look = lambda source: f"SELECT observation_id, k, mu0, mu, low, high, n, xr, yr, z + 1.0 - coalesce(elev, least) AS gap FROM (SELECT *, {at} FROM ({source}), ends) LEFT JOIN filled USING (xr, yr)"
    first = f"SELECT r.*, {GUESS}::double AS mu0, {GUESS}::double AS mu, 0.0::double AS low, NULL::double AS high, 0 AS n FROM r WHERE k = 1"
    over = "n > 50 OR abs(gap) <= 0.1"
    moved = (
        f"observation_id, CASE WHEN {over} THEN k + 1 ELSE k END AS k, CASE WHEN {over} THEN mu ELSE mu0 END AS mu0, CASE WHEN {over} THEN mu WHEN gap > 0 AND high IS NULL "
        f"THEN mu * 2 WHEN gap > 0 THEN (mu + high) / 2 ELSE (low + mu) / 2 END AS mu, CASE WHEN {over} THEN 0.0 WHEN gap > 0 THEN mu ELSE low END AS low, CASE WHEN {over} "
        f"THEN NULL WHEN gap > 0 THEN high ELSE mu END AS high, CASE WHEN {over} THEN 0 ELSE n + 1 END AS n"
    )
    then = f"SELECT r.*, m.mu0, m.mu, m.low, m.high, m.n FROM (SELECT {moved} FROM looks) m JOIN r USING (observation_id, k)"
    return (
        f"WITH RECURSIVE {_CELLS}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY obs_ind) AS k FROM ({rays})), looks AS ({look(first)} "
        f"UNION ALL {look(then)}) SELECT track_id, obs_ind, n <= 50 AS found, round(xr * {GEO['pixel_width']}::double + {GEO['x_origin']}::double, 4) AS x, round(yr * "
        f"{GEO['pixel_height']}::double + {GEO['y_origin']}::double, 4) AS y, round(mu, 6) AS mu FROM looks JOIN r USING (observation_id, k) WHERE {over}"
    )


@query("tracks_to_utm_carry", _carry_sql())
def tracks_to_utm_carry(t):
    """With the depth carried from frame to frame; the frames of the fixture hold a point each."""
    got = O.ground_points_carried(_rays(t), raster(t))
    return got.select("track_id", "obs_ind", "found", F.round("gx", 4).alias("x"), F.round("gy", 4).alias("y"), F.round("mu", 6).alias("mu"))
