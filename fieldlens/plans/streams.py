"""Streaming queries: the tables are streamed from files in the shared folder until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import geo as O
from fieldlens.plans.mapping import _GROUND, _SEL, GUESS, raster
from fieldlens.plans.registry import query
from fieldlens.plans.tracking import frames
from fieldlens.streaming import operators as X


@query("stream_detections", "SELECT det_id, name, score FROM fx_detections JOIN fx_categories USING (category_id) WHERE score >= 0.5")
def detections(t):
    stream = X.source(t.spark, t.detections, "detections", files=4)
    return X.drained(X.detections(stream, t.categories, 0.5).select("det_id", "name", "score"), "detections")


def _timed(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _start(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


_RATE = (
    "SELECT s AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '10 minutes', ts) AS s, event_type FROM events) GROUP "
    "BY s, event_type HAVING s + INTERVAL '10 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"
)


@query("stream_frame_rate", _RATE)
def rate(t):
    return _start(X.drained(X.frame_rate(X.source(t.spark, _timed(t), "rate"), "event_type"), "rate"))


@query("stream_frame_rate_sliding",
    "SELECT s AS start, event_type, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', "
    "ts) - INTERVAL '5 minutes']) AS s, event_type FROM events) GROUP BY ALL HAVING s + INTERVAL '10 minutes' <= (SELECT max(ts) - INTERVAL "
    "'10 minutes' FROM events)")
def sliding(t):
    return _start(X.drained(X.frame_rate(X.source(t.spark, _timed(t), "sliding"), "event_type", slide="5 minutes"), "sliding"))


@query("stream_gap_sessions",
    "WITH e AS (SELECT user_id AS track_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), s AS (SELECT track_id, "
    "ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL '2 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY ts ROWS "
    "UNBOUNDED PRECEDING) AS k FROM e) SELECT track_id, min(ts) AS start, count(*) AS n FROM s GROUP BY track_id, k HAVING max(ts) + INTERVAL "
    "'2 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def sessions(t):
    rows = _timed(t).select(F.col("user_id").alias("track_id"), "ts")
    return _start(X.drained(X.gap_sessions(X.source(t.spark, rows, "sessions"), "2 hours"), "sessions"))


def timed(rows):
    """Frames with a time of their own, a second each. Event time has to lie after 1970, where a stream's watermark begins."""
    return rows.withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_700_000_000))


def closing(rows):
    """A row of video -1, an hour after the last: once time allowed for late rows (less than that) is over, all others are handled."""
    last = rows.agg((F.max("ts") + F.expr("interval 1 hour")).alias("ts"))
    return last.select(*(F.col("ts") if c.name == "ts" else F.lit(-1 if c.name == "video_id" else None).cast(c.dataType).alias(c.name) for c in rows.schema))


@query("stream_tracker")
def tracker(t):
    rows = timed(frames(t)).select("video_id", "frame", "det_id", "x", "y", "w", "h", "score", "ts")
    return X.drained(X.tracker(X.source(t.spark, rows, "tracker", closing=closing(rows)), patience=3, overlap=0.3), "tracker")


@query("stream_anchor_monitor", f"SELECT * FROM ({_SEL}) WHERE kind <> 'plain'")
def monitor(t):
    rows = timed(t.inliers)
    return X.drained(X.anchor_monitor(X.source(t.spark, rows, "monitor", closing=closing(rows)), 100, 10), "monitor")


@query("stream_to_utm", f"{_GROUND} SELECT track_id, obs_ind, segment, round(gx, 4) AS gx, round(gy, 4) AS gy, found FROM g")
def to_utm(t):
    stream = X.source(t.spark, t.tracks.select("track_id", "obs_ind", "row_px", "col_px"), "utm", files=4)
    got = O.ground_points(O.track_rays(stream, t.anchors, t.warps, t.cameras.drop("image_name"), GUESS), raster(t))
    return X.drained(got.select("track_id", "obs_ind", "segment", F.round("gx", 4).alias("gx"), F.round("gy", 4).alias("gy"), "found"), "utm")
