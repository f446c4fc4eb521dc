"""Track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import inference as I
from fieldlens.operators import tracking as T
from fieldlens.plans.registry import query

_W = "WINDOW w AS (PARTITION BY track_id ORDER BY obs_ind ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("track_velocity",
    "SELECT track_id, obs_ind, round(v_row_px, 6) AS v_row_px, round(v_col_px, 6) AS v_col_px, round(row_px + v_row_px, 6) AS next_row_px "
    "FROM (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (row_px - first_value(row_px) OVER w) / (count(*) OVER w - 1) ELSE 0 END AS v_row_px, "
    "CASE WHEN count(*) OVER w > 1 THEN (col_px - first_value(col_px) OVER w) / (count(*) OVER w - 1) ELSE 0 END AS v_col_px FROM fx_tracks "
    f"{_W})")
def velocity(t):
    return T.velocity(t.tracks, 5, ("row_px", "col_px")).select("track_id", "obs_ind", *(F.round(c, 6).alias(c) for c in ("v_row_px", "v_col_px", "next_row_px")))


@query("track_gaps",
    "SELECT track_id, obs_ind, gap, (sum(CASE WHEN gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY obs_ind ROWS UNBOUNDED "
    "PRECEDING))::bigint AS session FROM (SELECT *, obs_ind - lag(obs_ind) OVER (PARTITION BY track_id ORDER BY obs_ind) AS gap FROM fx_tracks)")
def gaps(t):
    return T.gaps(t.tracks, 400).select("track_id", "obs_ind", "gap", "session")


@query("tracks_from_results", "SELECT track_id, min(obs_ind) AS first_frame, max(obs_ind) AS last_frame, count(*) AS n FROM fx_tracks GROUP BY 1")
def spans(t):
    return T.track_spans(t.tracks)


def frames(t):
    """Detections by video, an image being a frame."""
    return t.detections.join(t.images.select("image_id", "video_id"), "image_id").withColumn("frame", F.floor(F.col("image_id") / 100))


@query("track_step")
def track_step(t):
    return T.track(frames(t), patience=3, overlap=0.3)


@query("track_slices")
def track_slices(t):
    """The same in slices: more tasks than videos."""
    return T.track_slices(frames(t), span=50, patience=3, overlap=0.3)


@query("apply_predictor", "SELECT image_id, image_id % 5 AS label, (image_id % 101) / 101.0::double AS score FROM fx_images")
def predictor(t):
    """With a stand-in for a model."""

    def make():
        return lambda f: f[["image_id"]].assign(label=f["image_id"] % 5, score=(f["image_id"] % 101) / 101.0)

    return T.apply_predictor(t.images.select("image_id"), make, "image_id long, label long, score double")


def _predicted(t):
    """By a stand-in for a model, on bytes that stand for images: those of one video are damaged, and one in eleven names is too long for it."""

    def decode(content):
        name = bytes(content).decode("ascii")
        if name.startswith("survey_7_"):
            raise ValueError("damaged")
        return int(name.rsplit("_", 1)[1].removesuffix(".JPG"))

    def make():
        def model(numbers):
            if any(n % 11 == 3 for n in numbers):
                raise MemoryError("too large")
            return [
                {"boxes": [[n % 97 + k, k, n % 97 + k + 10.0, 20.0 + k] for k in range(n % 4)], "labels": [1 + (n + k) % 6 for k in range(n % 4)], "scores": [(n * 7 + k * 31) % 101 / 101 for k in range(n % 4)]}
                for n in numbers
            ]

        return model

    return I.predict(t.images.select("image_id", "video_id", F.col("file_name").cast("binary").alias("content")), make, decode=decode, batch=8, keys=("image_id", "video_id"))


_N = "SELECT image_id, video_id, image_id AS n FROM fx_images WHERE video_id <> 7 AND image_id % 11 <> 3"


@query("predict_boxes",
    f"SELECT image_id, video_id, k AS place, (n % 97 + k)::double AS x1, k::double AS y1, (n % 97 + k + 10)::double AS x2, (20 + k)::double AS y2, 1 + (n + k) % 6 AS label, "
    f"round(((n * 7 + k * 31) % 101) / 101.0::double, 6) AS score FROM ({_N}) CROSS JOIN (SELECT unnest([0, 1, 2]::bigint[]) AS k) WHERE k < n % 4 AND (n * 7 + k * 31) % 101 >= 31")
def predicted_boxes(t):
    """Boxes of a score that is high enough."""
    return I.detections(_predicted(t), least_score=31 / 101).withColumn("score", F.round("score", 6))


@query("predict_failures",
    "SELECT CASE WHEN video_id = 7 THEN 'ValueError: damaged' ELSE 'MemoryError: too large' END AS error, count(*) AS n FROM fx_images WHERE video_id = 7 OR image_id % 11 = 3 GROUP BY 1")
def failures(t):
    return I.failed(_predicted(t)).groupBy("error").agg(F.count("*").alias("n"))


@query("segment_worker", "SELECT segment, count(*) AS n, round(sum(m02), 6) AS moved FROM fx_warps GROUP BY 1")
def worker(t):
    """What a segment's worker sums up, for all segments at once."""
    return t.warps.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("m02"), 6).alias("moved"))
