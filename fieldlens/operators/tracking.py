"""Track operators: velocity, gaps, and linking of detections into tracks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.sources.shared import cut, small


def velocity(points: DataFrame, n: int, cols: tuple[str, ...]) -> DataFrame:
    """points with v_<col>, the mean step over the last n positions of the track, and the position expected next."""
    w = Window.partitionBy("track_id").orderBy("obs_ind").rowsBetween(-(n - 1), 0)
    steps = F.count("*").over(w) - 1
    out = points
    for c in cols:
        out = out.withColumn(f"v_{c}", F.when(steps > 0, (F.col(c) - F.first(c).over(w)) / steps).otherwise(0.0))
    return out.withColumns({f"next_{c}": F.col(c) + F.col(f"v_{c}") for c in cols})


def gaps(points: DataFrame, patience: int) -> DataFrame:
    """points with the frames since the track was last seen, and the number of its session; a longer gap starts a new one."""
    order = Window.partitionBy("track_id").orderBy("obs_ind")
    gap = F.col("obs_ind") - F.lag("obs_ind").over(order)
    broken = (F.coalesce(F.col("gap"), F.lit(0)) > patience).cast("long")
    return points.withColumn("gap", gap).withColumn("session", F.sum(broken).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def track_spans(points: DataFrame) -> DataFrame:
    return points.groupBy("track_id").agg(F.min("obs_ind").alias("first_frame"), F.max("obs_ind").alias("last_frame"), F.count("*").alias("n"))


class Tracker:
    """Tracks of one video, frame by frame.

    Boxes move on by their mean step; those left without area end. Each takes the free detection with the greatest overlap.
    Of tracks that then overlap by more than track_nms only the best by score goes on, the others count as unseen. Free
    detections that a track covers by more than overlap are dropped, and so are those that overlap a better one by more than
    new_nms; the rest begin tracks. A track ends after patience frames unseen.
    """

    def __init__(self, *, least_score: float = 0.5, overlap: float = 0.3, patience: int = 3, history: int = 3, track_nms: float = 0.6, new_nms: float = 0.3) -> None:
        self.least_score, self.overlap, self.patience, self.history = least_score, overlap, patience, history
        self.track_nms, self.new_nms = track_nms, new_nms
        self.tracks: dict[int, dict] = {}
        self.next_id = 0

    def step(self, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """(track, det_id, frame) of each detection that goes on with a track or begins one."""
        order = np.lexsort((ids, -scores))
        order = order[scores[order] > self.least_score]
        ids, boxes = ids[order], boxes[order]
        live = sorted(k for k, t in self.tracks.items() if frame - t["seen"] <= self.patience)
        self.tracks = {k: self.tracks[k] for k in live}
        moved = np.array([self._expected(self.tracks[k], frame) for k in live]).reshape(-1, 4)
        good = (moved[:, 2] > 0) & (moved[:, 3] > 0)
        for k in [k for k, g in zip(live, good, strict=True) if not g]:
            del self.tracks[k]
        live, moved = [k for k, g in zip(live, good, strict=True) if g], moved[good]
        over, names, plain = iou_table(moved, boxes), ids.tolist(), boxes.tolist()
        used, taker = {}, {}
        at = np.nonzero(over >= self.overlap)
        for _, _, _, a, b in sorted((-v, live[a], names[b], a, b) for v, a, b in zip(over[at].tolist(), at[0].tolist(), at[1].tolist(), strict=True)):
            if a not in used and b not in taker:
                used[a], taker[b] = b, a
        between = iou_table(boxes, boxes) if len(boxes) <= MOST_TOGETHER else None
        row = lambda b: iou_table(boxes[b : b + 1], boxes)[0] if between is None else between[b]
        # ids, boxes and scores are in order of falling scores, so the tracks are too, by the detections that they took
        best = suppressed(sorted(taker), row, len(boxes), self.track_nms)
        out = []
        for b in best:
            out.append((live[taker[b]], names[b], frame))
            self._see(live[taker[b]], frame, plain[b])
        covered = (over[[a for a in range(len(live)) if a not in used]] > self.overlap).any(0)
        for b in best:
            covered |= row(b) > self.overlap
        for b in suppressed([b for b, c in enumerate(covered.tolist()) if b not in taker and not c], row, len(boxes), self.new_nms):
            out.append((self.next_id, names[b], frame))
            self._see(self.next_id, frame, plain[b])
            self.next_id += 1
        return out

    def drop_ended(self, frame: int | None) -> None:
        """Forget the tracks that can't go on after a frame."""
        if frame is not None:
            self.tracks = {k: t for k, t in self.tracks.items() if frame + 1 - t["seen"] <= self.patience}

    def _expected(self, t: dict, frame: int) -> list[float]:
        (f0, b0), (f1, b1) = t["past"][0], t["past"][-1]
        return b1 if f1 == f0 else [q + (q - p) / (f1 - f0) * (frame - f1) for p, q in zip(b0, b1, strict=True)]

    def _see(self, k: int, frame: int, box: list[float]) -> None:
        t = self.tracks.setdefault(k, {"past": [], "seen": frame})
        t["past"] = [*t["past"], (frame, box)][-self.history :]
        t["seen"] = frame


#: Of so many boxes of a frame the overlaps with one another are made at once; of more, a box at a time.
MOST_TOGETHER = 1000


def suppressed(order: list[int], row: Callable[[int], np.ndarray], n: int, most: float) -> list[int]:
    """Of n boxes those of the order, best first, that overlap none kept before by more than most; row(b) has b's overlaps."""
    kept, blocked = [], np.zeros(n, bool)
    for b in order:
        if not blocked[b]:
            kept.append(b)
            blocked |= ~(row(b) <= most)
    return kept


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of each xywh box in a with each in b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(2)
    return shared / (a[:, 2:].prod(1)[:, None] + b[:, 2:].prod(1)[None, :] - shared)


def by_frame(f: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, ids, boxes, scores) of stretches of rows of equal keys."""
    at = [f[k].to_numpy() for k in keys]
    ids, boxes, scores = f["det_id"].to_numpy(), f[["x", "y", "w", "h"]].to_numpy(float), f["score"].to_numpy(float)
    edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in at])) + 1
    for a, b in pairwise([0, *edges.tolist(), len(f)] if len(f) else []):
        yield tuple(k[a].item() for k in at), ids[a:b], boxes[a:b], scores[a:b]


def track(dets: DataFrame, **options) -> DataFrame:
    """(video_id, track_id, det_id, frame) from dets (video_id, frame, det_id, x, y, w, h, score).

    Tracks depend on the frame before, so a video is gone through in one task, in order of frames; only its live tracks and
    the frame at hand are held. Videos run side by side. Track numbers count from 0 in each video.
    """

    def run(batches):
        video, tracker, held = None, None, None

        def frames(f: pd.DataFrame) -> pd.DataFrame:
            nonlocal video, tracker
            found = []
            for (v, frame), *own in by_frame(f, ["video_id", "frame"]):
                if v != video:
                    video, tracker = v, Tracker(**options)
                found += [(v, *x) for x in tracker.step(frame, *own)]
            return pd.DataFrame(found, columns=["video_id", "track_id", "det_id", "frame"])

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                last = (held["video_id"] == held["video_id"].iloc[-1]) & (held["frame"] == held["frame"].iloc[-1])
                yield frames(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield frames(held)

    rows = dets.select("video_id", "frame", "det_id", "x", "y", "w", "h", "score")
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame", "det_id").mapInPandas(run, "video_id long, track_id long, det_id long, frame long")


_SLICED = "video_id long, slice long, kind int, frame long, det_id long, x double, y double, w double, h double, score double, state string"
_FOUND = "video_id long, slice long, kind int, track_id long, det_id long, frame long, begin string, end string"


def _live(tracker: Tracker, frame: int) -> list[tuple]:
    """(number, frame last seen, past boxes) of the tracks that can go on at a frame, in order of numbers."""
    return [(k, int(t["seen"]), [(int(f), *map(float, b)) for f, b in t["past"]]) for k, t in sorted(tracker.tracks.items()) if frame - t["seen"] <= tracker.patience]


class _Slice:
    """One slice of a video: rows before it only warm the tracker up, unless the state that it begins with is given.

    From its first frame on, tracks that came in are numbered below 0 and those that begin here from 0.
    """

    def __init__(self, video: int, number: int, span: int, options: dict) -> None:
        self.key, self.start, self.end = (video, number), number * span, (number + 1) * span
        self.tracker, self.begin = Tracker(**options), None

    def given(self, state: str) -> None:
        self.enter([(k, seen, past) for k, (seen, past) in enumerate(json.loads(state))])

    def enter(self, live: list[tuple]) -> None:
        self.tracker.next_id = 0
        self.tracker.tracks = {k - len(live): {"seen": seen, "past": [(p[0], p[1:]) for p in past]} for k, (_, seen, past) in enumerate(live)}
        self.begin = json.dumps([x[1:] for x in live])

    def rows(self, kind: int, frame: int, own: list[np.ndarray]) -> list[tuple]:
        if kind == 2 and self.begin is None:
            self.enter(_live(self.tracker, self.start))
        if kind == 1 and self.begin is not None:
            return []
        found = self.tracker.step(frame, *own)
        return [(*self.key, 1, *x, None, None) for x in found] if kind == 2 else []

    def close(self) -> tuple:
        if self.begin is None:
            self.enter(_live(self.tracker, self.start))
        return (*self.key, 0, self.tracker.next_id, None, None, self.begin, json.dumps(_live(self.tracker, self.end)))


def track_slices(dets: DataFrame, *, span: int, warm: int = 8, **options) -> DataFrame:
    """As track, over slices of span frames that run side by side, so that a long video is no single task.

    A slice is begun from the warm frames before it. Where the state that this gives isn't the one that the slice before it
    ends with, the slice is run again from that one, until all agree: a state holds the tracks that may still go on, which
    few frames settle, so mostly one more round or none is needed, and at most as many as there are slices. States are small
    rows, a slice each. Tracks are numbered last: those that go on have the number of the slice before, and those that begin
    count on from all that began before.
    """
    rows = dets.select("video_id", F.floor(F.col("frame") / span).alias("slice"), F.lit(2).alias("kind"), "frame", "det_id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "score")), F.lit(None).cast("string").alias("state"))
    before = rows.withColumns({"slice": F.col("slice") + 1, "kind": F.lit(1)}).filter(F.col("frame") >= F.col("slice") * span - warm)
    every = cut(rows.unionByName(before.join(rows.select("video_id", "slice").distinct(), ["video_id", "slice"], "left_semi")), "track-slices")

    def run(batches):
        now, held = None, None

        def go(f: pd.DataFrame) -> pd.DataFrame:
            nonlocal now
            out = []
            states = iter(f["state"][f["kind"].to_numpy() == 0].tolist())
            for (v, n, kind, frame), *own in by_frame(f, ["video_id", "slice", "kind", "frame"]):
                if now is None or now.key != (v, n):
                    out += [now.close()] if now else []
                    now = _Slice(v, n, span, options)
                if kind == 0:
                    now.given(next(states))
                else:
                    out += now.rows(kind, frame, own)
            return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _FOUND.split(", ")])

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                end = held.iloc[-1]
                last = (held["video_id"] == end["video_id"]) & (held["slice"] == end["slice"]) & (held["kind"] == end["kind"]) & (held["frame"] == end["frame"])
                if not last.all():
                    yield go(held[~last])
                    held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield go(held)
        if now:
            yield pd.DataFrame([now.close()], columns=[c.split(" ")[0] for c in _FOUND.split(", ")])

    patience = Tracker(**options).patience

    def expected(f: pd.DataFrame):
        """For each slice of a video in order, the tracks that come in: (their numbers at the end of the slice before, state)."""
        ends: list = []
        for r in f.sort_values("slice").itertuples():
            live = [x for x in ends if r.slice * span - x[1] <= patience]
            yield r, [x[0] for x in live], json.dumps([x[1:] for x in live])
            ends = json.loads(r.end)

    def wrong(f: pd.DataFrame) -> pd.DataFrame:
        out = [(r.video_id, r.slice, 0, -1, -1, *[0.0] * 5, state) for r, _, state in expected(f) if r.begin != state]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _SLICED.split(", ")])

    def numbers(f: pd.DataFrame) -> pd.DataFrame:
        """(video_id, slice, local, track_id): of the tracks that came in, and at local 0 of the first that begins."""
        out, known, total = [], {}, 0
        for r, came, _ in expected(f):
            known = {k - len(came): known[x] if x < 0 else first + x for k, x in enumerate(came)}
            out += [(r.video_id, r.slice, k, n) for k, n in known.items()] + [(r.video_id, r.slice, 0, total)]
            first, total = total, total + r.track_id
        return pd.DataFrame(out, columns=["video_id", "slice", "local", "track_id"])

    def pass_(some: DataFrame) -> DataFrame:
        dealt = some.repartition("video_id", "slice").sortWithinPartitions("video_id", "slice", "kind", "frame", "det_id")
        return cut(dealt.mapInPandas(run, _FOUND), "track-pass")

    found = pass_(every)
    while True:
        bad = cut(found.filter("kind = 0").groupBy("video_id").applyInPandas(wrong, _SLICED), "track-wrong")
        if bad.isEmpty():
            break
        keys = bad.select("video_id", "slice")
        again = pass_(every.join(small(keys), ["video_id", "slice"], "left_semi").filter("kind = 2").unionByName(bad))
        found = cut(found.join(small(keys), ["video_id", "slice"], "left_anti").unionByName(again), "track-found")
    named = found.filter("kind = 0").groupBy("video_id").applyInPandas(numbers, "video_id long, slice long, local long, track_id long").withColumnRenamed("track_id", "number")
    tracks = found.filter("kind = 1").withColumn("local", F.least("track_id", F.lit(0)))
    on = tracks.join(named, ["video_id", "slice", "local"])
    return on.select("video_id", (F.col("number") + F.greatest("track_id", F.lit(0))).alias("track_id"), "det_id", "frame")


_models: dict = {}


def apply_predictor(images: DataFrame, make_model, schema: str) -> DataFrame:
    """Rows that a model makes of batches of images; make_model() gives a function from a frame to a frame, once a worker."""
    name = uuid.uuid4().hex

    def run(frames):
        if name not in _models:
            _models.clear()
            _models[name] = make_model()
        for f in frames:
            yield _models[name](f)

    return images.mapInPandas(run, schema)
