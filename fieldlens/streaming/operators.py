"""Streaming forms of the detection and track operators.

Each takes a streaming DataFrame and gives one. Rows older than the watermark are late and dropped; Spark counts them, and
late_rows tells how many. Outputs are appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldlens.operators.tracking import Tracker
from fieldlens.sources.shared import shared_dir


def detections(stream: DataFrame, categories: DataFrame, least: float) -> DataFrame:
    """Detections of at least a score, with their class's name."""
    return stream.filter(F.col("score") >= least).join(F.broadcast(categories), "category_id")


def frame_rate(stream: DataFrame, by: str, *, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, n): rows in each closed window; windows slide if slide is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def gap_sessions(stream: DataFrame, gap: str, *, late: str = "10 minutes") -> DataFrame:
    """(track_id, start, n) of each closed session; one ends when its track isn't seen for the gap."""
    w = F.session_window("ts", gap).alias("w")
    return stream.withWatermark("ts", late).groupBy(w, "track_id").agg(F.count("*").alias("n")).select("track_id", F.col("w.start").alias("start"), "n")


class InOrder(StatefulProcessor):
    """Rows of a key handled in order, whatever the order in which they come; for a watermark on ts, which rises with frames.

    Rows wait in map state until the watermark has passed them, so the state holds those of the time that late rows are
    allowed. They lie in parts of a stretch of time, each of some rows' bytes. A stretch is stretch_ms long; rows that lie far
    apart go into longer ones (each step finer times as long), so that no more than most_stretches parts are written for
    rows_held rows, and long ones are dealt into shorter ones once their time has come, if they hold more than rows_held rows.
    So each row is written a few times, however long the time that a batch spans, and a task holds about rows_held rows, or
    those of stretch_ms, however many rows a batch has. An event-time timer stands at the first of them; when it fires, those
    passed go to handle in order of time. When none is left, a timer stands at the last row's time plus idle: if no row has
    come until then, all of the key's state is removed. Rows after a longer time than idle begin anew, whatever the batches.
    What comes too late is dropped and counted by Spark.

    Columns are longs and doubles; each travels by itself, so 64-bit ids stay exact. The first is the frame; a frame's rows that
    have passed are handled together. Subclasses give columns, handle and the state that is their own.
    """

    columns: tuple[tuple[str, str], ...]
    output: str
    stretch_ms, finer, most_stretches, rows_held = 60_000, 8, 64, 100_000

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms
        self.kinds = np.dtype([(n, {"long": "<i8", "double": "<f8"}[kind]) for n, kind in (*self.columns, ("at", "long"))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_ = handle
        self.parts = handle.getMapState("parts", "width long, stretch long, part long", "rows binary")
        self.counts = handle.getMapState("counts", "width long, stretch long", "parts long, rows long, first long")
        self.clock = handle.getValueState("clock", "wake long, last long, done long")
        self.own_states(handle)

    def _put(self, rows: np.ndarray, counts: dict, width: int | None = None) -> None:
        """Adds rows as a part of each stretch that they lie in."""
        rows = rows[np.argsort(rows["at"], kind="stable")]
        width, at = width or self.stretch_ms, rows["at"]
        while np.count_nonzero(np.diff(at // width)) >= self.most_stretches:
            width *= self.finer
        edges = np.flatnonzero(np.diff(at // width)) + 1
        for a, b in pairwise([0, *edges.tolist(), len(rows)] if len(rows) else []):
            stretch, first = (width, int(at[a]) // width), int(at[a])
            parts, n, before = counts.get(stretch, (0, 0, first))
            self.parts.updateValue((*stretch, parts), (rows[a:b].tobytes(),))
            counts[stretch] = (parts + 1, n + b - a, min(first, before))

    def _take(self, stretch: tuple[int, int], counts: dict) -> Iterator[np.ndarray]:
        """The parts of a stretch, which are removed."""
        for k in range(counts.pop(stretch)[0]):
            (rows,) = self.parts.getValue((*stretch, k))
            self.parts.removeKey((*stretch, k))
            yield np.frombuffer(bytes(rows), self.kinds)

    def _deal(self, stretch: tuple[int, int], counts: dict) -> set[tuple[int, int]]:
        """The shorter stretches, of those that weren't there, that a stretch's rows go into."""
        known, held = set(counts), []
        for rows in self._take(stretch, counts):
            held.append(rows)
            if sum(map(len, held)) >= self.rows_held:
                self._put(np.concatenate(held), counts, stretch[0] // self.finer)
                held = []
        if held:
            self._put(np.concatenate(held), counts, stretch[0] // self.finer)
        return set(counts) - known

    def _counts(self) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Of each stretch the number of parts and of rows, and the first row's time."""
        return {tuple(k): tuple(v) for k, v in self.counts.iterator()}

    def _save(self, counts: dict, before: dict) -> None:
        for k in before.keys() - counts.keys():
            self.counts.removeKey(k)
        for k, v in counts.items():
            if before.get(k) != v:
                self.counts.updateValue(k, v)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        wake, last, done = self.clock.get() or (None, None, None)
        before, held = self._counts(), []
        counts = dict(before)
        for f in rows:
            f = f[f["whole"]]
            if not len(f):
                continue
            own = np.empty(len(f), self.kinds)
            for n in self.kinds.names[:-1]:
                own[n] = f[n].astype(self.kinds[n]).to_numpy()
            own["at"] = f["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
            held.append(own)
            if sum(map(len, held)) >= self.rows_held:
                self._put(np.concatenate(held), counts)
                held = []
            first, latest = int(own["at"].min()), int(own["at"].max())
            if wake is None or wake == last + self.idle_ms + 1 or first < wake:
                if wake is not None:
                    self.handle_.deleteTimer(wake)
                self.handle_.registerTimer(first)
                wake = first
            last = latest if last is None else max(last, latest)
        if held:
            self._put(np.concatenate(held), counts)
        self._save(counts, before)
        if wake is not None:
            self.clock.update((wake, last, done))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed, (_, last, done) = timerValues.getCurrentWatermarkInMs(), self.clock.get()
        before = self._counts()
        if not before and last + self.idle_ms < passed:
            self.forget()
            self.clock.clear()
            return
        counts, held = dict(before), np.empty(0, self.kinds)
        place = lambda stretch: (stretch[0] * stretch[1], -stretch[0])
        coming = [place(k) for k in counts if place(k)[0] <= passed]
        heapify(coming)
        while coming:
            begin, width = heappop(coming)
            stretch = (-width, begin // -width)
            if stretch[0] > self.stretch_ms and counts[stretch][1] > self.rows_held:
                for k in self._deal(stretch, counts):
                    if place(k)[0] <= passed:
                        heappush(coming, place(k))
                continue
            held = np.concatenate([held, *self._take(stretch, counts)])
            held = held[np.lexsort([held[n] for n in (*self.kinds.names[1::-1], "at")])]
            end = int(np.searchsorted(held["at"], min(coming[0][0], passed + 1) if coming else passed + 1))
            if coming and end:  # the last frame may go on in the next stretch
                frame = held[self.kinds.names[0]][:end]
                end = int(np.append(np.flatnonzero(frame != frame[-1]) + 1, 0).max())
            if not end:
                continue
            ready, held = held[:end], held[end:]
            found, start, at = [], 0, ready["at"]
            for k in np.flatnonzero(np.diff(at, prepend=at[0] if done is None else done) > self.idle_ms).tolist():  # what is idle ends, whether or not a batch ended meanwhile
                found += self.handle(ready[start:k]) if k > start else []
                self.forget()
                start = k
            found += self.handle(ready[start:])
            done = int(at[-1])
            if found:
                yield pd.DataFrame([(key[0], *x) for x in found], columns=[c.split(" ")[0] for c in self.output.split(", ")])
        self._put(held, counts)
        self._save(counts, before)
        wake = min((first for _, _, first in counts.values()), default=last + self.idle_ms + 1)
        self.handle_.registerTimer(wake)
        self.clock.update((wake, last, done))

    def own_states(self, handle: StatefulProcessorHandle) -> None:
        """Get the states that are the subclass's own."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clear them."""
        raise NotImplementedError

    def handle(self, rows: np.ndarray) -> list[tuple]:
        """Output rows, without the key, of rows in order (an array with the columns as fields)."""
        raise NotImplementedError


def in_order(stream: DataFrame, processor: InOrder, *, key: str, late: str) -> DataFrame:
    """A processor over the rows of each key. Rows without a frame or id (columns of longs) only move time on.

    Longs are sent without nulls, for pandas would make floats of a column with some.
    """
    longs = [n for n, kind in processor.columns if kind == "long"]
    whole = F.lit(True)
    for n in longs:
        whole &= F.col(n).isNotNull()
    typed = [F.coalesce(F.col(n).cast(kind), F.lit(0)).alias(n) if n in longs else F.col(n).cast(kind) for n, kind in processor.columns]
    rows = stream.withWatermark("ts", late).select(key, *typed, whole.alias("whole"), "ts")
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.output, "append", "EventTime")


class TrackProcessor(InOrder):
    """Tracks of a video: the next number as a value, live tracks in a map by their number."""

    columns = (("frame", "long"), ("det_id", "long"), *((c, "double") for c in ("x", "y", "w", "h", "score")))
    output = "video_id long, track_id long, det_id long, frame long"

    def __init__(self, idle_ms: int, options: dict) -> None:
        super().__init__(idle_ms)
        self.options = options

    def own_states(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "track_id long")
        self.tracks = handle.getMapState("tracks", "track_id long", "seen long, past array<struct<frame:long,x:double,y:double,w:double,h:double>>")

    def forget(self) -> None:
        self.next.clear()
        self.tracks.clear()

    def handle(self, rows: np.ndarray) -> list[tuple]:
        machine = Tracker(**self.options)
        machine.next_id = (self.next.get() or (0,))[0]
        before = {k[0]: {"seen": v[0], "past": [(p[0], list(p[1:])) for p in v[1]]} for k, v in self.tracks.iterator()}
        machine.tracks = {k: dict(t) for k, t in before.items()}
        out, frame = [], None
        frames, ids, scores = (np.ascontiguousarray(rows[n]) for n in ("frame", "det_id", "score"))
        boxes = np.column_stack([rows[n] for n in "xywh"])
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(rows)]):
            frame = int(frames[a])
            out += machine.step(frame, ids[a:b], boxes[a:b], scores[a:b])
        machine.drop_ended(frame)
        for k in before.keys() - machine.tracks.keys():
            self.tracks.removeKey((k,))
        for k, t in machine.tracks.items():
            if k not in before or t["seen"] != before[k]["seen"]:
                self.tracks.updateValue((k,), (t["seen"], [(f, *map(float, b)) for f, b in t["past"]]))
        self.next.update((machine.next_id,))
        return out


def _ms(time: str) -> int:
    return int(pd.Timedelta(time).total_seconds() * 1000)


def tracker(stream: DataFrame, *, late: str = "10 minutes", idle: str = "1 day", **options) -> DataFrame:
    """(video_id, track_id, det_id, frame), as the batch operator gives them, from rows with a time ts that rises with frames.

    Rows without a detection (det_id is null) only move time on. A video without rows for the time idle is over and its state
    goes; a video id that comes up later counts as another video, with tracks from 0.
    """
    return in_order(stream, TrackProcessor(_ms(idle), options), key="video_id", late=late)


class MonitorProcessor(InOrder):
    """Kinds of a video's frames: the number of low ones so far is a value."""

    columns = (("frame", "long"), ("n_inliers", "long"))
    output = "video_id long, frame long, low_no long, kind string"

    def __init__(self, idle_ms: int, threshold: int, most_pseudo: int) -> None:
        super().__init__(idle_ms)
        self.threshold, self.most_pseudo = threshold, most_pseudo

    def own_states(self, handle: StatefulProcessorHandle) -> None:
        self.low = handle.getValueState("low", "low_no long")

    def forget(self) -> None:
        self.low.clear()

    def handle(self, rows: np.ndarray) -> list[tuple]:
        begun, low, out = self.low.exists(), (self.low.get() or (0,))[0], []
        for frame, n in zip(rows["frame"].tolist(), rows["n_inliers"].tolist(), strict=True):
            is_low = n < self.threshold
            low += int(is_low)
            kind = "anchor" if not begun else "promotes_previous" if is_low and low % (self.most_pseudo + 1) == 0 else "pseudo" if is_low else None
            begun = True
            if kind:
                out.append((frame, low, kind))
        if begun:
            self.low.update((low,))
        return out


def anchor_monitor(stream: DataFrame, threshold: int, most_pseudo: int, *, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(video_id, frame, low_no, kind) of the frames that are anchors, make the one before an anchor, or are pseudo anchors.
    A video without rows for the time idle is over, as in tracker."""
    return in_order(stream, MonitorProcessor(_ms(idle), threshold, most_pseudo), key="video_id", late=late)


def source(spark: SparkSession, rows: DataFrame, name: str, files: int | None = None, *, closing: DataFrame | None = None) -> DataFrame:
    """rows, and closing rows if there are any, written to the shared folder, as a stream of so many files a batch.

    By default all go in one batch, so that no row comes late whatever order the files have.
    """
    path = shared_dir(spark, f"stream-{name}")
    rows.write.parquet(path)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


#: Typed state needs a store that is an embedded database on the executors' disks, copied to the checkpoint.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in STATE_STORE; settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream appends until its source is used up, from the files that it writes in the shared folder."""
    return drained_with_late(stream, name)[0]


def drained_with_late(stream: DataFrame, name: str) -> tuple[DataFrame, int]:
    """drained, and how many rows came too late and were dropped."""
    out, progress = drained_with_progress(stream, name)
    return out, sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def drained_with_progress(stream: DataFrame, name: str) -> tuple[DataFrame, list]:
    """drained, and the progress of each batch."""
    spark = stream.sparkSession
    out, at = shared_dir(spark, f"stream-{name}-out"), shared_dir(spark, f"stream-{name}-log")
    with state_store(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query.recentProgress
