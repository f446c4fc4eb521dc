"""Detection evaluation by the COCO protocol, as DataFrame operators.

Ground truth: id, image_id, category_id, x, y, w, h, iscrowd. Detections: det_id, image_id, category_id, x, y, w, h, score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import boxes as B
from fieldlens.sources.shared import cut


@dataclass(frozen=True)
class EvalParams:
    """What an evaluation goes by; areas are (name, least, most). Unknown names and values that make no sense are errors.

    classes: those to evaluate, all if None. use_classes: whether a detection has to have the class of its ground truth;
    otherwise all classes are one, -1.
    """

    iou: tuple[float, ...] = (0.2, 0.5, 0.8)
    most_dets: int = 350
    areas: tuple[tuple[str, float, float], ...] = (("all", 0.0, 1e10),)
    recall_steps: int = 100
    classes: tuple[int, ...] | None = None
    use_classes: bool = True

    def __post_init__(self) -> None:
        names = [n for n, _, _ in self.areas]
        if not self.iou or not all(0 < t <= 1 for t in self.iou) or len(set(self.iou)) < len(self.iou):
            raise ValueError(f"overlap thresholds {self.iou}")
        if not names or len(set(names)) < len(names) or not all(a <= b for _, a, b in self.areas):
            raise ValueError(f"area ranges {self.areas}")
        if self.most_dets < 1 or self.recall_steps < 1:
            raise ValueError(f"{self.most_dets} detections, {self.recall_steps} steps of recall")


# fixed values: the area ranges and overlap thresholds of the COCO summary
COCO = EvalParams(
    iou=(0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95),
    most_dets=100,
    areas=(("all", 0.0, 1e10), ("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, 1e10)),
)
KEY = ["area", "iou_thr", "category_id"]


def top_detections(dets: DataFrame, most: int) -> DataFrame:
    """The best most detections of each image and class by score, then det_id; rk counts from 1."""
    order = Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id")
    return dets.withColumn("rk", F.row_number().over(order).cast("long")).filter(F.col("rk") <= most)


def box_overlap() -> Column:
    """Of a detection's box and a ground truth's (columns with a g before their names)."""
    return B.iou([F.col(c) for c in "xywh"], [F.col(f"g{c}") for c in "xywh"], F.col("giscrowd"))


def keypoint_similarity(spread: tuple[float, ...], points: Column | list | None = None, gpoints: Column | list | None = None) -> Column:
    """Of a detection's key points and a ground truth's, both arrays of (x, y, v), by default named points.

    Points that are made of other columns are best given as lists (as in oks): then they aren't shuffled.
    """
    return B.oks(F.col("points") if points is None else points, F.col("gpoints") if gpoints is None else gpoints, F.col("garea"), spread)


def candidates(dets: DataFrame, gts: DataFrame, least: float, similar: Column | None = None, how: str = "inner") -> DataFrame:
    """Detections with the ground truths (g before their columns) of the same image and class that are like them by least or
    more; iou is the likeness, by default the overlap of boxes. how "left" keeps detections without any as well."""
    size = F.col("area") if "area" in gts.columns else F.col("w") * F.col("h")
    kept = [F.col(c).alias(f"g{c}") for c in ("x", "y", "w", "h", "points") if c in gts.columns]
    g = gts.select("image_id", "category_id", F.col("id").alias("gid"), F.col("iscrowd").alias("giscrowd"), *kept, size.alias("garea"))
    like = box_overlap() if similar is None else similar
    if how == "inner":
        return dets.join(g, ["image_id", "category_id"]).withColumn("iou", like).filter(F.col("iou") >= least)
    g = g.withColumnsRenamed({"image_id": "gimage_id", "category_id": "gcategory_id"})
    near = (F.col("image_id") == F.col("gimage_id")) & (F.col("category_id") == F.col("gcategory_id")) & (like >= least)
    return dets.join(g, near, "left").withColumn("iou", F.when(F.col("gid").isNotNull(), like))


def _words(params: EvalParams, bits: int = 60) -> list[EvalParams]:
    """params in parts of which each has so many slots at most: pairs of an area and a threshold, one bit of a long each."""
    ious = [params.iou[i : i + bits] for i in range(0, len(params.iou), bits)]
    each = max(1, bits // len(ious[0]))
    return [replace(params, iou=t, areas=params.areas[i : i + each]) for t in ious for i in range(0, len(params.areas), each)]


def slots(params: EvalParams) -> list[tuple[str, float]]:
    return [(n, float(t)) for n, _, _ in params.areas for t in params.iou]


def match_bits(dets: DataFrame, gts: DataFrame, params: EvalParams, similar: Column | None = None) -> DataFrame:
    """(image_id, category_id, det_id, score, rk, found, ignored, gids, slots): one row for every detection, whatever the
    number of areas and thresholds; these are bits (area by area, in each by threshold), 60 at most.

    Each image and class is gone through in order of score: a detection takes the free ground truth with the greatest likeness
    of at least the threshold, one that counts before one that is ignored (a crowd, or outside the area range), and of equal
    ones the one with the larger id. A crowd can be taken again. found: where it takes one; gids and slots: which one where.
    ignored: where what it takes is, or where it takes none and its own area is outside the range. All areas and thresholds
    are matched at once; only what one image's truths are taken for is held. Detections that share no truth with another, and
    are like one at most, are settled together as arrays.
    """
    if len(slots(params)) > 60:
        raise ValueError("more than 60 areas and thresholds")
    thrs = sorted(min(float(t), 1 - 1e-10) for t in params.iou)
    outside = lambda v: sum((F.when((v < float(low)) | (v > float(high)), 1 << k).otherwise(0) for k, (_, low, high) in enumerate(params.areas)), F.lit(0))
    top = top_detections(dets, params.most_dets)
    near = candidates(top, gts, thrs[0], similar, how="left")
    rows = near.select(
        "image_id", "category_id", "det_id", "score", "rk", outside(F.col("w") * F.col("h")).alias("out"), "gid",
        (F.col("giscrowd") == 1).alias("crowd"), outside(F.col("garea")).alias("gout"), F.coalesce(F.col("iou").cast("double"), F.lit(0.0)).alias("iou"),
    )
    reached = lambda b: np.searchsorted(thrs, b.column("iou").to_numpy(), "right")
    n = len(params.iou)
    areas, everything = [((1 << n) - 1) << (k * n) for k in range(len(params.areas))], (1 << n * len(params.areas)) - 1
    in_areas = [sum(m for k, m in enumerate(areas) if bits >> k & 1) for bits in range(1 << len(areas))] if len(areas) <= 12 else None
    of_areas = in_areas.__getitem__ if in_areas else lambda bits: sum(m for k, m in enumerate(areas) if bits >> k & 1)
    passed = [sum(1 << (k * n + j) for k in range(len(areas)) for j, t in enumerate(params.iou) if min(float(t), 1 - 1e-10) in thrs[:r]) for r in range(n + 1)]
    kept = ["image_id", "category_id", "det_id", "score", "rk"]
    schema = ", ".join([*(f"{c} {near.schema[c].dataType.simpleString()}" for c in kept), "found long, ignored long, gids array<long>, slots array<long>"])

    def run(batches):
        now, at, open_, taken = None, None, everything, {}  # image and class; the detection at hand; its free bits; what is taken
        gids, slots, later = [], [], []

        def end() -> tuple:
            """The detection at hand is settled: what is ignored comes after all that counts."""
            nonlocal open_
            ignored = 0
            for g, crowd, may in later:
                m = may & open_ if crowd else may & open_ & ~taken.get(g, 0)
                if m:
                    taken[g] = taken.get(g, 0) | m
                    open_ &= ~m
                    ignored |= m
                    gids.append(g)
                    slots.append(m)
            return (*at[:5], everything & ~open_, ignored | open_ & of_areas(at[5]), gids, slots)

        for batch in batches:
            free = lone(batch)
            if free.any():
                yield alone(batch.filter(pa.array(free)))
            b, done = batch.filter(pa.array(~free)), []
            for image, cls, i, score, rk, out, g, crowd, gout, r in zip(*(b.column(c).to_pylist() for c in (*kept, "out", "gid", "crowd", "gout")), reached(b).tolist(), strict=True):
                if now != (image, cls) or at[4] != rk:
                    if at is not None:
                        done.append(end())
                    if now != (image, cls):
                        now, taken = (image, cls), {}
                    at, open_, gids, slots, later = (image, cls, i, score, rk, out), everything, [], [], []
                if g is not None:
                    off = everything if crowd else of_areas(gout)
                    m = passed[r] & open_ & ~off & ~taken.get(g, 0)
                    if m:
                        taken[g] = taken.get(g, 0) | m
                        open_ &= ~m
                        gids.append(g)
                        slots.append(m)
                    if off:
                        later.append((g, crowd, passed[r] & off))
            yield table(done, b)
        if at is not None:
            yield table([end()], b)

    def alone(b: pa.RecordBatch) -> pa.RecordBatch:
        """As the loop does it, of detections whose only truth, if any, nothing else can take."""
        of = lambda c: pc.fill_null(b.column(c), False if c == "crowd" else 0).to_numpy(zero_copy_only=False).astype("int64")
        each = lambda bits: (lambda v, at: np.array([of_areas(x) for x in v.tolist()], "int64")[at])(*np.unique(bits, return_inverse=True))
        found, off = np.array(passed, "int64")[reached(b)], np.where(of("crowd") != 0, everything, each(of("gout")))
        ignored = found & off | everything & ~found & each(of("out"))
        masks = np.stack([found & ~off, found & off], 1)
        used = masks != 0
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(used.sum(1))], pa.int32()), pa.array(v[used]))
        columns = [*(b.column(c) for c in kept), pa.array(found), pa.array(ignored), lists(np.stack([of("gid")] * 2, 1)), lists(masks)]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, "found", "ignored", "gids", "slots"])

    def table(done: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [*(b.schema.field(c).type for c in kept), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = zip(*done, strict=True) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*kept, "found", "ignored", "gids", "slots"])

    ordered = rows.sortWithinPartitions("image_id", "category_id", "rk", F.desc("iou"), F.desc("gid"))
    return ordered.select(*kept, "out", F.col("gid").cast("long"), "crowd", "gout", "iou").mapInArrow(run, schema)


def lone(b: pa.RecordBatch) -> np.ndarray:
    """Of rows (image_id, category_id, rk, gid) in order, a row for each pair, which are of a detection that is like no truth,
    or like one only that no other detection of the image and class is like. The rest of the groups at the ends of a batch may
    be in another one, so there only the former count."""
    none = b.column("gid").is_null().to_numpy(zero_copy_only=False)
    if not b.num_rows or any(pa.types.is_floating(b.schema.field(c).type) for c in ("image_id", "category_id")):
        return none
    differs = lambda c: pc.fill_null(pc.not_equal(b.column(c)[1:], b.column(c)[:-1]), True).to_numpy(zero_copy_only=False)
    groups = differs("image_id") | differs("category_id")
    group, one = np.r_[0, np.cumsum(groups)], np.r_[True, groups | differs("rk"), True]
    gid = pc.fill_null(b.column("gid"), 0).to_numpy()
    order = np.lexsort((gid, none, group))
    same = np.r_[False, ~groups & (gid[order][1:] == gid[order][:-1]) & ~none[order][1:] & ~none[order][:-1], False]
    single = np.empty(b.num_rows, bool)
    single[order] = ~(same[1:] | same[:-1])
    return none | single & one[1:] & one[:-1] & (group > 0) & (group < group[-1])


def greedy_match(dets: DataFrame, gts: DataFrame, params: EvalParams, similar: Column | None = None) -> DataFrame:
    """(iou_thr, area, image_id, category_id, det_id, score, rk, gid, ignored) for every detection that counts, area and
    threshold, by match_bits; gid is null where it takes none."""

    def rows(some: EvalParams) -> DataFrame:
        every = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(t).alias("iou_thr"), F.lit(1 << k).cast("long").alias("bit")) for k, (n, t) in enumerate(slots(some))])).alias("s")
        each = match_bits(dets, gts, some, similar).select("*", every)
        of = lambda c: F.col(c).bitwiseAND(F.col("s.bit")) != 0
        which = F.get("gids", F.array_position(F.transform("slots", lambda m: m.bitwiseAND(F.col("s.bit")) != 0), True).cast("int") - 1)
        gid = F.when(of("found"), which)
        return each.select("s.iou_thr", "s.area", "image_id", "category_id", "det_id", "score", "rk", gid.alias("gid"), of("ignored").alias("ignored"))

    return reduce(DataFrame.unionByName, map(rows, _words(params)))


def truth_counts(gts: DataFrame, params: EvalParams) -> DataFrame:
    """(area, category_id, n_truth): ground truth that counts, by area range and class."""
    ranges = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in params.areas]))
    size = F.col("area") if "area" in gts.columns else F.col("w") * F.col("h")
    within = gts.filter("iscrowd = 0").select("category_id", size.alias("size"), ranges.alias("range")).filter("size >= range.low and size <= range.high")
    return within.groupBy(F.col("range.name").alias("area"), "category_id").agg(F.count("*").alias("n_truth"))


class _Ranges(NamedTuple):
    """What is known of detections (category_id, det_id, score, image_id, rk, found, live: bits) dealt out by ranges of score.

    before[bin, class]: what found truths and what is live, by slot, in the rows of the class in the ranges before; total
    [class]: in all; truths[class]: ground truth by slot. Tables of a row for each range and class, or each class.
    """

    slots: list[tuple[str, float]]
    before: dict
    total: dict
    truths: dict

    def runs(self, b: pa.RecordBatch, state: dict):
        """For each range and class in a batch: (key, rows from, to, live, tp_n and n at each row by slot); state goes on."""
        found, live = (b.column(c).to_numpy() for c in ("found", "live"))
        shift = np.arange(len(self.slots))
        for key, i, j in _stretches(b):
            if key[1] not in self.truths:
                continue
            if state.get("key") != key:
                state.update(key=key, seen=self.before[key])
            on = (live[i:j, None] >> shift & 1).astype(bool) & (self.truths[key[1]] > 0)
            hit = on & (found[i:j, None] >> shift & 1).astype(bool)
            tp, n = np.cumsum(hit, 0), np.cumsum(on, 0)
            (tp0, n0), (tp_all, n_all) = state["seen"], self.total[key[1]]
            state["seen"] = tp0 + tp[-1], n0 + n[-1]
            yield key, i, j, on, tp_all - tp0 - tp + hit, n_all - n0 - n + on


def _stretches(b: pa.RecordBatch):
    """((bin, class), from, to) of the stretches of rows of a batch that have the same."""
    if b.num_rows:
        bins, classes = b.column("bin").to_numpy(), b.column("category_id").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((bins[1:] != bins[:-1]) | (classes[1:] != classes[:-1])) + 1).tolist(), b.num_rows]
        for i, j in pairwise(cuts):
            yield (bins[i].item(), b.column("category_id")[i].as_py()), i, j


def _ranges(bits: DataFrame, slots: list[tuple[str, float]], truths: DataFrame, *, rows_a_task: int = 1_000_000) -> tuple[DataFrame, _Ranges]:
    """bits (category_id, det_id, score, image_id, rk, found, live) in an order that serves all slots; ties go by image and rank.

    A table of up to rows_a_task rows is one range. Ranges are kept on the executors' disks, for some passes read them.
    """
    order = ["category_id", F.asc("score"), F.desc("image_id"), F.desc("rk")]
    bits = bits.filter("category_id is not null")
    dealt = bits.repartition(1) if bits.limit(rows_a_task + 1).count() <= rows_a_task else bits.repartitionByRange(*order)
    rows = dealt.sortWithinPartitions(*order).withColumn("bin", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    n_truth: dict = {}
    for r in truths.collect():  # a row for each area and class
        n_truth.setdefault(r.category_id, np.zeros(len(slots)))[[k for k, (a, _) in enumerate(slots) if a == r.area]] = r.n_truth
    shift = np.arange(len(slots))

    def sums(batches):
        total: dict = {}
        for b in batches:
            found, live = (b.column(c).to_numpy() for c in ("found", "live"))
            for key, i, j in _stretches(b):
                on = live[i:j, None] >> shift & 1
                got = np.stack([(on & found[i:j, None] >> shift & 1).sum(0), on.sum(0)])
                total[key] = total[key] + got if key in total else got
        if total:
            kinds = [pa.int32(), b.schema.field("category_id").type, pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = zip(*((*k, *v.tolist()) for k, v in total.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bin", "category_id", "tp", "n"])

    before, total = {}, {}
    found = rows.select("bin", "category_id", "found", "live").mapInArrow(sums, f"bin int, category_id {rows.schema['category_id'].dataType.simpleString()}, tp array<long>, n array<long>")
    for r in sorted(found.collect(), key=lambda r: r.bin):
        before[r.bin, r.category_id] = total.get(r.category_id, (np.zeros(len(slots), "int64"),) * 2)
        tp, n = before[r.bin, r.category_id]
        total[r.category_id] = tp + r.tp, n + r.n
    return rows, _Ranges(slots, before, total, n_truth)


_EPS = 2.220446049250313e-16


def precision_recall(matches: DataFrame, truths: DataFrame, *, rows_a_task: int = 1_000_000) -> DataFrame:
    """(area, iou_thr, category_id, det_id, score, image_id, rk, place, recall, precision, envelope) along falling scores, of
    the rows of greedy_match. Ties go by image and rank."""
    slots = sorted((r.area, r.iou_thr) for r in matches.select("area", "iou_thr").distinct().collect())
    parts = [slots[i : i + 60] for i in range(0, len(slots), 60)] or [[]]

    def of(some: list) -> DataFrame:
        bit = F.coalesce(*(F.when((F.col("area") == a) & (F.col("iou_thr") == t), F.lit(1 << k).cast("long")) for k, (a, t) in enumerate(some)), F.lit(0).cast("long"))
        bits = matches.filter("not ignored").withColumn("live", bit).filter("live <> 0").withColumn("found", F.when(F.col("gid").isNotNull(), F.col("live")).otherwise(F.lit(0).cast("long")))
        return curve(cut(bits.select("category_id", "det_id", "score", "image_id", "rk", "found", "live"), "matches"), some, truths, rows_a_task=rows_a_task)

    return reduce(DataFrame.unionByName, map(of, parts))


def curve(bits: DataFrame, slots: list[tuple[str, float]], truths: DataFrame, **options) -> DataFrame:
    """As precision_recall, of a row for each detection with its slots as bits.

    Rows come by falling recall, so the envelope (the greatest precision from here on) is a running one; what a range's
    rows begin with is the greatest of the ranges before, a row for each range and class. The ranges stay kept for the
    session, for the curve is read when it is used.
    """
    rows, ranges = _ranges(bits, slots, truths, **options)
    kind = rows.schema["category_id"].dataType.simpleString()

    def tops(batches):
        best, state = {}, {}
        for b in batches:
            for key, _, _, _, tp, n in ranges.runs(b, state):
                best[key] = np.maximum(best.get(key, 0.0), (tp / (n + _EPS)).max(0))
        if best:
            columns = [pa.array([k for k, _ in best], pa.int32()), pa.array([k for _, k in best], b.schema.field("category_id").type), pa.array([v.tolist() for v in best.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["bin", "category_id", "top"])

    top, begin = {}, {}
    for r in sorted(rows.select("bin", "category_id", "found", "live").mapInArrow(tops, f"bin int, category_id {kind}, top array<double>").collect(), key=lambda r: r.bin):
        begin[r.bin, r.category_id] = top.get(r.category_id, np.zeros(len(slots)))
        top[r.category_id] = np.maximum(begin[r.bin, r.category_id], r.top)
    own = ["category_id", "det_id", "score", "image_id", "rk"]
    areas, thrs = pa.array([a for a, _ in slots], pa.string()), np.array([t for _, t in slots])

    def run(batches):
        state, now, best = {}, None, None
        for b in batches:
            for key, i, j, on, tp, n in ranges.runs(b, state):
                if key != now:
                    now, best = key, begin[key]
                precision = tp / (n + _EPS)
                envelope = np.maximum(np.maximum.accumulate(precision, 0), best)
                best = envelope[-1]
                r, s = np.nonzero(on)
                at = pa.array(r + i)
                yield pa.RecordBatch.from_arrays(
                    [areas.take(pa.array(s)), pa.array(thrs[s]), *(b.column(c).take(at) for c in own), pa.array(n[r, s]), pa.array(tp[r, s] / ranges.truths[key[1]][s]), pa.array(precision[r, s]), pa.array(envelope[r, s])],
                    names=["area", "iou_thr", *own, "place", "recall", "precision", "envelope"],
                )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in own)
    return rows.mapInArrow(run, f"area string, iou_thr double, {kinds}, place long, recall double, precision double, envelope double")


def sampled(bits: DataFrame, truths: DataFrame, params: EvalParams, **options) -> DataFrame:
    """(area, iou_thr, category_id, rec_thr, precision, score) at recall 0, 1/steps ... 1: of the first point of the curve that
    reaches it, else 0. Classes without ground truth give no rows (their cells are undefined). bits are rows as curve's.

    Precision there is the greatest from that point on, and points of a step follow one another; so each task sums its
    points up by step (the first one's score, the greatest precision), steps + 1 rows a class and slot, and no curve is made.
    """
    spark, steps, own = bits.sparkSession, params.recall_steps, slots(params)
    rows, ranges = _ranges(bits, own, truths, **options)
    kind = rows.schema["category_id"].dataType.simpleString()
    names = ["area", "iou_thr", "category_id", "step", "place", "score", "precision"]

    def run(batches):
        state, held, last = {}, {}, None
        for b in batches:
            scores, last = b.column("score").to_numpy(), b.schema.field("category_id").type
            for key, i, j, on, tp, n in ranges.runs(b, state):
                first, precision = held.setdefault(key[1], ({}, {}))
                s, r = np.nonzero(on.T)
                if not len(s):
                    continue
                step = np.floor(tp[r, s] / ranges.truths[key[1]][s] * steps + 1e-9).astype("int64")
                code = s * (steps + 1) + step
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                ends = np.r_[starts[1:], len(code)] - 1
                best = np.maximum.reduceat(tp[r, s] / (n[r, s] + _EPS), starts)
                for c, p, place, score in zip(code[starts].tolist(), best.tolist(), n[r[ends], s[ends]].tolist(), scores[i + r[ends]].tolist(), strict=True):
                    precision[c] = max(p, precision.get(c, 0.0))
                    first[c] = place, score  # places fall
        out = [(*own[c // (steps + 1)], k, c % (steps + 1), *first[c], precision[c]) for k, (first, precision) in held.items() for c in first]
        if out:
            kinds = [pa.string(), pa.float64(), last, pa.int32(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    points = cut(rows.select("bin", "category_id", F.col("score").cast("double"), "found", "live").mapInArrow(run, f"area string, iou_thr double, category_id {kind}, step int, place long, score double, precision double"), "points")
    rows.unpersist()
    hit = points.select(*KEY, F.explode(F.sequence(F.lit(0), "step")).alias("step"), "place", "score", "precision")
    hit = hit.groupBy(*KEY, "step").agg(F.max("precision").alias("precision"), F.min_by("score", "place").alias("score"))
    every = F.broadcast(truths.select("area", "category_id")).crossJoin(spark.range(steps + 1).select(F.col("id").cast("int").alias("step")))
    grid = every.withColumn("iou_thr", F.explode(F.array(*[F.lit(float(i)) for i in params.iou])))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return grid.join(hit, [*KEY, "step"], "left").select(*KEY, (F.col("step") / steps).alias("rec_thr"), zero("precision"), zero("score"))


def live_bits(matches: DataFrame, params: EvalParams) -> DataFrame:
    """What curve and sampled read, of match_bits: detections that are ignored in all slots are left out."""
    every = F.lit((1 << len(slots(params))) - 1).cast("long")
    live = every.bitwiseAND(F.bitwise_not("ignored"))
    return matches.select("category_id", "det_id", "score", "image_id", "rk", "found", live.alias("live")).filter("live <> 0")


def recalls(matches: DataFrame, truths: DataFrame, params: EvalParams, most: tuple[int, ...]) -> DataFrame:
    """(area, iou_thr, category_id, r<n>...): the share of the ground truth found among each image's n best detections, of
    match_bits."""
    good = F.col("found").bitwiseAND(F.bitwise_not("ignored"))
    counts = [F.count_if((good.bitwiseAND(F.lit(1 << k).cast("long")) != 0) & (F.col("rk") <= n)).alias(f"c{k}_{n}") for k in range(len(slots(params))) for n in most]
    per = matches.groupBy("category_id").agg(*counts)
    rows = [F.struct(F.lit(a).alias("area"), F.lit(t).alias("iou_thr"), *(F.col(f"c{k}_{n}").alias(f"n{n}") for n in most)) for k, (a, t) in enumerate(slots(params))]
    per = per.select("category_id", F.inline(F.array(*rows)))
    every = truths.withColumn("iou_thr", F.explode(F.array(*[F.lit(float(i)) for i in params.iou])))
    share = lambda n: (F.coalesce(F.col(f"n{n}"), F.lit(0)) / F.col("n_truth")).alias(f"r{n}")
    return every.join(per, KEY, "left").select(*KEY, *(share(n) for n in most))


def evaluated(dets: DataFrame, gts: DataFrame, params: EvalParams, similar: Column | None = None, most: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(sampled, recalls with each of most detections an image). The matching is done once, and written as a row a detection."""
    samples, found = [], []
    for some in _words(params):
        truths = cut(truth_counts(gts, some), "truths")
        matches = cut(match_bits(dets, gts, some, similar).drop("gids", "slots"), "matches")
        samples.append(sampled(live_bits(matches, some), truths, some))
        found += [recalls(matches, truths, some, most)] if most else []
    union = lambda some: reduce(DataFrame.unionByName, some)
    return union(samples), union(found) if found else None


def coco_summary(dets: DataFrame, gts: DataFrame, params: EvalParams = COCO, similar: Column | None = None) -> DataFrame:
    """One row of the protocol's twelve numbers: mean precision over all thresholds, at .5 and at .75, by area; mean recall
    with 1, 10 and all detections an image, and by area. The matching is done once."""
    top = params.most_dets
    samples, found = evaluated(dets, gts, params, similar, tuple(sorted({1, 10, top})))
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    of = lambda name: F.col("area") == name
    thr = lambda t: of("all") & (F.abs(F.col("iou_thr") - t) < 1e-9)
    precision = {"ap": of("all"), "ap50": thr(0.5), "ap75": thr(0.75), "ap_small": of("small"), "ap_medium": of("medium"), "ap_large": of("large")}
    recall = {
        "ar1": ("r1", "all"), "ar10": ("r10", "all"), "ar100": (f"r{top}", "all"), "ar_small": (f"r{top}", "small"),
        "ar_medium": (f"r{top}", "medium"), "ar_large": (f"r{top}", "large"),
    }
    one = samples.agg(*(mean("precision", on).alias(n) for n, on in precision.items()))
    two = found.agg(*(mean(c, of(name)).alias(n) for n, (c, name) in recall.items()))
    return one.crossJoin(F.broadcast(two))


def operating_points(samples: DataFrame, score_thrs: tuple[float, ...] = (0.2, 0.7)) -> DataFrame:
    """(category_id, iou_thr, score_thr, recall, precision): the largest recall whose score reaches the threshold, else null."""
    thr = samples.withColumn("score_thr", F.explode(F.array(*[F.lit(float(s)) for s in score_thrs])))
    ok = F.col("score") >= F.col("score_thr")
    best = thr.groupBy("category_id", "iou_thr", "score_thr").agg(F.max(F.when(ok, F.struct("rec_thr", "precision"))).alias("b"))
    return best.select("category_id", "iou_thr", "score_thr", F.col("b.rec_thr").alias("recall"), F.col("b.precision").alias("precision"))


def chosen(boxes: DataFrame, params: EvalParams, images: DataFrame | None = None) -> DataFrame:
    """The detections or ground truths that params evaluate, of the images given (a column image_id; all if None)."""
    if images is not None:
        boxes = boxes.join(images.select("image_id"), "image_id", "left_semi")
    if params.classes is not None:
        boxes = boxes.filter(F.col("category_id").isin(*params.classes)) if params.classes else boxes.limit(0)
    return boxes if params.use_classes else boxes.withColumn("category_id", F.lit(-1).cast(boxes.schema["category_id"].dataType))


def evaluate(dets: DataFrame, gts: DataFrame, params: EvalParams, images: DataFrame | None = None) -> DataFrame:
    return evaluated(chosen(dets, params, images), chosen(gts, params, images), params)[0]


def image_loss(matches: DataFrame) -> DataFrame:
    """(image_id, loss): the mean over an image's detections of what their scores are off: from 1 without a truth, else from 0."""
    off = F.when(F.col("gid").isNull(), 1 - F.col("score")).otherwise(F.col("score"))
    return matches.groupBy("image_id").agg(F.avg(off).alias("loss"))


def argmax_class(dets: DataFrame, background: int) -> DataFrame:
    """(image_id, category_id, score): the class with the best score that isn't the background; of equal ones the least."""
    per = dets.filter(F.col("category_id") != background).groupBy("image_id", "category_id").agg(F.max("score").alias("score"))
    best = F.max(F.struct("score", F.negative("category_id").alias("c"))).alias("b")
    return per.groupBy("image_id").agg(best).select("image_id", F.negative("b.c").alias("category_id"), "b.score")


def with_area(boxes: DataFrame) -> DataFrame:
    """Boxes that have a positive width and height."""
    return boxes.filter("w > 0 and h > 0")


def nms(df: DataFrame, thr: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(keys..., det_id) of boxes kept: by falling score, those with an overlap of more than thr to no box kept before."""
    box = F.struct(F.negative("score").alias("s"), "det_id", *"xywh")
    kind = "array<struct<s:double,det_id:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>"
    side = lambda b: [b[c] for c in "xywh"]
    kept = F.aggregate("boxes", F.array().cast(kind), lambda acc, b: F.when(F.exists(acc, lambda k: B.iou(side(k), side(b)) > thr), acc).otherwise(F.concat(acc, F.array(b))))
    groups = df.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return groups.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.det_id")


def nms_crowded(df: DataFrame, thr: float, key: str = "image_id", *, cell: int = 64) -> DataFrame:
    """As nms, for images of any number of boxes: (key, det_id) of those kept.

    An image's boxes come one by one, best first; only those kept are held, by the grid cells that they touch, and a box is
    compared with the ones in its own cells. So time grows with the boxes and how many of those kept lie over one place.
    """

    def run(batches):
        now, held = None, {}
        for b in batches:
            kept = []
            for k, i, x, y, w, h in zip(*(b[c].to_pylist() for c in ("key", "det_id", *"xywh")), strict=True):
                if k != now:
                    now, held = k, {}
                cells = [(p, q) for p in range(int(x // cell), int((x + w) // cell) + 1) for q in range(int(y // cell), int((y + h) // cell) + 1)]
                if not any(_iou(x, y, w, h, *o) > thr for c in cells for o in held.get(c, ())):
                    for c in cells:
                        held.setdefault(c, []).append((x, y, w, h))
                    kept.append((k, i))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in kept], b.schema.field(c).type) for n, c in enumerate(("key", "det_id"))], names=[key, "det_id"])

    rows = df.select(F.col(key).alias("key"), F.negative("score").alias("s"), F.col("det_id").cast("long"), *(F.col(c).cast("double").alias(c) for c in "xywh"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "s", "det_id")
    return ordered.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, det_id long")


def _iou(x: float, y: float, w: float, h: float, x2: float, y2: float, w2: float, h2: float) -> float:
    shared = max(0.0, min(x + w, x2 + w2) - max(x, x2)) * max(0.0, min(y + h, y2 + h2) - max(y, y2))
    total = w * h + w2 * h2 - shared
    return shared / total if total > 0 else 0.0


def suppress_covered(dets: DataFrame, tracks: DataFrame, thr: float) -> DataFrame:
    """Detections of an image that no active track's box (image_id, x, y, w, h) covers by more than thr."""
    t = tracks.select("image_id", *(F.col(c).alias(f"t{c}") for c in "xywh"))
    over = B.iou([F.col(c) for c in "xywh"], [F.col(f"t{c}") for c in "xywh"]) > thr
    covered = dets.join(t, "image_id").filter(over).select("det_id").distinct()
    return dets.join(covered, "det_id", "left_anti")
