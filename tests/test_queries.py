"""Every registered query against its SQL at sf0.001, plans, and properties of what SQL can't express."""

import datetime as dt
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import names as N
from fieldlens.operators import dataset as D
from fieldlens.operators import evaluation as V
from fieldlens.operators import geo as G
from fieldlens.operators import tracking as T
from fieldlens.plans import catalog as R
from fieldlens.sources.fixtures import Tables
from fieldlens.streaming import operators as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(5)
        df[c] = df[c].map(lambda v: "" if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(R.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = plain(R.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(R.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - set(R.ORACLES)))
def test_others_have_rows(spark, name):
    assert R.QUERIES[name](spark, SF).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    t = Tables(spark, SF)
    assert "CartesianProduct" not in plan_of(D.renumber_annotations(t.annotations))
    pushed = plan_of(t.table("events").filter("value > 400").select("event_id"))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,400.0)]" in pushed


def test_nms_keeps_no_overlap(spark):
    t = Tables(spark, SF)
    kept = t.detections.join(V.nms(t.detections, 0.3), ["image_id", "det_id"]).toPandas()
    for _, own in kept.groupby("image_id"):
        over = T.iou_table(own[list("xywh")].to_numpy(float), own[list("xywh")].to_numpy(float))
        np.fill_diagonal(over, 0)
        assert over.max(initial=0) <= 0.3


def test_matching_is_one_to_one(spark):
    t = Tables(spark, SF)
    m = V.greedy_match(t.detections, t.annotations.withColumn("iscrowd", F.lit(0)), V.EvalParams(iou=(0.5,)))
    taken = m.filter("gid is not null").groupBy("gid").count()
    assert taken.filter("count > 1").count() == 0


def test_curve_by_ranges(spark):
    """Dealt out by ranges, with scores of few values so that one makes up much of a class, the curve is that of one task."""
    t = Tables(spark, SF)
    params = V.EvalParams(iou=(0.5,))
    truths = V.truth_counts(t.annotations, params)
    matches = V.cut(V.greedy_match(t.detections.withColumn("score", F.round("score", 1)), t.annotations, params), "m")
    one, many = (plain(V.precision_recall(matches, truths, rows_a_task=n).toPandas()) for n in (10**6, 0))
    pd.testing.assert_frame_equal(one, many)


def test_matching_of_all_areas_at_once(spark):
    """A row for each detection holds what each area and threshold gives, as a plain matching of each does."""
    import random

    rng = random.Random(3)
    box = lambda: (rng.randrange(30), rng.randrange(30), rng.randrange(5, 30), rng.randrange(5, 30))
    gts = [(k, k % 4, 1 + k % 2, *box(), int(rng.random() < 0.2)) for k in range(60)]
    dets = [(1000 + k, k % 5, 1 + k % 2, *box(), rng.randrange(6) / 5) for k in range(150)]
    params = V.EvalParams(iou=(0.5, 0.2, 0.35), most_dets=10, areas=(("all", 0.0, 1e10), ("small", 0.0, 200.0), ("large", 200.0, 1e10)))
    d = spark.createDataFrame(dets, "det_id long, image_id long, category_id long, x long, y long, w long, h long, score double")
    g = spark.createDataFrame(gts, "id long, image_id long, category_id long, x long, y long, w long, h long, iscrowd int")
    want = set()
    for area, low, high in params.areas:
        for thr in params.iou:
            taken = set()
            for group in {r[1:3] for r in dets}:
                for i, *_, x, y, w, h, _ in sorted((r for r in dets if r[1:3] == group), key=lambda r: (-r[7], r[0]))[:10]:
                    best = None
                    for k, *_, gx, gy, gw, gh, crowd in (r for r in gts if r[1:3] == group):
                        shared = max(0, min(x + w, gx + gw) - max(x, gx)) * max(0, min(y + h, gy + gh) - max(y, gy))
                        over = shared / (w * h if crowd else w * h + gw * gh - shared)
                        if over >= thr and (crowd or k not in taken):
                            best = max(best or (-1,), (int(not crowd and low <= gw * gh <= high), over, k))
                    if best:
                        taken.add(best[2])
                    want.add((area, thr, i, best[2] if best else None, best[0] == 0 if best else not low <= w * h <= high))
    got = V.greedy_match(d, g, params)
    assert {(r.area, r.iou_thr, r.det_id, r.gid, r.ignored) for r in got.collect()} == want
    bits = V.match_bits(d, g, params)
    assert bits.count() == len({w[2] for w in want}) == got.count() / 9
    truths = V.truth_counts(g, params)
    live = V.cut(V.live_bits(bits, params), "live")
    one, many = (plain(V.sampled(live, truths, params, rows_a_task=n).toPandas()) for n in (10**6, 0))
    pd.testing.assert_frame_equal(one, many)
    long = V.EvalParams(iou=tuple(k / 100 for k in range(30, 95)), areas=params.areas[:2])  # more than a long has bits
    assert V.greedy_match(d, g, long).filter("iou_thr = 0.5 and area = 'all'").count() == len(dets)
    assert V.evaluate(d, g, long).count() == 65 * 101 * truths.filter("area in ('all', 'small')").count()


def test_boxes_are_made_once(spark):
    """An evaluation of the fixture shuffles the table once, and no key points."""
    plan = plan_of(R.QUERIES["keypoint_match"](spark, SF))
    assert "lineitem" not in plan and "points" not in plan


def test_anchors_of_six_digits(spark, tmp_path):
    """SQL's rows where frames have more than five digits."""
    events = spark.read.parquet(f"{SF}/events.parquet").filter("event_id < 300").withColumn("event_id", F.col("event_id") + 37 * 33333)
    events.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    pd.testing.assert_frame_equal(plain(R.QUERIES["anchor_scan"](spark, str(tmp_path)).toPandas()), plain(c.sql(R.ORACLES["anchor_scan"]).df()))


@pytest.mark.parametrize("name", ["sort_by_category_id", "empty_like"])
def test_classes_in_use_are_found_in_each_task(spark, name):
    """The table is aggregated before it is dealt out by class: no row of it is shuffled or numbered for that."""
    plan = plan_of(R.QUERIES[name](spark, SF))
    assert "HashAggregate(keys=[category_id" in plan and "row_number" not in plan and "hashpartitioning(l_orderkey" not in plan


def test_few_tries_of_a_crop_are_drawn(spark):
    """The list of all tries is made only where the first few are outside."""
    plan = plan_of(R.QUERIES["crop_plan_centred"](spark, SF))
    assert "coalesce(CASE WHEN" in plan and "sequence(1, 64" not in plan


def test_split_is_complete(spark):
    t = Tables(spark, SF)
    got = D.partition(t.images, {"a": 0.5, "b": 0.5}, F.col("image_id"))
    assert got.count() == t.images.count() and abs(got.filter("split = 'a'").count() - got.filter("split = 'b'").count()) <= 1


def test_name_of_many_digits_is_kept(spark):
    row = spark.createDataFrame([("abcdefghij",), ("日本日本日本日本日本",)], "n string").select(N.code_points(F.col("n")).alias("c"), N.code_point_number(F.col("n")).alias("k")).collect()
    assert row[0].c == str(row[0].k) == "979899100101102103104105106" and row[1].c == "2608526412" * 5 and row[1].k is None


def test_renumber_random_ids(spark):
    """Dense numbers of 64-bit random ids, with gaps, negative ones and repeats of an image."""
    import random

    rng = random.Random(5)
    images = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    rows = [(rng.choice(images), rng.randrange(-(2**63), 2**63)) for _ in range(3000)]
    got = D.renumber_annotations(spark.createDataFrame(rows, "image_id long, id long").repartition(7)).collect()
    assert [(r.image_id, r.id) for r in sorted(got, key=lambda r: r.new_id)] == sorted(rows) and sorted(r.new_id for r in got) == list(range(1, 3001))
    assert D.renumber_annotations(spark.createDataFrame([], "image_id long, id long")).count() == 0


def test_rolling_in_buckets(spark):
    """Buckets of a long meter give what the whole meter gives, and sparse ones as well."""
    from fieldlens.operators import metrics as M

    log = spark.range(500).select(
        F.when(F.col("id") % 5 == 0, "few").otherwise("many").alias("meter"),
        (F.col("id") * F.when(F.col("id") % 5 == 0, 40).otherwise(1)).alias("step"), ((F.col("id") * 37) % 101).cast("double").alias("value"),
    )
    pd.testing.assert_frame_equal(plain(M.rolling(log, 20, bucket=64, rows_a_task=0).toPandas()), plain(M.rolling(log, 20).toPandas()))


def test_flat_ground(spark):
    """Straight down from 100 to flat ground at 10: the depth is 100 + height - 10 within the threshold."""
    cells = spark.range(400).select((F.col("id") % 20).alias("xr"), F.floor(F.col("id") / 20).alias("yr"), F.lit(10.0).alias("elev"))
    inv = [0.001, 0, -0.32, 0, 0.001, -0.24, 0, 0, -1.0]
    names = [*(f"i{r}{c}" for r in range(3) for c in range(3)), "p03", "p13", "p23", "u", "v", "m02", "m12", "mu0"]
    ray = spark.createDataFrame([(*map(float, inv), 32000.0 - 1000 * 5, 24000.0 - 1000 * 5, 100.0, 320.0, 240.0, 0.0, 0.0, 90.0)], ", ".join(f"{n} double" for n in names))
    raster = G.Raster(cells, offset=(0.0, 0.0, 0.0))
    for limit in (1000, 0):
        got = G.ground_points(ray, raster, limit_cells=limit, tile=8).first()
        assert got.found and abs(got.mu - (100 + 1 - 10)) <= 0.1


def test_carried_depth(spark):
    """The carried search against a plain one, frame by frame, with several points a frame; it ends where the fixed one does."""
    from fieldlens.plans import mapping as P

    t = Tables(spark, SF)
    rays = P._rays(t).withColumn("obs_ind", F.floor(F.col("obs_ind") / 4)).filter("obs_ind < 60")
    raster = P.raster(t)
    size, _, least = G._sized(raster)
    grid = {(r.xr, r.yr): r.elev for r in raster.cells.collect()}
    got = {(r.track_id, r.obs_ind, r.col_px, r.row_px): (r.mu, r.found) for r in G.ground_points_carried(rays, raster).collect()}
    want, by = {}, {}
    for r in rays.collect():
        by.setdefault(r.observation_id, {}).setdefault(r.obs_ind, []).append(r)
    for frames in by.values():
        depth = P.GUESS
        for obs in sorted(frames):
            found = []
            for r in frames[obs]:
                mu, low, high = depth, 0.0, None
                for n in range(52):
                    side = r.u * mu - (r.p03 - r.m02 * depth), r.v * mu - (r.p13 - r.m12 * depth), mu - r.p23
                    x, y, z = (sum(r[f"i{k}{c}"] * side[c] for c in range(3)) + P.GEO["offset"][k] for k in range(3))
                    at = (
                        min(max(int((x - P.GEO["x_origin"]) / P.GEO["pixel_width"]), 0), size[0] - 1),
                        min(max(int((y - P.GEO["y_origin"]) / P.GEO["pixel_height"]), 0), size[1] - 1),
                    )
                    gap = z + 1 - grid.get(at, least)
                    if n > 50 or abs(gap) <= 0.1:
                        break
                    low, high, mu = (mu, high, mu * 2 if high is None else (mu + high) / 2) if gap > 0 else (low, mu, (low + mu) / 2)
                want[r.track_id, r.obs_ind, r.col_px, r.row_px] = (mu, abs(gap) <= 0.1)
                found.append(mu)
            depth = sum(found) / len(found) or depth
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)


def plain_tracks(rows, least=0.5, overlap=0.3, patience=3, history=3, track_nms=0.6, new_nms=0.3):
    """The tracker's rules for one video, box by box: (track, det_id, frame)."""

    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        shared = max(w, 0) * max(h, 0)
        return shared / (a[2] * a[3] + b[2] * b[3] - shared)

    def thinned(boxes, most):
        kept = []
        for name, box in boxes:
            if all(iou(k, box) <= most for _, k in kept):
                kept.append((name, box))
        return [n for n, _ in kept]

    tracks, count, out = {}, 0, []
    for frame in sorted({r[0] for r in rows}):
        dets = sorted([r for r in rows if r[0] == frame and r[3] > least], key=lambda r: (-r[3], r[1]))
        moved = {}
        for k, past in sorted(tracks.items()):
            (f0, b0), (f1, b1) = past[-history:][0], past[-1]
            if frame - f1 > patience:
                continue
            moved[k] = [v + (v - u) / (f1 - f0) * (frame - f1) if f1 > f0 else v for u, v in zip(b0, b1, strict=True)]
        moved = {k: b for k, b in moved.items() if b[2] > 0 and b[3] > 0}
        tracks = {k: tracks[k] for k in moved}
        pairs = sorted(((-iou(b, d[2]), k, d[1], j) for k, b in moved.items() for j, d in enumerate(dets) if iou(b, d[2]) >= overlap and iou(b, d[2]) > 0))
        taken = {}
        for _, k, _, j in pairs:
            if k not in taken and j not in taken.values():
                taken[k] = j
        best = thinned([(k, dets[j][2]) for k, j in sorted(taken.items(), key=lambda p: p[1])], track_nms)
        for k in best:
            tracks[k].append((frame, dets[taken[k]][2]))
            out.append((k, dets[taken[k]][1], frame))
        held = [dets[taken[k]][2] if k in taken else moved[k] for k in moved if k not in taken or k in best]
        free = [(j, d[2]) for j, d in enumerate(dets) if j not in taken.values() and all(iou(b, d[2]) <= overlap for b in held)]
        for j in thinned(free, new_nms):
            tracks[count] = [(frame, dets[j][2])]
            out.append((count, dets[j][1], frame))
            count += 1
    return out


def test_track_step_brute_force(spark):
    from fieldlens.plans.tracking import frames

    t, by = Tables(spark, SF), {}
    for r in frames(t).collect():
        by.setdefault(r.video_id, []).append((r.frame, r.det_id, [float(r[c]) for c in "xywh"], r.score))
    want = {(v, *x) for v, rows in by.items() for x in plain_tracks(rows)}
    got = R.QUERIES["track_step"](spark, SF).collect()
    assert {(r.video_id, r.track_id, r.det_id, r.frame) for r in got} == want and len(got) == len(want)
    stream = R.QUERIES["stream_tracker"](spark, SF).collect()
    assert {(r.video_id, r.track_id, r.det_id, r.frame) for r in stream} == want and len(stream) == len(want)


def in_files(spark, rows, name, order=None, files=6, closing=None):
    """rows in files, at random or in ranges of a column, each with a later time than the one before, so that a stream takes them in turn."""
    path = X.shared_dir(spark, name)
    parts = rows.randomSplit([1.0] * files, seed=3) if order is None else None
    if parts is None:
        (rows.repartitionByRange(files, order)).write.parquet(path)
    else:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(path)
    found = sorted((f for f in os.listdir(path) if f.startswith("part-")), key=lambda f: f if order else os.stat(f"{path}/{f}").st_mtime_ns)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(path)
        found += [f for f in os.listdir(path) if f.startswith("part-") and f not in found]
    for k, f in enumerate(found):
        os.utime(f"{path}/{f}", (1_700_000_000 + k, 1_700_000_000 + k))
    return path


def stream_of(spark, rows, path, files):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_shuffled_files(spark, files):
    """Rows dealt at random over six files, one or three a batch: within the time allowed none is lost; beyond it, all that
    are lost are counted."""
    from fieldlens.plans.streams import closing, timed
    from fieldlens.plans.tracking import frames

    t = Tables(spark, SF)
    cases = {
        "tracker": (timed(frames(t)).select("video_id", "frame", "det_id", "x", "y", "w", "h", "score", "ts"), lambda s, late: X.tracker(s, late=late, patience=3), T.track(frames(t), patience=3)),
        "monitor": (timed(t.inliers), lambda s, late: X.anchor_monitor(s, 100, 10, late=late), G.anchor_selection(t.inliers, 100, 10).filter("kind <> 'plain'").select("video_id", "frame", "low_no", "kind")),
    }
    for name, (rows, run, want) in cases.items():
        path = in_files(spark, rows, name, closing=closing(rows))
        got, late = X.drained_with_late(run(stream_of(spark, rows, path, files), "30 minutes"), name)
        pd.testing.assert_frame_equal(plain(got.toPandas()), plain(want.toPandas()))
        assert late == 0
        _, late = X.drained_with_late(run(stream_of(spark, rows, path, files), "1 second"), name)
        assert late > 0 or files > 1  # with three files a batch, no row comes after its time has been handled


def test_source_in_order_of_events(spark):
    """Over several batches in order of time, each stateful query gives what one batch gives."""
    t = Tables(spark, SF)
    events = t.table("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("track_id", F.col("user_id"))
    cases = {
        "rate": (events, "ts", lambda s: X.frame_rate(s, "event_type")),
        "sliding": (events, "ts", lambda s: X.frame_rate(s, "event_type", slide="5 minutes")),
        "sessions": (events, "ts", lambda s: X.gap_sessions(s, "2 hours")),
    }
    for name, (rows, order, run) in cases.items():
        want = plain(X.drained(run(X.source(spark, rows.coalesce(1), name)), name).toPandas())
        stream = stream_of(spark, rows, in_files(spark, rows.repartition(20), name, order=order, files=5), 1)
        pd.testing.assert_frame_equal(plain(X.drained(run(stream), name).toPandas()), want)


def test_stream_tracker_exact_ids_and_state_that_ends(spark):
    """64-bit ids beside null ones come back as they were; tracks leave the state with their patience, and a video's state goes
    once it has been idle; a video that comes up again begins anew. A file a batch."""
    big = 2**53 + 1
    ts = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s)
    box = lambda x: (float(x), 0.0, 50.0, 50.0, 0.9)
    rows = [(7, f, big + 2 * f, *box(f), ts(f)) for f in range(6)] + [(8, 0, 2**62 + 1, *box(0), ts(0))]
    rows += [(7, 1, None, *[None] * 5, ts(1)), (9, None, big, *box(0), ts(2))]
    rows += [(7, 5000 + f, big + 100 + f, *box(f), ts(5000 + f)) for f in range(2)]
    rows += [(-1, None, None, *[None] * 5, ts(s)) for s in (30, 2000, 4000, 9000, 20000, 20001)]
    df = spark.createDataFrame(rows, "video_id long, frame long, det_id long, x double, y double, w double, h double, score double, ts timestamp")
    path = in_files(spark, df, "ids", order="ts", files=8)
    got, progress = X.drained_with_progress(X.tracker(stream_of(spark, df, path, 1), late="10 seconds", idle="20 minutes", patience=3), "ids")
    found = {(r.video_id, r.track_id, r.det_id, r.frame) for r in got.collect()}
    assert found == {(7, 0, big + 2 * f, f) for f in range(6)} | {(8, 0, 2**62 + 1, 0)} | {(7, 0, big + 100 + f, 5000 + f) for f in range(2)}
    states = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]
    assert max(states) > 0 and states[-1] == 0, states


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_range_scan_of_long_keys(spark):
    """A chain and anchors that lie over many ranges give what going through them one by one does."""
    rng = np.random.default_rng(1)
    names = list(G.IDENTITY)
    rows = [(0 if k < 400 else k % 3, k, *(rng.normal(size=6) * 0.1 + [1, 0, 0, 0, 1, 0]).tolist()) for k in range(700)]
    schema = "segment long, step long, " + ", ".join(f"{n} double" for n in names)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.segment, r.step): np.array(r[2:]).reshape(2, 3) for r in G.warp_chain(spark.createDataFrame(rows, schema).repartition(9)).collect()}
        last = {}
        for s, k, *m in rows:
            now = np.vstack([np.array(m).reshape(2, 3), [0, 0, 1]])
            last[s] = last[s] @ now if s in last else now
            assert np.allclose(got[s, k], last[s][:2])
        assert len(got) == 700
        frames = spark.createDataFrame([(0, f, f"a/f{f % 90}.jpg") for f in range(900)], "observation_id long, frame_ind long, path string")
        anchors = [(0, k, f"f{int(x)}.jpg") for k, x in enumerate(rng.integers(0, 95, 300))]
        found = {r.anchor_ind: r.obs_ind for r in G.anchor_frames(spark.createDataFrame(anchors, "observation_id long, anchor_ind long, image_name string"), frames).collect()}
        at, want = 0, {}
        for _, k, name in anchors:
            ahead = [f for f in range(at, 900) if f"f{f % 90}.jpg" == name]
            if ahead:
                at = want[k] = ahead[0]
        assert found == want and len(want) > 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("tile", [4, 16])
def test_pyramid_equals_whole_grid(spark, tile):
    """Over rough ground, with holes, searches by tiles end where searches of the whole raster do."""
    from fieldlens.plans import mapping as P

    t = Tables(spark, SF)
    rays = P._rays(t).filter("obs_ind < 300").select(*(c for c in P._rays(t).columns))
    raster = P.raster(t)
    holes = G.Raster(raster.cells.filter("xr % 7 <> 3 or yr % 5 <> 2").withColumn("elev", F.col("elev") + F.col("xr") * 2), **{k: getattr(raster, k) for k in ("x_origin", "pixel_width", "y_origin", "pixel_height", "offset")})
    ready = G.pyramid(holes, limit_cells=0, tile=tile)
    assert ready.grid is None and ready.low.shape == ready.high.shape
    columns = ["track_id", "obs_ind", "gx", "gy", "found", "mu", "elevation"]
    one, two = (plain(G.ground_points(rays, r).select(*columns).toPandas()) for r in (holes, ready))
    pd.testing.assert_frame_equal(one, two)


def test_nms_of_a_crowded_image(spark):
    """As the fold does, with overlaps of all sizes, negative places, ties and boxes without area; and 100,000 boxes of one image."""
    rng = np.random.default_rng(2)
    rows = [(k % 3, k, int(rng.integers(-300, 300)), int(rng.integers(-300, 300)), int(rng.integers(1, 200)), int(rng.integers(1, 150)), float(rng.integers(0, 20))) for k in range(900)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, x long, y long, w long, h long, score double")
    one, two = (plain(x.toPandas()) for x in (V.nms(df, 0.3), V.nms_crowded(df.repartition(5), 0.3)))
    pd.testing.assert_frame_equal(one, two)
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("det_id"), *((F.xxhash64("id", F.lit(k)) % 20_000).alias(c) for k, c in enumerate("xy")), F.lit(60).alias("w"), F.lit(40).alias("h"), F.rand(3).alias("score"))
    assert 50_000 < V.nms_crowded(many, 0.3).count() < 100_000


@pytest.mark.parametrize("span, warm", [(3, 1), (5, 8), (40, 8), (10**6, 8)])
def test_track_slices_equal_whole_videos(spark, span, warm):
    from fieldlens.plans.tracking import frames

    t = Tables(spark, SF)
    rows = frames(t).filter("video_id < 6 and frame % 50 < 30").withColumns({c: F.col(c) % 90 for c in "xy"})
    one, two = (plain(x.toPandas()) for x in (T.track(rows, patience=3), T.track_slices(rows, span=span, warm=warm, patience=3)))
    pd.testing.assert_frame_equal(one, two)


def test_sketches_are_within_their_bounds(spark):
    t = Tables(spark, SF)
    exact, near = (D.class_histogram(t.annotations, t.categories, error=e).orderBy("category_id").toPandas() for e in (None, 0.02))
    assert (exact["n"] == near["n"]).all() and ((exact["n_images"] - near["n_images"]).abs() <= 0.08 * exact["n_images"].clip(lower=1)).all()
    areas = {c: np.sort(own["area"].to_numpy()) for c, own in t.annotations.select("category_id", F.col("area")).toPandas().groupby("category_id")}
    for r in D.area_distribution(t.annotations, accuracy=100).collect():
        own = areas[r.category_id]
        assert np.searchsorted(own, r.middle, "left") - 1 <= len(own) * 0.51 + 1 and np.searchsorted(own, r.middle, "right") + 1 >= len(own) * 0.49 - 1


def test_repeated_data_rows_and_two_tools_of_a_name(spark, tmp_path):
    """One data row that comes twice with two objects gives one image and four annotations; categories go by feature id."""
    import json

    from fieldlens.operators import labels as L

    box = lambda k, f: {"feature_id": f"o{k}", "feature_schema_id": f, "name": "cow", "bounding_box": {"left": 1.9, "top": 2, "width": 3, "height": 4}}
    row = {"data_row": {"id": "r", "external_id": "a", "row_data": "u", "details": {"dataset_name": "d"}}, "media_attributes": {"height": 5, "width": 6}, "projects": {"p": {"labels": [{"label_details": {"created_at": "now"}, "annotations": {"objects": [box(1, "A"), box(2, "B")]}}]}}}
    (tmp_path / "e.json").write_text(f"{json.dumps(row)}\n{json.dumps(row)}\n")
    tools = [{"featureSchemaId": f, "tool": "rectangle", "name": "cow", "color": "red", "classifications": []} for f in "AB"]
    (tmp_path / "o.json").write_text(json.dumps({"tools": tools, "classifications": []}, indent=1))
    export = spark.read.schema(L.EXPORT).json(str(tmp_path / "e.json"))
    coco = L.to_coco(export, spark.read.text(str(tmp_path / "o.json"), wholetext=True), "p", F.lit(0))
    assert [(r.id, r.coco_url, r.date_captured, r.license) for r in coco.images.collect()] == [(0, "u", "now", 1)]
    assert sorted((r.id, r.image_id, r.category_id, r.x, r.area) for r in coco.annotations.collect()) == [(f"o{k}", 0, k, 1.0, 12.0) for k in (1, 1, 2, 2)]
    assert sorted((r.id, r.name) for r in coco.categories.collect()) == [(1, "cow"), (2, "cow")]


def test_anchors_that_share_names(spark):
    """In blocks of a few rows, and the frames of a name aren't written again for each anchor that has it."""
    from pathlib import Path

    rng = np.random.default_rng(3)
    names = [f"f{k}.jpg" for k in range(9)] + ["/f1", "none.jpg"]
    anchors = [(o, k, names[int(x)]) for o in range(2) for k, x in enumerate(rng.integers(0, len(names), 300))]
    frames = [(o, f, f"a/f{(f * f + o) % 13}.jpg") for o in range(2) for f in range(3000)]
    tables = spark.createDataFrame(anchors, "observation_id long, anchor_ind long, image_name string"), spark.createDataFrame(frames, "observation_id long, frame_ind long, path string")
    at, want = {}, set()
    for o, k, name in anchors:
        ahead = next((f for p, f, path in frames if p == o and f >= at.get(o, 0) and name in path), None)
        if ahead is not None:
            at[o] = ahead
            want.add((o, k, ahead))
    written = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*.parquet"))
    before = written()
    assert {tuple(r) for r in G.anchor_frames(*tables).collect()} == want and written() - before < 200_000
    assert {tuple(r) for r in G.anchor_frames(*tables, most_anchors=40, most_frames=500).collect()} == want and len(want) > 200


@pytest.mark.parametrize("limit", [10**6, 0])
def test_few_rays_go_as_many_do(spark, monkeypatch, limit):
    """One by one, a frame's rays end where they end as arrays, to the last digit, some of them unfound."""
    from fieldlens.plans import mapping as P

    t = Tables(spark, SF)
    rays = P._rays(t).withColumn("obs_ind", F.floor(F.col("obs_ind") / 3)).filter("obs_ind < 200")
    columns = ["track_id", "obs_ind", "col_px", "row_px", "gx", "gy", "found", "mu", "elevation"]
    got = []
    for few in (7, 0):
        monkeypatch.setattr(G, "FEW", few)
        got.append(plain(G.ground_points_carried(rays, P.raster(t), G.Search(most=9), limit_cells=limit, tile=16).select(*columns).toPandas()))
    pd.testing.assert_frame_equal(*got, check_exact=True)
    assert got[0]["found"].astype(str).nunique() == 2


def test_one_ray_goes_on_in_plain_numbers():
    """A hundred thousand looks of single rays take seconds."""
    import time

    n = 10_000
    f = pd.DataFrame({c: np.zeros(n) for c in (*G._INV, "p03", "p13", "p23", "u", "v")} | {c: np.zeros(n) for c in G._NAMES})
    f["i22"], f["mu"], f["high"] = -1.0, 60.0, np.nan
    rays, grid = G._Rays(f), np.full((4, 4), -99.05)
    r = {"x_origin": 0.0, "pixel_width": 1.0, "y_origin": 0.0, "pixel_height": 1.0, "offset": (0.0, 0.0, 0.0)}
    began = time.time()
    for k in range(n):
        rays.follow(k, grid.item, None, r, (4, 4), G.Search())
    assert time.time() - began < 2 and rays.state["found"].all() and abs(rays.state["mu"] - 100.05).max() <= 0.1


def test_a_stream_hands_on_stretches_of_time(spark):
    """Of a batch of an hour no more than a stretch is handled at once; a frame over the border of two is handled once."""

    class Sizes(X.InOrder):
        columns, output, rows_held = (("frame", "long"), ("n", "long")), "video_id long, rows long, first long, last long", 1000

        def own_states(self, handle):
            pass

        def forget(self):
            pass

        def handle(self, rows):
            return [(len(rows), rows[0][0], rows[-1][0])]

    rows = spark.range(3600).select(F.lit(1).cast("long").alias("video_id"), F.floor(F.col("id") / 7).alias("frame"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"))
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("video_id"), *(F.lit(None).cast("long").alias(c) for c in ("frame", "n")), F.timestamp_seconds(F.lit(1_700_100_000)).alias("ts"))
    got = X.drained(X.in_order(X.source(spark, rows, "sizes", closing=end), Sizes(10**8), key="video_id", late="10 minutes"), "sizes").orderBy("first").collect()
    assert sum(r.rows for r in got) == 3600 and max(r.rows for r in got) < 130
    assert all(a.last + 1 == b.first for a, b in zip(got, got[1:]))


def test_a_frame_makes_two_tables_of_overlaps(monkeypatch):
    """Whatever number of boxes and tracks a frame has; with its boxes' overlaps made one by one the tracks are the same."""
    rng, calls, found = np.random.default_rng(5), [], []
    frames = [(rng.uniform(0, 300, (40, 4)) + [0, 0, 30, 30], rng.uniform(size=40)) for _ in range(12)]
    plain = T.iou_table
    monkeypatch.setattr(T, "iou_table", lambda a, b: calls.append(1) or plain(a, b))
    for most in (1000, 5):
        monkeypatch.setattr(T, "MOST_TOGETHER", most, raising=False)
        tracker = T.Tracker()
        found.append([tracker.step(f, np.arange(40) + 100 * f, *own) for f, own in enumerate(frames)])
        assert most < 1000 or len(calls) <= 2 * len(frames)
    assert found[0] == found[1] and any(len(x) > 2 for x in found[0])


@pytest.mark.parametrize("tile", [8, 64])
def test_carried_depth_over_a_large_raster(spark, tile):
    """With tiles that come as flights reach them, the carried search gives what the whole raster gives; frames hold several points."""
    from fieldlens.plans import mapping as P

    t = Tables(spark, SF)
    rays = P._rays(t).withColumn("obs_ind", F.floor(F.col("obs_ind") / 4)).filter("obs_ind < 120")
    raster = P.raster(t)
    rough = G.Raster(raster.cells.withColumn("elev", F.col("elev") + F.col("xr") * 1.5), **{k: getattr(raster, k) for k in ("x_origin", "pixel_width", "y_origin", "pixel_height", "offset")})
    columns = ["track_id", "obs_ind", "col_px", "row_px", "gx", "gy", "found", "mu", "elevation"]
    one, two = (plain(G.ground_points_carried(rays, rough, limit_cells=n, tile=tile).select(*columns).toPandas()) for n in (10**6, 0))
    pd.testing.assert_frame_equal(one, two)
