"""Box queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlens.functions import boxes as B
from fieldlens.operators import boxes as O
from fieldlens.plans.registry import query

CORNERS = ("x1", "y1", "x2", "y2")
_XYXY = "x AS x1, y AS y1, x + w AS x2, y + h AS y2"


def _xywh():
    return [F.col(c) for c in "xywh"]


def _box(t):
    return t.annotations.withColumns(dict(zip(CORNERS, B.corners(*_xywh()), strict=True)))


@query("box_xywh_to_xyxy", f"SELECT id, {_XYXY} FROM fx_annotations")
def xywh_to_xyxy(t):
    return _box(t).select("id", *CORNERS)


@query("box_xyxy_to_xywh", "SELECT id, x, y, w, h FROM fx_annotations")
def xyxy_to_xywh(t):
    return _box(t).select("id", *(c.alias(n) for n, c in zip("xywh", B.sized(*map(F.col, CORNERS)), strict=True)))


@query("box_area", "SELECT id, w * h AS box_area FROM fx_annotations")
def area(t):
    return t.annotations.select("id", (F.col("w") * F.col("h")).alias("box_area"))


@query("box_center", "SELECT id, (x + (x + w)) / 2.0::double AS cx, (y + (y + h)) / 2.0::double AS cy FROM fx_annotations")
def center(t):
    return _box(t).select("id", ((F.col("x1") + F.col("x2")) / 2.0).alias("cx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("cy"))


_CLIP = "greatest(0, least(x, 320)) AS x1, greatest(0, least(y, 240)) AS y1, greatest(0, least(x + w, 320)) AS x2, greatest(0, least(y + h, 240)) AS y2"


@query("box_clip", f"SELECT id, {_CLIP} FROM fx_annotations")
def box_clip(t):
    return O.clip_boxes(_box(t), 320, 240).select("id", *CORNERS)


@query("drop_degenerate_boxes", f"SELECT * FROM (SELECT id, iscrowd, {_CLIP} FROM fx_annotations) WHERE x2 > x1 AND y2 > y1")
def degenerate(t):
    return O.drop_degenerate(O.clip_boxes(_box(t), 320, 240)).select("id", "iscrowd", *CORNERS)


@query("box_to_polygon",
    "SELECT id, p[1] AS p0, p[2] AS p1, p[3] AS p2, p[4] AS p3, p[5] AS p4, p[6] AS p5, p[7] AS p6, p[8] AS p7 FROM (SELECT id, [x, y, "
    "x + w, y, x + w, y + h, x, y + h] AS p FROM fx_annotations)")
def to_polygon(t):
    return t.annotations.withColumn("p", B.polygon(*_xywh())).select("id", *(F.get("p", F.lit(k)).alias(f"p{k}") for k in range(8)))


_IOU = (
    "CASE WHEN least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y) THEN (least(a.x + "
    "a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) ELSE 0 END"
)
_PAIRS = (
    f"SELECT a.image_id, a.id AS id_a, b.id AS id_b, {_IOU} AS i, a.w * a.h + b.w * b.h AS s FROM fx_annotations a JOIN fx_annotations b "
    "ON a.image_id = b.image_id AND a.id < b.id"
)


@query("box_iou", f"SELECT id_a, id_b, round(i::double / (s - i), 6) AS iou FROM ({_PAIRS} AND b.id = a.id + 1)")
def box_iou(t):
    a, b = t.annotations.alias("a"), t.annotations.alias("b")
    side = lambda s: [F.col(f"{s}.{c}") for c in "xywh"]
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("b.id") == F.col("a.id") + 1))
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(B.iou(side("a"), side("b")), 6).alias("iou"))


@query("iou_self_pairs", f"SELECT image_id, id_a, id_b, round(i::double / (s - i), 6) AS iou FROM ({_PAIRS}) WHERE i > 0")
def self_pairs(t):
    return O.self_pairs(t.annotations).withColumn("iou", F.round("iou", 6))


@query("iou_self_pairs_grid", f"SELECT image_id, id_a, id_b, round(i::double / (s - i), 6) AS iou FROM ({_PAIRS}) WHERE i > 0")
def self_pairs_grid(t):
    return O.self_pairs_grid(t.annotations, cell=256).withColumn("iou", F.round("iou", 6))


@query("iou_distribution", f"SELECT least(floor(10 * i::double / (s - i)), 9)::bigint AS bin, count(*) AS n FROM ({_PAIRS}) WHERE i > 0 GROUP BY 1")
def iou_distribution(t):
    return O.self_pairs(t.annotations).groupBy(F.least(F.floor(10 * F.col("iou")), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("scale_boxes",
    "SELECT id, trunc(x * 0.37::double)::bigint AS x, trunc(y * 0.37::double)::bigint AS y, trunc(w * 0.37::double)::bigint AS w, trunc(h "
    "* 0.37::double)::bigint AS h, area FROM fx_annotations")
def scale_boxes(t):
    return t.annotations.select("id", *(B.scaled(F.col(c), 0.37).alias(c) for c in "xywh"), "area")


@query("scale_images",
    "SELECT image_id, ceil(width * 0.37::double)::bigint AS width, ceil(height * 0.37::double)::bigint AS height, concat('scaled-0.37-', "
    "file_name) AS file_name FROM fx_images")
def scale_images(t):
    return O.scale_images(t.images, 0.37).select("image_id", "width", "height", "file_name")


_SIZED = (
    "SELECT a.id, a.x, a.y, a.w, a.h, i.width, i.height, least(300.0::double / least(i.height, i.width), 500.0::double / greatest(i.height, "
    "i.width)) AS r FROM fx_annotations a JOIN fx_images i USING (image_id)"
)


def _resized(r: str) -> str:
    return "round(x * (trunc(width * r) / width), 9) AS x1, round(y * (trunc(height * r) / height), 9) AS y1, round((x + w) * (trunc(width * r) / width), 9) AS x2, round((y + h) * (trunc(height * r) / height), 9) AS y2".replace(" r)", f" {r})")


@query("resize_boxes_ratio", f"SELECT id, {_resized('r')} FROM ({_SIZED})")
def resize(t):
    on = _box(t).join(t.images.select("image_id", "width", "height"), "image_id")
    return O.resize_boxes(on, B.resize_ratio(F.col("width"), F.col("height"), 300, 500)).select("id", *(F.round(c, 9).alias(c) for c in CORNERS))


@query("scale_jitter_boxes",
    f"SELECT id, {_resized('j')} FROM (SELECT *, least(400.0::double / height, 600.0::double / width) * (0.5 + (id % 16) / 10.0)::double "
    f"AS j FROM ({_SIZED}))")
def jitter(t):
    on = _box(t).join(t.images.select("image_id", "width", "height"), "image_id")
    return O.jitter_boxes(on, F.lit(0.5) + (F.col("id") % 16) / 10.0, 600, 400).select("id", *(F.round(c, 9).alias(c) for c in CORNERS))


_WIDE = "640 + image_id % 3 * 100"


@query("hflip_boxes",
    f"SELECT id, CASE WHEN image_id % 2 = 0 THEN {_WIDE} - (x + w) ELSE x END AS x1, y AS y1, CASE WHEN image_id % 2 = 0 THEN {_WIDE} - x ELSE x + w END AS x2, y + h AS y2 FROM fx_annotations")
def hflip(t):
    """Images of three widths, each second one flipped."""
    return O.hflip_boxes(_box(t), F.lit(640) + F.col("image_id") % 3 * 100, F.col("image_id") % 2 == 0).select("id", *CORNERS)


_POINTS = "list_transform(range(0, 17), lambda i: {'x': x + i * w / 16.0::double, 'y': y + i * h / 16.0::double, 'v': (i % 3)::bigint})"


def keypoints():
    x, y, w, h = _xywh()
    return F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct((x + i * w / 16.0).alias("x"), (y + i * h / 16.0).alias("y"), (i % 3).cast("long").alias("v")))


def each_keypoint(before: str = "") -> list:
    """The same as columns."""
    x, y, w, h = (F.col(before + c) for c in "xywh")
    return [{"x": x + i * w / 16.0, "y": y + i * h / 16.0, "v": F.lit(i % 3)} for i in range(17)]


@query(
    "hflip_keypoints",
    f"SELECT id, j - 1 AS k, round(CASE WHEN q.v = 0 THEN 0 ELSE 640 - q.x END, 6) AS px, round(CASE WHEN q.v = 0 THEN 0 ELSE q.y END, 6) AS py, q.v AS v FROM (SELECT id, j, p[[0,2,1,4,3,6,5,8,7,10,9,12,11,14,13,16,15][j] + 1] AS q FROM (SELECT id, {_POINTS} AS p FROM fx_annotations), range(1, 18) r(j))",
)
def flip_points(t):
    out = t.annotations.select("id", F.posexplode(B.flip_keypoints(keypoints(), F.lit(640.0))).alias("k", "q"))
    return out.select("id", F.col("k").cast("long").alias("k"), F.round("q.x", 6).alias("px"), F.round("q.y", 6).alias("py"), F.col("q.v").alias("v"))


_CROP = "greatest(0, least(x - 100, 300)) AS x1, greatest(0, least(y - 80, 200)) AS y1, greatest(0, least(x + w - 100, 300)) AS x2, greatest(0, least(y + h - 80, 200)) AS y2"


@query("crop_boxes", f"SELECT * FROM (SELECT id, {_CROP} FROM fx_annotations) WHERE x2 > x1 AND y2 > y1")
def crop(t):
    return O.crop_boxes(_box(t), F.lit(100), F.lit(80), 300, 200).select("id", *CORNERS)


@query("zoom_out_boxes",
    "SELECT a.id, trunc(i.width * 1.5::double)::bigint AS canvas_w, trunc(i.height * 1.5::double)::bigint AS canvas_h, x + 30 AS x1, y "
    "+ 20 AS y1, x + w + 30 AS x2, y + h + 20 AS y2 FROM fx_annotations a JOIN fx_images i USING (image_id)")
def zoom_out(t):
    on = _box(t).join(t.images.select("image_id", "width", "height"), "image_id")
    return on.select(
        "id", (F.col("width") * F.lit(1.5)).cast("long").alias("canvas_w"), (F.col("height") * F.lit(1.5)).cast("long").alias("canvas_h"),
        *((F.col(c) + d).alias(c) for c, d in zip(CORNERS, (30, 20, 30, 20), strict=True)),
    )


_TRIALS = (
    "SELECT image_id, k, (image_id * 13 + k * 97) % 200 AS cl, (image_id * 7 + k * 53) % 150 AS ct, (image_id * 13 + k * 97) % 200 + 300 "
    "AS cr, (image_id * 7 + k * 53) % 150 + 220 AS cb FROM fx_images, range(0, 4) r(k)"
)


@query(
    "iou_crop_boxes",
    f"""WITH trials AS ({_TRIALS}),
inside AS (SELECT a.id, a.image_id, t.k, t.cl, t.ct, t.cr, t.cb, x, y, w, h, (CASE WHEN least(x + w, cr) > greatest(x, cl) AND least(y + h, cb) > greatest(y, ct) THEN (least(x + w, cr) - greatest(x, cl)) * (least(y + h, cb) - greatest(y, ct)) ELSE 0 END) AS i
  FROM fx_annotations a JOIN trials t USING (image_id) WHERE 2 * x + w > 2 * cl AND 2 * x + w < 2 * cr AND 2 * y + h > 2 * ct AND 2 * y + h < 2 * cb),
good AS (SELECT image_id, k FROM inside GROUP BY image_id, k HAVING max(i::double / (w * h + (cr - cl) * (cb - ct) - i)) >= 0.15),
best AS (SELECT image_id, min(k) AS k FROM good GROUP BY image_id)
SELECT id, k, greatest(0, least(x - cl, cr - cl)) AS x1, greatest(0, least(y - ct, cb - ct)) AS y1, greatest(0, least(x + w - cl, cr - cl)) AS x2, greatest(0, least(y + h - ct, cb - ct)) AS y2 FROM inside JOIN best USING (image_id, k)""",
)
def iou_crop(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    base = t.images.select("image_id", k).withColumn("k", F.col("k").cast("long"))
    trials = base.withColumns({
        "cl": (F.col("image_id") * 13 + F.col("k") * 97) % 200, "ct": (F.col("image_id") * 7 + F.col("k") * 53) % 150,
    }).withColumns({"cr": F.col("cl") + 300, "cb": F.col("ct") + 220})
    return O.iou_crop(_box(t), trials, 0.15).select("id", "k", *CORNERS)


_WINDOW = (
    "CASE WHEN {size} = {crop} THEN 0 ELSE trunc((greatest(0, least(0.999, (({v2}) - {crop} + 200)::double / ({size} - {crop}))) + 0.25 "
    "* (greatest(0, least(0.999, (({v1}) - 200)::double / ({size} - {crop}))) - greatest(0, least(0.999, (({v2}) - {crop} + 200)::double "
    "/ ({size} - {crop}))))) * ({size} - {crop})) END"
)


@query(
    "bbox_crop_window",
    "WITH b AS (SELECT *, 640 - image_id % 3 * 200 AS width FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (id * 7919) % 1009, id) AS rn FROM fx_annotations) WHERE rn = 1) "
    f"SELECT image_id, id, CASE WHEN width >= 300 THEN {_WINDOW.format(size='width', crop=300, v1='x', v2='x + w')}::bigint END AS crop_left, "
    f"CASE WHEN width >= 300 THEN {_WINDOW.format(size=480, crop=480, v1='y', v2='y + h')}::bigint END AS crop_top, width < 300 AS too_large FROM b",
)
def crop_window(t):
    """Images of three widths, one of which is less than the crop's."""
    first = Window.partitionBy("image_id").orderBy((F.col("id") * 7919) % 1009, "id")
    one = _box(t).withColumn("rn", F.row_number().over(first)).filter("rn = 1").withColumns({"width": F.lit(640) - F.col("image_id") % 3 * 200, "height": F.lit(480)})
    return O.box_crops(one, 300, 480, F.lit(0.25)).select("image_id", "id", "crop_left", "crop_top", "too_large")


def _drawn(text: str) -> str:
    return f"(('0x' || substr(md5(concat('7:', {text})), 1, 12))::bigint::double / 281474976710656.0::double)"


@query("crop_plan", f"SELECT image_id, floor({_drawn("'t:', image_id")} * 280)::bigint AS crop_top, floor({_drawn("'l:', image_id")} * 340)::bigint AS crop_left FROM fx_images")
def crop_plan(t):
    return O.crop_plan(t.images, 300, 200, seed=7).select("image_id", "crop_top", "crop_left")


def _around(salt: str, room: int) -> str:
    deviate = f"sqrt(-2 * ln(1 - {_drawn(f"'{salt}r:', image_id, ':', k")})) * cos(2 * pi() * {_drawn(f"'{salt}a:', image_id, ':', k")})"
    tried = f"list_transform(range(1, 65), lambda k: floor({room} * (0.5::double + 0.25::double * {deviate}))::bigint)"
    return f"coalesce(list_filter({tried}, lambda v: v >= 0 AND v < {room})[1], {room // 2})"


@query("crop_plan_centred", f"SELECT image_id, {_around('t', 280)} AS crop_top, {_around('l', 340)} AS crop_left FROM fx_images")
def crop_plan_centred(t):
    return O.crop_plan(t.images, 300, 200, seed=7, spread=0.25).select("image_id", "crop_top", "crop_left")


@query("score_filter", "SELECT det_id, score FROM fx_detections WHERE score >= 0.7")
def score_filter(t):
    return t.detections.filter(F.col("score") >= 0.7).select("det_id", "score")


@query("confidence_band", "SELECT CASE WHEN score < 0.5 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM fx_detections WHERE score >= 0.05 GROUP BY 1")
def confidence_band(t):
    return O.confidence_band(t.detections).groupBy("band").agg(F.count("*").alias("n"))


@query("non_crowd", "SELECT id FROM fx_annotations WHERE iscrowd = 0")
def non_crowd(t):
    return t.annotations.filter("iscrowd = 0").select("id")


@query("transform_chain", f"SELECT * FROM (SELECT id, greatest(0, least(640 - (x + w) - 100, 300)) AS x1, greatest(0, least(y - 80, 200)) AS y1, greatest(0, least(640 - x - 100, 300)) AS x2, greatest(0, least(y + h - 80, 200)) AS y2 FROM fx_annotations) WHERE x2 > x1 AND y2 > y1")
def chain(t):
    steps = [lambda d: d.withColumns({"x1": F.lit(640) - F.col("x2"), "x2": F.lit(640) - F.col("x1")}), lambda d: O.crop_boxes(d, F.lit(100), F.lit(80), 300, 200)]
    return O.chain(_box(t), steps).select("id", *CORNERS)


@query("extra_columns", "SELECT image_id, width * height AS pixels FROM fx_images")
def extra(t):
    return O.chain(t.images, [lambda d: d.withColumn("pixels", F.col("width") * F.col("height"))]).select("image_id", "pixels")
