"""Labeling-export queries, over export documents written from the annotation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.operators import labels as L
from fieldlens.plans.datasets import used_categories
from fieldlens.plans.registry import query
from fieldlens.sources.shared import shared_dir


#: Options nest so deep below each question.
DEPTH = 10


def ontology(t):
    """A tool for each category, in the order of ids, with a question whose first answer opens another, ten levels down; and a
    question of its own at the top. Classes 5 and 6 have tools of one name. Written as JSON and read as text."""
    c = t.categories.join(used_categories(t), "category_id", "left_semi")
    i = F.col("category_id").cast("string")
    node = lambda prefix, *fields: F.struct(F.concat(F.lit(f"{prefix}-"), i).alias("featureSchemaId"), *fields)
    text = lambda name, value: F.lit(value).alias(name)
    none = lambda: F.array().cast("array<struct<featureSchemaId:string>>").alias("options")
    question = lambda prefix, label, *fields: node(prefix, text("instructions", label), text("type", "radio"), *fields)
    inner = none()
    for d in reversed(range(DEPTH)):  # a list holds nodes of two kinds, so each is written as JSON first
        beside = question(f"p{d}", "why?", none()) if d % 2 else node(f"p{d}", text("label", "leaf"))
        own = node(f"o{d}", text("label", f"level {d}"), inner)
        inner = F.array(F.parse_json(F.to_json(own)), F.parse_json(F.to_json(beside))).alias("options")
    shape = F.when(F.col("category_id") % 3 == 1, "line").when(F.col("category_id") % 3 == 2, "point").otherwise("rectangle")
    name = F.when(F.col("category_id") == 6, "kelp").otherwise(F.col("name"))
    tool = node("t", shape.alias("tool"), name.alias("name"), text("color", "#00ff00"), F.array(question("c", "adult?", inner)).alias("classifications"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("category_id", F.to_json(tool).alias("s")))), lambda x: F.parse_json(x["s"]))
    top = F.struct(
        F.lit("top").alias("featureSchemaId"), text("instructions", "weather?"), text("type", "radio"),
        F.array(F.struct(F.lit("top-0").alias("featureSchemaId"), text("label", "rain"))).alias("options"),
    )
    path = shared_dir(t.spark, "ontology")
    c.agg(F.to_json(F.struct(ordered.alias("tools"), F.array(F.first(top)).alias("classifications"))).alias("value")).write.text(path)
    return t.spark.read.text(path)


def export(t):
    """Written as compressed JSON lines, and read with the export's schema. Boxes, lines, points, polygons and masks take turns by id.
    Each fiftieth data row comes twice."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    turn = F.col("id") % 5
    obj = F.struct(
        F.col("id").cast("string").alias("feature_id"), F.concat(F.lit("t-"), F.col("category_id").cast("string")).alias("feature_schema_id"), "name",
        F.when(turn == 0, F.struct(x.alias("left"), y.alias("top"), w.alias("width"), h.alias("height"))).alias("bounding_box"),
        F.when(turn == 1, F.array(at(x, y), at(x + w, y + h))).alias("line"), F.when(turn == 2, at(x, y)).alias("point"),
        F.when(turn == 3, F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))).alias("polygon"),
        F.when(turn == 4, F.struct(F.concat(F.lit("mask/"), F.col("id").cast("string")).alias("url"))).alias("mask"),
    )
    named = t.annotations.join(F.broadcast(t.categories), "category_id")
    per = named.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", obj.alias("o")))), lambda s: s["o"]).alias("objects"))
    label = F.array(F.struct(F.struct(F.lit("2024-01-01T00:00:00Z").alias("created_at")).alias("label_details"), F.struct("objects").alias("annotations")))
    none = F.array().cast(f"array<{L.LABEL}>")
    rows = t.images.join(per, "image_id", "left").select(
        F.struct(
            F.col("image_id").cast("string").alias("id"), F.col("file_name").alias("external_id"), F.concat(F.lit("s3://"), F.col("file_name")).alias("row_data"),
            F.struct(F.lit("set").alias("dataset_name")).alias("details"),
        ).alias("data_row"),
        F.struct("height", "width").alias("media_attributes"), F.create_map(
            F.lit("p1"), F.struct(F.when(F.col("objects").isNotNull(), label).otherwise(none).alias("labels")),
        ).alias("projects"),
    )
    path = shared_dir(t.spark, "export")
    twice = F.array_repeat(F.lit(1), F.when(F.col("data_row.id").cast("long") % 50 == 0, 2).otherwise(1))
    rows.select("*", F.explode(twice)).drop("col").write.json(path, compression="gzip")
    return t.spark.read.schema(L.EXPORT).json(path)


_IMAGES = "SELECT *, unnest(range(CASE WHEN image_id % 50 = 0 THEN 2 ELSE 1 END)) AS copy FROM fx_images"
_OBJ = f"SELECT *, row_number() OVER (PARTITION BY image_id, copy ORDER BY id) - 1 AS position FROM fx_annotations JOIN ({_IMAGES}) USING (image_id)"


@query("export_scan", f"SELECT image_id::varchar AS data_row_id, count(*) AS n FROM ({_OBJ}) GROUP BY image_id, copy")
def export_scan(t):
    return export(t).select(F.col("data_row.id").alias("data_row_id"), F.size(L.objects_of("p1")).cast("long").alias("n")).filter("n > 0")


@query("drop_unlabeled_rows", f"SELECT image_id::varchar AS data_row_id FROM ({_IMAGES}) WHERE image_id IN (SELECT image_id FROM fx_annotations)")
def drop_unlabeled(t):
    return L.labeled(export(t), "p1").select(F.col("data_row.id").alias("data_row_id"))


_NODES = f"""WITH c AS (SELECT category_id AS i, CASE WHEN category_id = 6 THEN 'kelp' ELSE name END AS name FROM fx_categories WHERE category_id IN (SELECT category_id FROM fx_annotations)),
shapes AS (SELECT *, CASE i % 3 WHEN 1 THEN 'line' WHEN 2 THEN 'point' ELSE 'rectangle' END AS shape FROM c),
levels AS (SELECT *, list_concat([0, i, 0], list_transform(range(d), lambda x: 0)) AS stem, list_concat(['t-' || i, 'c-' || i], list_transform(range(d), lambda x: 'o' || x || '-' || i)) AS above
  FROM c, (SELECT unnest(range({DEPTH})) AS d)),
nodes AS (SELECT 't-' || i AS schema_id, name, 'tool' AS kind, shape AS type, '#00ff00' AS color, []::varchar[] AS parents, [0, i] AS path FROM shapes
  UNION ALL SELECT 'c-' || i, 'adult?', 'classification', 'radio', NULL, ['t-' || i], [0, i, 0] FROM c
  UNION ALL SELECT 'o' || d || '-' || i, 'level ' || d, 'option', 'branch_option', NULL, above, list_append(stem, 0) FROM levels
  UNION ALL SELECT 'p' || d || '-' || i, CASE WHEN d % 2 = 1 THEN 'why?' ELSE 'leaf' END, CASE WHEN d % 2 = 1 THEN 'classification' ELSE 'option' END,
    CASE WHEN d % 2 = 1 THEN 'radio' ELSE 'leaf_option' END, NULL, above, list_append(stem, 1) FROM levels
  UNION ALL SELECT 'top', 'weather?', 'classification', 'radio', NULL, [], [1, 0] UNION ALL SELECT 'top-0', 'rain', 'option', 'leaf_option', NULL, ['top'], [1, 0, 0]),
idx AS (SELECT *, row_number() OVER (ORDER BY path) AS encoded FROM nodes)"""


@query("ontology_index", f"{_NODES} SELECT schema_id, name, kind, type, color, array_to_string(parents, '/') AS parents, encoded FROM idx")
def ontology_index(t):
    return L.ontology_index(ontology(t)).drop("path").withColumn("parents", F.array_join("parents", "/"))


_KIND = "['box', 'line', 'point', 'polygon', 'mask'][id % 5 + 1]"
_BOXED = ", ".join(f"CASE WHEN k IN ('box', 'polygon') THEN {v} END AS {n}" for v, n in (("x::double", "x"), ("y::double", "y"), ("w::double", "w"), ("h::double", "h"), ("(w * h)::double", "area"), ("0", "iscrowd")))
_SHAPES = (
    "CASE WHEN k IN ('box', 'polygon') THEN concat_ws(' ', x, y, x + w, y, x + w, y + h, x, y + h) END AS segmentation, CASE k WHEN 'line' THEN concat_ws(' ', x, y, 2, "
    "x + w, y + h, 2) WHEN 'point' THEN concat_ws(' ', x, y, 2) END AS keypoints, CASE k WHEN 'line' THEN 2 WHEN 'point' THEN 1 END AS num_keypoints"
)
_OBJECTS = f"SELECT a.*, idx.encoded AS category, {_KIND} AS k FROM ({_OBJ}) a JOIN idx ON idx.schema_id = 't-' || a.category_id"


def _numbers(df, *columns):
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), " ") for c in columns})


@query("objects_to_annotations",
    f"{_NODES} SELECT image_id::varchar AS data_row_id, position, id::varchar AS id, 't-' || category_id AS feature_schema_id, k AS kind, category AS category_id, {_BOXED}, {_SHAPES} "
    f"FROM ({_OBJECTS}) WHERE k <> 'mask'")
def objects(t):
    return _numbers(L.annotations_of(export(t), "p1", L.ontology_index(ontology(t))), "segmentation", "keypoints")


@query("mask_rejects", f"SELECT image_id::varchar AS data_row_id, 'mask/' || id AS url FROM ({_OBJ}) WHERE id % 5 = 4")
def masks(t):
    return L.masks_of(export(t), "p1")


_POINTS = "CASE WHEN kind = 'tool' AND type = 'line' THEN list_transform(range(1, n + 1), lambda i: 'line_' || i) WHEN kind = 'tool' AND type = 'point' THEN ['point'] ELSE [] END"
_BONES = "CASE WHEN kind = 'tool' AND type = 'line' THEN list_transform(range(0, n), lambda i: i || '-' || (i + 1)) WHEN kind = 'tool' AND type = 'point' THEN ['0-0'] ELSE [] END"
_CATS = (
    "SELECT encoded AS id, name, CASE WHEN kind = 'tool' THEN name ELSE (SELECT p.name FROM idx p WHERE p.schema_id = idx.parents[1]) END "
    f"AS supercategory, array_to_string({_POINTS}, ',') AS keypoints, array_to_string({_BONES}, ',') AS skeleton FROM idx, (SELECT max(CASE "
    "WHEN id % 5 = 1 THEN 2 ELSE 0 END)::bigint AS n FROM fx_annotations JOIN fx_images USING (image_id)) WHERE kind = 'tool' OR len(parents) "
    "= 2"
)


def _flat(df):
    bones = F.array_join(F.transform("skeleton", lambda b: F.array_join(F.transform(b, lambda i: i.cast("string")), "-")), ",")
    return df.withColumns({"keypoints": F.array_join("keypoints", ","), "skeleton": bones})


@query("categories_from_ontology", f"{_NODES} {_CATS}")
def categories(t):
    index = L.ontology_index(ontology(t))
    return _flat(L.categories_of(L.annotations_of(export(t), "p1", index), index))


def _coco(t):
    night = (F.col("data_row.id").cast("long") % 3 == 0).alias("night")
    return L.to_coco(export(t), ontology(t), "p1", F.col("data_row.id").cast("long"), extra={"night": night})


_PLACES = (
    f"SELECT image_id, min(number) AS number FROM (SELECT image_id, row_number() OVER (ORDER BY image_id, copy) - 1 AS number FROM ({_IMAGES}) WHERE image_id IN (SELECT image_id FROM "
    "fx_annotations)) GROUP BY image_id"
)


@query("export_to_coco",
    "SELECT number AS id, 1 AS license, concat('set-', file_name) AS file_name, width, height, '2024-01-01T00:00:00Z' AS date_captured, 's3://' || file_name AS coco_url, "
    f"image_id % 3 = 0 AS night FROM fx_images JOIN ({_PLACES}) USING (image_id)")
def export_to_coco(t):
    return _coco(t).images.drop("data_row_id")


@query("export_to_coco_annotations",
    f"{_NODES}, cats AS ({_CATS}), named AS (SELECT *, row_number() OVER (ORDER BY name, id) AS new_id FROM cats) SELECT number AS image_id, "
    f"position, o.id::varchar AS id, 't-' || category_id AS feature_schema_id, k AS kind, new_id AS category_id, {_BOXED}, {_SHAPES} FROM ({_OBJECTS}) o JOIN ({_PLACES}) i USING (image_id) "
    "JOIN (SELECT id AS cid, new_id FROM named) n ON n.cid = o.category WHERE k <> 'mask'")
def export_annotations(t):
    return _numbers(_coco(t).annotations, "segmentation", "keypoints")


@query("export_to_coco_categories", f"{_NODES}, cats AS ({_CATS}) SELECT row_number() OVER (ORDER BY name, id) AS id, name, supercategory, keypoints, skeleton FROM cats")
def export_categories(t):
    return _flat(_coco(t).categories)
