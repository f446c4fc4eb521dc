"""Labeling-export conversion: export rows, ontologies, and annotations made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions import geometry as G
from fieldlens.functions.names import export_file
from fieldlens.operators.dataset import alphabetized, remap, renumber
from fieldlens.sources.coco import Coco
from fieldlens.sources.shared import cut, small

POINT = "struct<x:double,y:double>"
BOX = "struct<left:double,top:double,width:double,height:double>"
OBJECT = f"struct<feature_id:string,feature_schema_id:string,name:string,bounding_box:{BOX},line:array<{POINT}>,point:{POINT},polygon:array<{POINT}>,mask:struct<url:string>>"
LABEL = f"struct<label_details:struct<created_at:string>,annotations:struct<objects:array<{OBJECT}>>>"
EXPORT = (
    "data_row struct<id:string,external_id:string,row_data:string,details:struct<dataset_name:string>>, media_attributes struct<height:int,width:int>, "
    f"projects map<string,struct<labels:array<{LABEL}>>>"
)


def objects_of(project: str) -> Column:
    return F.get(F.col("projects")[project]["labels"], F.lit(0))["annotations"]["objects"]


def labeled(export: DataFrame, project: str) -> DataFrame:
    """Rows whose first label in the project has an object."""
    return export.filter(F.size(F.coalesce(objects_of(project), F.array().cast(f"array<{OBJECT}>"))) > 0)


def ontology_index(ontology: DataFrame) -> DataFrame:
    """(schema_id, name, kind, type, color, parents, path, encoded) of every node of an ontology (value: its JSON), numbered
    from 1 in the order of a walk, parents first: the tools with all that is below them, then the classifications at the top.

    A node with a tool is a tool, over classifications; one with instructions a classification, over options; any other an
    option, over options. type is the tool's or classification's own; of options it is branch_option if they have a list of
    options, be it empty, else leaf_option. parents are the schema ids from the top down to the node's parent. Levels are
    opened as long as there are any, in a recursive query (whose depth spark.sql.cteRecursionLevelLimit bounds: deeper ones
    raise an error). An ontology is one small document.
    """
    top = ontology.select(F.explode(F.array(*(
        F.struct(F.lit(k).alias("first"), F.variant_get(F.parse_json("value"), f"$.{n}", "array<variant>").alias("nodes")) for k, n in enumerate(("tools", "classifications"))
    ))).alias("g")).select("g.first", "g.nodes")
    walk = ontology.sparkSession.sql("""WITH RECURSIVE walk(path, parents, schema_id, node) AS (
          SELECT array(first, t.pos), CAST(array() AS array<string>), variant_get(t.node, '$.featureSchemaId', 'string'), t.node
          FROM {top} LATERAL VIEW posexplode(nodes) t AS pos, node
          UNION ALL
          SELECT concat(path, array(t.pos)), concat(parents, array(schema_id)), variant_get(t.below, '$.featureSchemaId', 'string'), t.below
          FROM walk LATERAL VIEW posexplode(coalesce(variant_get(node, '$.classifications', 'array<variant>'), variant_get(node, '$.options', 'array<variant>'))) t AS pos, below
        ) SELECT * FROM walk""", top=top)
    get = lambda name: F.variant_get("node", f"$.{name}", "string")
    has = lambda name: F.variant_get("node", f"$.{name}", "variant").isNotNull()
    kind = F.when(has("tool"), "tool").when(has("instructions"), "classification").otherwise("option")
    option = F.when(has("options"), "branch_option").otherwise("leaf_option")
    return walk.select(
        "schema_id", F.when(has("tool"), get("name")).when(has("instructions"), get("instructions")).otherwise(get("label")).alias("name"), kind.alias("kind"),
        F.when(has("tool"), get("tool")).when(has("instructions"), get("type")).otherwise(option).alias("type"), F.when(has("tool"), get("color")).alias("color"), "parents", "path",
    ).withColumn("encoded", F.row_number().over(Window.orderBy("path")).cast("long"))


def annotations_of(export: DataFrame, project: str, index: DataFrame) -> DataFrame:
    """A row for each object that has geometry: (data_row_id, position, id, feature_schema_id, kind, category_id, x, y, w, h,
    area, iscrowd, segmentation, keypoints, num_keypoints).

    The first of box, line, point and polygon that is there counts. A box has whole numbers (truncated) but for its area, and
    its corners as segmentation; a polygon its ring, bounds and area; a line and a point their places as keypoints, all
    visible, and no box. Masks are left out (masks_of has them). The category is the encoded number of the object's feature;
    null where the index doesn't have it.
    """
    rows = labeled(export, project).select(F.col("data_row.id").alias("data_row_id"), F.posexplode(objects_of(project)).alias("position", "o"))
    return _geometry(rows, index)


def _geometry(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (..., position, o) with what annotations_of has of the object o in its place."""
    kind = F.when(F.col("o.bounding_box").isNotNull(), "box").when(F.col("o.line").isNotNull(), "line").when(F.col("o.point").isNotNull(), "point").when(F.col("o.polygon").isNotNull(), "polygon").otherwise("mask")
    bounds = G.polygon_bounds_area(F.col("o.polygon"))
    box = [F.col(f"o.bounding_box.{c}").cast("long").cast("double") for c in ("left", "top", "width", "height")]
    of = lambda b, p: F.when(F.col("kind") == "box", b).when(F.col("kind") == "polygon", p)
    x, y, w, h = box
    flat = lambda points: F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))
    seen = F.coalesce(F.when(F.col("kind") == "line", F.col("o.line")), F.when(F.col("kind") == "point", F.array("o.point")))
    values = {
        **{c: of(box[k], bounds[k]) for k, c in enumerate("xywh")}, "area": of(F.col("o.bounding_box.width") * F.col("o.bounding_box.height"), bounds[4]), "iscrowd": of(F.lit(0), F.lit(0)),
        "segmentation": of(F.array(x, y, x + w, y, x + w, y + h, x, y + h), flat(F.col("o.polygon"))),
        "keypoints": F.flatten(F.transform(seen, lambda p: F.array(p["x"], p["y"], F.lit(2.0)))), "num_keypoints": F.size(seen).cast("long"),
    }
    values["num_keypoints"] = F.when(seen.isNotNull(), values["num_keypoints"])
    features = index.select(F.col("schema_id").alias("feature_schema_id"), F.col("encoded").alias("category_id"))
    own = [c for c in rows.columns if c not in ("position", "o")]
    shaped = rows.withColumn("kind", kind).filter("kind <> 'mask'").withColumn("feature_schema_id", F.col("o.feature_schema_id"))
    return shaped.join(small(features), "feature_schema_id", "left").select(
        *own, F.col("position").cast("long").alias("position"), F.col("o.feature_id").alias("id"), "feature_schema_id", "kind", "category_id", *(v.alias(n) for n, v in values.items()),
    )


def masks_of(export: DataFrame, project: str) -> DataFrame:
    rows = labeled(export, project).select(F.col("data_row.id").alias("data_row_id"), F.explode(objects_of(project)).alias("o"))
    return rows.filter(F.col("o.mask").isNotNull()).select("data_row_id", F.col("o.mask.url").alias("url"))


def images_of(export: DataFrame, project: str, order: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(data_row_id, id, license, file_name, height, width, date_captured, coco_url, extra...): one for each data row.

    id is the row's position from 0 among the rows with labels, in the given order. A data row that comes again (with another
    label) takes up a position but is no image of its own: its first place counts. extra are columns of the export row that
    images get under the names given.
    """
    name = export_file(F.col("data_row.details.dataset_name"), F.col("data_row.external_id"))
    created = F.get(F.col("projects")[project]["labels"], F.lit(0))["label_details"]["created_at"]
    fields = {
        "license": F.lit(1), "file_name": name, "height": F.col("media_attributes.height"), "width": F.col("media_attributes.width"), "date_captured": created,
        "coco_url": F.col("data_row.row_data"), **(extra or {}),
    }
    rows = labeled(export, project).select(F.col("data_row.id").alias("data_row_id"), order.alias("__o"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("image"))
    placed = renumber(cut(rows, "labeled"), ["__o", "data_row_id"], "id", 0)  # bounds are sampled from it first
    return placed.groupBy("data_row_id").agg(F.min("id").alias("id"), F.min_by("image", "id").alias("image")).select("data_row_id", "id", "image.*")


def keypoint_arrays(n: Column) -> tuple[Column, Column]:
    """(keypoints, skeleton) of a line of n points: their names, and the pairs (0, 1) ... (n - 1, n) that bones join."""
    names = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.concat(F.lit("line_"), i.cast("string")))
    bones = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.array(i, i + 1))).otherwise(F.array().cast("array<array<bigint>>"))
    return F.when(n > 0, names).otherwise(F.array().cast("array<string>")).alias("keypoints"), bones.alias("skeleton")


def categories_of(annotations: DataFrame, index: DataFrame) -> DataFrame:
    """(id, name, supercategory, keypoints, skeleton) of an ontology's nodes that are categories.

    A line has as many key points as the longest line of all annotations, a point one, other tools none. Of what is no tool,
    only nodes with exactly two parents are categories, under the name of the first of them.
    """
    most = annotations.agg(F.coalesce(F.max(F.when(F.col("kind") == "line", F.col("num_keypoints"))), F.lit(0)).cast("long").alias("n"))
    names = index.select(F.col("schema_id").alias("__s"), F.col("name").alias("__n"))
    kept = index.filter((F.col("kind") == "tool") | (F.size("parents") == 2)).withColumn("__first", F.get("parents", F.lit(0)))
    on = kept.join(small(names), F.col("__first") == F.col("__s"), "left").join(F.broadcast(most))
    n = F.when(F.col("kind") != "tool", 0).when(F.col("type") == "line", F.col("n")).otherwise(0).cast("long")
    lines, bones = keypoint_arrays(n)
    point = (F.col("kind") == "tool") & (F.col("type") == "point")
    keypoints = F.when(point, F.array(F.lit("point"))).otherwise(lines).alias("keypoints")
    skeleton = F.when(point, F.array(F.array(F.lit(0), F.lit(0)).cast("array<bigint>"))).otherwise(bones).alias("skeleton")
    above = F.when(F.col("kind") == "tool", F.col("name")).otherwise(F.col("__n")).alias("supercategory")
    return on.select(F.col("encoded").alias("id"), "name", above, keypoints, skeleton)


def to_coco(
    export: DataFrame, ontology: DataFrame, project: str, order: Column, *, extra: dict[str, Column] | None = None, info: DataFrame | None = None,
) -> Coco:
    """The COCO tables of an export, which write_coco writes as documents: rows with labels as images, one for each data row,
    their objects as annotations with the image's id, and the ontology's categories, whose ids are then numbered by name.
    Objects of a data row that comes again belong to its one image. A licence stands for all."""
    index = cut(ontology_index(ontology), "ontology")
    images = cut(images_of(export, project, order, extra), "images")
    found = cut(annotations_of(export, project, index), "annotations")
    categories = cut(categories_of(found, index), "categories")
    renamed = alphabetized(categories.withColumnRenamed("id", "category_id"))
    moved = remap(found, renamed.select("category_id", "new_id")).drop("category_id", "unmapped").withColumnRenamed("new_id", "category_id")
    on = moved.join(images.select("data_row_id", F.col("id").alias("image_id")), "data_row_id").drop("data_row_id")
    licenses = export.sparkSession.createDataFrame([(1, "N/A", "N/A")], "id int, name string, url string")
    return Coco(images, on, renamed.drop("category_id").withColumnRenamed("new_id", "id"), info, licenses)
