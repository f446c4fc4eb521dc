"""Readers and writers of the file forms that annotation, camera and raster data come in. Schemas are always explicit."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_pmatrices(spark: SparkSession, path: str) -> DataFrame:
    """(image_name, p00 .. p23) from lines of a name and twelve numbers; a broken number is null."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("v"))
    return parts.select(F.get("v", F.lit(0)).alias("image_name"), *(F.get("v", F.lit(1 + 4 * r + c)).try_cast("double").alias(f"p{r}{c}") for r in range(3) for c in range(4)))


def sort_key(name: Column, order: str) -> list[Column]:
    """What camera files are ordered by: simple (the name), big_map and ungulates (flight part, part before, frame)."""
    if order == "simple":
        return [name]
    if order not in ("big_map", "ungulates"):
        raise ValueError(order)
    parts = F.split(name, "_")
    flight = F.try_element_at(parts, F.lit(-3 if order == "big_map" else -4))
    return [flight, F.try_element_at(parts, F.lit(-2)).try_cast("int"), F.regexp_extract(name, r"([0-9]+)\.[^.]*$", 1).try_cast("int")]


def read_offset(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", " ").alias("v"))
    return parts.select(*(F.get("v", F.lit(k)).cast("double").alias(n) for k, n in enumerate(("ox", "oy", "oz"))))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("imageName string, latitude double, longitude double").option("sep", " ").option("header", True).csv(path)


def read_flight_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The logs of all flights, with the flight of the folder that a file lies in."""
    return spark.read.schema(f"{schema}, flight long").parquet(path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.schema("filename string, obs_ind long").option("header", True).csv(path)
    return got.withColumn("parsed", F.regexp_extract("filename", r"-([0-9]+)\.[^.]*$", 1).cast("long"))


WARPS = "segment bigint, step bigint, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double, n_inliers bigint"


def write_warps(warps: DataFrame, path: str) -> None:
    """Warps in order of segments and steps, by ranges: as many files as the data need, however many segments there are."""
    warps.repartitionByRange("segment", "step").sortWithinPartitions("segment", "step").write.parquet(path)


def read_warps(spark: SparkSession, path: str, segments: tuple[int, int] | None = None) -> DataFrame:
    """All warps, or those of the segments from one to another, both included; other files are skipped by their statistics."""
    got = spark.read.schema(WARPS).parquet(path)
    return got if segments is None else got.filter(F.col("segment").between(*segments))


def write_raster(cells: DataFrame, path: str, tile: int) -> None:
    """Cells as tiles of tile x tile, each a row with its cells in order."""
    at = cells.withColumns({"tx": F.floor(F.col("xr") / tile), "ty": F.floor(F.col("yr") / tile)})
    inside = (F.col("yr") % tile * tile + F.col("xr") % tile).cast("int").alias("k")
    at.select("tx", "ty", F.struct(inside, "elev").alias("c")).groupBy("tx", "ty").agg(F.array_sort(F.collect_list("c")).alias("cells")).write.parquet(path)


def read_raster(spark: SparkSession, path: str, tile: int) -> DataFrame:
    tiles = spark.read.schema("tx long, ty long, cells array<struct<k:int,elev:double>>").parquet(path)
    rows = tiles.select("tx", "ty", F.explode("cells").alias("c"))
    return rows.select((F.col("tx") * tile + F.col("c.k") % tile).alias("xr"), (F.col("ty") * tile + F.floor(F.col("c.k") / tile)).alias("yr"), "c.elev")


def image_manifest(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of the files below path; contents are not read."""
    return _files(spark, path, pattern).select("path", "length", "modificationTime")


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def decoded_files(spark: SparkSession, path: str, pattern: str, decode: Callable[[bytes], object], kind: str) -> DataFrame:
    """(path, value, error) of the files below path, each decoded by a function of its bytes; kind is the value's type.

    A file that the function fails on gives a row without a value, with the error's text, and doesn't end the job.
    """

    def run(frames):
        for f in frames:
            values, errors = [], []
            for data in f["content"]:
                try:
                    values.append(decode(bytes(data)))
                    errors.append(None)
                except Exception as e:  # whatever a decoder raises belongs to its file
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": f["path"], "value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return _files(spark, path, pattern).select("path", "content").mapInPandas(run, f"path string, value {kind}, error string")


def with_objects(manifest: DataFrame, key: str, path: str, pattern: str, key_of: Column) -> DataFrame:
    """manifest with the bytes (content) of the object that its key names; null where there is none. key_of makes the key of
    an object's path."""
    objects = _files(manifest.sparkSession, path, pattern).select(key_of.alias(key), "content")
    return manifest.join(objects, key, "left")


def missing_images(images: DataFrame, manifest: DataFrame, name_of: Column, *, name: str = "file_name") -> DataFrame:
    """Images that no file of the manifest (path, ...) is: those still to be fetched. name_of makes the name of a path."""
    return images.join(manifest.select(name_of.alias(name)), name, "left_anti")


def pending_projects(projects: DataFrame, done: DataFrame, ending: str = ".json") -> DataFrame:
    """Projects (project) without an output (path) of their name."""
    base = F.regexp_extract("path", rf"([^/]+){re.escape(ending)}$", 1)
    return projects.join(done.select(base.alias("project")), "project", "left_anti")


def upload_rows(paths: Column) -> tuple[Column, Column]:
    """(row_data, external_id) of a path: itself, and its last part."""
    return paths.alias("row_data"), F.regexp_extract(paths, "[^/]+$", 0).alias("external_id")


def prediction_rows(dets: DataFrame, categories: DataFrame, least: float) -> DataFrame:
    """Detections of at least a score with their class's name, and box corners truncated to integers of at least 0."""
    corner = lambda c: F.greatest(F.lit(0).cast("long"), c.cast("long"))
    on = dets.filter(F.col("score") >= least).join(F.broadcast(categories), "category_id")
    sides = {"left": F.col("x"), "top": F.col("y"), "right": F.col("x") + F.col("w"), "bottom": F.col("y") + F.col("h")}
    return on.select("det_id", "name", "score", *(corner(c).alias(n) for n, c in sides.items()))


def overlays(names: DataFrame) -> DataFrame:
    """For each focal name _f.jpg its siblings _a.jpg and _b.jpg; null, and incomplete, where one isn't there."""
    stems = names.filter(F.col("name").endswith("_f.jpg")).withColumn("stem", F.regexp_replace("name", r"_f\.jpg.*", ""))
    side = lambda p, n: names.filter(F.col("name").endswith(f"_{p}.jpg")).select(F.regexp_replace("name", rf"_{p}\.jpg$", "").alias("stem"), F.col("name").alias(n))
    on = stems.join(side("a", "after_name"), "stem", "left").join(side("b", "before_name"), "stem", "left")
    both = F.array(*[F.struct(F.lit("IMAGE_OVERLAY").alias("type"), F.col(c).alias("value")) for c in ("after_name", "before_name")])
    return on.withColumns({"incomplete": F.col("after_name").isNull() | F.col("before_name").isNull(), "overlays": both})


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(video, split) from a JSON document of split names to lists of videos."""
    docs = spark.read.text(path).select(F.from_json("value", "map<string,array<bigint>>").alias("m"))
    return docs.select(F.explode("m").alias("split", "videos")).select("split", F.explode("videos").alias("video"))
