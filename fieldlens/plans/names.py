"""Name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import names as N
from fieldlens.plans.registry import query


_LONG = "CASE WHEN c_custkey % 5 = 0 THEN c_name || '日本日本日本日本日本' ELSE c_name END"
_CODE = f"array_to_string(list_transform(string_split(right({_LONG}, 10), ''), lambda c: unicode(c)::varchar), '')"


@query("name_to_unicode", f"SELECT c_custkey, {_CODE} AS code, CASE WHEN length({_CODE}) <= 38 THEN {_CODE} END AS number FROM customer")
def name_to_unicode(t):
    """Some of the names have more digits than an integer of 38 holds."""
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("日本日本日本日本日本"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", N.code_points(name).alias("code"), N.code_point_number(name).cast("string").alias("number"))


@query("time_as_int", "SELECT event_id, strftime(ts, '%y%m%d%H%M%S%f')::bigint AS ts_int FROM events")
def time_as_int(t):
    return t.events.select("event_id", N.time_number(F.col("ts")).alias("ts_int"))


@query("export_file_name",
    "SELECT image_id, CASE WHEN contains(n, '.JPG') THEN n ELSE n || '.JPG' END AS name FROM (SELECT image_id, concat('set-', CASE WHEN "
    "image_id % 2 = 0 THEN lower(file_name) ELSE file_name END) AS n FROM fx_images)")
def export_file(t):
    external = F.when(F.col("image_id") % 2 == 0, F.lower("file_name")).otherwise(F.col("file_name"))
    return t.images.select("image_id", N.export_file(F.lit("set"), external).alias("name"))


_CROP = "concat('video', image_id % 20, '_frame_', image_id, '_top_', image_id % 480, '_left_', image_id % 640, '_', ['f','a','b'][1 + image_id % 3], '.jpg')"


def _crop_name():
    c = F.col("image_id")
    video = F.concat(F.lit("video"), (c % 20).cast("string"))
    parts = [N.crop_file(video, c, p, c % 480, c % 640) for p in "fab"]
    return F.when(c % 3 == 0, parts[0]).when(c % 3 == 1, parts[1]).otherwise(parts[2])


@query("crop_name_build", f"SELECT image_id, {_CROP} AS name FROM fx_images")
def crop_build(t):
    return t.images.select("image_id", _crop_name().alias("name"))


@query("crop_name_parse",
    "SELECT image_id, regexp_extract(n, '^(.*)_frame_[0-9]+', 1) AS video, regexp_extract(n, '_frame_([0-9]+)', 1)::bigint AS frame, regexp_extract(n, "
    "'_top_([0-9]+)', 1)::bigint AS top, regexp_extract(n, '_left_([0-9]+)', 1)::bigint AS left_px, regexp_extract(n, '_([fab])\\.jpg$', "
    f"1) AS part FROM (SELECT image_id, {_CROP} AS n FROM fx_images)")
def crop_parse(t):
    named = t.images.select("image_id", _crop_name().alias("n"))
    return named.select("image_id", *(N.crop_field(F.col("n"), f).alias("left_px" if f == "left" else f) for f in ("video", "frame", "top", "left", "part")))


@query("flight_name", "SELECT image_id, regexp_replace(file_name, '_[^_]*$', '') AS flight, array_to_string(string_split(file_name, '_')[1:3], '_') AS head FROM fx_images")
def flight(t):
    return t.images.select("image_id", N.flight(F.col("file_name")).alias("flight"), N.first_parts(F.col("file_name"), 3).alias("head"))


_FRAME = "regexp_extract(file_name, '([0-9]+)\\.[^.]*$', 1)::bigint"


@query("frame_number", f"SELECT image_id, {_FRAME} AS frame, substr(file_name, 1, length(file_name) - 9) || printf('%05d', {_FRAME} - 2) || '.jpg' AS before FROM fx_images")
def frame(t):
    n = N.frame_number(F.col("file_name"))
    return t.images.select("image_id", n.alias("frame"), N.frame_name(F.col("file_name"), n - 2).alias("before"))


@query("short_class_name",
    "SELECT a.id, CASE WHEN length(name) > 13 THEN substr(name, 1, 11) || '..' ELSE name END AS short FROM fx_annotations a JOIN fx_categories "
    "USING (category_id)")
def short(t):
    return t.annotations.join(F.broadcast(t.categories), "category_id").select("id", N.short_class(F.col("name")).alias("short"))
