"""File, flight and class names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_points(name: Column, last: int = 10) -> Column:
    """The code points of the last characters, written on end: a string of digits, however many there are."""
    chars = F.filter(F.split(F.right(name, F.lit(last)), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.ascii(c).cast("string")), "")


def code_point_number(name: Column, last: int = 10) -> Column:
    """code_points as an integer of up to 38 digits; of more, there is only the string."""
    return code_points(name, last).try_cast("decimal(38,0)")


def time_number(ts: Column) -> Column:
    """UTC yyMMddHHmmss and six digits of the second's fraction as an integer."""
    return F.date_format(ts, "yyMMddHHmmssSSSSSS").cast("long")


def export_file(dataset: Column, external: Column) -> Column:
    name = F.concat(dataset, F.lit("-"), external)
    return F.when(name.contains(".JPG"), name).otherwise(F.concat(name, F.lit(".JPG")))


def crop_file(video: Column, frame: Column, part: str, top: Column | None = None, left: Column | None = None) -> Column:
    place = [] if top is None else [F.lit("top"), top.cast("string"), F.lit("left"), left.cast("string")]
    return F.concat_ws("_", video, F.lit("frame"), frame.cast("string"), *place, F.lit(f"{part}.jpg"))


def crop_field(name: Column, field: str) -> Column:
    """One field of a crop's file name: video, frame, top, left or part; null if it isn't there."""
    pattern = {"video": r"^(.*)_frame_[0-9]+", "frame": r"_frame_([0-9]+)", "top": r"_top_([0-9]+)", "left": r"_left_([0-9]+)", "part": r"_([fab])\.jpg$"}[field]
    got = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return got.cast("long") if field in ("frame", "top", "left") else got


def flight(path: Column) -> Column:
    """A file name less its last part after '_'."""
    return F.regexp_replace(path, "_[^_]*$", "")


def first_parts(name: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(name, "_"), 1, n), "_")


def frame_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"([0-9]+)\.[^.]*$", 1), F.lit("")).cast("long")


def short_class(name: Column) -> Column:
    return F.when(F.length(name) > 13, F.concat(F.substring(name, 1, 11), F.lit(".."))).otherwise(name)


def frame_name(name: Column, number: Column, digits: int = 5, ending: str = ".jpg") -> Column:
    """The name of another frame of the same video: its last part, so many digits and an ending, replaced."""
    stem = F.substring(name, F.lit(1), F.length(name) - (digits + len(ending)))
    return F.concat(stem, F.format_string(f"%0{digits}d", number), F.lit(ending))
