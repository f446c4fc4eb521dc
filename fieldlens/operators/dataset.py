"""Operators on annotation datasets: tables of images, annotations and categories.

Orders are explicit: images by image_id, annotations by id, unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fieldlens.sources.shared import cut, small


def renumber(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """df with dense numbers from start in the given order, whatever the values of its columns.

    Rows are dealt out by ranges of the order, sorted and numbered within each range, and written; the table of range sizes,
    a row for each task, gives the number before each. Nothing is gathered in one place, and sparse or random ids are no
    matter. Rows with equal orders share a range, so the order should tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__at", 33))
    sizes = written.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    return written.join(F.broadcast(offsets), "__part").withColumn(out, inside + F.col("__before") + F.lit(start)).drop("__at", "__part", "__before")


def renumber_annotations(annotations: DataFrame, start: int = 1) -> DataFrame:
    return renumber(annotations, ["image_id", "id"], "new_id", start)


def valid_images(images: DataFrame, annotations: DataFrame, categories: list[int] | None = None, *, least_points: int = 10) -> DataFrame:
    """Images with an annotation of the categories, not all of whose boxes are at most 1 wide or high.

    Where annotations have key points (an array of (x, y, v)), at least least_points of an image's have to be visible.
    """
    own = annotations if categories is None else annotations.filter(F.col("category_id").isin(categories))
    bad = F.bool_and((F.col("w") <= 1) | (F.col("h") <= 1))
    seen = F.sum(F.size(F.filter("keypoints", lambda p: p["v"] > 0))) if "keypoints" in own.columns else F.lit(least_points)
    good = own.groupBy("image_id").agg(bad.alias("bad"), seen.alias("seen")).filter((~F.col("bad")) & (F.col("seen") >= least_points))
    return images.join(good, "image_id", "left_semi")


def semantic_ids(categories: DataFrame, *, most: int = 254) -> DataFrame:
    """(category_id, semantic) from (category_id, isthing): stuff counts from 1 in the order of ids, things are 0, and the
    id 0, which nothing has, is 255. More than most kinds of stuff are an error. Category tables are small."""
    stuff = categories.filter("isthing = 0")
    if stuff.count() > most:
        raise ValueError(f"more than {most} kinds of stuff")
    placed = stuff.select("category_id", F.row_number().over(Window.orderBy("category_id")).cast("long").alias("semantic"))
    none = categories.sparkSession.createDataFrame([(0, 255)], "category_id long, semantic long")
    return placed.unionByName(categories.filter("isthing <> 0").select("category_id", F.lit(0).cast("long").alias("semantic"))).unionByName(none)


def frame_triplets(frames: DataFrame, spacing: int) -> DataFrame:
    """frames (video_id, image_id) with the frames so many before and after, null where there are none."""
    base = frames.select("video_id", "image_id")
    near = lambda d, n: base.select("video_id", (F.col("image_id") - d).alias("image_id"), F.col("image_id").alias(n))
    return base.join(near(spacing, "after_id"), ["video_id", "image_id"], "left").join(near(-spacing, "before_id"), ["video_id", "image_id"], "left")


def draw(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that hangs on the keys' text and the seed alone, the same in every engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def sample_frames(spans: DataFrame, n: int, seed: int, spacing: int = 0) -> DataFrame:
    """(video_id, k, frame): n frames of each video (video_id, least, most), drawn with replacement from [least, most).

    With a spacing, for triplets, the range is that much shorter at both ends, each video's own. A range of none gives its
    least frame.
    """
    low, high = F.col("least") + spacing, F.col("most") - spacing
    many = spans.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return many.select("video_id", "k", (low + F.floor(draw(seed, "video_id", "k") * F.greatest(high - low, F.lit(1)))).alias("frame"))


def split_by_manifest(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """(image_id, split) by a manifest (split, videos array)."""
    videos = manifest.select("split", F.explode("videos").alias("video_id"))
    return images.join(small(videos), "video_id").select("image_id", "split")


def follow(split: DataFrame, annotations: DataFrame) -> DataFrame:
    """annotations with the split of their image; for as many sets of annotations as the images have."""
    return annotations.join(split, "image_id")


def subset(images: DataFrame, annotations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Annotations of the wanted (ord, image_id), in that order, repeated where an id is; numbered from 1."""
    on = wanted.join(images.select("image_id"), "image_id").join(annotations, "image_id")
    return renumber(on, ["ord", "id"], "new_id")


def unknown_ids(images: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(images, "image_id", "left_anti")


def remap(annotations: DataFrame, mapping: DataFrame, *, seen: Observation | None = None) -> DataFrame:
    """Annotations with new_id by (category_id, new_id); null, and unmapped true, where the mapping has none. seen gets the
    number of these rows, once an action has run."""
    out = annotations.join(small(mapping), "category_id", "left").withColumn("unmapped", F.col("new_id").isNull())
    return out.observe(seen, F.count_if("unmapped").alias("unmapped")) if seen else out


def merged_categories(categories: DataFrame, mapping: DataFrame) -> DataFrame:
    """(category_id, new_name, new_id): ids from 1 in the order in which new names first appear among the old ids.

    mapping is (name, new_name). Names that repeat count at their first id. Category tables are small.
    """
    first = categories.groupBy("name").agg(F.min("category_id").alias("category_id"))
    named = first.join(small(mapping), "name")
    placed = named.withColumn("first", F.min("category_id").over(Window.partitionBy("new_name")))
    return placed.withColumn("new_id", F.dense_rank().over(Window.orderBy("first")).cast("long")).select("category_id", "new_name", "new_id")


def alphabetized(categories: DataFrame) -> DataFrame:
    return categories.withColumn("new_id", F.row_number().over(Window.orderBy("name", "category_id")).cast("long"))


def train_val(images: DataFrame, annotations: DataFrame, fraction: float) -> DataFrame:
    """(image_id, split) of the images with annotations: from the first on, every int(1 / fraction)-th is val."""
    some = images.join(annotations, "image_id", "left_semi").select("image_id")
    placed = renumber(some, ["image_id"], "place", 0)
    return placed.select("image_id", F.when(F.pmod("place", F.lit(int(1 / fraction))) == 0, "val").otherwise("train").alias("split"))


def random_split(images: DataFrame, fraction: float, seed: int) -> DataFrame:
    return images.select("image_id", F.when(draw(seed, "image_id") < fraction, "val").otherwise("train").alias("split"))


def partition(images: DataFrame, shares: dict[str, float], shuffle: Column) -> DataFrame:
    """(image_id, split): images in the order of shuffle, cut at int(total * cumulated share)."""
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    placed = renumber(images.select("image_id", shuffle.alias("__key")), ["__key", "image_id"], "place", 0).drop("__key")
    total, out, done = images.count(), F.lit(list(shares)[-1]), 0.0
    cuts = []
    for name, share in shares.items():
        done += share
        cuts.append((name, int(total * done + 1e-9)))
    for name, end in reversed(cuts[:-1]):
        out = F.when(F.col("place") < end, name).otherwise(out)
    return placed.select("image_id", out.alias("split"))


class Dataset(NamedTuple):
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame


def combine(parts: list[Dataset], *, keep_ids: bool = False) -> Dataset:
    """Several datasets in their order, with the first one's categories: images with new_image_id, numbered from 1 (or as they
    were, with keep_ids, which takes ids that are distinct over all parts), annotations with it and new_id, numbered from 0."""
    tag = lambda df, k: df.withColumn("file_ord", F.lit(k))
    images = reduce(DataFrame.unionByName, (tag(p.images, k) for k, p in enumerate(parts)))
    annotations = reduce(DataFrame.unionByName, (tag(p.annotations, k) for k, p in enumerate(parts)))
    placed = images.withColumn("new_image_id", F.col("image_id")) if keep_ids else renumber(images, ["file_ord", "image_id"], "new_image_id")
    moved = annotations.join(placed.select("file_ord", "image_id", "new_image_id"), ["file_ord", "image_id"])
    return Dataset(placed, renumber(moved, ["file_ord", "image_id", "id"], "new_id", 0), parts[0].categories)


def remove_category(data: Dataset, name: str, whole_images: bool = False) -> Dataset:
    """Without a category (by name) and its annotations, or without the images that have any; images left without annotations
    go too, and annotations get new_id, numbered from 1. A name that no category has changes nothing. Of several categories
    of the name all rows go, but only the annotations of the last."""
    category = data.categories.filter(F.col("name") == name).agg(F.max("category_id")).first()[0]
    if category is None:
        return data._replace(annotations=data.annotations.withColumn("new_id", F.col("id")))
    if whole_images:
        bad = data.annotations.filter(F.col("category_id") == category).select("image_id").distinct()
        left = data.annotations.join(bad, "image_id", "left_anti")
    else:
        left = data.annotations.filter(F.col("category_id") != category)
    return Dataset(data.images.join(left, "image_id", "left_semi"), renumber_annotations(left), data.categories.filter(F.col("name") != name))


def empty_like(data: Dataset) -> Dataset:
    """The categories, and no images or annotations."""
    return data._replace(images=data.images.filter(F.lit(False)), annotations=data.annotations.filter(F.lit(False)))


def category_ids(df: DataFrame, categories: DataFrame, *, name: str = "name", seen: Observation | None = None) -> DataFrame:
    """df with the category_id of its name: the least that a category of the name has; null for an unknown one. seen gets
    the number of rows with unknown names, once an action has run."""
    known = categories.groupBy(F.col("name").alias(name)).agg(F.min("category_id").alias("category_id"))
    out = df.join(small(known), name, "left")
    return out.observe(seen, F.count_if(F.col("category_id").isNull()).alias("unknown")) if seen else out


def area_distribution(annotations: DataFrame, *, accuracy: int | None = None) -> DataFrame:
    """(category_id, n, least, most, middle) of the boxes' areas. With an accuracy the median comes from a mergeable sketch,
    whose rank is off by 1 / accuracy of the rows at most; without, every area of a class is kept until the end."""
    middle = F.expr("percentile_disc(0.5) within group (order by area)") if accuracy is None else F.percentile_approx("area", 0.5, accuracy)
    return annotations.groupBy("category_id").agg(F.count("*").alias("n"), F.min("area").alias("least"), F.max("area").alias("most"), middle.alias("middle"))


def area_histogram(annotations: DataFrame, width: float) -> DataFrame:
    """(category_id, bin, n): boxes by area, in bins of a width, those that have any."""
    return annotations.groupBy("category_id", F.floor(F.col("area") / width).alias("bin")).agg(F.count("*").alias("n"))


def class_histogram(annotations: DataFrame, categories: DataFrame, *, error: float | None = None, seen: Observation | None = None) -> DataFrame:
    """Instances and images by category, those without any as well.

    With an error images are counted by a mergeable sketch of that relative standard deviation. seen gets the number of
    annotations whose category isn't one of 1 to the number of categories (out_of_range), once an action has run.
    """
    if seen:
        annotations = annotations.observe(seen, F.count_if(~F.coalesce(F.col("category_id").between(1, categories.count()), F.lit(False))).alias("out_of_range"))
    images = F.count_distinct("image_id") if error is None else F.approx_count_distinct("image_id", error)
    counts = annotations.groupBy("category_id").agg(F.count("*").alias("n"), images.alias("n_images"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return small(categories).join(counts, "category_id", "left").select("category_id", "name", zero("n"), zero("n_images"))


def renumber_splits(annotations: DataFrame, split: DataFrame, names: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """annotations with their split, numbered from 1 in each."""
    on = cut(annotations.join(split, "image_id"), "splits")
    return reduce(DataFrame.unionByName, (renumber_annotations(on.filter(F.col("split") == s)) for s in names))


def truth_of_targets(annotations: DataFrame) -> DataFrame:
    """Ground truth made of targets: numbered from 1 in the order of images (new_id), with num_keypoints, the visible ones of
    keypoints (an array of (x, y, v)) where there are any."""
    seen = F.size(F.filter("keypoints", lambda p: p["v"] > 0)).cast("long") if "keypoints" in annotations.columns else F.lit(0).cast("long")
    return renumber_annotations(annotations.withColumn("num_keypoints", seen))
