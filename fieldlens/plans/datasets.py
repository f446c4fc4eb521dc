"""Dataset queries."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from fieldlens.operators import dataset as D
from fieldlens.operators import labels as L
from fieldlens.plans.registry import query
from fieldlens.sources.shared import cut, small

_NUM = "CAST(row_number() OVER (ORDER BY image_id, id) AS BIGINT)"


def used_categories(t):
    """The few classes that annotations have, found in each task first, so that no task gets the rows of a whole class."""
    return t.annotations.select("category_id").distinct()


@query("class_histogram", "SELECT c.category_id, c.name, count(a.id) AS n FROM fx_categories c LEFT JOIN fx_annotations a USING (category_id) GROUP BY 1, 2")
def class_histogram(t):
    return D.class_histogram(t.annotations, t.categories).drop("n_images")


@query("class_image_histogram",
    "SELECT c.category_id, c.name, count(DISTINCT a.image_id) AS n_images FROM fx_categories c LEFT JOIN fx_annotations a USING (category_id) "
    "GROUP BY 1, 2")
def class_images(t):
    return D.class_histogram(t.annotations, t.categories).drop("n")


@query("dataset_summary",
    "SELECT src, count(DISTINCT image_id) AS n_images, count(*) AS n_annotations FROM (SELECT image_id, image_id % 2 AS src FROM fx_annotations) "
    "GROUP BY ROLLUP (src)")
def summary(t):
    return t.annotations.withColumn("src", F.col("image_id") % 2).rollup("src").agg(F.count_distinct("image_id").alias("n_images"), F.count("*").alias("n_annotations"))


@query("area_distribution", "SELECT category_id, count(*) AS n, min(area) AS least, max(area) AS most, quantile_disc(area, 0.5) AS middle FROM fx_annotations GROUP BY 1")
def areas(t):
    return D.area_distribution(t.annotations)


@query("area_histogram", "SELECT category_id, floor(area / 1000)::bigint AS bin, count(*) AS n FROM fx_annotations GROUP BY ALL")
def area_histogram(t):
    return D.area_histogram(t.annotations, 1000.0)


@query("dataset_violations",
    "SELECT (SELECT count(*) FROM fx_annotations WHERE category_id > 5) AS out_of_range, (SELECT count(*) FROM fx_annotations WHERE category_id IN (3, 4)) AS unmapped, "
    "(SELECT count(*) FROM fx_annotations WHERE category_id = 5) AS unknown")
def violations(t):
    """Ids that five categories don't have, ids that a mapping of two doesn't, and names that four categories don't: each is
    counted by the operator's own pass."""
    some = lambda *ids: t.categories.filter(F.col("category_id").isin(*ids))
    bad, lost, names = Observation(), Observation(), Observation()
    cut(D.class_histogram(t.annotations, some(1, 2, 3, 4, 5), seen=bad), "histogram")
    cut(D.remap(t.annotations, some(1, 2, 5, 6).select("category_id", F.col("category_id").alias("new_id")), seen=lost), "remapped")
    named = t.annotations.join(small(t.categories), "category_id").drop("category_id")
    cut(D.category_ids(named, some(1, 2, 3, 4, 6), seen=names), "named")
    return t.spark.createDataFrame([(bad.get["out_of_range"], lost.get["unmapped"], names.get["unknown"])], "out_of_range long, unmapped long, unknown long")


@query("class_set", "SELECT DISTINCT category_id FROM fx_annotations")
def class_set(t):
    return t.annotations.select("category_id").distinct().orderBy("category_id")


@query("annotations_per_image", "SELECT i.image_id, count(a.id) AS n FROM fx_images i LEFT JOIN fx_annotations a USING (image_id) GROUP BY 1")
def per_image(t):
    return t.images.select("image_id").join(t.annotations.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("annotations_for_image", "SELECT id, x, y, w, h FROM fx_annotations WHERE image_id = 7")
def for_image(t):
    return t.annotations.filter("image_id = 7").select("id", "x", "y", "w", "h")


@query("valid_images", "SELECT image_id FROM fx_annotations WHERE category_id IN (1, 3) GROUP BY 1 HAVING NOT bool_and(w <= 30 - 29 OR h <= 1)")
def valid(t):
    return D.valid_images(t.images, t.annotations, [1, 3]).select("image_id")


@query("image_annotation_join", "SELECT i.image_id, i.file_name, a.id FROM fx_images i LEFT JOIN fx_annotations a USING (image_id)")
def image_join(t):
    return t.images.select("image_id", "file_name").join(t.annotations.select("image_id", "id"), "image_id", "left")


@query("annotations_in_images", "SELECT id FROM fx_annotations WHERE image_id IN (SELECT image_id FROM fx_images WHERE video_id = 3)")
def in_images(t):
    return t.annotations.join(t.images.filter("video_id = 3"), "image_id", "left_semi").select("id")


_WANTED = "SELECT (o_orderkey * 31) % 1009 * 100000 + o_orderkey AS ord, o_orderkey * 2 AS image_id FROM orders WHERE o_custkey % 7 = 0"


def _wanted(t):
    return t.orders.filter("o_custkey % 7 = 0").select(((F.col("o_orderkey") * 31) % 1009 * 100000 + F.col("o_orderkey")).alias("ord"), (F.col("o_orderkey") * 2).alias("image_id"))


@query("subset_by_image_ids",
    f"SELECT ord, image_id, id, CAST(row_number() OVER (ORDER BY ord, id) AS BIGINT) AS new_id FROM ({_WANTED}) s JOIN fx_images USING (image_id) "
    "JOIN fx_annotations USING (image_id)")
def subset(t):
    return D.subset(t.images, t.annotations, _wanted(t)).select("ord", "image_id", "id", "new_id")


@query("unknown_image_ids", f"SELECT image_id FROM ({_WANTED}) s WHERE image_id NOT IN (SELECT image_id FROM fx_images)")
def unknown(t):
    return D.unknown_ids(t.images, _wanted(t)).select("image_id")


_MAP = {"salmon": "fish", "bear": "animal", "gull": "animal", "adult male zebra": "animal", "kelp": "plant", "boat": "boat"}
_MAPPED = (
    "SELECT category_id, name, CASE name WHEN 'salmon' THEN 'fish' WHEN 'bear' THEN 'animal' WHEN 'gull' THEN 'animal' WHEN 'adult male "
    "zebra' THEN 'animal' WHEN 'kelp' THEN 'plant' WHEN 'boat' THEN 'boat' END AS new_name FROM fx_categories"
)
_NEW = (
    "SELECT category_id, new_name, dense_rank() OVER (ORDER BY f) AS new_id FROM (SELECT *, min(category_id) OVER (PARTITION BY new_name) "
    f"AS f FROM ({_MAPPED}) WHERE new_name IS NOT NULL)"
)


def _mapping(t):
    return t.spark.createDataFrame(list(_MAP.items()), "name string, new_name string")


@query("rename_merge_categories", f"SELECT a.id, n.new_id, n.new_name FROM fx_annotations a LEFT JOIN ({_NEW}) n USING (category_id)")
def rename_merge(t):
    return D.remap(t.annotations, D.merged_categories(t.categories, _mapping(t))).select("id", "new_id", "new_name")


@query("merged_categories",
    f"SELECT DISTINCT new_id AS id, new_name AS name, 'all' AS supercategory, 1 AS isthing FROM ({_NEW}) JOIN (SELECT DISTINCT category_id "
    "FROM fx_annotations) USING (category_id)")
def merged(t):
    new = D.merged_categories(t.categories, _mapping(t)).join(used_categories(t), "category_id", "left_semi")
    return new.select(F.col("new_id").alias("id"), F.col("new_name").alias("name"), F.lit("all").alias("supercategory"), F.lit(1).alias("isthing")).distinct()


@query("remap_categories",
    f"SELECT category_id, count(*) AS n, count(new_id) AS mapped FROM fx_annotations LEFT JOIN (SELECT * FROM ({_NEW}) WHERE new_name <> "
    "'plant') USING (category_id) GROUP BY 1")
def remap(t):
    mapping = D.merged_categories(t.categories, _mapping(t)).filter("new_name <> 'plant'")
    return D.remap(t.annotations, mapping).groupBy("category_id").agg(F.count("*").alias("n"), F.count_if(~F.col("unmapped")).alias("mapped"))


@query("category_name_lookup", "SELECT a.id, c.name FROM fx_annotations a LEFT JOIN (SELECT * FROM fx_categories WHERE category_id <> 5) c USING (category_id)")
def lookup(t):
    return t.annotations.join(small(t.categories.filter("category_id <> 5")), "category_id", "left").select("id", "name")


@query("category_id_lookup", "SELECT a.id, CASE WHEN category_id <> 5 THEN category_id END AS category_id FROM fx_annotations a")
def id_lookup(t):
    """Names to ids; one name is unknown."""
    named = t.annotations.join(small(t.categories), "category_id").select("id", "name")
    return D.category_ids(named, t.categories.filter("category_id <> 5")).select("id", "category_id")


@query("alphabetize_categories",
    "SELECT a.id, n.new_id FROM fx_annotations a JOIN (SELECT category_id, row_number() OVER (ORDER BY name) AS new_id FROM fx_categories) "
    "n USING (category_id)")
def alphabetize(t):
    return D.remap(t.annotations, D.alphabetized(t.categories).select("category_id", "new_id")).select("id", "new_id")


@query("sort_by_category_id", "SELECT category_id, name FROM fx_categories WHERE category_id IN (SELECT category_id FROM fx_annotations)")
def sort_categories(t):
    return t.categories.join(used_categories(t), "category_id", "left_semi").orderBy("category_id")


@query("sort_images", "SELECT image_id, file_name FROM fx_images")
def sort_images(t):
    return t.images.select("image_id", "file_name").orderBy("image_id")


@query("empty_like", "SELECT count(*) AS n, 0::bigint AS images FROM fx_categories JOIN (SELECT DISTINCT category_id FROM fx_annotations) USING (category_id)")
def empty_like(t):
    none = D.empty_like(D.Dataset(t.images, t.annotations, t.categories.join(used_categories(t), "category_id", "left_semi")))
    return none.categories.agg(F.count("*").alias("n")).crossJoin(none.images.agg(F.count("*").alias("images")))


@query("head_examples", "SELECT image_id FROM fx_images ORDER BY image_id LIMIT 11")
def head(t):
    return t.images.orderBy("image_id").limit(11).select("image_id")


@query("renumber_annotations", f"SELECT id, {_NUM} AS new_id FROM fx_annotations")
def renumber(t):
    return D.renumber_annotations(t.annotations.select("image_id", "id")).select("id", "new_id")


@query("image_ordinal",
    "SELECT image_id, min(rn) AS ordinal FROM (SELECT l_orderkey AS image_id, CAST(row_number() OVER (ORDER BY l_orderkey, id) AS BIGINT) "
    "AS rn FROM (SELECT image_id AS l_orderkey, id FROM fx_annotations)) GROUP BY 1")
def image_ordinal(t):
    """An image's first position in the list of labels; labels of the same image take up positions."""
    return D.renumber_annotations(t.annotations.select("image_id", "id")).groupBy("image_id").agg(F.min("new_id").alias("ordinal"))


_SPLIT = (
    "SELECT image_id, CASE WHEN (row_number() OVER (ORDER BY image_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT "
    "image_id FROM fx_annotations JOIN fx_images USING (image_id))"
)


@query("train_val_split",
    "SELECT a.id, s.split, CAST(row_number() OVER (PARTITION BY split ORDER BY image_id, id) AS BIGINT) AS new_id FROM fx_annotations a "
    f"JOIN ({_SPLIT}) s USING (image_id)")
def train_val(t):
    split = D.cut(D.train_val(t.images, t.annotations, 0.2), "split")
    return D.renumber_splits(t.annotations, split).select("id", "split", "new_id")


def _draw(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::bigint::double / 281474976710656.0::double)"


@query("random_split", f"SELECT image_id, CASE WHEN {_draw("concat('3:', image_id)")} < 0.2 THEN 'val' ELSE 'train' END AS split FROM fx_images")
def random_split(t):
    return D.random_split(t.images, 0.2, seed=3)


@query("partition_dataset",
    "WITH p AS (SELECT image_id, row_number() OVER (ORDER BY (image_id * 7919) % 104729, image_id) - 1 AS place, count(*) OVER () AS n "
    "FROM fx_images) SELECT image_id, CASE WHEN place < trunc(n * 0.7 + 1e-9) THEN 'train' WHEN place < trunc(n * 0.9 + 1e-9) THEN 'val' "
    "ELSE 'test' END AS split FROM p")
def partition(t):
    key = (F.col("image_id") * 7919) % 104729
    return D.partition(t.images, {"train": 0.7, "val": 0.2, "test": 0.1}, key)


@query("partition_annotations",
    "WITH p AS (SELECT image_id, row_number() OVER (ORDER BY (image_id * 7919) % 104729, image_id) - 1 AS place, count(*) OVER () AS n "
    "FROM fx_images) SELECT id, id % 4 = 0 AS panoptic, CASE WHEN place < trunc(n * 0.7 + 1e-9) THEN 'train' ELSE 'val' END AS split FROM "
    "p JOIN fx_annotations USING (image_id)")
def partition_annotations(t):
    """Two sets of annotations that go the way of their images."""
    split = D.cut(D.partition(t.images, {"train": 0.7, "val": 0.3}, (F.col("image_id") * 7919) % 104729), "partition")
    sets = [D.follow(split, t.annotations.filter((F.col("id") % 4 == 0) == p)).withColumn("panoptic", F.lit(p)) for p in (True, False)]
    return sets[0].unionByName(sets[1]).select("id", "panoptic", "split")


@query("video_level_split", "SELECT image_id, CASE WHEN video_id < 14 THEN 'train' WHEN video_id < 17 THEN 'val' ELSE 'test' END AS split FROM fx_images")
def video_split(t):
    """By a manifest {split: [videos]}, here of the videos there are."""
    name = F.when(F.col("video_id") < 14, "train").when(F.col("video_id") < 17, "val").otherwise("test")
    manifest = t.images.select("video_id").distinct().groupBy(name.alias("split")).agg(F.collect_list("video_id").alias("videos"))
    return D.split_by_manifest(t.images, manifest)


def _combined(t, **options):
    halves = [D.Dataset(t.images.filter(F.col("image_id") % 2 == k), t.annotations.filter(F.col("image_id") % 2 == k), t.categories) for k in (0, 1)]
    return D.combine(halves, **options)


_CI = "SELECT image_id, image_id % 2 AS f, CAST(row_number() OVER (ORDER BY image_id % 2, image_id) AS BIGINT) AS new_image_id FROM fx_images"


@query("combine_datasets",
    "SELECT a.id, new_image_id, CAST(row_number() OVER (ORDER BY new_image_id, a.id) - 1 AS BIGINT) AS new_id FROM fx_annotations a JOIN "
    f"({_CI}) USING (image_id)")
def combine(t):
    return _combined(t).annotations.select("id", "new_image_id", "new_id")


@query("combine_datasets_kept_ids", "SELECT a.id, image_id AS new_image_id, CAST(row_number() OVER (ORDER BY image_id % 2, image_id, a.id) - 1 AS BIGINT) AS new_id FROM fx_annotations a JOIN fx_images USING (image_id)")
def combine_kept(t):
    return _combined(t, keep_ids=True).annotations.select("id", "new_image_id", "new_id")


@query("combine_images", f"SELECT image_id, new_image_id FROM ({_CI})")
def combine_images(t):
    return _combined(t).images.select("image_id", "new_image_id")


def _without(t, name, **options):
    return D.remove_category(D.Dataset(t.images, t.annotations, t.categories), name, **options)


@query("remove_category", f"SELECT id, {_NUM} AS new_id FROM fx_annotations WHERE category_id <> 2")
def remove(t):
    return _without(t, "bear").annotations.select("id", "new_id")


@query("remove_category_images", f"SELECT id, {_NUM} AS new_id FROM fx_annotations WHERE image_id NOT IN (SELECT image_id FROM fx_annotations WHERE category_id = 2)")
def remove_images(t):
    return _without(t, "bear", whole_images=True).annotations.select("id", "new_id")


@query("remove_category_left_images", "SELECT image_id, 6 AS categories FROM fx_images WHERE image_id IN (SELECT image_id FROM fx_annotations WHERE category_id <> 2)")
def remove_left(t):
    left = _without(t, "bear")
    return left.images.select("image_id").crossJoin(left.categories.agg(F.count("*").alias("categories")))


@query("remove_category_unknown", "SELECT image_id, coalesce(n, 0) AS n FROM fx_images LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_annotations GROUP BY 1) USING (image_id)")
def remove_unknown(t):
    """A class that isn't there: images without annotations stay, and numbers are as they were."""
    same = _without(t, "no such class")
    n = same.annotations.filter("new_id = id").groupBy("image_id").agg(F.count("*").alias("n"))
    return same.images.select("image_id").join(n, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))


_SPAN = "SELECT video_id, min(image_id) AS least, max(image_id) AS most FROM fx_images GROUP BY 1"


@query("sample_frames",
    f"SELECT video_id, k, least + 20 + floor({_draw("concat('11:', video_id, ':', k)")} * greatest(most - least - 40, 1))::bigint AS frame "
    f"FROM ({_SPAN}), range(1, 6) r(k)")
def sample_frames(t):
    """Five frames of each video, drawn with replacement from its own range, which leaves room for triplets."""
    span = t.images.groupBy("video_id").agg(F.min("image_id").alias("least"), F.max("image_id").alias("most"))
    return D.sample_frames(span, 5, 11, spacing=20).withColumn("k", F.col("k").cast("long"))


@query("frame_triplets",
    "SELECT f.image_id, f.video_id, a.image_id AS after_id, b.image_id AS before_id FROM fx_images f LEFT JOIN fx_images a ON a.video_id "
    "= f.video_id AND a.image_id = f.image_id + 20 LEFT JOIN fx_images b ON b.video_id = f.video_id AND b.image_id = f.image_id - 20")
def triplets(t):
    return D.frame_triplets(t.images, 20)


@query("gt_image_paths", "SELECT concat('frames/survey_', video_id, '/', file_name) AS path FROM fx_images WHERE image_id % 3 = 0")
def gt_paths(t):
    return t.images.filter(F.col("image_id") % 3 == 0).select(F.concat(F.lit("frames/survey_"), F.col("video_id").cast("string"), F.lit("/"), F.col("file_name")).alias("path"))


@query("semantic_id_map",
    "SELECT id, CASE WHEN c = 0 THEN 255 WHEN c IN (5, 6) THEN c - 4 ELSE 0 END AS semantic FROM (SELECT id, CASE WHEN id % 10 = 0 THEN "
    "0 ELSE category_id END AS c FROM fx_annotations)")
def semantic(t):
    """Of segments, some of which are of no category."""
    ids = D.semantic_ids(t.categories.select("category_id", F.when(F.col("category_id").isin(5, 6), 0).otherwise(1).alias("isthing")))
    segments = t.annotations.select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("category_id")).alias("category_id"))
    return segments.join(F.broadcast(ids), "category_id", "left").select("id", "semantic")


_SEEN = "(SELECT count(*) FROM range(0, 17) r(i) WHERE (i + id) % 7 = 0)"


@query("valid_images_keypoints",
    f"SELECT image_id FROM (SELECT image_id, w, h, {_SEEN} AS seen FROM fx_annotations) GROUP BY 1 HAVING sum(seen) >= 10 AND NOT bool_and(w "
    "<= 1 OR h <= 1)")
def valid_keypoints(t):
    """Key points of which every seventh is visible: images of few boxes have fewer than ten."""
    points = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(F.when((i + F.col("id")) % 7 == 0, 2).otherwise(0).alias("v")))
    return D.valid_images(t.images, t.annotations.withColumn("keypoints", points)).select("image_id")


@query("max_keypoints",
    "SELECT k, concat('line_', k) AS keypoint, k - 1 AS bone_from, k AS bone_to FROM (SELECT max(1 + id % 9) AS n FROM fx_annotations), "
    "range(1, 100) r(k) WHERE k <= n")
def max_keypoints(t):
    """The names and bones of a category's key points, one to a row."""
    points = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("id") % 9), lambda i: i)
    most = t.annotations.agg(F.max(F.size(points)).cast("long").alias("n")).select(*L.keypoint_arrays(F.col("n")))
    rows = most.select(F.posexplode("keypoints").alias("k", "keypoint"), "skeleton").withColumn("bone", F.get("skeleton", F.col("k")))
    return rows.select((F.col("k") + 1).cast("long").alias("k"), "keypoint", F.col("bone")[0].alias("bone_from"), F.col("bone")[1].alias("bone_to"))


@query("distinct_images_first", "SELECT image_id, min(id) AS id FROM fx_annotations GROUP BY 1")
def distinct_first(t):
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("id"))
    return t.annotations.withColumn("rn", first).filter("rn = 1").select("image_id", "id")
