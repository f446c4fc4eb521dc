"""COCO documents: any layout and split gives the same objects, and what is written comes back."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from fieldlens.sources import coco as C

SEGMENTS = [[[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]], [1.5, 2, 3, 4], {"counts": "ab}", "size": [4, 5]}]
DOCUMENT = {
    "info": {"description": 'a "x} {[" \\ z', "year": 2024, "extra": {"deep": [{"a": 1}]}}, "version": "top } level \\\" {", "licenses": [{"id": 1, "name": "N/A", "url": "N/A"}],
    "images": [{"id": k, "file_name": f'f}}{k}"[{{.JPG', "width": 640, "height": 480, "license": 1, "date_captured": "2024", "coco_url": "u"} for k in range(300)],
    "nothing": [], "numbers": [1, 2, 3], "lists": [[1, {"a": "}"}]],
    "annotations": [
        {
            "id": k, "image_id": k % 300, "category_id": str(k % 3) if k % 2 else k % 3, "bbox": [1, 2.5, "3", 4], "area": 12.0, "iscrowd": k % 2, "segmentation": SEGMENTS[k % 3],
            "keypoints": ["1", "2", "2"], "num_keypoints": 1,
        } for k in range(1000)
    ],
    "categories": [{"id": 0, "name": "salmon", "supercategory": "fish", "keypoints": ["a", "b"], "skeleton": [[0, 1], [1, 2]]}, {"id": 1, "name": "né", "supercategory": "x"}],
}


@pytest.fixture()
def splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1b"))
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent, size", [(None, "128m"), (None, "3001b"), (4, "5003b"), (None, "1499b")])
def test_objects_whatever_the_ranges(spark, splits, tmp_path, indent, size):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps({"images": [{"id": -1}], "info": {}}))
    splits(size)
    got = sorted((r.name, json.dumps(json.loads(r.value), sort_keys=True)) for r in C.document_objects(spark, str(tmp_path)).collect())
    want = [("info", DOCUMENT["info"]), ("info", {}), ("images", {"id": -1})] + [(n, x) for n in ("licenses", "images", "annotations", "categories") for x in DOCUMENT[n]]
    assert got == sorted((n, json.dumps(x, sort_keys=True)) for n, x in want)


@pytest.mark.parametrize("documents", [1, 3])
def test_round_trip(spark, splits, tmp_path, documents):
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT))
    splits("20000b")
    first = C.read_coco(spark, str(tmp_path / "a.json"))
    C.write_coco(first, str(tmp_path / "out"), documents)
    written = [json.loads((tmp_path / "out" / f).read_text()) for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    assert len(written) == documents and sum(len(d["annotations"]) for d in written) == 1000
    rows = lambda df: {r[0] for r in df.drop("src").selectExpr("to_json(struct(*))").collect()}
    for a, b in zip(first, C.read_coco(spark, str(tmp_path / "out")), strict=True):
        assert rows(a) == rows(b)
    C.write_coco_lines(first, str(tmp_path / "lines"))
    lines = C.read_coco_lines(spark, str(tmp_path / "lines"), info=C.INFO, license_=C.LICENSE)
    for a, b in zip(first, lines, strict=True):
        assert rows(a) == rows(b)
    boxes = {r.id: r for r in first.annotations.select("*", C.rings(first.annotations.segmentation).alias("rings")).collect()}
    assert [boxes[k].rings for k in range(3)] == [[[1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12]], [[1.5, 2, 3, 4]], None]
    assert (boxes[1].category_id, boxes[1].w, boxes[1].keypoints) == (1, 3.0, [1.0, 2.0, 2.0])


@pytest.mark.parametrize("documents, tables", [(1, "both"), (3, "both"), (1, "images"), (1, "annotations")])
def test_documents_in_files(spark, splits, tmp_path, documents, tables):
    """Beyond rows_a_file a document is written by several tasks, one file after another, and comes back."""
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT))
    splits("20000b")
    first = C.read_coco(spark, str(tmp_path / "a.json"))
    first = first._replace(**{n: getattr(first, n).limit(0) for n in ("images", "annotations") if tables not in ("both", n)})
    C.write_coco(first, str(tmp_path / "out"), documents, rows_a_file=70)
    folders = [f for f in os.listdir(tmp_path / "out") if "=" in f]
    files = [sorted(f for f in os.listdir(tmp_path / "out" / d) if f.startswith("part-")) for d in folders]
    written = [json.loads("".join((tmp_path / "out" / d / f).read_text() for f in own)) for d, own in zip(folders, files, strict=True)]
    assert len(written) == documents and all(len(f) > 2 for f in files)
    assert sum(len(d["annotations"]) for d in written) == (1000 if tables != "images" else 0) and all([a["image_id"] for a in d["annotations"]] == sorted(a["image_id"] for a in d["annotations"]) for d in written)
    rows = lambda df: {r[0] for r in df.drop("src").selectExpr("to_json(struct(*))").collect()}
    for size in ("128m", "997b"):
        splits(size)
        got = C.read_coco(spark, str(tmp_path / "out"))
        assert got.info.select("src").distinct().count() == documents
        for a, b in zip(first, got, strict=True):
            assert rows(a) == rows(b)


def test_rows_are_parsed_once(spark, tmp_path):
    """A join on fields of a document's rows doesn't parse them again."""
    (tmp_path / "annotations").mkdir()
    (tmp_path / "annotations" / "a.json").write_text('{"id": 1, "image_id": 2, "category_id": "3"}\n{"id": 2}\nnone\n')
    for n in ("images", "categories"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "a.json").write_text('{"id": 2}\n')
    got = C.read_coco_lines(spark, str(tmp_path)).annotations
    joined = got.join(spark.createDataFrame([(2, 3)], "image_id long, category_id long"), ["image_id", "category_id"]).select("id", "image_id")
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [tuple(r) for r in joined.collect()] == [(1, 2)] and sorted(r.id or 0 for r in got.collect()) == [0, 1, 2]


def test_empty_tables(spark, tmp_path):
    none = {n: spark.createDataFrame([], s) for n, s in (("images", "id long"), ("annotations", "id long, image_id long"), ("categories", "id long, name string"))}
    C.write_coco(C.Coco(**none), str(tmp_path / "out"))
    got = C.read_coco(spark, str(tmp_path / "out"))
    assert got.images.count() == got.annotations.count() == got.categories.count() == got.info.count() == 0


def test_written_once_and_small(spark, tmp_path):
    """Compressed documents in files come back, one image's many annotations go over files too, and rows are written once as
    text and once as what was read."""
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENT))
    first = C.read_coco(spark, str(tmp_path / "a.json"))
    many = first.annotations.withColumn("image_id", F.when(F.col("id") < 700, F.lit(5)).otherwise(F.col("image_id")))
    first = first._replace(annotations=many.select(*first.annotations.columns))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    C.write_coco(first, str(tmp_path / "out"), 2, rows_a_file=100, compression="gzip")
    assert not {f for f in set(os.listdir(shared)) - before if f.startswith("coco-")}
    folders = sorted(f for f in os.listdir(tmp_path / "out") if "=" in f)
    assert len(folders) == 2
    found = []
    for d in folders:
        files = sorted(f for f in os.listdir(tmp_path / "out" / d) if f.startswith("part-"))
        texts = [gzip.decompress((tmp_path / "out" / d / f).read_bytes()).decode() for f in files]
        assert max(t.count('"iscrowd"') for t in texts) < 200
        found += json.loads("".join(texts))["annotations"]
    assert sorted(a["id"] for a in found) == list(range(1000)) and sum(a["image_id"] == 5 for a in found) >= 700
    got = C.read_coco(spark, str(tmp_path / "out"))
    rows = lambda df: {r[0] for r in df.drop("src").selectExpr("to_json(struct(*))").collect()}
    for a, b in zip(first, got, strict=True):
        assert rows(a) == rows(b)
    new = [f for f in set(os.listdir(shared)) - before if f.startswith("coco-") and "parquet" in "".join(os.listdir(f"{shared}/{f}"))]
    whole = [f for f in new if spark.read.parquet(f"{shared}/{f}").count() >= 1000]
    assert len(whole) == 1 and whole[0].startswith("coco-pieces"), whole


def test_fields_of_other_types(spark):
    """Fields that aren't written as their types are cast, and those of the other fields in the same row are as they were."""
    values = [
        '{"id": "7", "file_name": 12, "width": 3.9, "height": true, "license": null}', '{"id": 8, "file_name": "a", "width": 3000000000, "height": 5}',
        '{"id": 9, "file_name": 1.50, "width": 4, "height": 5, "coco_url": {"a": 1}}', '{"id": 10, "width": "x"}', '{"id": [1], "height": 2}',
        "{'id': 11}", '{"id": 12, "width": NaN}',
    ]
    rows = C._fields(spark.createDataFrame([("s", v) for v in values], "src string, value string"), C.IMAGE)
    got = [(r.id, r.file_name, r.width, r.height, r.coco_url) for r in rows.collect()]
    assert got == [(7, "12", 3, 1, None), (8, "a", None, 5, None), (9, "1.5", 4, 5, '{"a":1}'), (10, None, None, None, None), (None, None, None, 2, None), *[(None,) * 5] * 2]
