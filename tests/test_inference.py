"""Detection by a user's model."""

import pytest

from fieldlens.operators import inference as I


def _images(spark, rows):
    return spark.createDataFrame(rows, "image_id long, content binary, found string").coalesce(1)


@pytest.mark.parametrize("batch", [1, 2, 3, 100])
def test_batches_and_bad_images(spark, batch):
    """Any size of batch gives the same rows; a bad image costs no other, whatever is wrong with it."""
    rows = [(i, None if i == 4 else bytes([i]), "x") for i in range(12)] + [(3, bytes([3]), "x"), (None, bytes([2]), "x")]

    def decode(content):
        if content == b"\x05":
            raise OSError("cut short")
        return content[0]

    def make():
        def model(images):
            if 6 in images:
                raise RuntimeError("no memory")
            out = [{"boxes": [[k, k, k + 1, k + 2] for k in range(i % 3)], "labels": [i] * (i % 3), "scores": [0.25 * (k + 1) for k in range(i % 3)]} for i in images]
            return [f | {"labels": f["labels"] + [1]} if i == 7 else f for i, f in zip(images, out, strict=True)]

        return model

    got = I.predict(_images(spark, rows), make, decode=decode, batch=batch)
    assert got.columns == ["image_id", "found", "error"]
    kept = {r.image_id: (None if r.found is None else [tuple(f) for f in r.found], r.error) for r in got.collect()}
    assert got.count() == len(rows)
    boxes = {i: [(k, k, k + 1.0, k + 2.0, i, 0.25 * (k + 1)) for k in range(i % 3)] for i in range(12)}
    bad = {4: "no image", 5: "OSError: cut short", 6: "RuntimeError: no memory", 7: "ValueError: 1 boxes, 2 labels and 1 scores"}
    assert kept == {i: (None, bad[i]) if i in bad else (boxes[i], None) for i in range(12)} | {None: (boxes[2], None)}
    assert {(r.image_id, r.place) for r in I.detections(got, least_score=0.5).collect()} == {(8, 1), (2, 1), (11, 1), (None, 1)}
    assert {r.image_id: r.error for r in I.failed(got).collect()} == bad


def test_one_model_for_each_worker(spark):
    """Weights are loaded once, not for each batch or image; batches are no larger than asked."""

    def make():
        calls = []

        def model(images):
            calls.append(len(images))
            return [{"boxes": [[len(calls), len(images), 0, 0]], "labels": [0], "scores": [float("nan")]} for _ in images]

        return model

    got = I.predict(_images(spark, [(i, bytes([i]), "") for i in range(10)]), make, batch=4)
    assert [(b.x1, b.y1) for r in got.collect() for b in r.found] == [(1, 4)] * 4 + [(2, 4)] * 4 + [(3, 2)] * 2
    assert I.detections(got).count() == 0


def test_no_images_and_wrong_counts(spark):
    assert I.predict(_images(spark, []), lambda: lambda images: [], batch=4).count() == 0
    got = I.predict(_images(spark, [(1, b"a", "")]), lambda: lambda images: [], batch=4).collect()
    assert [r.error for r in got] == ["ValueError: 0 results for 1 images"]
