"""Parameters of an evaluation."""

import pytest

from fieldlens.operators import evaluation as V


@pytest.mark.parametrize("wrong", [
    {"iou": ()}, {"iou": (0.5, 0.5)}, {"iou": (1.5,)}, {"areas": ()}, {"areas": (("a", 2.0, 1.0),)}, {"areas": (("a", 0.0, 1.0), ("a", 0.0, 2.0))}, {"most_dets": 0}, {"recall_steps": 0},
])
def test_values_without_sense(wrong):
    with pytest.raises(ValueError):
        V.EvalParams(**wrong)


def test_unknown_name():
    with pytest.raises(TypeError):
        V.EvalParams(iouThr=(0.5,))


def test_chosen_images_and_classes(spark):
    gts = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10, 0), (2, 1, 2, 50, 0, 10, 10, 0), (3, 2, 1, 0, 0, 10, 10, 0)], "id long, image_id long, category_id long, x long, y long, w long, h long, iscrowd int")
    dets = spark.createDataFrame([(10, 1, 2, 0, 0, 10, 10, 0.9), (20, 1, 2, 50, 0, 10, 10, 0.8), (30, 2, 3, 0, 0, 10, 10, 0.7)], "det_id long, image_id long, category_id long, x long, y long, w long, h long, score double")

    def best(images=None, **kw):
        got = V.evaluate(dets, gts, V.EvalParams(iou=(0.5,), **kw), images)
        return {(r.category_id, round(r.rec_thr, 2)): round(r.precision, 4) for r in got.collect() if round(r.rec_thr, 2) in (0.3, 1.0)}

    assert best() == {(1, 0.3): 0, (1, 1.0): 0, (2, 0.3): 0.5, (2, 1.0): 0.5}
    assert best(use_classes=False) == {(-1, 0.3): 1, (-1, 1.0): 1}
    assert best(classes=(1, 2), use_classes=False) == {(-1, 0.3): 1, (-1, 1.0): 0}  # the detection of class 3 is gone
    assert best(classes=(2,)) == {(2, 0.3): 0.5, (2, 1.0): 0.5}
    assert best(spark.createDataFrame([(2,), (2,)], "image_id long")) == {(1, 0.3): 0, (1, 1.0): 0}
    assert best(classes=()) == {}
