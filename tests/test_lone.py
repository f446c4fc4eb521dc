"""Detections that are matched as arrays."""

import numpy as np
import pyarrow as pa

from fieldlens.operators import evaluation as V

AREAS = (("all", 0.0, 1e10), ("small", 0.0, 500.0), ("large", 500.0, 1e10))


def test_lone_rows():
    # of image 2: 5 is taken by one, 6 by two, none by one, 7 and 8 by one together
    rows = [(1, 1, 1, 4), (2, 1, 1, 5), (2, 1, 2, 6), (2, 1, 3, 6), (2, 1, 4, None), (2, 1, 5, 7), (2, 1, 5, 8), (2, 2, 1, 6), (3, 1, 1, None), (3, 1, 2, 9)]
    b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["image_id", "category_id", "rk", "gid"])
    assert V.lone(b).tolist() == [False, True, False, False, True, False, False, True, True, False]
    assert V.lone(b[:0]).tolist() == []


def test_lone_detections_match_as_the_loop_does(spark):
    rng = np.random.default_rng(5)

    def boxes(n):
        return [(i, int(rng.integers(150)), int(rng.integers(2)), *map(int, rng.integers(0, 40, 2)), *map(int, rng.integers(10, 40, 2))) for i in range(n)]

    gts = spark.createDataFrame([(*b, int(rng.random() < 0.2)) for b in boxes(900)], "id long, image_id long, category_id long, x long, y long, w long, h long, iscrowd int")
    dets = spark.createDataFrame([(*b, float(rng.integers(50))) for b in boxes(900)], "det_id long, image_id long, category_id long, x long, y long, w long, h long, score double")
    params = V.EvalParams(iou=(0.1, 0.3, 0.5), areas=AREAS)
    got = lambda: sorted(map(tuple, V.match_bits(dets, gts, params).collect()))
    found = got()
    assert len(found) == 900
    assert sum(bool(r[7]) for r in found) > 100
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # then rows with truths all go through the loop
    try:
        assert got() == found
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
