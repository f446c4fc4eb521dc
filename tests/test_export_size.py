"""Exports are written small."""

import os

from pyspark.sql import functions as F

from fieldlens.plans import exports as E
from fieldlens.sources.fixtures import Tables


def test_export_is_written_compressed(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    files = [f.removeprefix("file://") for f in E.export(t).inputFiles()]
    text = spark.read.text(files).agg(F.sum(F.length("value"))).first()[0]
    assert sum(map(os.path.getsize, files)) * 4 < text
