"""Each stage of the pipeline on empty tables, null ids and texts, repeats, and columns whose names stages use inside."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, size long, copies long, row long, locator string"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline as P

    return dict(P.STAGES), P.COLUMNS


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0.5, 1, True, 3, 4, 5, "x") for i, t, s in rows], SCHEMA)


EDGE = [(None, None, None), (None, "one two", "a"), (1, "", "a"), (2, "one two", None), (2, "one two", None), (3, "word " * 30_000, "a"), (4, " \t\n", "a")]


@pytest.mark.parametrize("name", ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixing_sources"])
def test_stage_on_edges(spark, stages, name):
    stage, columns = stages[0][name], stages[1]
    none = stage(spark, table(spark, []), SF)
    assert none.count() == 0 and none.columns[: len(columns)] == list(columns)
    got = stage(spark, table(spark, EDGE), SF)
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert set(found) <= {(i, t) for i, t, _ in EDGE} and got.columns[: len(columns)] == list(columns)
    if name == "exact_dedup":
        assert len(found) == 4 and {(i, t) for i, t in found if t and t.strip()} == {(2, "one two"), (3, "word " * 30_000)}
    if name == "benchmark_decontamination":
        assert sorted(found, key=str) == sorted(((i, t) for i, t, _ in EDGE), key=str)
    if name == "simhash_near_dedup":
        assert len({t.split()[0] if t and t.split() else "" for _, t in found}) == len(found)


def test_quality_stage_scores_copies_alike(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs).repartition(7)
    got = stages[0]["quality_classifier"](spark, twice, SF).groupBy("doc_id", "text").count()
    assert got.filter(F.col("count") % 2 == 1).count() == 0
