"""A document pipeline in five stages; each is written and read again before the next.

Quality first (rejected documents go), then one of each exact text, one of each near-duplicate class, what is not
contaminated by the benchmark, and last the mix. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import contamination, exact, mixing, quality, simhash
from fieldlens.llm.queries import QUALITY_METADATA, quality_model
from fieldlens.llm.storage import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it is fitted on labelled rows of the whole documents table.

    Null and empty texts are scored like others, repeated rows get the same score, and no rows give no rows.
    """
    machine = quality_model(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return quality.score(docs, machine, metadata=QUALITY_METADATA, threshold=0.7, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each text; one of repeated rows. Null is an empty text, and null ids come last."""
    found = exact.exact_duplicates(docs, keep=COLUMNS)
    return found.filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, that with the least id. Blank and empty texts are one class.

    Rows are told apart by a number that is written with them, so repeated ids and rows without one are no matter.
    """
    numbered = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "near-rows")
    first = cut(simhash.near_duplicates(numbered, keep=("__row",)).filter("kept").select("__row"), "near-first")
    return numbered.join(first.hint("merge"), "__row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts are clean; repeated rows all stay or go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contamination(docs, bench, keep=COLUMNS).filter("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its copies in the mix and the words they take; documents that the mix takes no copy of stay out.

    Texts without words take nothing but may have copies; repeated rows go the same way.
    """
    return mixing.mix_sources(docs, keep=COLUMNS).filter("copies > 0").select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality_classifier", quality_filter), ("exact_dedup", exact_dedup), ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate), ("mixing_sources", mix),
]

#: The classifier's and the fingerprints' results have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return cut(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
