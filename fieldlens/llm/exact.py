"""Exact deduplication as a stateful stream: keyed state without expiry, on disk, with a check of full bytes on hits."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut, shared_dir
from .textkit import BLANKS, carried

#: Where Spark keeps a stream's state: an embedded database on the executors' disks, copied to the shared folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk is set aside for many small stores
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


class Store(NamedTuple):
    """A deduplication store in the shared folder: every row that was fed in, the stream's checkpoint, and its output."""

    top: str

    @property
    def feed(self) -> str:
        return f"{self.top}/feed"

    @property
    def checkpoint(self) -> str:
        return f"{self.top}/stream"

    @property
    def states(self) -> str:
        return f"{self.top}/states"

    def of_run(self, run: int) -> str:
        return f"{self.feed}/run-{run}"


def digest_state(stream: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_at, seen) by digest from a stream of (digest, id, locator).

    The state has no expiry: a digest is remembered for good, with the least id, its row's content locator and the number
    of rows so far. Rows are combined within each task first, so a text that makes up a third of a batch sends a row a task.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator"))
    return stream.groupBy("digest").agg(first.alias("first"), F.count("*").alias("seen")).select(
        "digest", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("keep_at"), "seen",
    )


def run_stream(spark: SparkSession, store: Store, schema, *, files_a_batch: int = 256, partitions: int | None = None) -> DataFrame:
    """The state of each digest that the rows (digest, id, locator) in the store's new files touch, after they have gone through.

    The stream goes on from its checkpoint, so digests of earlier runs are remembered; a batch that is broken off starts again.
    """
    wanted = STATE_STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before, batches = {k: spark.conf.get(k, None) for k in wanted}, []
    for k, v in wanted.items():
        spark.conf.set(k, v)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store.states}/batch={n}")
        batches.append(f"{store.states}/batch={n}")

    try:
        states = digest_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{store.feed}/run-*"))
        query = states.writeStream.outputMode("update").option("checkpointLocation", store.checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema(states.schema).parquet(*batches) if batches else spark.createDataFrame([], states.schema)
    # a digest's count only grows and its least id only falls, so the newest of its rows has the most seen
    return found.groupBy("digest").agg(F.max_by(F.struct("keep_id", "keep_at", "seen"), "seen").alias("s")).select("digest", "s.*")


def unequal_digests(content: DataFrame, hits: DataFrame, run: int, *, broadcast_hits: int = 500_000) -> DataFrame:
    """(digest) of the hits whose rows are not all the same text, byte for byte.

    content (digest, locator, text) is the store; compared are this run's rows of a hit and the row at the hit's locator. A
    digest's least and greatest text tell, so that each task sends two texts a digest at most, however many copies there
    are. Up to broadcast_hits the hits go to the content, and no text but theirs is shuffled; beyond, both are shuffled.
    """
    some = hits.select("digest", "keep_at")
    some = F.broadcast(some) if hits.count() <= broadcast_hits else some.hint("merge")
    met = content.join(some, "digest").filter((F.col("locator.run") == run) | (F.col("locator") == F.col("keep_at")))
    return met.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """(id, keep..., keep_id, group_size, kept, text_sha256) for each row.

    Texts are equal when they are after each run of blanks has become one space; null counts as empty, and very long texts
    are read whole. The row with the least id stays; of rows that repeat it, the one fed first does, and the others don't.
    Null ids come last. No rows give no rows. A kept column named like a result column gets ``_in`` behind its name.

    Rows go into a store in the shared folder, and their digests through a stream whose state holds each digest's least id
    and content locator: the run that fed the row, and its number in it. Where the state reports a hit, a digest with more
    rows than one, full texts are compared, with the one at the locator among them; texts that share a digest without
    being equal are then told apart by their whole texts, and the other digests keep their state.

    folder is a store to go on with (rows are then compared with those of earlier calls, group_size counts them too, and a
    new row with a smaller id takes over); by default there is a new one. Only the rows of df are returned.
    """
    spark, columns = df.sparkSession, carried([id_col, *keep], RESULTS)
    store, run = Store(folder or shared_dir(spark, "dedup")), time.time_ns()
    rest = [] if text_col in dict(columns) else [F.col(text_col).alias("content")]
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(columns)), *rest)
    at = F.struct(F.lit(run).alias("run"), F.monotonically_increasing_id().alias("row"))
    fed = df.select(row.alias("row"), F.unhex(F.sha2(normal(F.col(text_col)), 256)).alias("digest"), F.col(id_col).alias("id"), at.alias("locator"))
    fed.write.parquet(store.of_run(run))
    rows = spark.read.schema(fed.schema).parquet(store.of_run(run))
    state = cut(run_stream(spark, store, rows.select("digest", "id", "locator").schema), "dedup-state")

    raw = "row.content" if rest else f"row.c{[c for c, _ in columns].index(text_col)}"
    content = lambda r: spark.read.schema(fed.schema).parquet(store.of_run(r)).select("digest", "locator", "id", normal(F.col(raw)).alias("text"))
    hits = state.filter("seen > 1")
    older = [r.run for r in hits.filter(F.col("keep_at.run") != run).select("keep_at.run").distinct().collect()]  # one row for each earlier call
    every = content(run)
    for r in older:
        every = every.unionByName(content(r))
    wrong = cut(unequal_digests(every, hits, run), "dedup-wrong")

    own = [F.col(f"row.c{i}").alias(n) for i, (_, n) in enumerate(columns)]
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    met = rows.join(state.hint("merge"), "digest")
    results = [*own, "keep_id", F.col("seen").alias("group_size"), (F.col("locator") == F.col("keep_at")).alias("kept"), sha]
    if wrong.isEmpty():
        return met.select(*results)
    past = spark.read.schema(fed.schema).parquet(f"{store.feed}/run-*").select("digest", "locator", "id", normal(F.col(raw)).alias("text"))
    apart = _told_apart(rows.join(wrong, "digest", "left_semi").withColumn("text", normal(F.col(raw))), past.join(wrong, "digest", "left_semi"))
    return met.join(wrong, "digest", "left_anti").select(*results).unionByName(apart.select(*results))


def _told_apart(rows: DataFrame, past: DataFrame) -> DataFrame:
    """rows of digests that several texts share, with their state by whole text instead."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "locator")).alias("first")
    groups = past.groupBy("digest", "text").agg(first, F.count("*").alias("seen"))
    return rows.join(groups.select("digest", "text", F.col("first.id").alias("keep_id"), F.col("first.locator").alias("keep_at"), "seen"), ["digest", "text"])
