"""Metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(log: DataFrame, size: int = 20, *, bucket: int = 1 << 14, rows_a_task: int = 1_000_000) -> DataFrame:
    """(meter, step, mean, most, last, middle) over a meter's last size values; middle is the lower of the middle two.

    A meter of up to rows_a_task rows is gone through in one task. Where there are longer ones, meters are split into buckets
    of steps, each with the size - 1 values before it, which are looked for in the bucket before; where steps are so sparse
    that it holds fewer, the meter stays whole.
    """
    at = log.select("meter", "step", "value", F.floor(F.col("step") / bucket).alias("b"), F.lit(False).alias("guest"))
    longest = log.groupBy("meter").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= rows_a_task:
        every = at.withColumn("b", F.lit(0))
    else:
        counts = at.groupBy("meter", "b").agg(F.count("*").alias("n"))
        whole = (F.count_if(F.col("n") < size - 1) > 0) | (F.max("b") - F.min("b") + 1 > F.count("*"))
        placed = at.join(F.broadcast(counts.groupBy("meter").agg(whole.alias("whole"))), "meter")
        placed = placed.withColumn("b", F.when(F.col("whole"), F.lit(0)).otherwise(F.col("b")))
        back = Window.partitionBy("meter", "b").orderBy(F.desc("step"))
        tail = placed.filter("not whole").withColumn("k", F.row_number().over(back)).filter(F.col("k") < size)
        guests = tail.select("meter", "step", "value", (F.col("b") + 1).alias("b"), F.lit(True).alias("guest"))
        every = placed.select("meter", "step", "value", "b", "guest").unionByName(guests)
    w = Window.partitionBy("meter", "b").orderBy("step").rowsBetween(-(size - 1), 0)
    values = F.sort_array(F.collect_list("value").over(w))
    base = every.select("meter", "step", "guest", F.avg("value").over(w).alias("mean"), F.max("value").over(w).alias("most"), F.col("value").alias("last"), values.alias("v"))
    return base.filter("not guest").select("meter", "step", "mean", "most", "last", F.get("v", F.floor((F.size("v") - 1) / 2).cast("int")).alias("middle"))


def meters(log: DataFrame) -> DataFrame:
    return log.groupBy("meter").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))


def rank_means(log: DataFrame) -> DataFrame:
    """(meter, step, mean): the mean over the ranks at each step."""
    return log.groupBy("meter", "step").agg(F.avg("value").alias("mean"))


def block_means(log: DataFrame, size: int = 10) -> DataFrame:
    """(meter, epoch, block, step, loss) of a log (meter, epoch, batch, value): the mean of each full block of size batches.

    Batches count from 0 in each epoch; what is left at an epoch's end gives none. step is that of the block's last batch,
    all batches of the epochs before counted as many as this epoch has.
    """
    length = log.groupBy("meter", "epoch").agg((F.max("batch") + 1).alias("n"))
    blocks = log.groupBy("meter", "epoch", F.floor(F.col("batch") / size).alias("block")).agg(F.avg("value").alias("loss"), F.count("*").alias("k"), F.max("batch").alias("last"))
    full = blocks.filter(F.col("k") == size).join(length, ["meter", "epoch"])
    return full.select("meter", "epoch", "block", (F.col("epoch") * F.col("n") + F.col("last")).alias("step"), "loss")
