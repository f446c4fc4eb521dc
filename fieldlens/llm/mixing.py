"""Mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .textkit import WORD, carried

RESULTS = ("size", "source_size", "target", "copies", "taken")


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key, on a null key's text, and on the seed alone."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources in order of code points, null last, get the weights in turn. With all sources at the level L, a target is
    min(most * source_size, L * weight), and L is such that the targets add up to all sizes: sources are ordered by the
    level at which they fill up, and L is found from the running sums before the first that doesn't.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumns({"cap": F.col("source_size") * most, "fills": F.col("source_size") * most / F.col("weight")})
    fill = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    placed = capped.withColumns({"level": level, "place": F.row_number().over(fill)})
    first = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("place", "level"))).over(everywhere)
    found = placed.withColumn("level", first["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def many_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """targets for so many sources that they are too much for one task: the same levels, without a window over all sources.

    Ranks come from ranges of the source, numbered within each. The level rises from what it were if no target were capped:
    sources that fill up at the level so far leave the rest to the others, until no more of them fill up. Each time is a sum
    over the sources' table; levels only rise, and a few times are enough.
    """
    nulls_last = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sizes.repartitionByRange(*nulls_last).sortWithinPartitions(*nulls_last).withColumn("at", F.monotonically_increasing_id()), "mix-ranked")
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("part", before.alias("before")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = ranged.withColumn("part", part).join(offsets, "part").withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    capped = cut(ranked.select("source", "source_size", "weight", (F.col("source_size") * most).alias("cap")), "mix-capped")
    total, level = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0
    while True:
        open_ = F.col("cap") > level * F.col("weight")
        rest = capped.agg(F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(~open_, F.col("cap"))), F.lit(0.0)).alias("cap")).first()
        if not rest.weight or (total - rest.cap) / rest.weight <= level:
            return capped.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))
        level = (total - rest.cap) / rest.weight


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    most: int = 3, seed: int = 42, broadcast_sources: int = 100_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., size, source_size, target, copies, taken) for each row; copies times the row makes the mix.

    size is the number of words; null and empty texts have none and take none. A document gets floor(rate) copies, where rate
    is its source's target by its size, and one more if its draw is below the fraction; the draw hangs on the id, or on the text
    of a row without one, so reruns agree and repeated rows go the same way. Null is a source of its own. Sizes are summed within the tasks before they are
    shuffled, so a source with most rows sends each task's sum only. The sources' table is ordered in one task and broadcast up
    to so many sources; beyond that it stays dealt out (many_targets), and the join is a shuffled one. No rows give no rows. Columns not named are ignored, whatever their names; a kept
    column named like a result column gets ``_in`` behind its name.
    """
    columns = carried([id_col, *keep], RESULTS)
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, (c, _) in enumerate(columns))).alias("row")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    base = df.select(row, F.col(source_col).alias("source"), size.alias("size"), draw(F.col(id_col), F.col(text_col), seed).alias("draw"))
    sums = cut(base.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = sums.count() <= broadcast_sources
    found = targets(sums, weights=weights, most=most) if few else many_targets(sums, weights=weights, most=most)
    plan = cut(found.select(F.struct("source").alias("key"), "source_size", "target"), "mix-targets")
    plan = F.broadcast(plan) if few else plan
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("key.source")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = joined.withColumn("rate", rate).withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(F.col(f"row.c{i}").alias(n) for i, (_, n) in enumerate(columns)), *RESULTS)
