"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def _with_least(nodes: DataFrame, name: str) -> DataFrame:
    """(u, v, m): each pair with the least node m among u and its partners. Both sides are plain exchanges, so that a
    hub's rows can be split."""
    least = cut(nodes.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    return nodes.join(least.hint("merge"), "u")


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component of every node that an edge (a, b) names.

    Loops and repeated edges are allowed; no edges give no rows. Each round is cut off in the shared folder, and the rounds
    end when one changes nothing. Stars shrink by the square of their depth, so a path of n nodes takes about log n rounds.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "cc-large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "cc-stars")
        pairs = _with_least(large, "cc-small")
        hung = pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(hung.unionByName(pairs.select("u", F.col("m").alias("v"))).distinct(), "cc")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
