"""Connected components of a graph in a DataFrame of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stored


def _star(pairs: DataFrame) -> DataFrame:
    """Adds m, the smallest node among u and its partners v. The minimum is combined before the shuffle, and the join
    back is an ordinary one, whose large keys Spark may split."""
    low = pairs.groupBy("u").agg(F.min("v").alias("w"))
    return pairs.join(low, "u").select("u", "v", F.least("u", "w").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (u, v): root is the smallest node that can be reached.

    Rows are written to the shared folder after each round; the rounds end when the edges form stars, after about the
    logarithm of the longest path. No edges give no rows; loops and repeated edges change nothing.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        now = stored(
            small.select("v", "m").union(small.select("u", "m")).where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        last, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
