"""Connected components by alternating star contractions, one shuffle-only round after the other.

Edge cases: edges with a null end, and loops, are left out; repeated edges count once; without edges the result is empty; other columns of
the edges are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import delete, noted, written


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least of u and all its v. The minima combine before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _with_least(down)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; edges: columns u and v, of one type. The root is the component's least node.

    Each half of a round is written to the shared folder, so the driver never has more than a few joins to plan. It ends when no
    root is itself below another node, after a number of rounds that grows with the logarithm of the longest path.
    """
    spark, old, new = edges.sparkSession, [], []
    with noted(new):
        stars = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ends = stars.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).union(stars.select("v", F.lit(0), F.lit(1)))
        met = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not met.where("below > 1 or below = 1 and above = 1").count():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        old, new = new, []
        with noted(old):
            half = written(_large_star(stars), "half")
        with noted(new):
            stars = written(_small_star(half), "stars")
        delete(spark, old)  # the round before; what is left is read until the caller has its result
